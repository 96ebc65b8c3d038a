"""Queries over elements that are derived from documents' lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import chunking as C
from docloom.operators import layout as L
from docloom.sources.derived import elements, table, with_tables
from docloom.sources.shared import cut


def _attempts(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.pmod("l_linenumber", F.lit(3)).alias("t"), "l_returnflag", "l_linestatus")
    a = line.groupBy("page", (F.col("t") + 1).cast("int").alias("tier")).agg(F.min("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"))
    return a.select((F.col("page") % 100).alias("doc_id"), "page", "tier", (F.col("rf") == "N").alias("ok"), (F.col("ls") == "O").alias("retryable"))


def b2_attempt(spark, sf):
    return L.choose_attempt(_attempts(spark, sf)).select("doc_id", "page", "tier")


def b2_failed_pages(spark, sf):
    return L.failed_pages(_attempts(spark, sf))


def _raw_pages(spark, sf):
    """Documents as raw page payloads; list and block names, and box forms, alternate. Every fifth has blocks without usable boxes, every third outer keys."""
    e = elements(spark, sf)
    even = F.col("doc_id") % 2 == 0
    box = F.when(even, F.to_json(F.array("x0", "y0", "x1", "y1"))).otherwise(F.to_json(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))))
    label = F.when(F.col("kind") == "table", "Table-Region").when(F.col("kind") == "heading", "paragraph title").otherwise("plain text")
    block = F.concat(F.lit('{"'), F.when(even, "block_label").otherwise("type"), F.lit('":"'), label, F.lit('","'), F.when(even, "block_bbox").otherwise("bbox"), F.lit('":'), box, F.lit(',"score":'), (F.col("pos") % 15 / 10).cast("string"), F.lit(',"extra":"x'), F.col("pos"), F.lit('"}'))
    pages = e.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), ",").alias("b"))
    lost = F.when(F.col("doc_id") % 5 == 0, ',7,{"label":"lost","bbox":[1,2]},{"label":"lost","box":{"x0":1,"y0":"?","x1":3,"y1":4}},{"label":"lost"}').otherwise("")
    inner = F.concat(F.lit('{"'), F.when(F.col("doc_id") % 2 == 0, "parsing_res_list").otherwise("elements"), F.lit('":['), "b", lost, F.when(F.col("doc_id") % 6 == 0, '],"markdown":"own"}').otherwise("]}"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"data":{"result":{"pages":[{"page":999},{"page":'), "page", F.lit(',"markdown":"outer","input_path":"p'), "page", F.lit('","prunedResult":'), inner, F.lit("}]}}}"))).otherwise(inner)
    raw = F.when(F.col("doc_id") % 31 == 30, "[1]").otherwise(raw)
    return pages.select("doc_id", "page", F.lit(1000).alias("width"), F.lit(1000).alias("height"), raw.alias("raw"))


def _blocks(spark, sf):
    return L.explode_blocks(L.unwrap_page(_raw_pages(spark, sf)))


def b1_unwrap(spark, sf):
    """Keys of each page's payload, and what comes from its outer part."""
    p = L.unwrap_page(_raw_pages(spark, sf))
    text = lambda k: F.try_variant_get(F.col("payload")[k], "$", "string").alias(k)
    return p.select("doc_id", "page", F.array_join(F.sort_array(F.map_keys("payload")), ",").alias("keys"), text("markdown"), text("input_path"), "code")


def b3_blocks(spark, sf):
    return _blocks(spark, sf).select("doc_id", "page", "ord", "label", *(F.round(F.col("box")[i], 6).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def b4_kind(spark, sf):
    return _blocks(spark, sf).groupBy(L.kind_of(F.col("label")).alias("kind")).agg(F.count("*").alias("blocks"))


def b5_bbox(spark, sf):
    """Boxes of lines, scaled and normalised; every third line's box is shrunk to fractions first."""
    e = elements(spark, sf)
    part = F.col("pos") % 3 == 0
    c = F.array(*(F.when(part, F.col(x) / 1000).otherwise(F.col(x)) for x in ("x1", "y0", "x0", "y1")))
    w, h = F.lit(800), F.lit(900)
    box = e.select("element_id", L.scaled_box(c, w, h).alias("b"))
    return box.select("element_id", L.normalised(F.col("b"), w, h).alias("n")).select("element_id", "n.*")


def b6_polygon(spark, sf):
    """Polygons given as flat lists (with a number too many), lists of pairs, points with x and y, fractions, or not at all."""
    e = elements(spark, sf)
    w, h = F.lit(800), F.lit(900)
    raw = F.when(F.col("pos") % 5 == 0, F.to_json(F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0"))).when(F.col("pos") % 5 == 1, F.concat(F.lit("["), F.to_json(F.array("x0", "y0")), F.lit(',"no",'), F.to_json(F.array("x1", "y1")), F.lit(",[5]]")))
    raw = raw.when(F.col("pos") % 5 == 2, F.concat(F.lit("["), F.to_json(F.struct(F.col("x1").alias("x"), F.col("y0").alias("y"))), F.lit(',{"x":1}]'))).when(F.col("pos") % 5 == 3, F.lit("[0.5,0.25,1,1]"))
    p = e.select("element_id", L.polygon(F.try_parse_json(raw), F.struct("x0", "y0", "x1", "y1"), w, h).alias("p"))
    total = lambda c: F.round(F.aggregate(F.col("p")[c], F.lit(0.0), lambda s, q: s + q["x"] + q["y"]), 6)
    return p.select("element_id", F.size("p.points").cast("long").alias("points"), total("points").alias("total"), total("normalised").alias("normalised"))


def b7_confidence(spark, sf):
    return _blocks(spark, sf).select("doc_id", "page", "ord", F.round("confidence", 6).alias("confidence"))


def b8_order(spark, sf):
    e = elements(spark, sf).withColumn("ord", F.pmod(F.col("pos") * 7, F.lit(10)))
    return L.reading_order(e).select("element_id", "seq")


def b9_ids(spark, sf):
    return elements(spark, sf).select("doc_id", "pos", "element_id")


def b10_unknown_fields(spark, sf):
    return _blocks(spark, sf).select("doc_id", "page", "ord", F.explode(L.unknown_fields(F.col("raw"))).alias("field", "value"))


def b11_assets(spark, sf):
    return L.assets(elements(spark, sf))


def b12_counts(spark, sf):
    e = cut(_ready(spark, sf))
    return L.counters(e, C.chunks(e, 300))


def b13_kinds(spark, sf):
    return L.kinds_per_page(elements(spark, sf))


def b14_regions(spark, sf):
    """Where each element stands, as if all were cited; every seventh document's citations are of a version that is gone."""
    e = elements(spark, sf).withColumn("version", (F.col("doc_id") % 3 + 1).cast("int"))
    cited = e.select("doc_id", (F.col("version") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("version"), "element_id")
    pages = e.select("doc_id", "version", "page", F.concat_ws("/", F.lit("pages"), "doc_id", "version", "page").alias("page_key")).distinct()
    return L.citation_regions(cited, e, pages, L.assets(e)).select("doc_id", "version", "element_id", "page", "box.*", "page_key", "object_key")


def _ready(spark, sf):
    e = elements(spark, sf).withColumn("seq", F.col("pos").cast("int"))
    e = e.withColumns({"nx0": F.col("x0") / 1000, "ny0": F.col("y0") / 1000, "nx1": F.col("x1") / 1000, "ny1": F.col("y1") / 1000, "asset_id": F.when(F.col("kind").isin(*L.MULTIMODAL), F.concat(F.lit("as-"), "element_id"))})
    return e.withColumn("md", C.element_markdown())


def c1_markdown(spark, sf):
    return _ready(spark, sf).select("element_id", F.md5("md").alias("md5"))


def c2_document_markdown(spark, sf):
    return C.document_markdown(_ready(spark, sf)).select("doc_id", F.md5("markdown").alias("md5"), F.length("markdown").cast("long").alias("n"))


def c3_chunks(spark, sf):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return C.chunks(_ready(spark, sf)).select("chunk_id", "doc_id", "ordinal", "page_start", "page_end", joined("element_ids"), joined("asset_ids"), F.length("markdown").alias("size"), F.md5("markdown").alias("md5"), "heading")


def c4_heading_path(spark, sf):
    return C.heading_path(_ready(spark, sf)).select("element_id", "heading")


def c5_ranges(spark, sf):
    """Size and page range of each run of lines under one heading."""
    h = elements(spark, sf).withColumn("part", F.sum((F.col("kind") == "heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("doc_id", "part").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(F.length("content")).alias("size"))


def c6_batches(spark, sf):
    """Batches of chunks of 300 characters, with what of their texts goes to extraction."""
    e = cut(_ready(spark, sf))
    b = C.extraction_batches(C.chunks(e, 300), e)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x["text"]), "|"))
    return b.select("doc_id", "batch", F.size("chunks").alias("chunks"), F.size("elements").alias("elements"), text("chunks").alias("chunk_md5"), text("elements").alias("element_md5"), F.array_join(F.transform("elements", lambda x: x["element_id"]), ",").alias("element_ids"))


QUERIES = {f.__name__: f for f in (
    b1_unwrap, b2_attempt, b2_failed_pages, b3_blocks, b4_kind, b5_bbox, b6_polygon, b7_confidence, b8_order, b9_ids, b10_unknown_fields, b11_assets, b12_counts, b13_kinds, b14_regions,
    c1_markdown, c2_document_markdown, c3_chunks, c4_heading_path, c5_ranges, c6_batches,
)}

_ATT = """WITH a AS (SELECT l_orderkey AS page, l_orderkey % 100 AS doc_id, (l_linenumber % 3 + 1)::INTEGER AS tier, min(l_returnflag) = 'N' AS ok, max(l_linestatus) = 'O' AS re FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT doc_id, page, bool_or(ok) FILTER (tier = 1) AS ok1, bool_or(re) FILTER (tier = 1) AS re1, bool_or(ok) FILTER (tier = 2) AS ok2, bool_or(re) FILTER (tier = 2) AS re2 FROM a GROUP BY ALL),
c AS (SELECT doc_id, page, min(tier) AS tier FROM a JOIN f USING (doc_id, page) WHERE ok AND CASE tier WHEN 1 THEN true WHEN 2 THEN NOT ok1 AND re1 WHEN 3 THEN NOT ok1 AND (NOT re1 OR (NOT coalesce(ok2, true) AND coalesce(re2, false))) END GROUP BY ALL) """
_LABEL = "CASE kind WHEN 'table' THEN 'Table-Region' WHEN 'heading' THEN 'paragraph title' ELSE 'plain text' END"
_ORD = "(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos))::INTEGER"
_MD = r"""CASE kind WHEN 'heading' THEN '## ' || content WHEN 'table' THEN '<asset id="as-' || element_id || '" type="table" page="' || page || '" bbox="' || printf('%.6f,%.6f,%.6f,%.6f', x0 / 1000, y0 / 1000, x1 / 1000, y1 / 1000) || '">' || chr(10) || chr(10) || content ELSE content END"""
_e = lambda body: with_tables("el", body)


def _chunks(target: int, body: str) -> str:
    """Chunks as ch, packed by walking from element to element."""
    return _e(rf"""WITH md AS (SELECT *, {_MD} AS md, coalesce(lag(kind = 'table') OVER (PARTITION BY doc_id ORDER BY pos), false) OR kind = 'heading' AS o,
        last_value(CASE WHEN kind = 'heading' AND content <> '' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM el),
      pt AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM md), pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY pos) AS k FROM pt),
      w AS (SELECT doc_id, part, k, length(md) AS size, 0 AS piece FROM pl WHERE k = 1
        UNION ALL SELECT pl.doc_id, pl.part, pl.k, CASE WHEN size + length(md) + 2 > {target} THEN length(md) ELSE size + length(md) + CASE WHEN size > 0 THEN 2 ELSE 0 END END, piece + (size + length(md) + 2 > {target})::INTEGER FROM w JOIN pl ON pl.doc_id = w.doc_id AND pl.part = w.part AND pl.k = w.k + 1),
      g AS (SELECT doc_id, part, piece, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY pos) FILTER (md <> ''), '') AS markdown, min(page) AS page_start, max(page) AS page_end, list(element_id ORDER BY pos) AS element_ids, coalesce(list('as-' || element_id ORDER BY pos) FILTER (kind = 'table'), []) AS asset_ids, arg_min(coalesce(heading, chr(0)), pos) AS heading
        FROM w JOIN pl USING (doc_id, part, k) GROUP BY 1, 2, 3),
      n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY part, piece))::INTEGER AS ordinal FROM g WHERE markdown <> ''),
      ch AS (SELECT 'ch_' || substr(sha256(doc_id || chr(31) || ordinal || chr(31) || array_to_string(element_ids, ',') || chr(31) || markdown), 1, 24) AS chunk_id, doc_id, ordinal, markdown, page_start, page_end, element_ids, asset_ids, nullif(heading, chr(0)) AS heading FROM n) {body}""").replace("WITH el", "WITH RECURSIVE el", 1)


SQL = {
    "b1_unwrap": _e("""SELECT DISTINCT doc_id, page, CASE WHEN doc_id % 31 <> 30 THEN array_to_string(list_sort(list_concat([CASE WHEN doc_id % 2 = 0 THEN 'parsing_res_list' ELSE 'elements' END], CASE WHEN doc_id % 3 = 0 THEN ['markdown', 'input_path'] ELSE [] END)), ',') END AS keys,
      CASE WHEN doc_id % 31 = 30 THEN NULL WHEN doc_id % 6 = 0 THEN 'own' WHEN doc_id % 3 = 0 THEN 'outer' END AS markdown, CASE WHEN doc_id % 31 <> 30 AND doc_id % 3 = 0 THEN 'p' || page END AS input_path, CASE WHEN doc_id % 31 = 30 THEN 'ocr_invalid_response' END AS code FROM el"""),
    "b2_attempt": _ATT + "SELECT doc_id, page, tier FROM c",
    "b2_failed_pages": _ATT + "SELECT DISTINCT doc_id, page FROM a WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM c)",
    "b3_blocks": _e(f"SELECT doc_id, page, {_ORD} AS ord, {_LABEL} AS label, x0, y0, x1, y1 FROM el WHERE doc_id % 31 <> 30"),
    "b4_kind": _e("SELECT kind, count(*) AS blocks FROM el WHERE doc_id % 31 <> 30 GROUP BY 1"),
    "b5_bbox": _e("""WITH s AS (SELECT element_id, CASE WHEN pos % 3 = 0 AND greatest(x1, y0, x0, y1) <= 1000 THEN 0.8 ELSE 1 END AS fx, CASE WHEN pos % 3 = 0 AND greatest(x1, y0, x0, y1) <= 1000 THEN 0.9 ELSE 1 END AS fy,
      CASE WHEN pos % 3 = 0 THEN x0 ELSE x0 END AS x0, x1, y0, y1 FROM el)
      SELECT element_id, round(least(x0 * fx, 800) / 800, 6) AS x0, round(least(y0 * fy, 900) / 900, 6) AS y0, round(least(x1 * fx, 800) / 800, 6) AS x1, round(least(y1 * fy, 900) / 900, 6) AS y1 FROM s"""),
    "b6_polygon": _e("""WITH c AS (SELECT element_id, pos % 5 AS m, least(x0, 800) AS a, least(y0, 900) AS b, least(x1, 800) AS c, least(y1, 900) AS d FROM el),
      p AS (SELECT element_id, CASE m WHEN 0 THEN [a, c, c] WHEN 1 THEN [a, c] WHEN 2 THEN [c] WHEN 3 THEN [400, 800] ELSE [a, c, c, a] END AS xs, CASE m WHEN 0 THEN [b, b, d] WHEN 1 THEN [b, d] WHEN 2 THEN [b] WHEN 3 THEN [225, 900] ELSE [b, b, d, d] END AS ys FROM c)
      SELECT element_id, len(xs) AS points, round(list_sum(xs) + list_sum(ys), 6) AS total, round(list_sum(list_transform(xs, lambda x: round(x / 800, 6))) + list_sum(list_transform(ys, lambda y: round(y / 900, 6))), 6) AS normalised FROM p"""),
    "b7_confidence": _e(f"SELECT doc_id, page, {_ORD} AS ord, round(least(pos % 15 / 10.0::DOUBLE, 1), 6) AS confidence FROM el WHERE doc_id % 31 <> 30"),
    "b8_order": _e("SELECT element_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, pos * 7 % 10, y0, x0, element_id))::INTEGER AS seq FROM el"),
    "b9_ids": _e("SELECT doc_id, pos, element_id FROM el"),
    "b10_unknown_fields": _e(f"SELECT doc_id, page, {_ORD} AS ord, 'extra' AS field, 'x' || pos AS value FROM el WHERE doc_id % 31 <> 30"),
    "b11_assets": _e("WITH a AS (SELECT *, 'as_' || substr(sha256(element_id || chr(31) || kind), 1, 24) AS asset_id FROM el WHERE kind = 'table') SELECT asset_id, element_id, doc_id, page, kind, 'assets/' || doc_id || '/' || asset_id AS object_key, 'pages/' || doc_id || '/' || page AS page_key, [x0, y0, x1, y1] AS bbox, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] AS polygon, sha256(content) AS content_sha256 FROM a"),
    "b12_counts": _chunks(300, ", n2 AS (SELECT doc_id, count(*) AS chunks FROM ch GROUP BY 1), c2 AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS elements, count(*) FILTER (kind = 'table') AS assets FROM el GROUP BY 1) SELECT doc_id, pages, elements, assets, coalesce(chunks, 0) AS chunks FROM c2 LEFT JOIN n2 USING (doc_id)"),
    "b13_kinds": _e("SELECT doc_id, page, 0::BIGINT AS figure, 0::BIGINT AS formula, count(*) FILTER (kind = 'table') AS \"table\", count(*) FILTER (kind = 'heading') AS heading, count(*) FILTER (kind = 'text') AS text FROM el GROUP BY 1, 2"),
    "b14_regions": _e("SELECT doc_id, (doc_id % 3 + 1)::INTEGER AS version, element_id, page, x0, y0, x1, y1, 'pages/' || doc_id || '/' || doc_id % 3 + 1 || '/' || page AS page_key, CASE WHEN kind = 'table' THEN 'assets/' || doc_id || '/as_' || substr(sha256(element_id || chr(31) || kind), 1, 24) END AS object_key FROM el WHERE doc_id % 7 <> 0"),
    "c1_markdown": _e(f"SELECT element_id, md5({_MD}) AS md5 FROM el"),
    "c2_document_markdown": _e(f"""WITH p AS (SELECT doc_id, page, '<!-- page:' || page || ' -->' || chr(10) || chr(10) || string_agg({_MD}, chr(10) || chr(10) ORDER BY pos) AS p FROM el GROUP BY 1, 2),
      d AS (SELECT doc_id, '# doc-' || doc_id || chr(10) || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY page) || chr(10) AS m FROM p GROUP BY 1) SELECT doc_id, md5(m) AS md5, length(m)::BIGINT AS n FROM d"""),
    "c4_heading_path": _e("SELECT element_id, last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM el"),
    "c5_ranges": _e("WITH h AS (SELECT *, sum((kind = 'heading')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS part FROM el) SELECT doc_id, part, min(page) AS page_start, max(page) AS page_end, sum(length(content))::BIGINT AS size FROM h GROUP BY 1, 2"),
    "c3_chunks": _chunks(1800, "SELECT chunk_id, doc_id, ordinal, page_start, page_end, array_to_string(element_ids, ',') AS element_ids, array_to_string(asset_ids, ',') AS asset_ids, length(markdown)::INTEGER AS size, md5(markdown) AS md5, heading FROM ch"),
    "c6_batches": _chunks(300, """, cb AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1) // 8 AS batch FROM ch),
      ct AS (SELECT doc_id, batch, count(*)::INTEGER AS chunks, md5(string_agg(markdown[1:1600], '|' ORDER BY ordinal)) AS chunk_md5 FROM cb GROUP BY 1, 2),
      x AS (SELECT doc_id, batch, ordinal, unnest(element_ids) AS element_id, unnest(range(len(element_ids))) AS p FROM cb), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, batch ORDER BY ordinal, p) AS r FROM x QUALIFY r <= 64),
      z AS (SELECT y.doc_id, batch, count(*)::INTEGER AS elements, md5(string_agg(content[1:400], '|' ORDER BY r)) AS element_md5, string_agg(element_id, ',' ORDER BY r) AS element_ids FROM y JOIN el USING (element_id) GROUP BY 1, 2) SELECT * FROM ct JOIN z USING (doc_id, batch)"""),
}
