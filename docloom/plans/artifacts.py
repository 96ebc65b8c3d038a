"""Queries over artifact versions, indexes and enrichment, derived from documents and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import indexing as I
from docloom.operators import layout as L
from docloom.sources import artifacts as A
from docloom.sources.derived import elements, table, with_tables


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), "lang", "text", F.sha2("text", 256).alias("sha256"))


def a1_uploads(spark, sf):
    """Documents as uploads: some without bytes, some that are no PDF, some of another media type."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    body = F.when(n % 5 == 0, "").when(n % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-"), "text"))
    up = d.select(F.concat(F.lit("doc-"), n, F.when(n % 2 == 0, ".pdf").otherwise(".PDF")).alias("name"), F.when(n % 11 == 0, "text/plain").otherwise(A.PDF_TYPE).alias("media_type"), body.cast("binary").alias("content"))
    return A.classify_uploads(up)


def _json_artifacts(spark, sf):
    e = elements(spark, sf).select("doc_id", F.struct("element_id", F.col("pos").cast("int").alias("pos"), "page", "kind", "content").alias("x"))
    chunks = _chunks(spark, sf).select("doc_id", F.struct("chunk_id", F.lit(0).alias("ordinal"), F.col("text").alias("markdown"), "page_start", "page_end", "element_ids", "asset_ids").alias("x"))
    items = lambda t, name: t.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list("x").alias("items"))).alias(name))
    counts = elements(spark, sf).groupBy("doc_id").agg(F.count("*").alias("element_count"), F.count_distinct("page").alias("chunk_count"))
    manifest = _docs(spark, sf).join(counts, "doc_id").select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("sha256").alias("source_sha256"), F.lit("cfg").alias("config_hash"), "element_count", "chunk_count")).alias("manifest"))
    return items(e, "elements").join(items(chunks, "chunks"), "doc_id").join(manifest, "doc_id").withColumn("version", F.lit(1))


def a3_artifacts(spark, sf):
    """Elements, chunks and manifests read from JSON, each with what tells it."""
    e, c, m = A.artifact_tables(_json_artifacts(spark, sf))
    rows = e.select("doc_id", F.lit("element").alias("part"), F.col("element_id").alias("id"), F.concat_ws("|", "pos", "page", "kind", "content").alias("said"))
    rows = rows.union(c.select("doc_id", F.lit("chunk"), "chunk_id", F.concat_ws("|", "page_start", "page_end", F.size("element_ids"), F.size("asset_ids"), "markdown")))
    return rows.union(m.select("doc_id", F.lit("manifest"), F.col("source_sha256"), F.concat_ws("|", "schema_version", "config_hash", "element_count", "chunk_count")))


def a2_integrity(spark, sf):
    registry = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return A.mismatches(_docs(spark, sf), registry)


def _manifests(spark, sf):
    return _docs(spark, sf).where("doc_id % 3 <> 0").select("doc_id", "version", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("sha256")).alias("source_sha256"), F.lit("cfg").alias("config_hash"))


def a4_visible(spark, sf):
    rows = elements(spark, sf).withColumn("version", F.lit(1))
    return A.visible(rows, _manifests(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("elements"))


def a5_replay(spark, sf):
    work = _docs(spark, sf).select("doc_id", "version", F.col("sha256").alias("source_sha256"), F.when(F.col("doc_id") % 11 == 0, "new").otherwise("cfg").alias("config_hash"))
    return A.classify_work(work, _manifests(spark, sf))


def a6_canonical_hash(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", A.canonical_hash(n).alias("sha256"))


def a7_purge(spark, sf):
    rows = elements(spark, sf).withColumn("version", F.lit(1))
    return A.purge(rows, _docs(spark, sf).where("doc_id % 4 = 0").select("doc_id", "version")).groupBy("kb_id").agg(F.count("*").alias("elements"))


def a8_without_secrets(spark, sf):
    names = F.create_map(*(x for n in (*A.SECRET_NAMES, " API-Key", "private-key", "my-token-id", "credential-ref", "Configured", "tokens") for x in (F.lit(n), F.col("props"))))
    e = table(spark, sf, "events").select("event_id", F.struct("event_type", F.col("props").alias("client_secret"), F.col("props").alias("private-key"), F.col("user_id").alias("credential_ref")).alias("settings"), names.alias("extra"), F.col("props").alias("api_key"), F.col("props").alias("bearer"))
    clean = A.without_secrets(e)
    return clean.select("event_id", F.to_json("settings").alias("settings"), F.array_join(F.map_keys("extra"), ",").alias("extra"), F.lit(",".join(clean.columns)).alias("columns"))


def a9_latest_snapshot(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("namespace"), F.col("event_id").alias("revision"), F.col("props").alias("payload"), F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.sha2("props", 256)).alias("checksum"), (F.col("event_id") % 4).alias("schema_version"))
    return A.latest_snapshot(s)


def _elements(spark, sf):
    unit = [(F.col(c) / 1000).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return elements(spark, sf).select("doc_id", "kb_id", "pos", "page", "kind", "content", "element_id", F.concat_ws(":", "doc_id", "page").alias("chunk_id"), *unit)


def _chunks(spark, sf):
    """A chunk per page of a document."""
    e = _elements(spark, sf)
    said = F.sort_array(F.collect_list(F.struct("pos", "element_id", "content", "kind")))
    c = e.groupBy("kb_id", "doc_id", "chunk_id").agg(said.alias("e"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    asset = F.transform(F.filter("e", lambda x: x["kind"] == "table"), lambda x: F.concat(F.lit("as-"), x["element_id"]))
    return c.select("kb_id", "doc_id", "chunk_id", "page_start", "page_end", F.transform("e", lambda x: x["element_id"]).alias("element_ids"), asset.alias("asset_ids"), F.array_join(F.transform("e", lambda x: x["content"]), "\n").alias("text"))


def _assets(spark, sf):
    return L.assets(elements(spark, sf)).select(F.concat(F.lit("as-"), "element_id").alias("asset_id"), "element_id")


def d1_dangling(spark, sf):
    """Every sixth element and every third document's assets are lost."""
    lost = _assets(spark, sf).join(_elements(spark, sf).where("doc_id % 3 = 0").select("element_id"), "element_id", "left_anti")
    chunks = _chunks(spark, sf).withColumn("text", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")))
    return I.lineage_violations(chunks, _elements(spark, sf).where("pos % 6 <> 5"), lost)


def d2_anchor(spark, sf):
    """Some elements have no page or box, some assets are unknown or of another chunk's element."""
    e = _elements(spark, sf).withColumns({"page": F.when(F.col("doc_id") % 6 == 0, 0).otherwise(F.col("page")), "y1": F.when(F.col("doc_id") % 10 != 7, F.col("y1"))})
    known = L.assets(elements(spark, sf)).where("doc_id % 4 <> 3").select(F.concat(F.lit("as-"), "element_id").alias("asset_id"), F.when(F.col("doc_id") % 4 == 2, "el_none").otherwise(F.col("element_id")).alias("element_id"), "page")
    chunks = _chunks(spark, sf).withColumn("page_start", F.when(F.col("doc_id") % 12 == 0, 0).otherwise(F.col("page_start")))
    return I.anchors(chunks, e, known).select("chunk_id", "anchor", "page", "x0", "y0", "x1", "y1", "code")


def d3_union_bbox(spark, sf):
    shift = _elements(spark, sf).withColumn("x1", F.when(F.col("doc_id") % 5 == 0, F.col("x0")).otherwise(F.col("x1") + 0.2))
    return I.union_boxes(shift)


def d4_count_check(spark, sf):
    manifests = _docs(spark, sf).select("doc_id", (F.floor(F.size(F.split("text", "\n")) / 20) + 1).alias("chunk_count"))
    return I.count_mismatches(_chunks(spark, sf), manifests)


def d5_overlay(spark, sf):
    """Labels as page notes, tables as element notes."""
    l = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    pages = l.select("doc_id", F.lit(1).alias("page"), (F.col("quality") == 1).alias("publishable"), F.when(F.col("toxic") == 1, "toxic").alias("summary"), F.concat(F.lit(" q"), "quality").alias("search_text"), F.array(F.lit("t"), F.lit(""), F.concat(F.lit("x"), "toxic")).alias("tags"))
    notes = _elements(spark, sf).where("kind = 'table'").select("element_id", (F.col("pos") % 2 == 0).alias("publishable"), F.col("content").alias("description"), F.lit("same").alias("search_text"), F.array(F.lit("t"), F.lit("table")).alias("tags"))
    o = I.overlay(_chunks(spark, sf), pages, notes)
    return o.select("chunk_id", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))


def d6_overlay_lineage(spark, sf):
    n = F.col("doc_id")
    m = _docs(spark, sf).select(n, F.lit(1).alias("schema_version"), F.lit("v1").alias("artifact_version"), F.concat(F.lit("doc-"), n).alias("document"), "version", "sha256", F.md5("text").alias("artifact_checksum"))
    o = m.withColumns({
        "schema_version": F.when(n % 3 == 0, 2).otherwise(1), "artifact_version": F.when(n % 4 == 0, F.lit(None)).otherwise("v1"), "document": F.when(n % 11 == 0, "other").otherwise(F.col("document")),
        "version": F.when(n % 5 == 0, 2).otherwise(1), "sha256": F.when(n % 7 == 0, None).otherwise(F.col("sha256")), "artifact_checksum": F.when(n % 13 == 0, "x").otherwise(F.col("artifact_checksum")),
    })
    return I.overlay_lineage(o, m, ("schema_version", "artifact_version", "document", "version", "sha256", "artifact_checksum"))


def d7_embed(spark, sf):
    """A toy embedder of three numbers; it fails on batches with an empty text's marker and returns short vectors for every ninth text."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws(" ", F.when(F.col("doc_id") % 9 == 0, "short").otherwise("whole"), "text").alias("text"))

    def embedder(texts):
        return [[float(len(t)), float(t.count(" "))] + ([1.0] if t.startswith("whole") else []) for t in texts]

    return I.embed(chunks, embedder, dimensions=3).select("chunk_id", F.element_at("embedding", 1).cast("long").alias("chars"), F.element_at("embedding", 2).cast("long").alias("blanks"), "code")


def d8_mode(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") < 100, "small").otherwise(F.col("lang")).alias("kb_id"))
    return I.index_mode(chunks, table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id")))


def d9_index_identity(spark, sf):
    hybrid = F.col("doc_id") % 2 == 0
    d = _docs(spark, sf).select(
        F.lit("1.0").alias("schema_version"), F.concat_ws("/", F.lit("compiled"), "doc_id", "version").alias("compiler_manifest_key"), F.col("sha256").alias("source_sha256"), F.lit("cfg").alias("compiler_config_hash"), F.concat(F.lit("doc-"), "doc_id").alias("document_title"),
        F.lit("none").alias("semantic_fingerprint"), F.col("lang").alias("index_signature"), F.when(hybrid, "hybrid").otherwise("lexical-only").alias("mode"), F.when(hybrid, 1024).alias("dimensions"), "doc_id",
    )
    return d.select("doc_id", F.substring(A.canonical_hash(d.select(*I.IDENTITY)), 1, 16).alias("variant"))


def d10_load_check(spark, sf):
    """Indexes whose payload is lost or no longer has its hash, and hybrid ones of another embedder than the queries'."""
    n = F.col("doc_id")
    m = _manifests(spark, sf).select("doc_id", F.col("source_sha256").alias("sha256"), F.when(n % 2 == 0, "hybrid").otherwise("lexical-only").alias("mode"), F.when(n % 5 == 0, "old:768").otherwise("toy:1024").alias("index_signature"))
    return I.load_violations(m, _docs(spark, sf).where(n % 13 != 0), "toy:1024")


def _work(spark, sf):
    return I.eligible(_elements(spark, sf)).withColumn("version", F.lit(1)).withColumn("asset", F.when(F.col("pos") % 3 != 0, F.md5("content")).cast("binary")).withColumn("fingerprint", I.fingerprint())


def i1_eligible(spark, sf):
    return I.eligible(_elements(spark, sf)).select("element_id", "kind")


def i2_pages(spark, sf):
    return I.enriched_pages(elements(spark, sf))


def i3_fingerprint(spark, sf):
    return _work(spark, sf).select("element_id", "fingerprint")


def i4_reuse(spark, sf):
    n = F.col("pos")
    cache = _work(spark, sf).where("pos % 5 <> 0").select("element_id", F.when(n % 5 == 1, 2).otherwise(1).alias("version"), F.when(n % 5 == 2, "x").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(n % 7 == 3, -1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(n % 11 == 5, 0).otherwise(F.col("page")).alias("page"), (F.col("x0") + F.when(n % 13 == 6, 1e-9).when(n % 13 == 7, 1e-3).otherwise(0)).alias("x0"), "y0", "x1", "y1")
    return I.reuse(_work(spark, sf), cache)


def _accepted(spark, sf):
    n = F.col("pos")
    outputs = _work(spark, sf).where("pos % 6 <> 0").select("element_id", F.when(n % 6 == 1, -1).otherwise(F.col("doc_id")).alias("doc_id"), "version", F.when(n % 6 == 2, 0).otherwise(F.col("page")).alias("page"), (F.col("x0") + F.when(n % 6 == 4, 1e-9).otherwise(0.0)).alias("x0"), "y0", (F.col("x1") + F.when(n % 6 == 5, 0.001).otherwise(0.0)).alias("x1"), "y1", F.concat(F.lit("seen "), "element_id").alias("search_text"))
    return I.accept(_work(spark, sf), outputs)


def i5_echo(spark, sf):
    return _accepted(spark, sf).select("element_id", "publishable", "code")


def i6_fallback(spark, sf):
    return _accepted(spark, sf).where("not publishable").select("element_id", F.md5("search_text").alias("text_md5"))


def i7_summary(spark, sf):
    return I.enrichment_summary(_accepted(spark, sf))


def i8_tags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "[,.\n]").alias("tags"))
    return d.select("doc_id", F.md5(F.array_join(I.clean_tags(F.col("tags")), "|")).alias("tags_md5"), F.size(I.clean_tags(F.col("tags"))).cast("long").alias("n"))


def i9_artifact(spark, sf):
    """Semantic artifacts of two versions of every document; the second has page notes only, texts stand as their hashes."""
    docs = _docs(spark, sf).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.sha2("text", 256).alias("source_sha256"))
    notes = _accepted(spark, sf).select("doc_id", F.lit(1).alias("version"), "element_id", "publishable", F.md5("search_text").alias("search_text"), "code")
    pages = elements(spark, sf).select("doc_id", "page").distinct().select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "page", (F.col("page") % 2 == 1).alias("publishable"), F.concat(F.lit("page "), "page").alias("search_text"), F.when(F.col("page") % 2 == 0, "pending").alias("code"))
    return I.semantic_artifact(docs, pages, notes).select("doc_id", "version", "pages", "elements", "sha256")


QUERIES = {f.__name__: f for f in (
    a1_uploads, a2_integrity, a3_artifacts, a4_visible, a5_replay, a6_canonical_hash, a7_purge, a8_without_secrets, a9_latest_snapshot, d1_dangling, d2_anchor, d3_union_bbox, d4_count_check, d5_overlay, d6_overlay_lineage, d7_embed, d8_mode, d9_index_identity, d10_load_check,
    i1_eligible, i2_pages, i3_fingerprint, i4_reuse, i5_echo, i6_fallback, i7_summary, i8_tags, i9_artifact,
)}

_e = lambda body: with_tables("el", body)
_CH = "pg AS (SELECT *, doc_id || ':' || page AS chunk_id FROM el)"
_ACC = "acc AS (SELECT *, pos % 6 NOT IN (0, 1, 2, 5) OR (pos % 6 = 2 AND page = 0) AS publishable, CASE WHEN pos % 6 = 0 THEN 'pending' WHEN pos % 6 IN (1, 2, 5) THEN 'lineage_mismatch' END AS code FROM el WHERE kind = 'table')"

SQL = {
    "a1_uploads": """WITH u AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text ELSE '%PDF-' || text END AS c FROM documents)
      SELECT 'doc-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS name, strlen(c)::BIGINT AS length, sha256(c) AS sha256, 'doc-' || doc_id AS title,
        CASE WHEN doc_id % 11 = 0 THEN 'unsupported_media_type' WHEN c = '' THEN 'empty_file' WHEN NOT starts_with(c, '%PDF-') THEN 'invalid_pdf_signature' END AS code FROM u""",
    "a3_artifacts": _e(f"""WITH {_CH} SELECT doc_id, 'element' AS part, element_id AS id, pos || '|' || page || '|' || kind || '|' || content AS said FROM el
      UNION ALL SELECT doc_id, 'chunk', chunk_id, min(page) || '|' || max(page) || '|' || count(*) || '|' || count(*) FILTER (kind = 'table') || '|' || string_agg(content, chr(10) ORDER BY pos) FROM pg GROUP BY doc_id, chunk_id
      UNION ALL SELECT d.doc_id, 'manifest', sha256(any_value(text)), '1|cfg|' || count(*) || '|' || count(DISTINCT page) FROM el JOIN documents d ON d.doc_id = el.doc_id GROUP BY d.doc_id"""),
    "a2_integrity": "SELECT doc_id, 'source_hash_mismatch' AS code FROM documents WHERE doc_id % 10 = 0",
    "a4_visible": _e("SELECT doc_id, count(*) AS elements FROM el WHERE doc_id % 3 <> 0 GROUP BY 1"),
    "a5_replay": "SELECT doc_id, 1 AS version, CASE WHEN doc_id % 3 = 0 THEN 'todo' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'version_conflict' ELSE 'replay' END AS state FROM documents",
    "a6_canonical_hash": "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS sha256 FROM nation",
    "a7_purge": _e("SELECT kb_id, count(*) AS elements FROM el WHERE doc_id % 4 <> 0 GROUP BY 1"),
    "a8_without_secrets": "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"credential_ref\":' || user_id || '}' AS settings, 'credential-ref,Configured,tokens' AS extra, 'event_id,settings,extra' AS columns FROM events",
    "a9_latest_snapshot": "SELECT user_id AS namespace, max(event_id) AS revision, CASE WHEN arg_max(event_id % 4, event_id) = 1 THEN left(arg_max(props, event_id), -1) || ', \"wiki_pages\": {}}' ELSE arg_max(props, event_id) END AS payload, arg_max(event_id % 4, event_id) AS schema_version FROM events WHERE event_id % 3 <> 0 AND event_id % 4 IN (1, 2) GROUP BY 1",
    "d1_dangling": _e(f"""WITH {_CH} SELECT DISTINCT chunk_id, 'empty_text' AS code FROM pg WHERE doc_id % 13 = 0 UNION SELECT chunk_id, 'unknown_element' FROM pg WHERE pos % 6 = 5
      UNION SELECT chunk_id, 'invalid_asset_lineage' FROM pg WHERE kind = 'table' AND doc_id % 3 = 0"""),
    "d2_anchor": _e(f"""WITH {_CH}, f AS (SELECT chunk_id, doc_id, min(pos) FILTER (kind = 'table') AS asset, min(pos) AS pos, min(page) AS first FROM pg GROUP BY 1, 2),
      a AS (SELECT *, CASE WHEN asset IS NULL THEN pos WHEN doc_id % 4 IN (2, 3) THEN NULL ELSE asset END AS own FROM f),
      b AS (SELECT a.chunk_id, a.doc_id, asset, first, own, element_id, page, x0 / 1000 AS x0, y0 / 1000 AS y0, x1 / 1000 AS x1, CASE WHEN a.doc_id % 10 <> 7 THEN y1 / 1000 END AS y1 FROM a LEFT JOIN pg ON pg.chunk_id = a.chunk_id AND pg.pos = own),
      c AS (SELECT *, CASE WHEN asset IS NOT NULL THEN CASE WHEN doc_id % 4 = 2 THEN first WHEN doc_id % 4 <> 3 THEN page END WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 12 = 0 THEN 0 ELSE first END ELSE page END AS p FROM b)
      SELECT chunk_id, CASE WHEN asset IS NOT NULL AND doc_id % 4 = 2 THEN 'el_none' ELSE element_id END AS anchor, p::INTEGER AS page, x0, y0, x1, y1, CASE WHEN asset IS NOT NULL AND own IS NULL THEN 'invalid_asset_lineage' WHEN p < 1 OR y1 IS NULL THEN 'invalid_element_lineage' END AS code FROM c"""),
    "d3_union_bbox": _e(f"""WITH {_CH}, b AS (SELECT chunk_id, min(x0 / 1000) AS x0, min(y0 / 1000) AS y0, max(least(CASE WHEN doc_id % 5 = 0 THEN x0 / 1000 ELSE x1 / 1000 + 0.2 END, 1.0)) AS x1, max(y1 / 1000) AS y1 FROM pg GROUP BY 1)
      SELECT chunk_id, CASE WHEN x0 >= x1 THEN 0.02 ELSE x0 END::DOUBLE AS x0, CASE WHEN x0 >= x1 THEN 0.02 ELSE y0 END::DOUBLE AS y0, CASE WHEN x0 >= x1 THEN 0.98 ELSE x1 END::DOUBLE AS x1, CASE WHEN x0 >= x1 THEN 0.98 ELSE y1 END::DOUBLE AS y1 FROM b"""),
    "d4_count_check": _e("""WITH b AS (SELECT doc_id, count(DISTINCT page) AS built FROM el GROUP BY 1), m AS (SELECT doc_id, len(string_split(text, chr(10))) // 20 + 1 AS chunk_count FROM documents)
      SELECT doc_id, chunk_count, coalesce(built, 0) AS built FROM m LEFT JOIN b USING (doc_id) WHERE coalesce(built, 0) <> chunk_count"""),
    "d5_overlay": _e(f"""WITH {_CH}, l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1),
      c AS (SELECT doc_id, chunk_id, any_value(page) AS page, string_agg(content, chr(10) ORDER BY pos) AS text FROM pg GROUP BY 1, 2),
      n AS (SELECT chunk_id, 0 AS lv, 0 AS pl, '[page summary] ' || CASE WHEN t = 1 THEN 'toxic' ELSE '' END AS a, '[page search] q' || q AS b, 'x' || t AS tag FROM c JOIN l USING (doc_id) WHERE page = 1 AND q = 1
        UNION ALL SELECT chunk_id, 1, pos, '[element description] ' || trim(content), '[element search] same', 'table' FROM pg WHERE kind = 'table' AND pos % 2 = 0),
      li AS (SELECT chunk_id, line, min((lv, pl, k)) AS o FROM (SELECT chunk_id, lv, pl, 0 AS k, a AS line FROM n UNION ALL SELECT chunk_id, lv, pl, 1, b FROM n) GROUP BY 1, 2),
      ls AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY o) AS s FROM li GROUP BY 1),
      ta AS (SELECT chunk_id, 't,' || string_agg(tag, ',' ORDER BY o) AS tags FROM (SELECT chunk_id, tag, min((lv, pl)) AS o FROM n GROUP BY 1, 2) GROUP BY 1)
      SELECT chunk_id, md5(text || coalesce(chr(10) || chr(10) || s, '')) AS text_md5, coalesce(tags, '') AS tags FROM c LEFT JOIN ls USING (chunk_id) LEFT JOIN ta USING (chunk_id)"""),
    "d6_overlay_lineage": "SELECT doc_id, field FROM documents, (VALUES (3, 'schema_version'), (4, 'artifact_version'), (11, 'document'), (5, 'version'), (7, 'sha256'), (13, 'artifact_checksum')) f(m, field) WHERE doc_id % m = 0",
    "d7_embed": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'short ' ELSE 'whole ' END || text AS t FROM documents) SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 9 <> 0 THEN length(t) END AS chars, CASE WHEN doc_id % 9 <> 0 THEN length(t) - length(replace(t, ' ', '')) END AS blanks, CASE WHEN doc_id % 9 = 0 THEN 'embedding_dimension_mismatch' END AS code FROM t",
    "d8_mode": "WITH c AS (SELECT doc_id, CASE WHEN doc_id < 100 THEN 'small' ELSE lang END AS kb_id FROM documents) SELECT kb_id, count(*) AS chunks, count(v) AS vectors, CASE WHEN count(v) = count(*) THEN 'hybrid' ELSE 'lexical-only' END AS mode, CASE WHEN count(v) = count(*) THEN NULL WHEN count(v) = 0 THEN 'no_vectors' ELSE 'missing_vectors' END AS reason FROM c LEFT JOIN (SELECT DISTINCT vec_id AS v FROM embeddings) ON v = doc_id GROUP BY 1",
    "d9_index_identity": """SELECT doc_id, substr(sha256('{"compiler_config_hash":"cfg","compiler_manifest_key":"compiled/' || doc_id || '/1","dimensions":' || CASE WHEN doc_id % 2 = 0 THEN '1024' ELSE 'null' END || ',"document_title":"doc-' || doc_id || '","index_signature":"' || lang
      || '","mode":"' || CASE WHEN doc_id % 2 = 0 THEN 'hybrid' ELSE 'lexical-only' END || '","schema_version":"1.0","semantic_fingerprint":"none","source_sha256":"' || sha256(text) || '"}'), 1, 16) AS variant FROM documents""",
    "d10_load_check": "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'payload_missing' WHEN doc_id % 7 = 0 THEN 'payload_hash_mismatch' WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN 'embedding_signature_mismatch' END AS code FROM documents WHERE doc_id % 3 <> 0) WHERE code IS NOT NULL",
    "i1_eligible": _e("SELECT element_id, kind FROM el WHERE kind = 'table'"),
    "i2_pages": _e("WITH n AS (SELECT doc_id, page, count(*) AS n FROM el WHERE kind = 'table' GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page))::INTEGER AS place FROM n QUALIFY place <= 6"),
    "i3_fingerprint": _e("SELECT element_id, sha256('{\"version\":1,\"doc_id\":' || doc_id || ',\"page\":' || page || ',\"element_id\":\"' || element_id || '\",\"bbox\":[' || round(x0 / 1000, 6) || ',' || round(y0 / 1000, 6) || ',' || round(x1 / 1000, 6) || ',' || round(y1 / 1000, 6) || ']}' || chr(31) || kind || chr(31) || content || chr(31) || CASE WHEN pos % 3 = 0 THEN chr(0) ELSE sha256(md5(content)) END) AS fingerprint FROM el WHERE kind = 'table'"),
    "i4_reuse": _e("SELECT element_id, CASE WHEN pos % 5 IN (3, 4) AND pos % 7 <> 3 AND pos % 11 <> 5 AND pos % 13 <> 7 THEN 'hit' ELSE 'todo' END AS state FROM el WHERE kind = 'table'"),
    "i5_echo": _e(f"WITH {_ACC} SELECT element_id, publishable, code FROM acc"),
    "i6_fallback": _e(f"WITH {_ACC} SELECT element_id, md5(content) AS text_md5 FROM acc WHERE NOT publishable"),
    "i7_summary": _e(f"WITH {_ACC} SELECT doc_id, count(*) AS eligible, count(*) FILTER (publishable) AS enriched, count(*) FILTER (NOT publishable) AS pending, bool_and(publishable) AS fully_enriched FROM acc GROUP BY 1"),
    "i8_tags": r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '[,.\n]')) AS t, unnest(range(0, len(string_split_regex(text, '[,.\n]')))) AS pl FROM documents), u AS (SELECT doc_id, trim(t) AS t, min(pl) AS pl FROM t WHERE trim(t) <> '' GROUP BY 1, 2)
      SELECT d.doc_id, md5(coalesce(string_agg(t, '|' ORDER BY pl), '')) AS tags_md5, count(t) AS n FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id""",
    "i9_artifact": _e(f"""WITH {_ACC}, dv AS (SELECT doc_id, unnest([1, 2]) AS version, sha256(text) AS h FROM documents),
      en AS (SELECT doc_id, 1 AS version, count(*)::INTEGER AS n, string_agg('{{' || coalesce('"code":"' || code || '",', '') || '"element_id":"' || element_id || '","publishable":' || publishable || ',"search_text":"' || md5(CASE WHEN publishable THEN 'seen ' || element_id ELSE content END) || '"}}', ',' ORDER BY element_id) AS j FROM acc GROUP BY 1),
      pn AS (SELECT doc_id, count(*)::INTEGER AS n, string_agg('{{' || CASE WHEN page % 2 = 0 THEN '"code":"pending",' ELSE '' END || '"page":' || page || ',"publishable":' || (page % 2 = 1) || ',"search_text":"page ' || page || '"}}', ',' ORDER BY page) AS j FROM (SELECT DISTINCT doc_id, page FROM el) GROUP BY 1)
      SELECT dv.doc_id, dv.version, coalesce(pn.n, 0) AS pages, coalesce(en.n, 0) AS elements, sha256('{{"document_id":' || dv.doc_id || ',"document_version":' || dv.version || ',"elements":[' || coalesce(en.j, '') || '],"pages":[' || coalesce(pn.j, '') || '],"schema_version":2,"source_sha256":"' || h || '","trusted_layout_contract":"layout-lineage-v1"}}') AS sha256
      FROM dv LEFT JOIN en ON en.doc_id = dv.doc_id AND en.version = dv.version LEFT JOIN pn ON pn.doc_id = dv.doc_id"""),
}
