"""Queries over extractions (derived from parts) and wiki pages (derived from customers and orders)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from docloom.functions.text import alias_key, slug
from docloom.operators import extraction as X
from docloom.operators import wiki as W
from docloom.sources.derived import elements, table, with_tables


def _declared(spark, sf):
    """Parts as declared entities of 20 documents, in 3 batches."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("doc_id"), F.struct((F.col("p_partkey") % 3).alias("batch"), "p_partkey").alias("place"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"),
        F.array("p_brand").alias("aliases"), F.array(F.concat(F.lit("chunk:"), F.col("p_size") % 5), F.concat(F.lit("element:"), F.col("p_partkey") % 7)).alias("refs"),
    )


def f1_pull_json(spark, sf):
    """Event properties wrapped as model answers: fenced, in prose, or broken."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here: "), "props", F.lit(" ok}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{ broken "), "event_id")).otherwise(F.col("props")).alias("text"))
    return X.pull_json(e).select("event_id", "json", "code")


def f2_sanitise(spark, sf):
    valid = _declared(spark, sf).select("doc_id").distinct().withColumn("refs", F.array(F.concat(F.lit("chunk:"), F.col("doc_id") % 5), F.lit("element:3")))
    return X.sanitise(_declared(spark, sf), valid).select("id", F.array_join("refs", ",").alias("refs"))


def f3_contract(spark, sf):
    d = _declared(spark, sf)
    n = F.col("id")
    ents = d.select("doc_id", F.when(n % 17 == 0, "bad").otherwise(F.format_string("entity_%04d", n)).alias("ref"), F.when(n % 13 == 0, " ").otherwise(F.col("name")).alias("name"), F.when(n % 11 == 0, "x y").otherwise("PRODUCT").alias("kind"), F.when(n % 7 == 0, F.array("kind", "kind")).otherwise(F.array("kind")).alias("aliases"), F.when(n % 19 == 0, F.array().cast("array<string>")).otherwise(F.col("refs")).alias("refs"))
    claims = d.select("doc_id", F.format_string("claim_%04d", n).alias("ref"), F.format_string("entity_%04d", F.when(n % 5 == 0, n + 1).otherwise(n)).alias("subject"), F.when(n % 23 == 0, "").otherwise("s").alias("statement"), "refs")
    relations = d.select("doc_id", F.when(n % 29 == 0, F.format_string("claim_%04d", n)).otherwise(F.format_string("relation_%04d", n)).alias("ref"), F.format_string("entity_%04d", n).alias("source"), F.format_string("entity_%04d", F.when(n % 4 == 0, n + 1).otherwise(n)).alias("target"), F.when(n % 6 == 0, "uses it").otherwise("USES").alias("predicate"), F.lit("s").alias("statement"), "refs")
    evidence = d.select("doc_id", F.explode("refs").alias("ref")).where("ref <> 'element:6'").distinct()
    return X.contract_violations(ents, claims, relations, evidence, d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "0.9").otherwise("1.0").alias("schema_version")).distinct())


def _pages(spark, sf):
    return elements(spark, sf).withColumn("chunk_id", F.concat_ws(":", "doc_id", "page"))


def f4_catalogue(spark, sf):
    """Elements and page chunks, with some of each lost, some elements given twice and some of another document."""
    e = _pages(spark, sf)
    chunks = e.where("doc_id % 9 <> 0 and pos % 10 <> 4").groupBy("chunk_id").agg(F.collect_list("element_id").alias("element_ids"), F.min("doc_id").alias("doc_id"))
    own = e.where("pos % 6 <> 5").union(e.where("pos = 2")).select((F.col("doc_id") + F.when(F.col("pos") % 12 == 7, 1).otherwise(0)).alias("doc_id"), "element_id", "chunk_id")
    return X.catalogue_violations(chunks, own)


def _places(spark, sf):
    e = _pages(spark, sf)
    unit = [(F.col(c) / 1000).alias(c) for c in ("x0", "y0", "x1", "y1")]
    one = e.select("element_id", "chunk_id", "doc_id", "pos", "page", *unit)
    chunks = one.groupBy("chunk_id").agg(F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return one, chunks


def f5_lineage(spark, sf):
    """Each document cites all its elements and two pages, one of which may not exist."""
    one, chunks = _places(spark, sf)
    refs = one.groupBy(F.col("doc_id").alias("item")).agg(F.collect_list("element_id").alias("r"))
    items = refs.select("item", F.concat("r", F.array(F.concat_ws(":", "item", F.lit(1)), F.concat_ws(":", "item", F.lit(2)))).alias("refs"))
    return X.lineage(items, one, chunks)


def f6_validity(spark, sf):
    one, _ = _places(spark, sf)
    rows = one.select(F.col("element_id").alias("key"), (F.col("page") - (F.col("pos") % 8 == 0).cast("int")).alias("page"), (F.col("x0") - F.when(F.col("pos") % 9 == 0, 0.1).otherwise(0)).alias("x0"), "y0", (F.col("x1") + F.when(F.col("pos") % 10 == 0, 1).otherwise(0)).alias("x1"), "y1")
    return X.invalid_lineage(rows).select("key", "page")


def _extracted(spark, sf):
    """Parts as entities of 20 documents in 3 batches, lines as claims about their part, and as relations to a part 60 further on, which may not exist."""
    d = _declared(spark, sf)
    ref = lambda c: F.concat(F.lit("e"), c)
    entities = d.select("doc_id", F.col("place.batch").alias("batch"), "place", ref("id").alias("ref"), F.when(F.col("id") % 31 == 0, " ").otherwise(F.col("kind")).alias("kind"), F.concat(F.lit(" "), "name").alias("name"), F.array(F.concat(F.element_at("aliases", 1), F.lit(" ")), F.lit("")).alias("aliases"), "refs")
    line = table(spark, sf, "lineitem").withColumns({"doc_id": F.col("l_partkey") % 20, "batch": F.col("l_partkey") % 3, "place": F.struct((F.col("l_partkey") % 3).alias("batch"), F.col("l_partkey").alias("p_partkey"))})
    refs = F.array(F.concat(F.lit(" s"), F.col("l_suppkey") % 5, F.lit(" ")), F.concat(F.lit("n"), "l_linenumber"))
    claims = line.select("doc_id", "batch", "place", ref("l_partkey").alias("subject_ref"), F.concat(F.lit("is "), "l_returnflag", F.lit(" ")).alias("statement"), refs.alias("refs"))
    relations = line.select("doc_id", "batch", "place", ref("l_partkey").alias("source_ref"), ref(F.col("l_partkey") + 60).alias("target_ref"), F.concat(F.lit("SHIPS_"), F.translate("l_linestatus", " ", "_")).alias("predicate"), F.concat(F.lit("by "), F.col("l_suppkey") % 3).alias("statement"), refs.alias("refs"))
    return X.merge_extractions(entities, claims, relations)


def _flat(rows):
    return rows.withColumns({c: F.array_join(c, ",") for c in ("aliases", "refs") if c in rows.columns})


def f7_merge(spark, sf):
    return _flat(_extracted(spark, sf)[0])


def f7_claims(spark, sf):
    return _flat(_extracted(spark, sf)[1])


def f7_relations(spark, sf):
    return _flat(_extracted(spark, sf)[2])


def f7_problems(spark, sf):
    return _extracted(spark, sf)[3]


def f8_alias(spark, sf):
    return table(spark, sf, "part").select("p_partkey", alias_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("alias"))


def f9_components(spark, sf):
    d = _declared(spark, sf).select("id", F.concat_ws("/", "doc_id", "kind").alias("kind"), F.array("name", F.element_at("aliases", 1)).alias("names"))
    return X.resolve(d)


def f10_match(spark, sf):
    """Every third part is an entity that is known already."""
    old = table(spark, sf, "part").where("p_partkey % 3 = 0")
    existing = old.select(F.concat(F.lit("e"), "p_partkey").alias("entity_id"), F.col("p_type").alias("kind"), alias_key(F.col("p_name")).alias("alias"), F.upper("p_name").alias("label")).union(old.where("p_partkey % 2 = 0").select(F.concat(F.lit("e"), "p_partkey"), F.col("p_type"), alias_key(F.concat_ws(" ", "p_brand", F.col("p_partkey") % 3)), F.upper("p_name")))
    groups = table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("group_id"), F.col("p_type").alias("kind"), F.array("p_name", F.concat_ws(" ", "p_brand", F.col("p_size") % 3)).alias("names"))
    return X.match_existing(groups, existing).withColumn("aliases", F.array_join("aliases", ","))


def f11_new_entity(spark, sf):
    d = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("kb_id"), F.col("p_type").alias("kind"), F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("name"))
    return X.new_entities(d)


def _entities(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("entity:"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("entity_kind"), "c_custkey")


def _relations(spark, sf):
    """Orders that are open or pending relate their customer to the one of their own number."""
    customers = table(spark, sf, "customer").agg(F.max("c_custkey").alias("most"))
    o = table(spark, sf, "orders").where("o_orderstatus <> 'F'").join(F.broadcast(customers))  # one row
    return o.select(F.concat(F.lit("r"), "o_orderkey").alias("id"), F.concat(F.lit("entity:"), "o_custkey").alias("source"), F.concat(F.lit("entity:"), F.col("o_custkey") * 3 % F.col("most")).alias("target"), F.concat(F.lit("buys "), "o_orderstatus").alias("statement"), F.array(F.concat(F.lit("d"), F.col("o_orderkey") % 30)).alias("refs"))


def _claims(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return o.select(F.concat(F.lit("c"), "o_orderkey").alias("id"), F.concat(F.lit("entity:"), "o_custkey").alias("source"), F.concat(F.lit("has "), "o_orderpriority").alias("statement"), F.array(F.concat(F.lit("d"), F.col("o_orderkey") % 30), F.lit("d99")).alias("refs"))


def _conclusions(spark, sf):
    return W.conclusions(_entities(spark, sf), _claims(spark, sf), _relations(spark, sf))


def _drafts(spark, sf):
    e = _entities(spark, sf).select(F.col("id").alias("entity_id"), "label", slug(F.col("label"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("slug"))
    return e.join(_conclusions(spark, sf).select("entity_id").distinct(), "entity_id", "left_semi")


def h1_conclusions(spark, sf):
    return _conclusions(spark, sf).select("entity_id", "conclusion_id", "section", "statement", "other")


def h2_sections(spark, sf):
    s = W.sections(_conclusions(spark, sf), _drafts(spark, sf)).select("entity_id", "section", F.md5("text").alias("text_md5"))
    return s.join(W.summaries(_entities(spark, sf), _conclusions(spark, sf)).select("entity_id", "summary"), "entity_id")


def h3_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", slug(F.concat_ws("  ", F.lit(" *"), "p_name", "p_brand", F.lit("!")), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("slug"))


def h4_related(spark, sf):
    return W.related(_relations(spark, sf), _drafts(spark, sf))


def _published(spark, sf):
    c = F.col("c_custkey")
    base = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("p"), c).alias("page_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"))
    lock = F.when(c % 6 == 0, F.array(F.lit("title"))).when(c % 9 == 0, F.array(F.lit("summary"), F.lit("section:a"), F.lit("conclusions"))).when(c % 15 == 0, F.array(F.lit("related_page_ids"))).otherwise(F.array().cast("array<string>"))
    old = base.where("c_custkey % 3 = 0").select("page_id", F.concat(F.lit("old "), "title").alias("title"), F.lit("old").alias("summary"), F.create_map(F.lit("a"), F.lit("old a"), F.lit("b"), F.lit("old b")).alias("sections"), F.array(F.lit("old claim")).alias("conclusions"), F.array(F.lit("p0")).alias("related"), (c % 5 + 1).alias("revision"), lock.alias("locked"))
    new = base.where("c_custkey % 4 <> 1").select("page_id", "title", "summary", F.create_map(F.lit("a"), F.col("title"), F.lit("c"), F.when(c % 2 == 0, "").otherwise("c")).alias("sections"), F.array("summary", "title").alias("conclusions"), F.array(F.concat(F.lit("p"), c + 1)).alias("related"))
    return W.publish(old, new)


def h5_merge(spark, sf):
    return _published(spark, sf).select("page_id", "title", "summary", F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda s: F.concat_ws("=", s["key"], s["value"])), ";").alias("sections"), F.array_join("conclusions", ",").alias("conclusions"), F.array_join("related", ",").alias("related"), "revision", "status")


def h6_orphans(spark, sf):
    """Pages without a draft: those with a lock stay as they were."""
    old_only = F.concat(F.lit("p"), F.col("c_custkey"))
    gone = table(spark, sf, "customer").where("c_custkey % 3 = 0 and c_custkey % 4 = 1").select(old_only.alias("page_id"))
    return gone.join(_published(spark, sf).select("page_id", "title", "status", "revision"), "page_id", "left")


def h7_history(spark, sf):
    """Some of the published records are in the history already, and older ones."""
    new = _published(spark, sf).select("page_id", "revision", "title")
    history = new.where("page_id like '%2'").union(new.where("revision > 1").select("page_id", F.col("revision") - 1, F.concat(F.lit("before "), "title")))
    return W.append_history(W.append_history(history, new), new)


def h8_markdown(spark, sf):
    return _published(spark, sf).select("page_id", W.page_markdown().alias("markdown"))


def h9_lookup(spark, sf):
    """Pages asked for by id, by slug, by a slug that is another page's id, or not known."""
    c = F.col("c_custkey")
    pages = table(spark, sf, "customer").select(F.concat(F.lit("p"), c).alias("page_id"), F.when(c % 5 == 0, F.concat(F.lit("p"), c + 1)).otherwise(F.concat(F.lit("s"), c)).alias("slug"), F.col("c_name").alias("title"))
    asked = table(spark, sf, "customer").select(F.when(c % 3 == 0, F.concat(F.lit("s"), c)).when(c % 7 == 0, "unknown").otherwise(F.concat(F.lit("p"), c)).alias("asked")).distinct()
    return W.find_pages(pages, asked)


def h9_citations(spark, sf):
    titles = table(spark, sf, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("ref"), F.col("n_name").alias("title"))
    return W.page_citations(_conclusions(spark, sf), titles)


def h10_stale(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), "doc_id")
    return W.stale_documents(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 4 = 0"), docs.where("doc_id % 5 <> 0"))


def h11_cascade(spark, sf):
    """What is left of elements, manifests, graph rows, pages and jobs after toxic documents and one knowledge base are deleted."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), "doc_id", "text")
    gone = docs.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    tables = {
        "elements": elements(spark, sf).select("kb_id", "doc_id", F.col("element_id").alias("id")), "manifests": docs.select("kb_id", "doc_id", F.md5("text").alias("id")),
        "graph": elements(spark, sf).where("kind = 'heading'").select("kb_id", "doc_id", F.concat(F.lit("heading:"), "element_id").alias("id")), "wiki": docs.select("kb_id", "doc_id", F.concat(F.lit("page:"), "doc_id").alias("id")),
        "jobs": docs.select("kb_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("doc_id"), F.concat(F.lit("job:"), "doc_id").alias("id")),
    }
    left = [t.select(F.lit(name).alias("part"), "kb_id", "doc_id", "id") for name, t in W.cascade(tables, gone, docs.where("kb_id = 'fr'")).items()]
    return functools.reduce(lambda a, b: a.union(b), left)


QUERIES = {f.__name__: f for f in (
    f1_pull_json, f2_sanitise, f3_contract, f4_catalogue, f5_lineage, f6_validity, f7_merge, f7_claims, f7_relations, f7_problems, f8_alias, f9_components, f10_match, f11_new_entity,
    h1_conclusions, h2_sections, h3_slug, h4_related, h5_merge, h6_orphans, h7_history, h8_markdown, h9_lookup, h9_citations, h10_stale, h11_cascade,
)}

_D = "d AS (SELECT p_partkey AS id, p_partkey % 20 AS doc_id, p_partkey % 3 AS batch, p_type AS kind, p_name AS name, p_brand AS brand, 'chunk:' || p_size % 5 AS r1, 'element:' || p_partkey % 7 AS r2 FROM part)"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_PG = "pg AS (SELECT *, doc_id || ':' || page AS chunk_id FROM el)"
_WIKI = """r AS (SELECT 'r' || o_orderkey AS id, 'entity:' || o_custkey AS source, 'entity:' || o_custkey * 3 % (SELECT max(c_custkey) FROM customer) AS target, 'buys ' || o_orderstatus AS statement, ['d' || o_orderkey % 30] AS refs FROM orders WHERE o_orderstatus <> 'F'),
c AS (SELECT 'c' || o_orderkey AS id, 'entity:' || o_custkey AS source, 'has ' || o_orderpriority AS statement, ['d' || o_orderkey % 30, 'd99'] AS refs FROM orders WHERE o_orderstatus = 'F'),
en AS (SELECT 'entity:' || c_custkey AS entity_id, c_name AS label, c_mktsegment AS entity_kind, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || lpad(c_custkey::VARCHAR, 8, '0') AS slug FROM customer),
co AS (SELECT * FROM (SELECT source AS entity_id, id AS conclusion_id, '关键结论' AS section, statement, NULL::VARCHAR AS other, refs FROM c UNION ALL SELECT source, id, '关联关系', statement, target, refs FROM r
  UNION ALL SELECT target, id || ':incoming', '反向关联', statement, source, refs FROM r WHERE source <> target) WHERE entity_id IN (SELECT entity_id FROM en))"""
_PUB = """old AS (SELECT 'p' || c_custkey AS page_id, 'old ' || c_name AS title, c_custkey % 5 + 1 AS revision, CASE WHEN c_custkey % 6 = 0 THEN 1 WHEN c_custkey % 9 = 0 THEN 2 WHEN c_custkey % 15 = 0 THEN 3 ELSE 0 END AS k FROM customer WHERE c_custkey % 3 = 0),
new AS (SELECT 'p' || c_custkey AS page_id, 'p' || (c_custkey + 1) AS next, c_name AS title, c_mktsegment AS summary, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'c' END AS c FROM customer WHERE c_custkey % 4 <> 1),
pub AS (SELECT page_id, CASE WHEN new.page_id IS NULL OR k = 1 THEN old.title ELSE new.title END AS title, CASE WHEN new.page_id IS NULL OR k = 2 THEN 'old' ELSE new.summary END AS summary,
  CASE WHEN new.page_id IS NULL THEN 'old a' WHEN k = 2 THEN 'old a' ELSE new.title END AS a, CASE WHEN new.page_id IS NULL THEN 'old b' END AS b, CASE WHEN new.page_id IS NOT NULL THEN new.c END AS c,
  CASE WHEN new.page_id IS NULL OR k = 2 THEN 'old claim' ELSE new.summary || ',' || new.title END AS conclusions, CASE WHEN new.page_id IS NULL OR k = 3 THEN 'p0' ELSE new.next END AS related,
  coalesce(revision, 0) + 1 AS revision, CASE WHEN coalesce(k, 0) > 0 THEN 'locked' ELSE 'published' END AS status FROM old FULL JOIN new USING (page_id) WHERE new.page_id IS NOT NULL OR k > 0)"""

_F7 = f"""{_D}, m0 AS (SELECT doc_id, kind, {_KEY.format("name")} AS key, arg_min(name, (batch, id)) AS name, array_to_string(list_sort(list(DISTINCT brand)), ',') AS aliases, array_to_string(list_sort(list_distinct(flatten(list([r1, r2])))), ',') AS refs FROM d WHERE id % 31 <> 0 GROUP BY 1, 2, 3),
      m AS (SELECT *, printf('entity_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY kind, key)) AS ref FROM m0),
      lo AS (SELECT d.doc_id, d.batch, d.id, m.ref, printf('(%s%s%s, %s%s%s)', chr(39), m.kind, chr(39), chr(39), m.key, chr(39)) AS w FROM d JOIN m ON m.doc_id = d.doc_id AND m.kind = d.kind AND m.key = {_KEY.format("d.name")} WHERE id % 31 <> 0),
      li AS (SELECT *, l_partkey % 20 AS doc_id, l_partkey % 3 AS batch FROM lineitem)"""
_F7_REFS = "array_to_string(list_sort(list_distinct(flatten(list(['s' || l_suppkey % 5, 'n' || l_linenumber])))), ',')"

SQL = {
    "f1_pull_json": "SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN props END AS json, CASE WHEN event_id % 4 = 2 THEN 'no_json_object' END AS code FROM events",
    "f2_sanitise": f"WITH {_D}, k AS (SELECT id, list_filter([r1, r2], lambda x: x = 'chunk:' || doc_id % 5 OR x = 'element:3') AS l FROM d) SELECT id, array_to_string(l, ',') AS refs FROM k WHERE len(l) > 0",
    "f3_contract": f"""WITH {_D}, s AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'bad' ELSE printf('entity_%04d', id) END AS ref FROM d),
      q AS (SELECT *, printf('claim_%04d', id) AS cref, printf('entity_%04d', CASE WHEN id % 5 = 0 THEN id + 1 ELSE id END) AS subject FROM s),
      rl AS (SELECT *, CASE WHEN id % 29 = 0 THEN cref ELSE printf('relation_%04d', id) END AS rref, printf('entity_%04d', id) AS source, printf('entity_%04d', CASE WHEN id % 4 = 0 THEN id + 1 ELSE id END) AS target FROM q)
      SELECT doc_id, ref, 'bad_ref' AS code FROM s WHERE id % 17 = 0 OR id > 9999 UNION SELECT doc_id, ref, 'blank_name' FROM s WHERE id % 13 = 0 UNION SELECT doc_id, ref, 'bad_kind' FROM s WHERE id % 11 = 0
      UNION SELECT doc_id, ref, 'repeated_alias' FROM s WHERE id % 7 = 0 UNION SELECT doc_id, ref, 'no_evidence' FROM s WHERE id % 19 = 0 UNION SELECT doc_id, ref, 'repeated_ref' FROM (SELECT doc_id, ref FROM s UNION ALL SELECT doc_id, cref FROM q UNION ALL SELECT doc_id, rref FROM rl) GROUP BY doc_id, ref HAVING count(*) > 1
      UNION SELECT doc_id, cref, 'unknown_subject' FROM q WHERE (doc_id, subject) NOT IN (SELECT (doc_id, ref) FROM s) UNION SELECT doc_id, cref, 'blank_statement' FROM q WHERE id % 23 = 0 UNION SELECT doc_id, '', 'too_many_entities' FROM s GROUP BY doc_id HAVING count(*) > 10
      UNION SELECT doc_id, '', 'too_many_claims' FROM s GROUP BY doc_id HAVING count(*) > 12 UNION SELECT doc_id, '', 'too_many_relations' FROM s GROUP BY doc_id HAVING count(*) > 12 UNION SELECT doc_id, '', 'bad_schema_version' FROM s WHERE doc_id % 3 = 0
      UNION SELECT doc_id, rref, 'unknown_source' FROM rl WHERE (doc_id, source) NOT IN (SELECT (doc_id, ref) FROM s) UNION SELECT doc_id, rref, 'unknown_target' FROM rl WHERE (doc_id, target) NOT IN (SELECT (doc_id, ref) FROM s) UNION SELECT doc_id, rref, 'bad_predicate' FROM rl WHERE id % 6 = 0
      UNION SELECT doc_id, ref, 'unknown_evidence' FROM s WHERE r2 = 'element:6' AND id % 19 <> 0 UNION SELECT doc_id, cref, 'unknown_evidence' FROM q WHERE r2 = 'element:6' UNION SELECT doc_id, rref, 'unknown_evidence' FROM rl WHERE r2 = 'element:6'""",
    "f4_catalogue": with_tables("el", f"""WITH {_PG}, l AS (SELECT chunk_id, element_id FROM pg WHERE doc_id % 9 <> 0 AND pos % 10 <> 4), c AS (SELECT DISTINCT chunk_id FROM l), e AS (SELECT element_id, chunk_id FROM pg WHERE pos % 6 <> 5)
      SELECT element_id AS id, 'unknown_chunk' AS code FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION SELECT element_id, 'unlisted_element' FROM e WHERE chunk_id IN (SELECT chunk_id FROM c) AND (chunk_id, element_id) NOT IN (SELECT (chunk_id, element_id) FROM l)
      UNION SELECT element_id, 'unknown_element' FROM l WHERE element_id NOT IN (SELECT element_id FROM e) UNION SELECT element_id, 'repeated_element' FROM pg WHERE pos = 2
      UNION SELECT element_id, 'other_document' FROM pg WHERE pos % 12 = 7 AND chunk_id IN (SELECT chunk_id FROM c)"""),
    "f5_lineage": with_tables("el", f"""WITH {_PG}, c AS (SELECT doc_id, chunk_id, min(page) AS page, min(x0) / 1000 AS x0, min(y0) / 1000 AS y0, max(x1) / 1000 AS x1, max(y1) / 1000 AS y1 FROM pg GROUP BY 1, 2)
      SELECT doc_id AS item, element_id AS key, page, x0 / 1000 AS x0, y0 / 1000 AS y0, x1 / 1000 AS x1, y1 / 1000 AS y1, chunk_id, element_id FROM pg
      UNION ALL SELECT doc_id, chunk_id, page, x0, y0, x1, y1, chunk_id, NULL FROM c WHERE page <= 2"""),
    "f6_validity": with_tables("el", "SELECT element_id AS key, (page - (pos % 8 = 0)::INTEGER)::INTEGER AS page FROM el WHERE (page = 1 AND pos % 8 = 0) OR pos % 9 = 0 OR pos % 10 = 0"),
    "f7_merge": f"WITH {_F7} SELECT doc_id, ref, kind, name, aliases, refs FROM m",
    "f7_claims": f"""WITH {_F7}, c AS (SELECT l.doc_id, w, ref AS subject_ref, 'is ' || l_returnflag AS statement, {_F7_REFS} AS refs FROM li l JOIN lo a ON a.doc_id = l.doc_id AND a.id = l_partkey GROUP BY 1, 2, 3, 4)
      SELECT doc_id, printf('claim_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY w, statement)) AS ref, subject_ref, statement, refs FROM c""",
    "f7_relations": f"""WITH {_F7}, c AS (SELECT l.doc_id, a.w AS w, b.w AS w2, a.ref AS source_ref, b.ref AS target_ref, 'SHIPS_' || l_linestatus AS predicate, 'by ' || l_suppkey % 3 AS statement, {_F7_REFS} AS refs FROM li l JOIN lo a ON a.doc_id = l.doc_id AND a.id = l_partkey JOIN lo b ON b.doc_id = l.doc_id AND b.id = l_partkey + 60 GROUP BY ALL)
      SELECT doc_id, printf('relation_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY w, w2, predicate, statement)) AS ref, source_ref, target_ref, predicate, statement, refs FROM c""",
    "f7_problems": f"""WITH {_F7} SELECT DISTINCT doc_id, batch, 'incomplete_entity' AS code FROM d WHERE id % 31 = 0 UNION SELECT doc_id, batch, 'claim_of_unknown_entity' FROM li WHERE l_partkey NOT IN (SELECT id FROM lo)
      UNION SELECT doc_id, batch, 'relation_of_unknown_entity' FROM li WHERE l_partkey NOT IN (SELECT id FROM lo) OR l_partkey + 60 NOT IN (SELECT id FROM lo)""",
    "f8_alias": "SELECT p_partkey, " + _KEY.format("p_name || ' - ' || p_brand") + " AS alias FROM part",
    "f9_components": f"""WITH RECURSIVE {_D}, t AS (SELECT DISTINCT id, doc_id || '/' || kind || ':' || a AS alias FROM (SELECT id, doc_id, kind, unnest([{_KEY.format('name')}, {_KEY.format('brand')}]) AS a FROM d)), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM t x JOIN t y USING (alias)),
      r AS (SELECT id, id AS root FROM d UNION SELECT b, root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS root FROM r GROUP BY id""",
    "f10_match": f"""WITH ex AS (SELECT 'e' || p_partkey AS entity_id, p_type AS kind, {_KEY.format('p_name')} AS alias FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'e' || p_partkey, p_type, {_KEY.format("p_brand || ' ' || p_partkey % 3")} FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0),
      g AS (SELECT p_partkey AS group_id, p_type AS kind, unnest([{_KEY.format('p_name')}, {_KEY.format("p_brand || ' ' || p_size % 3")}]) AS alias FROM part WHERE p_partkey % 3 <> 0),
      h AS (SELECT group_id, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM g LEFT JOIN ex USING (kind, alias) GROUP BY 1),
      al AS (SELECT group_id, alias FROM g UNION SELECT group_id, ex.alias FROM h JOIN ex ON ex.entity_id = e WHERE n = 1), ag AS (SELECT group_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM al GROUP BY 1)
      SELECT group_id, CASE n WHEN 0 THEN 'new' WHEN 1 THEN 'match' ELSE 'conflict' END AS verdict, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n = 1 THEN upper(p_name) END AS label, aliases FROM h JOIN ag USING (group_id) LEFT JOIN part ON 'e' || p_partkey = e""",
    "f11_new_entity": f"""WITH s AS (SELECT p_partkey % 3 AS kb_id, p_type AS kind, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '!' ELSE p_name END AS name FROM part)
      SELECT 'en_' || substr(sha256(kb_id || chr(31) || kind || chr(31) || {_KEY.format('name')}), 1, 24) AS entity_id, kb_id, kind, arg_min(name, (-length(name), lower(name), name)) AS label FROM s GROUP BY kb_id, kind, {_KEY.format('name')}""",
    "h1_conclusions": f"WITH {_WIKI} SELECT entity_id, conclusion_id, section, statement, other FROM co",
    "h2_sections": f"""WITH {_WIKI}, pg AS (SELECT * FROM en WHERE entity_id IN (SELECT entity_id FROM co)),
      s AS (SELECT co.entity_id, section, string_agg('- ' || statement || coalesce('（[[' || pg.label || '|' || pg.slug || ']]）', '') || ' `[' || array_to_string(refs, '; ') || ']`', chr(10) ORDER BY conclusion_id) AS t FROM co LEFT JOIN pg ON pg.entity_id = co.other GROUP BY 1, 2),
      n AS (SELECT entity_id, count(*) AS n FROM co GROUP BY 1) SELECT s.entity_id, section, md5(t) AS text_md5, label || ' 是知识库中的 ' || entity_kind || ' 实体；当前页面汇集 ' || n || ' 条可回溯结论。' AS summary FROM s JOIN n USING (entity_id) JOIN en USING (entity_id)""",
    "h3_slug": "SELECT p_partkey, trim(regexp_replace(lower(' *  ' || p_name || '  ' || p_brand || '  !'), '[^a-z0-9]+', '-', 'g'), '-') || '-' || right(lpad(p_partkey::VARCHAR, 10, '0'), 8) AS slug FROM part",
    "h4_related": f"WITH {_WIKI}, b AS (SELECT source AS entity_id, target AS other FROM r UNION SELECT target, source FROM r), p AS (SELECT DISTINCT entity_id FROM co) SELECT entity_id, string_agg(other, ',' ORDER BY other) AS related FROM b WHERE entity_id IN (SELECT entity_id FROM p) AND other IN (SELECT entity_id FROM p) GROUP BY 1",
    "h5_merge": f"WITH {_PUB} SELECT page_id, title, summary, 'a=' || a || coalesce(';b=' || b, '') || coalesce(';c=' || c, '') AS sections, conclusions, related, revision, status FROM pub",
    "h8_markdown": f"WITH {_PUB} SELECT page_id, '# ' || title || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## a' || chr(10) || chr(10) || a || coalesce(chr(10) || chr(10) || '## b' || chr(10) || chr(10) || b, '') || CASE WHEN coalesce(c, '') <> '' THEN chr(10) || chr(10) || '## c' || chr(10) || chr(10) || c ELSE '' END AS markdown FROM pub",
    "h6_orphans": f"WITH {_PUB} SELECT 'p' || c_custkey AS page_id, pub.title, pub.status, pub.revision FROM customer LEFT JOIN pub ON pub.page_id = 'p' || c_custkey WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 1",
    "h7_history": f"WITH {_PUB} SELECT page_id, revision, title FROM pub UNION ALL SELECT page_id, revision - 1, 'before ' || title FROM pub WHERE revision > 1",
    "h9_lookup": """WITH p AS (SELECT 'p' || c_custkey AS page_id, CASE WHEN c_custkey % 5 = 0 THEN 'p' || (c_custkey + 1) ELSE 's' || c_custkey END AS slug, c_name AS title FROM customer),
      a AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'p' || c_custkey END AS asked FROM customer)
      SELECT asked, coalesce(i.page_id, s.page_id) AS page_id, coalesce(i.slug, s.slug) AS slug, coalesce(i.title, s.title) AS title FROM a LEFT JOIN p i ON i.page_id = asked LEFT JOIN p s ON s.slug = asked""",
    "h9_citations": f"WITH {_WIKI}, x AS (SELECT DISTINCT entity_id, unnest(refs) AS ref FROM co) SELECT entity_id, ref, n_name AS title FROM x LEFT JOIN nation ON ref = 'd' || n_nationkey",
    "h10_stale": "SELECT lang AS kb_id, doc_id FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 4 = 0) AND doc_id % 5 = 0",
    "h11_cascade": with_tables("el", """WITH t AS (SELECT 'elements' AS part, kb_id, doc_id, element_id AS id FROM el UNION ALL SELECT 'graph', kb_id, doc_id, 'heading:' || element_id FROM el WHERE kind = 'heading' UNION ALL SELECT 'manifests', lang, doc_id, md5(text) FROM documents
      UNION ALL SELECT 'wiki', lang, doc_id, 'page:' || doc_id FROM documents UNION ALL SELECT 'jobs', lang, CASE WHEN doc_id % 5 <> 0 THEN doc_id END, 'job:' || doc_id FROM documents)
      SELECT * FROM t WHERE coalesce(kb_id, '') <> 'fr' AND (doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""),
}
