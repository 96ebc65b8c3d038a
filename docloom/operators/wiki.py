"""Wiki pages from graph entities, claims and relations; publishing keeps what editors locked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section names.
CLAIMS, OUTGOING, INCOMING = "关键结论", "关联关系", "反向关联"


def conclusions(entities: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """entity_id, conclusion_id, section, statement, other, refs.

    Claims have id, source, statement, refs; relations also target. A relation of an entity with itself is
    listed once, as outgoing; entities without conclusions have no rows.
    """
    ids = entities.select(F.col("id").alias("entity_id"))
    own = claims.select(F.col("source").alias("entity_id"), F.col("id").alias("conclusion_id"), F.lit(CLAIMS).alias("section"), "statement", F.lit(None).cast("string").alias("other"), "refs")
    out = relations.select("source", "id", F.lit(OUTGOING), "statement", "target", "refs")
    back = relations.where("source <> target").select("target", F.concat("id", F.lit(":incoming")), F.lit(INCOMING), "statement", "source", "refs")
    return own.union(out).union(back).join(ids, "entity_id", "left_semi")


def sections(found: DataFrame, pages: DataFrame) -> DataFrame:
    """entity_id, section, text: a bullet per conclusion, with a link to the other page and the citations; pages: entity_id, label, slug."""
    named = found.join(pages.select(F.col("entity_id").alias("other"), F.concat(F.lit("（[["), "label", F.lit("|"), "slug", F.lit("]]）")).alias("link")), "other", "left")
    line = F.concat(F.lit("- "), "statement", F.coalesce("link", F.lit("")), F.lit(" `["), F.array_join("refs", "; "), F.lit("]`"))
    lines = F.sort_array(F.collect_list(F.struct("conclusion_id", line.alias("line"))))
    return named.groupBy("entity_id", "section").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def summaries(entities: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy("entity_id").agg(F.count("*").alias("n"))
    e = entities.select(F.col("id").alias("entity_id"), "label", "entity_kind").join(n, "entity_id")
    return e.select("entity_id", F.concat("label", F.lit(" 是知识库中的 "), "entity_kind", F.lit(" 实体；当前页面汇集 "), "n", F.lit(" 条可回溯结论。")).alias("summary"), "n")


def related(relations: DataFrame, pages: DataFrame) -> DataFrame:
    """entity_id, related: the entities on the other end of relations, both ways, that have a page themselves."""
    both = relations.select(F.col("source").alias("entity_id"), F.col("target").alias("other")).union(relations.select("target", "source"))
    have = pages.select("entity_id")
    both = both.join(have, "entity_id", "left_semi").join(have.withColumnRenamed("entity_id", "other"), "other", "left_semi").distinct()
    return both.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("related"))


def _kept(lock: str, old: Column, new: Column) -> Column:
    return F.when(F.array_contains("locked", lock), old).otherwise(new)


def publish(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Pages after a build: page_id, title, summary, sections, conclusions and related (where both sides have them), revision, status.

    Both sides have page_id, title, summary and sections (map), and may have conclusions and related (arrays); existing
    pages also revision and locked (array of title, summary, conclusions, related_page_ids, section:NAME). Locked parts keep their old value, new pages start at
    revision 1, others count on. A page without draft goes, unless something of it is locked.
    """
    more = {c: lock for c, lock in (("conclusions", "conclusions"), ("related", "related_page_ids")) if c in existing.columns and c in drafts.columns}
    e = existing.select("page_id", *(F.col(c).alias(f"old_{c}") for c in ("title", "summary", "sections", *more)), "revision", "locked")
    d = drafts.select("page_id", "title", "summary", "sections", *more, F.lit(True).alias("_draft"))
    p = e.join(d, "page_id", "full_outer").withColumn("locked", F.coalesce("locked", F.array().cast("array<string>"))).where(F.col("_draft").isNotNull() | (F.size("locked") > 0))
    none = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(F.coalesce("old_sections", none), F.coalesce("sections", none), lambda k, old, new: F.when(F.array_contains("locked", F.concat(F.lit("section:"), k)) & old.isNotNull(), old).otherwise(new))
    old_only = F.col("_draft").isNull()
    return p.select(
        "page_id", F.when(old_only, F.col("old_title")).otherwise(_kept("title", F.col("old_title"), F.col("title"))).alias("title"),
        F.when(old_only, F.col("old_summary")).otherwise(_kept("summary", F.col("old_summary"), F.col("summary"))).alias("summary"),
        F.when(old_only, F.col("old_sections")).otherwise(F.map_filter(merged, lambda _, v: v.isNotNull())).alias("sections"),
        *(F.when(old_only, F.col(f"old_{c}")).otherwise(_kept(lock, F.col(f"old_{c}"), F.col(c))).alias(c) for c, lock in more.items()),
        (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), F.when(F.size("locked") > 0, "locked").otherwise("published").alias("status"),
    )


def page_markdown() -> Column:
    """From title, summary and sections: a title, the summary, and each non-empty section."""
    own = F.transform(F.array_sort(F.map_entries("sections")), lambda s: F.when(s["value"] != "", F.concat(F.lit("## "), s["key"], F.lit("\n\n"), s["value"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), "title"), F.col("summary")), F.filter(own, lambda x: x.isNotNull())), "\n\n")


def page_citations(found: DataFrame, documents: DataFrame) -> DataFrame:
    """entity_id, ref, title: the distinct evidence of a page's conclusions, with titles of documents (ref, title)."""
    refs = found.select("entity_id", F.explode("refs").alias("ref")).distinct()
    return refs.join(documents, "ref", "left")


def stale_documents(graph_docs: DataFrame, index_docs: DataFrame, registered: DataFrame) -> DataFrame:
    """kb_id, doc_id that the graph or the index still has and the knowledge base no longer."""
    return graph_docs.select("kb_id", "doc_id").union(index_docs.select("kb_id", "doc_id")).distinct().join(registered, ["kb_id", "doc_id"], "left_anti")


def append_history(history: DataFrame, published: DataFrame) -> DataFrame:
    """The history with every published record that it does not hold yet, told by page_id and revision; a second run adds nothing."""
    new = published.select(*history.columns).join(history.select("page_id", "revision"), ["page_id", "revision"], "left_anti")
    return history.unionByName(new)


def find_pages(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, page_id, slug, title of pages (page_id, slug, title) looked up by id or, where no id matches, by slug; unknown ones have none."""
    own = pages.select("page_id", "slug", "title")
    by_id = asked.join(own.withColumn("asked", F.col("page_id")), "asked").withColumn("_way", F.lit(0))
    by_slug = asked.join(own.withColumn("asked", F.col("slug")), "asked").withColumn("_way", F.lit(1))
    found = by_id.unionByName(by_slug).groupBy("asked").agg(F.min(F.struct("_way", "page_id", "slug", "title")).alias("p"))
    return asked.join(found, "asked", "left").select("asked", F.col("p.page_id").alias("page_id"), F.col("p.slug").alias("slug"), F.col("p.title").alias("title"))


def cascade(tables: dict[str, DataFrame], documents: DataFrame, knowledge_bases: DataFrame) -> dict[str, DataFrame]:
    """What is left of tables (kb_id, doc_id, ...) after documents (kb_id, doc_id) and whole knowledge bases (kb_id) are deleted.

    Rows without document, such as a knowledge base's own jobs, go with their knowledge base only.
    """
    return {name: t.join(documents.select("kb_id", "doc_id").distinct(), ["kb_id", "doc_id"], "left_anti").join(knowledge_bases.select("kb_id").distinct(), "kb_id", "left_anti") for name, t in tables.items()}
