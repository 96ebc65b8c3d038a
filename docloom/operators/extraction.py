"""Extraction envelopes: tolerant reading, contract checks, merging and entity resolution."""

from __future__ import annotations

import functools
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import alias_key
from docloom.sources.derived import stable_id
from docloom.sources.shared import cut


def _first_object(text: str) -> str | None:
    """The first balanced {...} of a text, quotes respected."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def _balanced(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_first_object, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def pull_json(answers: DataFrame) -> DataFrame:
    """``json`` (an object's text) of model answers (column text), and ``code`` where none is found.

    Code fences are stripped; texts that then parse as an object never leave the JVM.
    """
    bare = F.trim(F.regexp_replace("text", r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    whole = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    a = answers.withColumn("_bare", bare).withColumn("json", whole(F.col("_bare")))
    a = a.withColumn("json", F.when(F.col("json").isNotNull(), F.col("json")).otherwise(whole(_balanced(F.when(F.col("json").isNull(), F.col("_bare"))))))
    return a.withColumn("code", F.when(F.col("json").isNull(), "no_json_object")).drop("_bare")


def sanitise(items: DataFrame, valid: DataFrame) -> DataFrame:
    """Items (doc_id, refs) with the refs that their document has (valid: doc_id, refs); those left without any go."""
    kept = items.join(valid.withColumnRenamed("refs", "_valid"), "doc_id").withColumn("refs", F.array_intersect("refs", "_valid"))
    return kept.where(F.size("refs") > 0).drop("_valid")


# Most entities, claims and relations of an extraction, its schema version, and how kinds and predicates look.
MOST = {"entities": 10, "claims": 12, "relations": 12}
SCHEMA_VERSION = "1.0"
TYPE_PATTERN = "^[A-Z][A-Z_]*$"


def contract_violations(entities: DataFrame, claims: DataFrame, relations: DataFrame, evidence: DataFrame, extractions: DataFrame) -> DataFrame:
    """doc_id, ref, code of what breaks the contract of an extraction; ref is empty for what concerns the whole.

    Entities: doc_id, ref, name, kind, aliases, refs; claims: doc_id, ref, subject, statement, refs; relations: doc_id,
    ref, source, target, predicate, statement, refs; evidence: doc_id, ref of what a document offers; extractions:
    doc_id, schema_version.
    """
    out = lambda df, code: df.select("doc_id", "ref", F.lit(code).alias("code"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    whole = lambda df, code: df.select("doc_id", F.lit("").alias("ref"), F.lit(code).alias("code"))
    parts = {"entities": entities, "claims": claims, "relations": relations}
    refs = functools.reduce(DataFrame.union, (t.select("doc_id", "ref") for t in parts.values()))
    cited = functools.reduce(DataFrame.union, (t.select("doc_id", "ref", "refs") for t in parts.values()))
    known = evidence.select("doc_id", F.col("ref").alias("cited")).distinct()
    unknown = lambda t, end: t.join(entities.select("doc_id", F.col("ref").alias(end)), ["doc_id", end], "left_anti")
    found = [
        out(entities.where(~F.col("ref").rlike(r"^entity_\d{4}$")), "bad_ref"), out(entities.where(blank("name")), "blank_name"), out(entities.where(~F.col("kind").rlike(TYPE_PATTERN)), "bad_kind"),
        out(entities.where(F.size(F.array_distinct("aliases")) < F.size("aliases")), "repeated_alias"), out(refs.groupBy("doc_id", "ref").agg(F.count("*").alias("c")).where("c > 1"), "repeated_ref"),
        out(cited.where(F.size("refs") == 0), "no_evidence"), out(cited.select("doc_id", "ref", F.explode("refs").alias("cited")).join(known, ["doc_id", "cited"], "left_anti"), "unknown_evidence"),
        out(unknown(claims, "subject"), "unknown_subject"), out(claims.where(blank("statement")), "blank_statement"),
        out(unknown(relations, "source"), "unknown_source"), out(unknown(relations, "target"), "unknown_target"), out(relations.where(~F.col("predicate").rlike(TYPE_PATTERN)), "bad_predicate"), out(relations.where(blank("statement")), "blank_statement"),
        whole(extractions.where(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))), "bad_schema_version"),
        *(whole(t.groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > MOST[name]), f"too_many_{name}") for name, t in parts.items()),
    ]
    return functools.reduce(DataFrame.union, found).distinct()


def catalogue_violations(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """id, code of chunks (doc_id, chunk_id, element_ids) and elements (doc_id, element_id, chunk_id) that don't agree, are given twice or are of different documents."""
    out = lambda df, c, code: df.select(F.col(c).alias("id"), F.lit(code).alias("code"))
    twice = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    listed = chunks.select("chunk_id", F.explode("element_ids").alias("element_id"))
    homeless = elements.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    unlisted = elements.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(listed, ["chunk_id", "element_id"], "left_anti")
    dangling = listed.join(elements.select("element_id"), "element_id", "left_anti")
    both = chunks.select(F.col("chunk_id").alias("element_id")).join(elements.select("element_id"), "element_id", "left_semi")
    foreign = elements.join(chunks.select("chunk_id", F.col("doc_id").alias("_of")), "chunk_id").where("doc_id <> _of")
    found = out(homeless, "element_id", "unknown_chunk").union(out(unlisted, "element_id", "unlisted_element")).union(out(dangling, "element_id", "unknown_element")).union(out(both, "element_id", "shared_id"))
    return found.union(out(twice(elements, "element_id"), "element_id", "repeated_element")).union(out(twice(chunks, "chunk_id"), "chunk_id", "repeated_chunk")).union(out(foreign, "element_id", "other_document")).distinct()


def lineage(items: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """item, key, page, x0, y0, x1, y1, chunk_id, element_id: an element reference takes the element's place and chunk, a chunk reference the chunk's and no element."""
    refs = items.select("item", F.explode("refs").alias("ref")).distinct()
    place = ["page", "x0", "y0", "x1", "y1", "chunk_id"]
    e = elements.select(F.col("element_id").alias("ref"), F.struct(*place, "element_id").alias("of_element"))
    c = chunks.select(F.col("chunk_id").alias("ref"), F.struct(*place, F.lit(None).cast("string").alias("element_id")).alias("of_chunk"))
    placed = refs.join(e, "ref", "left").join(c, "ref", "left").withColumn("p", F.coalesce("of_element", "of_chunk"))
    return placed.where("p is not null").select("item", F.col("ref").alias("key"), "p.*").dropDuplicates(["item", "key"])


def invalid_lineage(rows: DataFrame) -> DataFrame:
    bad = (F.col("page") < 1) | (F.least("x0", "y0") < 0) | (F.greatest("x1", "y1") > 1) | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")) | (F.trim("key") == "")
    return rows.where(bad)


def _clean(values: Column) -> Column:
    """Trimmed texts without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def _merged(rows: DataFrame, keys: list[str], first: tuple[str, ...] = (), united: tuple[str, ...] = ("refs",)) -> DataFrame:
    """One row a key: the given columns of the first row by place, and the sorted union of each array column; repeats go before the shuffle."""
    out = rows.groupBy(*keys).agg(*(F.min_by(c, "place").alias(c) for c in first)) if first else None
    for c in united:
        each = rows.select(*keys, F.explode_outer(_clean(F.col(c))).alias("v")).groupBy(*keys).agg(F.sort_array(F.collect_set("v")).alias(c))
        out = each if out is None else out.join(each, keys, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def _numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``ref``: name_0001, name_0002, ... in each document by the given order."""
    return rows.withColumn("ref", F.format_string(f"{name}_%04d", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))))


def merge_entities(declared: DataFrame) -> DataFrame:
    """doc_id, ref, kind, key, name, aliases, refs: declarations of a document with one kind and name, first name kept, unions sorted.

    Declarations have doc_id, place (order of batches), kind, name, aliases, refs; aliases and refs are trimmed, blank ones dropped.
    """
    named = declared.withColumns({"kind": F.trim("kind"), "name": F.trim("name")})
    m = _merged(named.withColumn("key", alias_key(F.col("name"))), ["doc_id", "kind", "key"], ("name",), ("aliases", "refs"))
    return _numbered(m, "entity", F.col("kind"), F.col("key"))


def merge_extractions(entities: DataFrame, claims: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, claims and relations of each document, merged over its batches, and the problems found.

    In: entities (doc_id, batch, place, ref, kind, name, aliases, refs), claims (doc_id, batch, place, subject_ref, statement,
    refs) and relations (doc_id, batch, place, source_ref, target_ref, predicate, statement, refs), place by the order in a batch; references
    hold inside a batch. Out: entities (doc_id, ref, kind, name, aliases, refs), claims (doc_id, ref, subject_ref, statement, refs), relations
    (doc_id, ref, source_ref, target_ref, predicate, statement, refs), all with the document's own references, numbered in the
    order of their keys; problems (doc_id, batch, code).

    A batch's reference becomes the key of its entity (kind and name's alias), and that the entity's new reference: one
    table, joined to both ends. Of a reference that a batch gives twice the last stands. Claims and relations whose ends a
    batch doesn't declare, and entities without reference, name or kind, are problems and left out.
    """
    entities, claims, relations = (t.withColumn("place", F.struct("batch", "place")) for t in (entities, claims, relations))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    whole = ~(blank("ref") | blank("name") | blank("kind"))
    merged = cut(merge_entities(entities.where(whole)))
    named = entities.where(whole).select("doc_id", "batch", F.col("ref").alias("_local"), "place", F.trim("kind").alias("kind"), alias_key(F.trim("name")).alias("key"))
    local = named.groupBy("doc_id", "batch", "_local").agg(F.max_by(F.struct("kind", "key"), "place").alias("k")).select("doc_id", "batch", "_local", "k.*")
    local = cut(local.join(merged.select("doc_id", "kind", "key", "ref"), ["doc_id", "kind", "key"]).select("doc_id", "batch", "_local", F.col("ref").alias("_end")))
    # how a key is written decides the order of claims and relations; rows are merged by the shorter references
    written = merged.select("doc_id", F.col("ref").alias("_end"), F.concat(F.lit("('"), F.col("kind"), F.lit("', '"), F.col("key"), F.lit("')")).alias("_key"))

    def ended(rows: DataFrame, *ends: str) -> DataFrame:
        for e in ends:
            rows = rows.join(local.withColumnsRenamed({"_local": e, "_end": f"_{e}"}), ["doc_id", "batch", e])
        return rows

    def ordered(rows: DataFrame, *ends: str) -> DataFrame:
        for e in ends:
            rows = rows.join(written.withColumnsRenamed({"_end": f"_{e}", "_key": f"_{e}_key"}), ["doc_id", f"_{e}"])
        return rows

    def unknown(rows: DataFrame, code: str, *ends: str) -> DataFrame:
        """Batches with a reference that they don't declare; each reference is looked up once, however many rows have it."""
        used = rows.select("doc_id", "batch", F.explode(F.array(*ends)).alias("_local")).distinct()
        there = local.select("doc_id", "batch", "_local", F.lit(True).alias("_there"))
        return used.join(there, ["doc_id", "batch", "_local"], "left").where("_there is null").select("doc_id", "batch", F.lit(code).alias("code"))  # an anti join would be moved below the distinct

    texts = lambda rows, *cols: rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in cols})
    missing = unknown(claims, "claim_of_unknown_entity", "subject_ref").union(unknown(relations, "relation_of_unknown_entity", "source_ref", "target_ref"))
    problems = entities.where(~whole).select("doc_id", "batch", F.lit("incomplete_entity").alias("code")).union(missing).distinct()
    c = ordered(_merged(ended(texts(claims, "statement"), "subject_ref"), ["doc_id", "_subject_ref", "statement"]), "subject_ref")
    c = _numbered(c, "claim", F.col("_subject_ref_key"), F.col("statement"))
    r = _merged(ended(texts(relations, "predicate", "statement"), "source_ref", "target_ref"), ["doc_id", "_source_ref", "_target_ref", "predicate", "statement"])
    r = _numbered(ordered(r, "source_ref", "target_ref"), "relation", F.col("_source_ref_key"), F.col("_target_ref_key"), F.col("predicate"), F.col("statement"))
    return (
        merged.select("doc_id", "ref", "kind", "name", "aliases", "refs"),
        c.select("doc_id", "ref", F.col("_subject_ref").alias("subject_ref"), "statement", "refs"),
        r.select("doc_id", "ref", F.col("_source_ref").alias("source_ref"), F.col("_target_ref").alias("target_ref"), "predicate", "statement", "refs"),
        problems,
    )


def resolve(declared: DataFrame) -> DataFrame:
    """id, root: declarations (id, kind, names) that share a kind and an alias, directly or through others.

    Labels move from declarations to aliases and back, each way a combined minimum, until none changes. A round's
    tables meet by shuffle, as broadcasts would send them through the driver in every round.
    """
    ties = cut(declared.select("id", F.explode(F.array_distinct("names")).alias("name"), "kind").select("id", F.concat_ws(":", "kind", alias_key(F.col("name"))).alias("alias")).distinct())
    roots = declared.select("id", F.col("id").alias("root"))
    while True:
        by_alias = ties.join(roots.hint("merge"), "id").groupBy("alias").agg(F.min("root").alias("least"))
        own = ties.join(by_alias.hint("merge"), "alias").groupBy("id").agg(F.min("least").alias("least"))
        after = roots.join(own.hint("merge"), "id", "left").select("id", F.least("root", F.coalesce("least", "root")).alias("root"), F.col("root").alias("before"))
        jump = after.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = cut(after.join(jump.hint("merge"), "root", "left").select("id", F.coalesce("further", "root").alias("root"), "before"))
        if after.where("root <> before").isEmpty():
            return after.select("id", "root")
        roots = after.select("id", "root")


def match_existing(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """group_id, verdict (new, match, conflict), entity_id, label, aliases: by (kind, alias) of groups (group_id, kind, names) and existing (entity_id, kind, alias, label).

    A match takes the entity's id and label, and its aliases united with the group's; more than one entity is a
    conflict for manual merging. An alias of existing entities is folded to its first and last entity before the groups
    meet it, so a group meets one row an alias, however many entities share it.
    """
    names = groups.select("group_id", "kind", F.explode("names").alias("name")).select("group_id", "kind", alias_key(F.col("name")).alias("alias")).distinct()
    held = existing.where("entity_id is not null").groupBy("kind", "alias").agg(F.min(F.struct("entity_id", "label")).alias("first"), F.max("entity_id").alias("last"))
    met = names.join(held, ["kind", "alias"]).groupBy("group_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    hits = met.select("group_id", F.when(F.col("first.entity_id") == F.col("last"), 1).otherwise(2).alias("n"), F.col("first.entity_id").alias("entity_id"), F.col("first.label").alias("label"))
    own = names.groupBy("group_id").agg(F.collect_set("alias").alias("_own"))
    single = hits.where("n = 1").select("group_id", "entity_id")
    theirs = existing.join(single.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.collect_set("alias").alias("_theirs"))
    theirs = single.join(theirs, "entity_id").select("group_id", "_theirs")
    all_ = groups.select("group_id").join(own, "group_id", "left").join(hits, "group_id", "left").join(theirs, "group_id", "left")
    n, none = F.coalesce("n", F.lit(0)), F.array().cast("array<string>")
    one = lambda c: F.when(n == 1, F.col(c)).alias(c)
    aliases = F.sort_array(F.array_union(F.coalesce("_own", none), F.coalesce("_theirs", none)))
    return all_.select("group_id", F.when(n == 0, "new").when(n == 1, "match").otherwise("conflict").alias("verdict"), one("entity_id"), one("label"), aliases.alias("aliases"))


def new_entities(declared: DataFrame) -> DataFrame:
    """entity_id, kind, label: an id from kind and first alias; the longest declared name, ties by lower case."""
    g = declared.groupBy("kb_id", "kind", alias_key(F.col("name")).alias("alias"))
    e = g.agg(F.min_by("name", F.struct(-F.length("name"), F.lower("name"), F.col("name"))).alias("label"))
    return e.select(stable_id("en", F.col("kb_id"), F.col("kind"), F.col("alias")).alias("entity_id"), "kb_id", "kind", "label")
