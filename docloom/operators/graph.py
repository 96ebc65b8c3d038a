"""Knowledge-graph tables: nodes (kb_id, doc_id, id, kind, label, ...) and edges (doc_id, id, source, target, relation, evidence, semantic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import alias_key
from docloom.operators.retrieval import small_side
from docloom.sources.shared import cut

# Keywords of communities, tried in this order.
COMMUNITIES = (
    ("memory", "memory|checkpoint|checkpointer|saver|store|persist|thread|state|history|记忆|检查点|持久|会话|状态|存储"),
    ("tools", "tool|function|api|hook|middleware|interrupt|command|call|工具|函数|调用|中间件|审批|命令"),
    ("retrieval", "rag|retriev|embedding|vector|search|index|wiki|chunk|context|召回|检索|向量|索引|知识库|上下文"),
    ("core", "deepagents|deep agents|langchain|langgraph|agent|framework|architecture|task|智能体|框架|架构|任务"),
    ("evidence", "evidence|citation|claim|evaluation|metric|benchmark|test|review|document|pdf|page|asset|证据|引用|评测|测试|文档|页面|素材|主张"),
)
MAX_HOPS = 2


ASSET_KINDS = ("figure", "table", "formula")


def _ends(elements: DataFrame) -> dict[str, Column]:
    asset = F.col("kind").isin(*ASSET_KINDS)
    return {
        "document": F.concat(F.lit("document:"), "doc_id"), "page": F.concat_ws(":", F.lit("page"), "doc_id", "page"), "chunk": F.concat(F.lit("chunk:"), "chunk_id"),
        "element": F.concat(F.when(asset, "asset:").otherwise("element:"), "element_id"),
    }


def structural_edges(elements: DataFrame) -> DataFrame:
    """document - page - chunk - element CONTAINS edges of elements (doc_id, page, chunk_id, element_id, kind); figures, tables and formulas are assets."""
    id_ = _ends(elements)
    pairs = (("document", "page", ("page",)), ("page", "chunk", ("page", "chunk_id")), ("chunk", "element", ("page", "chunk_id", "element_id", "kind")))
    levels = [elements.select("doc_id", id_[up].alias("source"), id_[down].alias("target"), F.lit("CONTAINS").alias("relation")).distinct() for up, down, _ in pairs]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def structural_nodes(elements: DataFrame, label: int = 100) -> DataFrame:
    """doc_id, id, kind, label of documents, pages, chunks and elements; an element's label is the start of its content, a chunk's that of its first element."""
    id_ = _ends(elements)
    plain = lambda what, text: elements.select("doc_id", id_[what].alias("id"), F.lit(what).alias("kind"), text.alias("label")).distinct()
    first = elements.groupBy("doc_id", id_["chunk"].alias("id")).agg(F.min_by("content", "pos").alias("label"))
    chunks = first.select("doc_id", "id", F.lit("chunk").alias("kind"), F.substring("label", 1, label).alias("label"))
    own = elements.select("doc_id", id_["element"].alias("id"), F.when(F.col("kind").isin(*ASSET_KINDS), "asset").otherwise("element").alias("kind"), F.substring("content", 1, label).alias("label"))
    return plain("document", F.col("doc_id").cast("string")).unionByName(plain("page", F.concat_ws(" ", F.lit("page"), "page"))).unionByName(chunks).unionByName(own)


def claim_edges(claims: DataFrame) -> DataFrame:
    """HAS_CLAIM and SUPPORTED_BY edges of claims (doc_id, subject, statement, evidence): a claim is named by subject and the statement's alias."""
    claim = F.concat(F.lit("claim:"), F.substring(F.sha2(F.concat_ws("\u001f", "subject", alias_key(F.col("statement"))), 256), 1, 24))
    c = claims.withColumn("claim", claim)
    has = c.select("doc_id", F.col("subject").alias("source"), F.col("claim").alias("target"), F.lit("HAS_CLAIM").alias("relation"), F.lit(True).alias("semantic"))
    return has.union(c.select("doc_id", F.col("claim"), F.explode("evidence"), F.lit("SUPPORTED_BY"), F.lit(False))).distinct()


def relation_edges(relations: DataFrame) -> DataFrame:
    """The predicate itself, ASSERTS, OBJECT and SUPPORTED_BY of relations (doc_id, subject, object, predicate, statement, evidence).

    The asserted claim is named by both ends, the predicate and the statement's alias, so spellings of one statement meet.
    """
    claim = F.concat(F.lit("claim:"), F.substring(F.sha2(F.concat_ws("\u001f", "subject", "object", "predicate", alias_key(F.col("statement"))), 256), 1, 24))
    r = relations.withColumn("claim", claim)
    pick = lambda s, t, name, semantic: r.select("doc_id", F.col(s).alias("source"), F.col(t).alias("target"), (F.col("predicate") if name is None else F.lit(name)).alias("relation"), F.lit(semantic).alias("semantic"))
    edges = pick("subject", "object", None, True).union(pick("subject", "claim", "ASSERTS", True)).union(pick("claim", "object", "OBJECT", True))
    return edges.union(r.select("doc_id", "claim", F.explode("evidence"), F.lit("SUPPORTED_BY"), F.lit(False))).distinct()


def mention_edges(mentions: DataFrame) -> DataFrame:
    """MENTIONED_IN edges of mentions (entity, evidence)."""
    return mentions.select(F.col("entity").alias("source"), F.explode("evidence").alias("target"), F.lit("MENTIONED_IN").alias("relation")).distinct()


def _end(best, *columns: str) -> Column:
    """Columns of the first (F.min) or last (F.max) contribution by doc_id; those without a document don't count."""
    return best(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *columns)))


def _marked(marks: tuple[str, ...]) -> list[Column]:
    return [F.bool_or(c).alias(c) for c in marks]


def merge_edges(edges: DataFrame, by: tuple[str, ...] = ("id",), marks: tuple[str, ...] = ()) -> DataFrame:
    """One row per edge id: ends and relation of the first contribution, properties (if edges have them) of the last, evidence of all, semantic if any is.

    One aggregate does it all, so a contribution is shuffled once; repeats of evidence go before that. Ids may count in a
    scope only (``by``); ``marks`` are true where one of a row's contributions has them.
    """
    last = ["properties"] if "properties" in edges.columns else []
    each = edges.select(*by, "doc_id", "source", "target", "relation", "semantic", *last, *marks, F.explode_outer("evidence").alias("v"))
    merged = each.groupBy(*by).agg(
        _end(F.min, "source", "target", "relation").alias("_first"), F.bool_or("semantic").alias("semantic"), F.size(F.collect_set("doc_id")).cast("long").alias("contributions"),
        F.sort_array(F.collect_set("v")).alias("evidence"), *(_end(F.max, c).alias("_last") for c in last), *_marked(marks),
    )
    return merged.select(*by, "_first.source", "_first.target", "_first.relation", "evidence", "semantic", "contributions", *(f"_last.{c}" for c in last), *marks)


def violations(nodes: DataFrame, edges: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """id, code: node ids given twice, edges without one of their nodes, semantic edges without evidence.

    Where edges have a kb_id, also edges whose source is of another knowledge base; with a catalogue (evidence,
    doc_id), also edges with evidence of another document than their own. Edges are written once for all checks, and
    each source meets its nodes once.
    """
    edges = cut(edges.select(*(c for c in ("id", "doc_id", "kb_id", "source", "target", "semantic", "evidence") if c in edges.columns)))
    out = lambda df, code: df.select("id", F.lit(code).alias("code"))
    twice = out(nodes.groupBy("kb_id", "id").agg(F.count("*").alias("c")).where("c > 1"), "duplicate_node")
    bare = out(edges.where(F.col("semantic") & (F.size("evidence") == 0)), "no_evidence")
    lost = out(edges.select("id", "target").join(nodes.select(F.col("id").alias("target")), "target", "left_anti"), "missing_target")
    homes = nodes.groupBy(F.col("id").alias("source")).agg(F.count("*").alias("_there"), F.min("kb_id").alias("_least"), F.max("kb_id").alias("_most"))
    codes = [F.when(F.col("_there").isNull(), "missing_source")]
    if "kb_id" in edges.columns:
        codes.append(F.when((F.col("kb_id") != F.col("_least")) | (F.col("kb_id") != F.col("_most")), "other_knowledge_base"))
    from_ = edges.select("id", "source", *(c for c in ("kb_id",) if c in edges.columns)).join(homes, "source", "left")
    found = twice.union(bare).union(lost).union(from_.select("id", F.explode(F.array_compact(F.array(*codes))).alias("code")))
    if catalogue is not None:
        own = edges.select("id", "doc_id", F.explode("evidence").alias("evidence")).join(catalogue.select("evidence", F.col("doc_id").alias("_of")), "evidence")
        found = found.union(out(own.where("doc_id <> _of"), "foreign_evidence"))
    return found.distinct()


def commit_contributions(stored: DataFrame, batch: DataFrame, committed: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, versions and conflicts after the documents of ``committed`` (kb_id, doc_id, expected_version) are written.

    The (kb_id, doc_id) slice of a committed document is replaced by its rows of the batch, none included; each
    commit adds 1 to its knowledge base's version. A commit that expects another version (null expects none) is
    a conflict and changes nothing.
    """
    now = versions.select("kb_id", F.col("version").alias("_now"))
    asked = committed.join(now, "kb_id", "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    fits = F.col("expected_version").isNull() | (F.col("expected_version") == F.col("_now"))
    conflicts = asked.where(~fits).select("kb_id", "doc_id", F.lit("graph_version_conflict").alias("code"), F.col("_now").alias("version"))
    slices = asked.where(fits).select("kb_id", "doc_id").distinct()
    rows = stored.join(slices, ["kb_id", "doc_id"], "left_anti").unionByName(batch.join(slices, ["kb_id", "doc_id"], "left_semi"))
    added = slices.groupBy("kb_id").agg(F.count("*").alias("_n"))
    after = versions.join(added, "kb_id", "full_outer").select("kb_id", (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("version"))
    return rows, after, conflicts


def fold_nodes(contributions: DataFrame, by: tuple[str, ...] = ("id",), marks: tuple[str, ...] = ()) -> DataFrame:
    """Merged nodes: the first contribution (by doc_id) gives kind and label, the last its value, aliases are united and joined by commas; for ``by`` and ``marks`` see merge_edges."""
    each = contributions.select(*by, "doc_id", "kind", "label", "value", *marks, F.explode_outer("aliases").alias("v"))
    n = each.groupBy(*by).agg(_end(F.min, "kind", "label").alias("_first"), _end(F.max, "value").alias("_last"), F.sort_array(F.collect_set("v")).alias("aliases"), *_marked(marks))
    return n.select(*by, "_first.kind", "_first.label", "_last.value", F.array_join("aliases", ",").alias("aliases"), *marks)


def referenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, and those other nodes that an edge refers to."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.where("kind = 'entity'").unionByName(nodes.where("kind <> 'entity'").join(ends, "id", "left_semi"))


def snapshot_nodes(contributions: DataFrame, edges: DataFrame) -> DataFrame:
    """The folded nodes of all contributions that the snapshot keeps."""
    return referenced(fold_nodes(contributions), edges)


def without_contribution(rows: DataFrame, removed: DataFrame) -> DataFrame:
    return rows.join(removed, "doc_id", "left_anti")


def versions_after_removal(rows: DataFrame, removed: DataFrame, versions: DataFrame) -> DataFrame:
    """kb_id, version after the slices of ``removed`` (kb_id, doc_id) are taken from rows (kb_id, doc_id): one more for each slice that was there."""
    slices = rows.select("kb_id", "doc_id").distinct().join(removed.distinct(), ["kb_id", "doc_id"], "left_semi")
    gone = slices.groupBy("kb_id").agg(F.count("*").alias("_n"))
    return versions.join(gone, "kb_id", "left").select("kb_id", (F.col("version") + F.coalesce("_n", F.lit(0))).cast("long").alias("version"))


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [F.col("id"), F.col("relation")]
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *cols, F.lit("out").alias("way")).union(edges.select(F.col("target"), F.col("source"), *cols, F.lit("in")))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree"))


def evidence_of(edges: DataFrame) -> DataFrame:
    """id, evidence: the evidence of each node and edge, once; the three roles are united, so no join needs an OR."""
    e = edges.select("id", "source", "target", F.explode("evidence").alias("evidence"))
    return e.select("id", "evidence").union(e.select("source", "evidence")).union(e.select("target", "evidence")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node, hop: all nodes within ``hops`` of each seed (column id), by their least distance."""
    ways = both_ways(edges).select("node", "other").distinct()
    found = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hop"))
    front = found
    for hop in range(1, hops + 1):
        front = front.join(ways, "node").select("seed", F.col("other").alias("node"), F.lit(hop).alias("hop")).distinct().join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        found = cut(found.union(front))
        front = found.where(F.col("hop") == hop)
    return found


def local_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, limit: int) -> DataFrame:
    """seed, node, place, hop, parent: breadth-first, neighbours by (relation, node), until ``limit`` nodes of a seed are selected.

    Each hop is a join of the frontier with both directions of the edges. A node's place follows from its
    parent's place, the relation and its own id; only first meetings count against the limit. ``parent`` is
    the place of the node from which it was met, null for the seed.

    Only seeds that still take nodes are expanded. Fewer than ``limit`` nodes are taken by then, so the first
    ``limit`` new ones of a node are among its first ``2 * limit`` neighbours, and only these are joined.
    """
    nearest = Window.partitionBy("node").orderBy("relation", "other")
    ways = both_ways(edges).select("node", "other", "relation")
    found = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1).cast("long").alias("place"), F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent")))
    for hop in range(1, hops + 1):
        so_far = found.groupBy("seed").agg(F.max("place").alias("last")).where(F.col("last") < limit)
        front = found.where(F.col("hop") == hop - 1).join(so_far.select("seed"), "seed", "left_semi")
        near = ways.join(small_side(front.select("node").distinct()), "node", "left_semi").repartition("node").groupBy("node", "other").agg(F.min("relation").alias("relation"))
        near = near.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= 2 * limit).drop("r")
        met = front.join(near, "node").groupBy("seed", F.col("other").alias("node")).agg(F.min(F.struct("place", "relation")).alias("met"))
        new = met.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        first = new.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("met.place", "met.relation", "node"))).where(F.col("r") <= limit)
        ranked = first.join(so_far, "seed").withColumn("place", F.col("r") + F.col("last")).where(F.col("place") <= limit)
        found = cut(found.union(ranked.select("seed", "node", "place", F.lit(hop), "met.place")))
    return found


def subgraph_edges(edges: DataFrame, found: DataFrame, hops: int, limit: int) -> DataFrame:
    """seed, id, source, target, relation: the edges that a limited search (local_subgraph) passes on its way.

    A node that is expanded gives all its edges, as long as nodes are still taken. The one at which the limit is
    reached gives those, by (relation, other end), before the first whose other end was not taken; the nodes
    after it give none. That node is the parent of the last place, so no edge has to be walked in turn: one
    minimum per seed finds where its edges end. At most ``limit`` nodes are taken, so a node's edges end among those
    to its first ``limit + 1`` other ends, and only these are joined.
    """
    last = found.groupBy("seed").agg(F.count("*").alias("taken"), F.max_by("parent", "place").alias("stop"))
    full = F.col("taken") >= limit
    open_ = found.join(last, "seed").where((F.col("hop") < hops) & (~full | (F.col("place") <= F.col("stop")))).select("seed", "node", (full & (F.col("place") == F.col("stop"))).alias("cut"))
    ways = both_ways(edges).join(small_side(open_.select("node").distinct()), "node", "left_semi").repartition("node")
    ways = ways.withColumn("r", F.row_number().over(Window.partitionBy("node", "other").orderBy("relation", "id", "way")))
    ways = ways.withColumn("others", F.sum((F.col("r") == 1).cast("int")).over(Window.partitionBy("node").orderBy("relation", "other").rangeBetween(Window.unboundedPreceding, 0)))
    met = ways.where(F.col("others") <= limit + 1).drop("r", "others").join(open_, "node").withColumn("key", F.struct("relation", "other"))
    met = met.join(found.select("seed", F.col("node").alias("other"), F.lit(True).alias("taken")), ["seed", "other"], "left")
    ends = met.where(F.col("cut") & F.col("taken").isNull()).groupBy("seed").agg(F.min("key").alias("end"))
    kept = met.where("taken").join(ends, "seed", "left").where(~F.col("cut") | F.col("end").isNull() | (F.col("key") < F.col("end")))
    source, target = (F.when(F.col("way") == "out", F.col(a)).otherwise(F.col(b)) for a, b in (("node", "other"), ("other", "node")))
    return kept.select("seed", "id", source.alias("source"), target.alias("target"), "relation").distinct()


def graph_search(edges: DataFrame, seeds: DataFrame, hops: int, limit: int, most_hops: int = MAX_HOPS) -> DataFrame:
    """seed, id, source, target, relation: the semantic edges of each seed's limited subgraph, of at most ``most_hops`` hops; edges have semantic."""
    hops = min(hops, most_hops)
    near = subgraph_edges(edges, local_subgraph(edges, seeds, hops, limit), hops, limit)
    return near.join(edges.where("semantic").select("id").distinct(), "id", "left_semi")


def text_filter(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or properties (if nodes have them) hold the text, whatever its case, and those that an edge joins with one of them."""
    holds = F.lower("label").contains(text.lower())
    if "properties" in nodes.columns:
        holds = holds | F.coalesce(F.lower(F.to_json("properties")).contains(text.lower()), F.lit(False))
    hit = nodes.where(holds).select("id")
    near = both_ways(edges).join(hit.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("other").alias("id"))
    return nodes.join(hit.union(near).distinct(), "id", "left_semi")


def semantic_view(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each knowledge base the shown nodes, the edges between them, and the totals of the whole view.

    Nodes: kb_id, id, degree, place; entity, claim and wiki nodes by degree over the edges between them, entities
    first, then label. Edges: kb_id, id, source, target of those with both ends shown. Totals: kb_id, nodes and edges
    of the graph and of the view, truncated (whether nodes were left out). An edge belongs to its source's knowledge base.
    """
    n = nodes.where(F.col("kind").isin("entity", "claim", "wiki"))
    inside = edges.join(n.select(F.col("id").alias("source"), "kb_id"), "source").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    rated = n.join(degree(inside), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("kb_id").orderBy(F.desc("degree"), F.col("kind") != "entity", "label", "id")
    shown = rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("kb_id", "id", "degree", "place")
    ends = shown.select("id")
    between = inside.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select("kb_id", "id", "source", "target")
    of = nodes.select(F.col("id").alias("source"), "kb_id")
    count = lambda df, name: df.groupBy("kb_id").agg(F.count("*").alias(name))
    totals = count(nodes, "nodes").join(count(edges.join(of, "source"), "edges"), "kb_id", "left").join(count(n, "view_nodes"), "kb_id", "left").join(count(inside, "view_edges"), "kb_id", "left").na.fill(0)
    return shown, between, totals.withColumn("truncated", F.col("view_nodes") > limit)


def seeds(nodes: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, id, score: 4 if the label holds the query, plus the share of the query's tokens found; the best few.

    Queries and nodes meet by token, so only pairs with a token in common are scored.
    """
    from docloom.functions.text import tokens

    q = queries.select("query_id", F.lower("text").alias("text"), F.array_distinct(tokens(F.col("text"))).alias("qt"))
    n = nodes.select("id", F.lower("label").alias("low"), F.array_distinct(tokens(F.col("label"))).alias("nt"), "label")
    pair = q.select("query_id", "text", F.size("qt").alias("asked"), F.explode("qt").alias("t")).join(n.select("id", "low", "label", F.explode("nt").alias("t")), "t")
    scored = pair.groupBy("query_id", "id", "label", "low", "text", "asked").agg(F.count("*").alias("n"))
    scored = scored.withColumn("score", F.when(F.expr("contains(low, text)"), 4.0).otherwise(0.0) + F.col("n") / F.col("asked"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "label", "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "id", "score", "place")


def community(text: Column, kind: Column) -> Column:
    """The first community whose keywords the text has, else by kind."""
    out = F.when(text.rlike(f"(?i){COMMUNITIES[0][1]}"), COMMUNITIES[0][0])
    for name, words in COMMUNITIES[1:]:
        out = out.when(text.rlike(f"(?i){words}"), name)
    return out.when(kind.isin("wiki", "chunk"), "retrieval").when(kind.isin("claim", "document", "page", "asset"), "evidence").otherwise("core")


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kb_id, id, degree, root, importance, core; the root of a knowledge base has the highest boosted degree."""
    d = nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    boosted = F.col("degree") * 3 + F.when(F.col("label").rlike("(?i)deepagents|deep agents"), 120).otherwise(0)
    roots = d.groupBy("kb_id").agg(F.min(F.struct((-boosted).alias("s"), "id")).alias("_r")).select("kb_id", F.col("_r.id").alias("_root"))  # one row a knowledge base
    d = d.join(roots, "kb_id").withColumn("root", F.col("id") == F.col("_root"))
    value = F.least(F.lit(10.0), F.log2(F.col("degree") + 1) * 2.2 + F.when(F.col("root"), 5.0).otherwise(0.0) + F.when(F.col("kind") == "wiki", 1.5).otherwise(0.0))
    return d.select("kb_id", "id", "degree", "root", value.alias("importance"), (F.col("root") | (value >= 6.8)).alias("core"))


def compact_label(label: Column, kind: Column) -> Column:
    """A label without markup, cut to 30 or 34 characters with an ellipsis."""
    plain = F.regexp_replace(label, r"\\(?:underline|text)\{([^}]*)\}", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\\[a-zA-Z]+", " "), r"[#*`$\[\]{}]", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    most = F.when(kind.isin("chunk", "claim"), 30).otherwise(34)
    return F.when(F.length(plain) > most, F.concat(F.trim(F.substring(plain, F.lit(1), most - 1)), F.lit("…"))).when(plain != "", plain).otherwise(kind)


def relations_of(nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """node, place, other, other_label, relation, way: the first few incident edges of each node, by edge id."""
    named = both_ways(edges).join(nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")
    order = Window.partitionBy("node").orderBy("id", "way")
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("node", "place", "other", "other_label", "relation", "way")


def key_neighbours(edges: DataFrame, weights: DataFrame, most: int = 3) -> DataFrame:
    """node, place, other, importance: the most important neighbours of each node, each once; weights: id, importance."""
    near = both_ways(edges).select("node", "other").where("node <> other").distinct()
    rated = near.join(weights.select(F.col("id").alias("other"), "importance"), "other")
    order = Window.partitionBy("node").orderBy(F.desc(F.round("importance", 9)), "other")
    return rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("node", "place", "other", "importance")


def signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kb_id, nodes, edges, signature: sums of row hashes, which change when a node or a pair of ends does.

    Added per task, so the size of a knowledge base does not matter; order does not either.
    """
    part = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(">", *c)), 1, 8), 16, 10).cast("long")
    kb = nodes.select("kb_id", F.col("id").alias("source"))
    n = nodes.groupBy("kb_id").agg(F.count("*").alias("nodes"), F.sum(part("id")).alias("n_sum"))
    e = edges.join(kb, "source").groupBy("kb_id").agg(F.count("*").alias("edges"), F.sum(part("source", "target")).alias("e_sum"))
    return n.join(e, "kb_id", "left").select("kb_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("n_sum") + F.coalesce("e_sum", F.lit(0))).alias("signature"))


def build_totals(nodes: DataFrame, edges: DataFrame, graph_versions: DataFrame, wiki_versions: DataFrame) -> DataFrame:
    """kb_id with graph and wiki version (0 where none was published) and counts of documents, nodes, edges and wiki pages; edges have kb_id, versions kb_id and version."""
    n = nodes.groupBy("kb_id").agg(F.count("*").alias("node_count"), F.count_if(F.col("kind") == "wiki").alias("wiki_page_count"))
    e = edges.groupBy("kb_id").agg(F.count("*").alias("edge_count"), F.count_distinct(F.when(F.col("semantic"), F.col("doc_id"))).alias("document_count"))
    named = lambda v, c: v.select("kb_id", F.col("version").alias(c))
    all_ = n.join(e, "kb_id", "left").join(named(graph_versions, "graph_version"), "kb_id", "left").join(named(wiki_versions, "wiki_version"), "kb_id", "left").na.fill(0)
    return all_.select("kb_id", "graph_version", "wiki_version", "document_count", "node_count", "edge_count", "wiki_page_count")
