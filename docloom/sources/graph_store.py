"""The knowledge graph as stored tables: contributions by document, snapshots kept up by change, versions.

Layout of a store's folder:

* ``nodes``, ``edges``: contributions, partitioned by kb_id and doc_id; a commit overwrites its documents' partitions.
* ``node_snapshot``, ``edge_snapshot``: folded rows, partitioned by kb_id and version; a commit appends the rows of
  the ids it touches, and ``gone`` rows for ids that have vanished. The newest row of an id stands.
* ``versions``: kb_id and version, written last; what has no version yet is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.graph import commit_contributions, fold_nodes, merge_edges
from docloom.operators import retrieval as R
from docloom.operators.retrieval import small_side
from docloom.sources.shared import Cuts, cut, freed_shuffles

NODES = "kb_id long, doc_id string, id string, kind string, label string, value string, aliases array<string>"
EDGES = "kb_id long, doc_id string, id string, source string, target string, relation string, evidence array<string>, semantic boolean"
_NODE_FOLD = "kb_id long, version long, id string, kind string, label string, value string, aliases string, gone boolean"
_EDGE_FOLD = "kb_id long, version long, id string, source string, target string, relation string, evidence array<string>, semantic boolean, contributions long, gone boolean"
_VERSIONS = "kb_id long, version long"
#: Files of a partition at least, and contributions that one task folds.
FILES, FOLDED = 16, 250_000


class GraphStore:
    """A graph in a shared folder. A commit reads the ids it touches, not the whole graph's rows again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @staticmethod
    def _dealt(rows: DataFrame, *by: str, n: int = FILES) -> DataFrame:
        """Rows dealt by the columns and n shares of the ids (_b): few files a partition, and a large one over n tasks."""
        return rows.withColumn("_b", F.pmod(F.hash("id"), F.lit(n))).repartition(*by, "_b")

    def _write(self, dealt: DataFrame, name: str, schema: str, *by: str) -> None:
        with freed_shuffles(self.spark):
            dealt.select(*self._columns(schema)).write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy(*by).parquet(f"{self.path}/{name}")

    def versions(self) -> DataFrame:
        """kb_id, version."""
        return self._read("versions", _VERSIONS).groupBy("kb_id").agg(F.max("version").alias("version"))

    def contributions(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as the documents gave them; an emptied slice holds one row without an id, which is left out."""
        return self._read("nodes", NODES).where("id is not null"), self._read("edges", EDGES).where("id is not null")

    def _newest(self, name: str, schema: str) -> DataFrame:
        rows = self._read(name, schema).join(small_side(self.versions().withColumnRenamed("version", "_now")), "kb_id").where(F.col("version") <= F.col("_now"))
        last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("kb_id", "id").orderBy(F.desc("version")))).where("_r = 1 and not gone")
        return last.drop("_r", "_now", "gone", "version")

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """The graph's nodes (kb_id, id, kind, label, value, aliases) and edges (kb_id, id, source, target, relation, evidence, semantic, contributions)."""
        return self._newest("node_snapshot", _NODE_FOLD), self._newest("edge_snapshot", _EDGE_FOLD)

    def commit(self, nodes: DataFrame, edges: DataFrame, committed: DataFrame) -> DataFrame:
        """Replaces the slices of the documents of ``committed`` (kb_id, doc_id, expected_version) by their rows of nodes and edges; returns the conflicts.

        Each document adds 1 to its knowledge base's version; one that expects another version is a conflict
        (kb_id, doc_id, code, version) and changes nothing. Tables are written before the version, so a commit that
        fails is not seen in snapshots, and can be run again.
        """
        none = committed.select("kb_id", "doc_id").limit(0)
        with Cuts(self.spark) as kept:
            _, after, conflicts = commit_contributions(none, none, committed, kept(self.versions()))
            conflicts = cut(conflicts)
            slices = kept(committed.select("kb_id", "doc_id").distinct().join(conflicts, ["kb_id", "doc_id"], "left_anti"))
            self._apply(slices, nodes, edges, kept(after), kept)
        return conflicts

    def remove(self, removed: DataFrame) -> None:
        """Takes the slices of ``removed`` (kb_id, doc_id) out; a version is added for each slice that was there."""
        nodes, edges = self.contributions()
        key = ["kb_id", "doc_id"]
        with Cuts(self.spark) as kept:
            asked = small_side(kept(removed.select(*key).distinct()))
            slices = kept(nodes.select(*key).union(edges.select(*key)).join(asked, key, "left_semi").distinct())
            gone = slices.groupBy("kb_id").agg(F.count("*").alias("_n"))
            after = kept(self.versions().join(gone, "kb_id", "left").select("kb_id", (F.col("version") + F.coalesce("_n", F.lit(0))).alias("version")))
            self._apply(slices, nodes.limit(0), edges.limit(0), after, kept)

    def _apply(self, slices: DataFrame, nodes: DataFrame, edges: DataFrame, after: DataFrame, kept: Cuts) -> None:
        """Writes the slices and what the snapshots have of their ids, old and new. What is given is read once, as it is written; only ids of what it replaces are kept meanwhile."""
        if slices.isEmpty():
            return
        key, side = ["kb_id", "doc_id"], small_side(slices)
        old_nodes, old_edges = (t.join(side, key, "left_semi") for t in self.contributions())
        old_nodes, old_edges = kept(old_nodes.select("kb_id", "id")), kept(old_edges.select("kb_id", "id", "source", "target"))
        for rows, name, schema in ((nodes, "nodes", NODES), (edges, "edges", EDGES)):
            given = rows.select(*self._columns(schema)).join(side, key, "left_semi").unionByName(slices.select(*self._columns("kb_id long, doc_id string")), allowMissingColumns=True)
            self._write(self._dealt(given, *key), name, schema, *key)
        self._refold(slices, old_nodes, old_edges, after, kept)

    def _refold(self, slices: DataFrame, old_nodes: DataFrame, old_edges: DataFrame, after: DataFrame, kept: Cuts) -> None:
        """Snapshot rows of the touched ids, from the contributions of every document that has them.

        Contributions are dealt once, as the snapshot is written, and folded there. Those of the slices mark their ids as
        touched (_t), and so do the ids of what the slices held before; where these are few, only their contributions
        are dealt. Other nodes than entities also are touched by edges that come or go, and stand while an edge has them.
        """
        key, id_, by = ["kb_id", "doc_id"], ["kb_id", "id"], ("kb_id", "_b", "id")
        scope, new = small_side(slices.select("kb_id").distinct()), small_side(slices.withColumn("_t", F.lit(True)))
        all_nodes, all_edges = (t.join(scope, "kb_id", "left_semi").join(new, key, "left") for t in self.contributions())
        old_nodes, old_edges = (t.withColumn("_t", F.lit(True)) for t in (old_nodes, old_edges))
        version = small_side(after.select("kb_id", F.col("version").cast("long").alias("version")))

        def dealt(rows: DataFrame, name: str, *touched: DataFrame) -> DataFrame:
            ids = rows.where("_t").select(*id_)
            for t in touched:
                ids = ids.union(t.where("_t").select(*id_))
            few = ids.count() <= R.BROADCAST_ROWS
            rows = rows.join(F.broadcast(ids), id_, "left_semi") if few else rows
            for t in touched:
                rows = rows.unionByName(t, allowMissingColumns=True)
            return self._dealt(rows, "kb_id", n=FILES if few else max(FILES, -(-self._read(name, NODES if name == "nodes" else EDGES).count() // FOLDED)))

        merged = merge_edges(dealt(all_edges, "edges", old_edges.drop("source", "target")), by, ("_t",)).where("_t")
        self._write(merged.withColumn("gone", F.col("contributions") == 0).join(version, "kb_id"), "edge_snapshot", _EDGE_FOLD, "kb_id", "version")

        loose = kept(all_nodes.where("kind <> 'entity'").select(*id_).distinct())
        ends = lambda e, there: e.select("kb_id", F.explode(F.array("source", "target")).alias("id"), "_t", F.lit(there).alias("_e"))
        met = ends(all_edges, True).union(ends(old_edges, False))
        met = met.join(F.broadcast(loose), id_, "left_semi") if loose.count() <= R.BROADCAST_ROWS else met
        met = kept(met.groupBy(*id_).agg(F.bool_or("_t").alias("_t"), F.bool_or("_e").alias("_e")))
        rows = dealt(all_nodes.withColumn("_n", F.lit(True)), "nodes", old_nodes.withColumn("_o", F.lit(True)), met)
        folded = fold_nodes(rows, by, ("_t", "_e", "_n", "_o")).where("_t and (_n or _o)")
        stands = F.coalesce(F.col("_n") & ((F.col("kind") == "entity") | ((F.col("kind") != "entity") & F.col("_e"))), F.lit(False))
        self._write(folded.withColumn("gone", ~stands).join(version, "kb_id"), "node_snapshot", _NODE_FOLD, "kb_id", "version")
        after.select("kb_id", F.col("version").cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/versions")

    def compact(self) -> None:
        """Rewrites the snapshots with the newest row of each id only, under the present version."""
        with Cuts(self.spark) as kept:
            for name, schema in (("node_snapshot", _NODE_FOLD), ("edge_snapshot", _EDGE_FOLD)):
                now = kept(self._newest(name, schema).join(small_side(self.versions()), "kb_id").withColumn("gone", F.lit(False)))
                old = self._read(name, schema).select("kb_id", "version").distinct().join(now.select("kb_id", "version").distinct(), ["kb_id", "version"], "left_anti")
                rows = now.unionByName(old.withColumn("gone", F.lit(True)), allowMissingColumns=True)
                self._write(self._dealt(rows, "kb_id", "version"), name, schema, "kb_id", "version")

    @staticmethod
    def _columns(schema: str) -> list[Column]:
        return [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]
