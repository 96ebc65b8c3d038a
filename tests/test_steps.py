"""Steps that large tables pass: how often rows are read, and what is sent to the driver."""

from docloom.operators import extraction as X
from docloom.operators import graph as G
from tests.growth import _steps


def _reads(df, column):
    """How often the plan reads tables with the column that aren't stored."""
    return sum("RDD" in line and column in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def _rows_joined(df):
    """The most rows that a join makes; runs the query."""
    df.collect()
    joins = (p for p in _steps(df._jdf.queryExecution().executedPlan()) if "Join" in p.getClass().getSimpleName())
    return max(p.metrics().get("numOutputRows").get().value() for p in joins)


def _extractions(spark):
    entities = spark.createDataFrame([(1, 0, i, f"e{i}", "KIND", f"Name {i}", [], ["n1"]) for i in range(2)], "doc_id int, batch int, place int, ref string, kind string, name string, aliases array<string>, refs array<string>")
    claims = spark.createDataFrame([(1, 0, i, f"e{i % 3}", f"is {i % 2}", [f"n{i % 4}", " "]) for i in range(300)] + [(1, 0, 300, "e0", "bare", [])], "doc_id int, batch int, place int, subject_ref string, statement string, refs array<string>")
    relations = spark.createDataFrame([(1, 0, i, "e0", "e1" if i % 10 else "e7", "USES", "by", [f"n{i % 3}"]) for i in range(300)] + [(1, 1, 0, None, "e1", "USES", "by", ["n1"])], "doc_id int, batch int, place int, source_ref string, target_ref string, predicate string, statement string, refs array<string>")
    return entities, claims, relations


def test_merged_relations_read_their_rows_once(spark):
    _, claims, relations, _ = X.merge_extractions(*_extractions(spark))
    assert _reads(relations, "target_ref") == 1 and _reads(claims, "subject_ref") == 1
    assert [tuple(r) for r in relations.collect()] == [(1, "relation_0001", "entity_0001", "entity_0002", "USES", "by", ["n0", "n1", "n2"])]
    assert sorted((r.subject_ref, r.statement, r.refs) for r in claims.collect()) == [("entity_0001", "bare", []), ("entity_0001", "is 0", ["n0", "n2"]), ("entity_0001", "is 1", ["n1", "n3"]), ("entity_0002", "is 0", ["n0", "n2"]), ("entity_0002", "is 1", ["n1", "n3"])]


def test_problems_look_each_reference_up_once(spark):
    problems = X.merge_extractions(*_extractions(spark))[3]
    assert {tuple(r) for r in problems.collect()} == {(1, 0, "claim_of_unknown_entity"), (1, 0, "relation_of_unknown_entity"), (1, 1, "relation_of_unknown_entity")}
    assert _rows_joined(problems) <= 10


def test_resolve_sends_no_table_to_the_driver(spark, monkeypatch):
    plans, cut = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    declared = spark.createDataFrame([(i, "K", [f"a{i}", f"a{i - 1}"]) for i in range(1, 9)] + [(20, "L", ["a1"])], "id long, kind string, names array<string>")
    assert {tuple(r) for r in X.resolve(declared).collect()} == {(i, 1) for i in range(1, 9)} | {(20, 20)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_violations_evaluate_their_edges_once(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (0, "c"), (2, "c"), (None, "d")], "kb_id int, id string")
    edges = spark.createDataFrame(
        [("1", "a", "b", True, ["v"], 0, 5), ("2", "a", "x", True, [], 0, 5), ("3", "x", "a", False, [], 0, 5), ("4", "b", "a", True, ["v"], 0, 6), ("5", "c", "a", True, ["w"], 0, 5), ("6", "d", "a", True, ["v"], 0, 5), ("7", "a", "a", True, ["v"], None, 5), ("8", None, "a", False, [], 0, 5)],
        "id string, source string, target string, semantic boolean, evidence array<string>, kb_id int, doc_id int",
    )
    catalogue = spark.createDataFrame([("v", 5)], "evidence string, doc_id int")
    found = G.violations(nodes, edges, catalogue)
    assert _reads(found, "semantic") == 0
    assert sorted(tuple(r) for r in found.collect()) == [
        ("2", "missing_target"), ("2", "no_evidence"), ("3", "missing_source"), ("4", "foreign_evidence"), ("4", "other_knowledge_base"), ("5", "other_knowledge_base"), ("8", "missing_source"), ("b", "duplicate_node"),
    ]
    plain = G.violations(nodes, edges.drop("kb_id", "doc_id"))
    assert {r.code for r in plain.collect()} == {"duplicate_node", "missing_source", "missing_target", "no_evidence"}
