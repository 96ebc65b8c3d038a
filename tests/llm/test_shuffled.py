"""What is shuffled of texts and prefixes where tables are too large to be broadcast on their own."""

import pytest

from docloom.llm.decontam import decontaminate
from docloom.llm.ngram_join import jaccard_components
from docloom.llm.scratch import Scratch
from tests.growth import _steps


@pytest.fixture
def moved(spark, monkeypatch):
    """(columns, rows) of each shuffle before a saved table."""
    seen, save = [], Scratch.save

    def noted(self, df):
        df.collect()
        for p in _steps(df._jdf.queryExecution().executedPlan()):
            if p.getClass().getSimpleName() == "ShuffleExchangeExec":
                seen.append((p.output().toString(), p.metrics().get("shuffleRecordsWritten").get().value()))
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_texts_with_candidates_are_shuffled(spark, moved):
    item = "One two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"plain Ärger text {i} One two" if i % 20 else f"before {item} after {i}") for i in range(100)] + [(100, None), (101, "")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert rows[0] == (13, 10, 1) and rows[1] == (6, 0, 0) and rows[100] == rows[101] == (0, 0, 0) and len(rows) == 102
    assert sum(n for columns, n in moved if "text#" in columns) <= 5
    assert not any("phrase#" in columns and "start#" in columns for columns, _ in moved)


def test_prefixes_are_not_shuffled(spark, moved):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, "other " * 3 + "words here"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs, k=3, percent=80).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert not any("prefix#" in columns or "ranges#" in columns and "n#" in columns for columns, _ in moved)
