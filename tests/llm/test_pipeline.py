"""The pipeline's stages on the smallest tables, each against the plain definition of its decision."""

from collections import Counter

import corpus_pipeline
from docloom.llm.scratch import Scratch
from docloom.llm.toxicity import score_toxicity
from tests.llm import brute
from tests.llm.test_mixing import brute_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts, kept = docs.columns, {}, {}
    texts["start"] = {r.doc_id: r.text for r in docs.collect()}
    before = "start"
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF))
        kept[name] = docs.collect()
        if name in ("mixing", "sharding"):
            continue
        assert docs.columns == columns
        texts[name] = {r.doc_id: r.text for r in kept[name]}
        assert len(texts[name]) == len(kept[name]) and set(texts[name]) <= set(texts[before])
        before = name
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(texts["start"]) - set(texts["toxicity"])
    judged = {r.doc_id for r in score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert gone == judged and not any(toxic.get(d) == 0 for d in gone)  # too few labels here for recall; see test_toxicity
    parts = brute.jaccard_components(list(texts["toxicity"].items()), k=5, percent=80)
    assert set(texts["near_duplicates"]) == {d for d, (_, c) in parts.items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.decontaminate(list(texts["near_duplicates"].items()), items)
    assert set(texts["decontamination"]) == {d for d, x in hit.items() if not x[4]}
    sizes = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id in texts["decontamination"]:
            sizes[r.source] += len(brute.spaced(r.text))
    want, copies = brute_targets(sizes), Counter(r.doc_id for r in kept["mixing"])
    assert max(copies.values()) <= 2 and set(copies) <= set(texts["decontamination"])
    assert all(r.text == texts["start"][r.doc_id] for r in kept["mixing"])
    assert abs(sum(len(brute.spaced(r.text)) for r in kept["mixing"]) - sum(want.values())) < 0.2 * sum(want.values())
    shards = Counter()
    for r in kept["sharding"]:
        shards[r.shard] += r.size
    assert Counter(r.doc_id for r in kept["sharding"]) == copies and set(shards) == set(range(16))


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, row_key string"


def test_stages_judge_rows(spark, tmp_path):
    """Null and repeated ids: a row's fate is that of its own text, and equal rows leave one."""
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1, 400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bench one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many = [f"w{i} v{i} u{i} t{i} s{i} r{i}" for i in range(400)]
    bad, hit = "vile scum filth " * 4, "say one two three four five six seven eight nine ten eleven now"
    rows = [(i, f"{bad if i % 2 == 0 else ''}{many[i]}") for i in range(1, 400)]
    rows += [(None, f"{bad} null one"), (None, "null clean row of some words"), (3, f"{bad} again three"), (3, many[3]), (None, None), (None, ""), (5, hit), (5, "five without the passage")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x", "y") for d, t in rows], DOCS)
    clean = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((d, t) for d, t in rows if not (t or "").startswith(bad))
    single = corpus_pipeline.without_copies(spark, clean, str(tmp_path))
    assert single.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter({(d, t) for d, t in rows if not (t or "").startswith(bad)})
    apart = corpus_pipeline.without_benchmark(spark, single, str(tmp_path))
    assert apart.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in apart.collect()) == Counter({(d, t) for d, t in rows if not (t or "").startswith(bad) and t != hit})


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
