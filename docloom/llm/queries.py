"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontam import decontaminate
from docloom.llm.debruijn import remove_repeats
from docloom.llm.html_diff import extract_pages
from docloom.llm.kd_shards import kd_shards
from docloom.llm.licenses import scan_licenses
from docloom.llm.maxent import score_texts
from docloom.llm.mixing import mix_sources
from docloom.llm.ngram_join import jaccard_components
from docloom.llm.pivot_index import near_vectors
from docloom.llm.recompression import find_runs, planted_period
from docloom.llm.resample import resample
from docloom.llm.robust_rules import quality_rules
from docloom.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10).drop("item_ids")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), k=3, percent=90)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), size=20).drop("kept")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir), share=1.5, most=2.0).drop("copies", "row")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_documents(spark, sf_dir), shards=16)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_documents(spark, sf_dir), least=6, times=4, rewrite=planted_period)
    top = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


OP2_SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dp AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l),
h AS (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS p FROM dp WHERE array_to_string(w[i : i + l - 1], ' ') IN (SELECT p FROM iw)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT h.doc_id, iw.item_id::VARCHAR AS x FROM h JOIN iw ON h.p = iw.p) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM met JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * same >= 90 * (na.n + nb.n - same)),
ends AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (SELECT a AS doc_id, b AS other FROM ends UNION SELECT r.doc_id, e.b FROM reached r JOIN ends e ON r.other = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reached r USING (doc_id) GROUP BY d.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (
  SELECT a.cap / a.weight AS ratio,
    ((SELECT 1.5::DOUBLE * sum(source_size) FROM w) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
  FROM w a, w b GROUP BY a.source, a.cap, a.weight),
l AS (SELECT min_by(level, ratio) AS level FROM c WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP11_SQL = r"""
WITH bytes AS (SELECT range AS b FROM range(256)),
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM bytes)),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (
  SELECT side, row, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM (SELECT side, row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM features, crc_table),
r AS (SELECT side, row, bucket FROM runs JOIN hashed USING (f)),
b AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM r GROUP BY bucket),
al AS (SELECT count(*) FILTER (side = 0) + 10000 AS s, count(*) FILTER (side = 1) + 10000 AS t FROM r),
g AS (SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * al.s::DOUBLE / ((b.s + 1)::DOUBLE * al.t::DOUBLE)))::BIGINT AS gain FROM b, al),
w AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM r JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
sc AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN w USING (row) WHERE side = 0),
rk AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS drawn FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= drawn THEN k END AS rank FROM rk
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_lm_scores": op5_lm_scores,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_near_vectors": op9_near_vectors,
    "op10_kd_shards": op10_kd_shards,
    "op11_resample": op11_resample,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op11_resample": OP11_SQL,
}
