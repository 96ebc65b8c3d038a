"""Sources, versioned artifact tables and state snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that are kept all the same, names that are secrets, and name parts that make one.
KEPT_NAMES = ("credential_ref", "configured")
SECRET_NAMES = (
    "access_key",
    "access_token",
    "api_key",
    "apikey",
    "authorization",
    "bearer",
    "client_secret",
    "credential",
    "credential_value",
    "credentials",
    "password",
    "private_key",
    "refresh_token",
    "secret",
    "secret_key",
    "token",
)
SECRET_PARTS = ("authorization", "credential", "password", "secret", "token")


PDF_TYPE = "application/pdf"


def classify_uploads(uploads: DataFrame) -> DataFrame:
    """name, length, sha256, title, code of uploads (name, media_type, content); code says why one is rejected, null if it is not.

    A null payload is an empty one; bytes are not kept. Rows with a code are the quarantine.
    """
    u = uploads.withColumn("content", F.coalesce("content", F.lit(b"")))
    code = (
        F.when(~F.col("media_type").eqNullSafe(F.lit(PDF_TYPE)), "unsupported_media_type").when(F.octet_length("content") == 0, "empty_file")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "invalid_pdf_signature")
    )
    return u.select("name", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), F.regexp_replace("name", r"(?i)\.pdf$", "").alias("title"), code.alias("code"))


def scan_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path and classify_uploads of the files of a folder; the media type follows the name.

    Spark's reader passes over files of no bytes, so an empty file has no row here; an empty upload in a table has.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rated = classify_uploads(f.select(F.col("path").alias("name"), F.when(F.lower(name).endswith(".pdf"), PDF_TYPE).alias("media_type"), "content"))
    return rated.select(F.col("name").alias("path"), "length", "sha256", F.regexp_extract("title", r"([^/]*)$", 1).alias("title"), "code")


def mismatches(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id whose stored hash is not the registered one."""
    return stored.join(registry.select("doc_id", F.col("sha256").alias("registered")), "doc_id").where("sha256 <> registered").select("doc_id", F.lit("source_hash_mismatch").alias("code"))


CHUNK_SCHEMA = "chunk_id string, ordinal int, markdown string, page_start int, page_end int, element_ids array<string>, asset_ids array<string>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of JSON artifacts {document_id, version, chunks: [...]}."""
    raw = spark.read.schema(f"document_id string, version int, chunks array<struct<{CHUNK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return raw.select(F.col("document_id").alias("doc_id"), "version", F.explode("chunks").alias("c")).select("doc_id", "version", "c.*")


ELEMENT_SCHEMA = "element_id string, pos int, page int, kind string, content string"
MANIFEST_SCHEMA = "schema_version int, source_sha256 string, config_hash string, element_count int, chunk_count int"


def _exploded(artifacts: DataFrame, column: str, schema: str) -> DataFrame:
    whole = F.from_json(column, f"struct<items:array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>>")
    return artifacts.select("doc_id", "version", F.explode(whole["items"]).alias("x")).select("doc_id", "version", "x.*")


def artifact_tables(artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, chunks and manifest of JSON artifacts (doc_id, version, elements, chunks: {items: [...]}, manifest: {...}); text that is no JSON gives no rows."""
    manifest = F.from_json("manifest", f"struct<{MANIFEST_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    return _exploded(artifacts, "elements", ELEMENT_SCHEMA), _exploded(artifacts, "chunks", CHUNK_SCHEMA), artifacts.select("doc_id", "version", manifest.alias("m")).select("doc_id", "version", "m.*").where("schema_version is not null")


def payload_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, version, checksum: of a version's rows in any order, from their JSON's hashes and their number."""
    one = F.xxhash64(F.to_json(F.struct(*sorted(set(rows.columns) - {"doc_id", "version"}))))  # partition columns come back with other types
    return rows.groupBy("doc_id", "version").agg(F.concat_ws("-", F.count("*"), F.hex(F.bit_xor(one)), F.hex(F.sum(one % (1 << 31)))).alias("checksum"))


def write_version(rows: DataFrame, manifests: DataFrame, path: str) -> None:
    """Payload first, then its manifest rows with the payload's checksum: readers that join manifests never see half a version.

    Both replace their own (doc_id, version) partitions only, so a second run gives the same tables.
    """
    replace = {"partitionOverwriteMode": "dynamic"}
    rows.write.options(**replace).mode("overwrite").partitionBy("doc_id", "version").parquet(f"{path}/data")
    signed = manifests.join(payload_checksums(rows), ["doc_id", "version"], "left")
    signed.write.options(**replace).mode("overwrite").partitionBy("doc_id", "version").parquet(f"{path}/manifests")


def visible(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of versions that have a manifest and, where manifests state a checksum, whose rows have it."""
    named = manifests.select("doc_id", "version").distinct()
    if "checksum" in manifests.columns:
        named = manifests.select("doc_id", "version", "checksum").join(payload_checksums(rows), ["doc_id", "version", "checksum"]).select("doc_id", "version").distinct()
    return rows.join(named, ["doc_id", "version"], "left_semi")


def classify_work(work: DataFrame, manifests: DataFrame) -> DataFrame:
    """doc_id, version, state: replay (same hashes), version_conflict (other hashes), todo (not built)."""
    m = manifests.select("doc_id", "version", F.col("source_sha256").alias("_s"), F.col("config_hash").alias("_c"))
    both = work.join(m, ["doc_id", "version"], "left")
    state = F.when(F.col("_s").isNull(), "todo").when((F.col("_s") == F.col("source_sha256")) & (F.col("_c") == F.col("config_hash")), "replay").otherwise("version_conflict")
    return both.select("doc_id", "version", state.alias("state"))


def canonical_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's JSON with its fields in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def purge(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones, ["doc_id", "version"], "left_anti")


def _secret(name: str) -> bool:
    """Names are compared without outer blanks and case, and with _ for -."""
    plain = name.strip().lower().replace("-", "_")
    return plain not in KEPT_NAMES and (plain in SECRET_NAMES or bool(set(plain.split("_")) & set(SECRET_PARTS)))


def _is_secret(name: Column) -> Column:
    plain = F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "-", "_")
    return (plain.isin(*SECRET_NAMES) | F.arrays_overlap(F.split(plain, "_"), F.array(*map(F.lit, SECRET_PARTS)))) & ~plain.isin(*KEPT_NAMES)


def _clean(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields if not _secret(f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_filter(F.transform_values(col, lambda _, v: _clean(v, kind.valueType)), lambda k, _: ~_is_secret(k))
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return col


def without_secrets(df: DataFrame) -> DataFrame:
    """All columns without secret fields, at any depth; times as UTC text."""
    return df.select(*(_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not _secret(f.name)))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """namespace, revision, payload and schema_version of the newest row whose checksum and schema version (1 or 2) hold.

    A payload of version 1 gains an empty wiki_pages.
    """
    good = snapshots.where((F.sha2("payload", 256) == F.col("checksum")) & F.col("schema_version").isin(1, 2))
    newest = good.groupBy("namespace").agg(F.max("revision").alias("revision"), F.max_by("payload", "revision").alias("payload"), F.max_by("schema_version", "revision").alias("schema_version"))
    gained = F.regexp_replace(F.regexp_replace("payload", r"\}\s*$", ', "wiki_pages": {}}'), r"^\s*\{\s*,", "{")
    return newest.withColumn("payload", F.when(F.col("schema_version") == 1, gained).otherwise(F.col("payload")))
