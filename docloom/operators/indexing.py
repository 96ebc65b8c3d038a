"""Index building over chunks, elements and assets: lineage checks, anchors, overlays; and enrichment tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.layout import MULTIMODAL

#: Texts of an embedding batch, vector length, pages of a document that are enriched.
EMBED_BATCH, DIMENSIONS, ENRICHED_PAGES = 10, 1024, 6


def lineage_violations(chunks: DataFrame, elements: DataFrame, assets: DataFrame) -> DataFrame:
    """chunk_id, code. Chunks: chunk_id, text, element_ids, asset_ids; an index is built only if there are none."""
    out = lambda df, code: df.select("chunk_id", F.lit(code).alias("code"))
    e = chunks.select("chunk_id", F.explode("element_ids").alias("element_id"))
    a = chunks.select("chunk_id", F.explode("asset_ids").alias("asset_id"))
    placed = a.join(assets.select("asset_id", "element_id"), "asset_id")
    return (
        out(chunks.where("coalesce(text, '') = ''"), "empty_text").union(out(chunks.where("size(element_ids) = 0"), "no_elements")).union(out(e.join(elements.select("element_id"), "element_id", "left_anti"), "unknown_element"))
        .union(out(a.join(assets.select("asset_id"), "asset_id", "left_anti"), "invalid_asset_lineage")).union(out(placed.join(e, ["chunk_id", "element_id"], "left_anti"), "asset_outside_chunk")).distinct()
    )


def anchors(chunks: DataFrame, elements: DataFrame, assets: DataFrame) -> DataFrame:
    """chunk_id, anchor, page, x0 .. y1, code: the first asset's element if the chunk has assets, else its first element.

    An asset's page and the element's box are taken; without an asset, the element's page, or where that is missing the
    chunk's first. The code tells what makes a chunk unusable: invalid_asset_lineage (its asset is unknown, or of an element
    that it doesn't list), invalid_element_lineage (no element, no page from 1 on, or no whole box).
    """
    box = ("x0", "y0", "x1", "y1")
    c = chunks.select("chunk_id", "element_ids", "page_start", F.try_element_at("asset_ids", F.lit(1)).alias("asset_id"), F.try_element_at("element_ids", F.lit(1)).alias("_first"))
    own = c.join(assets.select("asset_id", F.col("element_id").alias("_own"), F.col("page").alias("_asset_page")), "asset_id", "left").withColumn("anchor", F.when(F.col("asset_id").isNotNull(), F.col("_own")).otherwise(F.col("_first")))
    e = elements.select(F.col("element_id").alias("anchor"), F.col("page").alias("_page"), *box, F.lit(True).alias("_known"))
    placed = own.join(e, "anchor", "left").withColumn("page", F.when(F.col("asset_id").isNotNull(), F.col("_asset_page")).otherwise(F.coalesce(F.nullif("_page", F.lit(0)), "page_start")))
    detached = F.col("asset_id").isNotNull() & (F.col("_known").isNull() | ~F.coalesce(F.array_contains("element_ids", F.col("anchor")), F.lit(False)))
    unplaced = F.col("_known").isNull() | F.coalesce(F.col("page") < 1, F.lit(True)) | F.array_contains(F.transform(F.array(*box), lambda v: v.isNull()), F.lit(True))
    return placed.select("chunk_id", "anchor", "page", *box, F.when(detached, "invalid_asset_lineage").when(unplaced, "invalid_element_lineage").alias("code"))


def union_boxes(members: DataFrame) -> DataFrame:
    """chunk_id and the union of its members' boxes within the page; a degenerate one becomes nearly the whole page."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    b = members.groupBy("chunk_id").agg(*(f(clamp(F.col(c))).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    bad = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    return b.select("chunk_id", *(F.when(bad, v).otherwise(F.col(c)).alias(c) for c, v in (("x0", 0.02), ("y0", 0.02), ("x1", 0.98), ("y1", 0.98))))


def count_mismatches(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    built = chunks.groupBy("doc_id").agg(F.count("*").alias("built"))
    return manifests.join(built, "doc_id", "left").select("doc_id", "chunk_count", F.coalesce("built", F.lit(0)).alias("built")).where("built <> chunk_count")


def overlay(chunks: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """chunk_id, text, tags after publishable notes are added.

    Chunks: chunk_id, doc_id, text, page_start, page_end, element_ids. Page notes (doc_id, page, publishable,
    summary, search_text, tags) come first, by page, then element notes (element_id, publishable,
    description, search_text, tags) in the chunk's order; repeated lines and tags are kept once. A note's
    label line stands even if its text is empty. Pages are met by key: a chunk's range is exploded.
    """
    p = chunks.select("chunk_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).join(pages.where("publishable"), ["doc_id", "page"])
    lines = lambda a, b, x, y: F.array(F.concat(F.lit(f"[{a}] "), F.trim(F.coalesce(x, F.lit("")))), F.concat(F.lit(f"[{b}] "), F.trim(F.coalesce(y, F.lit("")))))
    of_pages = p.select("chunk_id", F.lit(0).alias("level"), F.col("page").alias("at"), lines("page summary", "page search", F.col("summary"), F.col("search_text")).alias("lines"), "tags")
    e = chunks.select("chunk_id", F.posexplode("element_ids").alias("at", "element_id")).join(elements.where("publishable"), "element_id")
    of_elements = e.select("chunk_id", F.lit(1), "at", lines("element description", "element search", F.col("description"), F.col("search_text")), "tags")
    notes = of_pages.union(of_elements).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("level", "at", "lines", "tags"))).alias("n"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("n", lambda x: x[c])))
    notes = notes.select("chunk_id", flat("lines").alias("_lines"), F.filter(flat("tags"), lambda t: t != "").alias("tags"))
    both = chunks.select("chunk_id", "text").join(notes, "chunk_id", "left")
    return both.select("chunk_id", F.when(F.col("_lines").isNotNull(), F.concat("text", F.lit("\n\n"), F.array_join("_lines", "\n"))).otherwise(F.col("text")).alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def overlay_lineage(overlays: DataFrame, manifests: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """doc_id, field of overlays that don't echo their document's manifest."""
    both = overlays.select("doc_id", *(F.col(c).cast("string").alias(f"_{c}") for c in names)).join(manifests.select("doc_id", *(F.col(c).cast("string").alias(c) for c in names)), "doc_id")
    wrong = F.filter(F.array(*(F.when(~F.col(f"_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in names)), lambda x: x.isNotNull())
    return both.select("doc_id", F.explode(wrong).alias("field"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimensions: int = DIMENSIONS, batch: int = EMBED_BATCH) -> DataFrame:
    """chunk_id, embedding, code: texts in batches through the given embedder; a failing batch or a wrong length is a code."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                try:
                    vectors, code = embedder(part.text.tolist()), None
                    if len(vectors) != len(part):
                        vectors, code = [None] * len(part), "embedding_count_mismatch"
                except Exception:  # noqa: BLE001  any outage leaves the index lexical
                    vectors, code = [None] * len(part), "embedding_provider_unavailable"
                codes = [code or (None if len(v) == dimensions else "embedding_dimension_mismatch") for v in vectors]
                yield pd.DataFrame({"chunk_id": part.chunk_id, "embedding": [v if c is None else None for v, c in zip(vectors, codes, strict=True)], "code": codes})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>, code string")


def index_mode(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """kb_id, chunks, vectors, mode and reason: hybrid where every chunk has a vector, else lexical-only because of no vectors at all or missing ones."""
    both = chunks.join(vectors.select("chunk_id", F.lit(1).alias("_v")).distinct(), "chunk_id", "left")
    n = both.groupBy("kb_id").agg(F.count("*").alias("chunks"), F.count("_v").alias("vectors"))
    whole = F.col("vectors") == F.col("chunks")
    reason = F.when(whole, None).when(F.col("vectors") == 0, "no_vectors").otherwise("missing_vectors")
    return n.withColumn("mode", F.when(whole, "hybrid").otherwise("lexical-only")).withColumn("reason", reason)


#: The parts of an index's identity.
IDENTITY = ("schema_version", "compiler_manifest_key", "source_sha256", "compiler_config_hash", "document_title", "semantic_fingerprint", "index_signature", "mode", "dimensions")


def load_violations(indexes: DataFrame, payloads: DataFrame, signature: str) -> DataFrame:
    """doc_id, code of indexes (doc_id, sha256, mode, index_signature) that must not be loaded.

    Their payload (doc_id, sha256) is missing or has another hash, or they are hybrid and of another
    signature than the queries' embedder.
    """
    both = indexes.join(payloads.select("doc_id", F.col("sha256").alias("_p")), "doc_id", "left")
    code = F.when(F.col("_p").isNull(), "payload_missing").when(F.col("_p") != F.col("sha256"), "payload_hash_mismatch").when((F.col("mode") == "hybrid") & ~F.col("index_signature").eqNullSafe(F.lit(signature)), "embedding_signature_mismatch")
    return both.select("doc_id", code.alias("code")).where("code is not null")


def eligible(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("kind").isin(*MULTIMODAL))


def enriched_pages(elements: DataFrame, most: int = ENRICHED_PAGES) -> DataFrame:
    """doc_id, page, n, place: the pages with most eligible elements."""
    n = eligible(elements).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "page"))).where(F.col("place") <= most)


def fingerprint():
    """Of version, lineage (document, page, element, box to 6 decimals), kind, content and the asset's bytes; a null part is told from an empty one."""
    box = [F.round(c, 6) for c in ("x0", "y0", "x1", "y1")]
    lineage = F.to_json(F.struct("version", "doc_id", "page", "element_id", F.array(*box).alias("bbox")), {"ignoreNullFields": "false"})
    part = lambda c: F.coalesce(c, F.lit("\u0000"))
    return F.sha2(F.concat_ws("\u001f", lineage, part(F.col("kind")), part(F.col("content")), part(F.sha2(F.col("asset"), 256))), 256)


def _echo() -> Column:
    """What an output must repeat of its element: document, page and box to 6 decimals."""
    return F.struct("doc_id", "page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def reuse(work: DataFrame, cache: DataFrame) -> DataFrame:
    """element_id, state (hit or todo): a cached output (element_id, version, fingerprint and the lineage it echoes) counts if all of these agree."""
    c = cache.select("element_id", F.col("version").alias("_v"), F.col("fingerprint").alias("_f"), _echo().alias("_e"))
    both = work.join(c, "element_id", "left")
    same = F.col("version").eqNullSafe(F.col("_v")) & F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("_e").eqNullSafe(_echo())
    return both.select("element_id", F.when(same, "hit").otherwise("todo").alias("state"))


def accept(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """element_id, publishable, search_text, code: outputs that echo their element's lineage, the element's own text for others."""
    echo = F.struct("doc_id", "version", "page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))
    o = outputs.select("element_id", echo.alias("_echo"), F.col("search_text").alias("_text"))
    both = work.join(o, "element_id", "left")
    good = F.col("_echo").eqNullSafe(echo)
    return both.select("element_id", "doc_id", good.alias("publishable"), F.when(good, F.col("_text")).otherwise(F.col("content")).alias("search_text"), F.when(good, None).when(F.col("_echo").isNull(), "pending").otherwise("lineage_mismatch").alias("code"))


def enrichment_summary(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("doc_id").agg(F.count("*").alias("eligible"), F.count_if("publishable").alias("enriched"), F.count_if(~F.col("publishable")).alias("pending"), F.bool_and("publishable").alias("fully_enriched"))


def clean_tags(tags):
    """Trimmed, without blanks, each once in first order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


#: Versions that a semantic artifact names.
ARTIFACT_SCHEMA, LAYOUT_CONTRACT = 2, "layout-lineage-v1"


def semantic_artifact(documents: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, version, pages, elements (counts), artifact (JSON), sha256: one record for each document version, its notes in order.

    Documents: doc_id, version, source_sha256; pages: doc_id, version, page, publishable, search_text, code; elements: the
    same with element_id. Keys stand in the order of their names at each level; a version without notes has empty arrays.
    """
    key = ["doc_id", "version"]

    def noted(rows: DataFrame, by: str, name: str) -> DataFrame:
        one = F.struct(*sorted((by, "code", "publishable", "search_text")))
        listed = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), one.alias("e"))))
        return rows.groupBy(*key).agg(F.transform(listed, lambda x: x["e"]).alias(name))

    d = documents.join(noted(pages, "page", "pages"), key, "left").join(noted(elements, "element_id", "elements"), key, "left")
    listed = {c: F.when(F.col(c).isNull(), F.array()).otherwise(F.col(c)).alias(c) for c in ("elements", "pages")}
    whole = F.struct(
        F.col("doc_id").alias("document_id"), F.col("version").alias("document_version"), listed["elements"], listed["pages"], F.lit(ARTIFACT_SCHEMA).alias("schema_version"), "source_sha256", F.lit(LAYOUT_CONTRACT).alias("trusted_layout_contract")
    )
    a = d.select(*key, *(F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("pages", "elements")), F.to_json(whole).alias("artifact"))
    return a.withColumn("sha256", F.sha2("artifact", 256))
