"""Elements to markdown, and markdown to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.layout import MULTIMODAL
from docloom.sources.derived import stable_id

#: Characters of a chunk; chunks and elements of an extraction batch; characters kept of each.
TARGET, BATCH_CHUNKS, BATCH_ELEMENTS, CHUNK_CHARS, ELEMENT_CHARS = 1800, 8, 64, 1600, 400


def element_markdown() -> Column:
    """From kind, content, element_id, page and the normalised box nx0, ny0, nx1, ny1."""
    box = F.concat_ws(",", *(F.format_string("%.6f", F.col(c)) for c in ("nx0", "ny0", "nx1", "ny1")))
    tag = F.concat(F.lit('<asset id="'), F.col("asset_id"), F.lit('" type="'), F.when(F.col("kind") == "figure", "image").otherwise(F.col("kind")), F.lit('" page="'), F.col("page"), F.lit('" bbox="'), box, F.lit('">'))
    or_ = lambda word: F.when(F.col("content") == "", word).otherwise(F.col("content"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("## "), or_("未命名章节")))
        .when(F.col("kind") == "formula", F.concat(tag, F.lit("\n\n$$\n"), F.trim(F.col("content"), F.lit("$ \n")), F.lit("\n$$")))
        .when(F.col("kind") == "table", F.concat(tag, F.lit("\n\n"), or_("表格")))
        .when(F.col("kind") == "figure", F.concat(tag, F.lit("\n\n"), or_("图片")))
        .otherwise(F.col("content"))
    )


def document_markdown(elements: DataFrame) -> DataFrame:
    """doc_id, markdown: a title, then each page's mark and its elements' non-empty markdown (column md)."""
    page = elements.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "md"))).alias("e"))
    lines = F.filter(F.transform("e", lambda x: x["md"]), lambda x: x != "")
    page = page.select("doc_id", "page", F.array_join(F.concat(F.array(F.concat(F.lit("<!-- page:"), "page", F.lit(" -->"))), lines), "\n\n").alias("p"))
    whole = page.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "p"))).alias("pages"))
    return whole.select("doc_id", F.concat(F.lit("# doc-"), "doc_id", F.lit("\n\n"), F.array_join(F.transform("pages", lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("markdown"))


def heading_path(elements: DataFrame) -> DataFrame:
    """``heading``: the last non-empty heading at or before each element."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("heading", F.last(F.when((F.col("kind") == "heading") & (F.col("content") != ""), F.col("content")), ignorenulls=True).over(before))


def _starts(link: Column) -> Column:
    """The positions 1, link[1], link[link[1]], ... of an array of links, each beyond its own place, up to the array's end.

    By doubling: the first 2^k positions and the links over 2^k steps give the next 2^k positions.
    """
    begin = F.struct(F.array(F.lit(1)).alias("s"), F.concat(link, F.array(F.size(link) + 1)).alias("j"), F.size(link).alias("n"))

    def double(state, _):
        far = F.filter(F.transform(state["s"], lambda x: F.element_at(state["j"], x)), lambda x: x <= state["n"])
        return F.struct(F.concat(state["s"], far).alias("s"), F.transform(state["j"], lambda x: F.element_at(state["j"], x)).alias("j"), state["n"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(link) + 1)).cast("int")), begin, double, lambda state: state["s"])


def packed(elements: DataFrame, target: int = TARGET) -> DataFrame:
    """doc_id, part, piece, e: runs of elements in order, by greedy packing of markdown (md); e keeps seq and the other columns.

    A heading opens a part, an asset closes one; a running sum finds these. Inside a part each element is linked to
    the one at which a chunk that began with it would end: the last whose start lies within the target, from
    prefix sums and one count. Chunks follow these links from the part's first element. Markdown that is empty
    takes a joiner only behind some that is not.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    opens = (F.col("kind") == "heading") | F.coalesce(F.lag(F.col("kind").isin(*MULTIMODAL)).over(order), F.lit(False))
    parts = elements.withColumn("_opens", opens.cast("int")).withColumn("part", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    by = Window.partitionBy("doc_id", "part")
    size, before = F.length("md"), Window.unboundedPreceding
    rows = parts.withColumns({"_at": F.row_number().over(by.orderBy("seq")), "_n": F.count("*").over(by), "_upto": F.sum(size + 2).over(by.orderBy("seq").rowsBetween(before, 0))})
    rows = rows.withColumn("_from", F.col("_upto") - size - 2)
    rows = rows.withColumn("_reach", F.count("*").over(by.orderBy("_from").rangeBetween(before, target + 2)).cast("int"))
    own = F.struct("_at", size.alias("size"), F.when((F.col("_reach") == F.col("_n")) & (F.max("_upto").over(by) <= F.col("_from") + target + 2), F.col("_n") + 1).otherwise(F.col("_reach")).cast("int").alias("reach"))
    rows = rows.withColumn("_f", F.last(F.when(size > 0, own), ignorenulls=True).over(by.orderBy(F.desc("seq")).rowsBetween(before, 0)))  # the first with markdown from here on
    far = F.greatest(F.col("_f._at") + 1, F.col("_f.reach"))
    link = F.when(F.col("_f").isNull(), F.col("_n") + 1).when((F.col("_f._at") > F.col("_at")) & (F.col("_f.size") + 2 > target), F.col("_f._at")).otherwise(far).cast("int")
    rows = rows.withColumn("_link", link)
    kept = ["seq", *(c for c in elements.columns if c not in ("doc_id", "seq")), "_link"]
    whole = rows.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("e"))
    whole = whole.withColumn("_starts", _starts(F.transform("e", lambda x: x["_link"])))
    pieces = F.transform("_starts", lambda s: F.slice("e", s, F.element_at("e", s)["_link"] - s))
    return whole.select("doc_id", "part", F.posexplode(pieces).alias("piece", "e"))


def chunks(elements: DataFrame, target: int = TARGET) -> DataFrame:
    """chunk_id, doc_id, ordinal, markdown, page_start, page_end, element_ids, asset_ids, heading; empty chunks take no ordinal.

    Elements have doc_id, seq, kind, content, md, page, element_id and, where they are assets, asset_id.
    """
    e = heading_path(elements)
    asset = F.col("asset_id") if "asset_id" in elements.columns else F.lit(None).cast("string")
    c = packed(e.select("doc_id", "seq", "kind", "md", "page", "element_id", asset.alias("asset_id"), "heading"), target)
    of = lambda name: F.transform("e", lambda x: x[name])
    c = c.withColumn("markdown", F.array_join(F.filter(of("md"), lambda x: x != ""), "\n\n")).where("markdown <> ''")
    c = c.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "piece"))).withColumn("element_ids", of("element_id"))
    return c.select(
        stable_id("ch", F.col("doc_id"), F.col("ordinal"), F.array_join("element_ids", ","), F.col("markdown")).alias("chunk_id"), "doc_id", "ordinal", "markdown",
        F.array_min(of("page")).alias("page_start"), F.array_max(of("page")).alias("page_end"), "element_ids", F.array_compact(of("asset_id")).alias("asset_ids"), F.element_at("e", 1)["heading"].alias("heading"),
    )


def page_chunks(elements: DataFrame) -> DataFrame:
    """Fixed chunks: a page each, with page range and size."""
    return elements.groupBy("doc_id", "page").agg(F.sum(F.length("content")).alias("size"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("elements"))


def extraction_batches(chunks: DataFrame, elements: DataFrame, size: int = BATCH_CHUNKS, most: int = BATCH_ELEMENTS) -> DataFrame:
    """doc_id, batch, chunks, elements: runs of ``size`` chunks of a document with the elements they list, at most ``most``.

    Chunks have doc_id, ordinal, chunk_id, markdown and element_ids; elements element_id, kind and content. The arrays hold
    structs (chunk_id, text) and (element_id, kind, text), in order, their texts cut to CHUNK_CHARS and ELEMENT_CHARS.
    """
    batch = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1) / size)
    c = chunks.withColumn("batch", batch)
    texts = c.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", F.substring("markdown", 1, CHUNK_CHARS).alias("text")))).alias("c"))
    listed = c.select("doc_id", "batch", "ordinal", F.posexplode("element_ids").alias("pos", "element_id"))
    listed = listed.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("ordinal", "pos"))).where(F.col("_r") <= most)
    held = listed.join(elements.select("element_id", "kind", F.substring("content", 1, ELEMENT_CHARS).alias("text")), "element_id")
    held = held.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("_r", "element_id", "kind", "text"))).alias("e"))
    both = texts.join(held, ["doc_id", "batch"], "left")
    return both.select(
        "doc_id", "batch", F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("chunks"),
        F.coalesce(F.transform("e", lambda x: F.struct(x["element_id"].alias("element_id"), x["kind"].alias("kind"), x["text"].alias("text"))), F.array().cast("array<struct<element_id:string,kind:string,text:string>>")).alias("elements"),
    )
