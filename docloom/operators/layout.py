"""Layout normalisation: from raw page payloads to an element table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.derived import stable_id

MULTIMODAL = ("figure", "table", "formula")
# Names under which a payload may hold its list, and a block its parts.
LIST_KEYS = ("parsing_res_list", "parsing_results", "elements", "blocks", "layout")
LABEL_KEYS = ("block_label", "label", "type")
CONTENT_KEYS = ("block_content", "content", "text", "markdown")
BOX_KEYS = ("block_bbox", "bbox", "box", "coordinate")
ORDER_KEYS = ("block_order", "order")
KNOWN_KEYS = (*LABEL_KEYS, *CONTENT_KEYS, *BOX_KEYS, *ORDER_KEYS, "confidence", "score", "polygon", "poly", "image_base64", "asset_base64", "crop_base64")
OUTER_KEYS = ("markdown", "images", "input_path")
BOX_FORMS = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("x", "y", "width", "height"))


def _get(v: Column, path: str = "$", kind: str = "variant") -> Column:
    """A part of a variant as the given type; null where it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kind})"), F.lit(False))


def _object(v: Column) -> Column:
    return F.when(_is(v, "OBJECT"), v)


def _list(v: Column) -> Column:
    """array<variant> of a list; null for anything else."""
    return F.when(_is(v, "ARRAY"), _get(v, kind="array<variant>"))


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """The first successful attempt of each page that the policy reaches; attempts: doc_id, page, tier, ok, retryable.

    Tier 2 follows a retryable failure of tier 1; tier 3 a failure of tier 1 that is not retryable or a
    retryable one of tier 2; nothing follows success.
    """
    by = Window.partitionBy("doc_id", "page")
    fact = lambda tier, c: F.max(F.when(F.col("tier") == tier, F.col(c))).over(by)
    a = attempts.withColumns({"ok1": fact(1, "ok"), "re1": fact(1, "retryable"), "ok2": fact(2, "ok"), "re2": fact(2, "retryable")})
    reached = (
        F.when(F.col("tier") == 1, True).when(F.col("tier") == 2, ~F.col("ok1") & F.col("re1")).when(F.col("tier") == 3, ~F.col("ok1") & (~F.col("re1") | (~F.coalesce("ok2", F.lit(True)) & F.coalesce("re2", F.lit(False))))).otherwise(False)
    )
    first = a.where(reached & F.col("ok")).groupBy("doc_id", "page").agg(F.min_by(F.struct(*(c for c in attempts.columns if c not in ("doc_id", "page"))), "tier").alias("a"))
    return first.select("doc_id", "page", "a.*")


def failed_pages(attempts: DataFrame) -> DataFrame:
    return attempts.select("doc_id", "page").distinct().join(choose_attempt(attempts).select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def unwrap_page(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, payload (map<string, variant>), code of pages (doc_id, page, width, height, raw: JSON text).

    A payload is inside ``data`` and ``result``, of the list's item for the asked page (one without a number fits any), else its
    first; its ``prunedResult`` is taken with those outer keys that it lacks. Each text is parsed once. What is no object
    has no payload and the code ocr_invalid_response.
    """
    p = pages.select("doc_id", "page", "width", "height", F.try_parse_json("raw").alias("v"))
    for key in ("data", "result"):
        p = p.withColumn("v", F.coalesce(_object(_get(F.col("v"), f"$.{key}")), F.col("v")))
    p = p.withColumn("items", F.coalesce(*(_list(_get(F.col("v"), f"$.{k}")) for k in ("layoutParsingResults", "results", "pages"))))
    number = lambda x: F.coalesce(_get(x, "$.page_number", "int"), _get(x, "$.page", "int"), F.col("page"))
    asked = F.get(F.filter("items", lambda x: _is(x, "OBJECT") & (number(x) == F.col("page"))), F.lit(0))
    p = p.withColumn("v", F.when(F.size("items") > 0, F.coalesce(asked, F.get("items", F.lit(0)))).otherwise(F.col("v")))
    fields = lambda v: _get(_object(v), kind="map<string,variant>")
    p = p.withColumns({"outer": fields(F.col("v")), "inner": fields(_get(F.col("v"), "$.prunedResult"))})
    lacking = F.map_filter("outer", lambda k, _: k.isin(*OUTER_KEYS) & ~F.map_contains_key("inner", k))
    p = p.withColumn("payload", F.when(F.col("inner").isNull(), F.col("outer")).otherwise(F.map_concat("inner", lacking)))
    return p.select("doc_id", "page", "width", "height", "payload", F.when(F.col("payload").isNull(), "ocr_invalid_response").alias("code"))


def explode_blocks(pages: DataFrame) -> DataFrame:
    """One row per block with a usable box: label, content, box (4 doubles), polygon (variant), ord, confidence and raw (variant), each from the first name that has a value.

    Blocks are the objects of the first list among the payload's names; one without an order takes its place among them.
    """
    listed = F.coalesce(*(_list(F.col("payload")[k]) for k in LIST_KEYS))
    b = pages.select("doc_id", "page", "width", "height", F.posexplode(F.filter(listed, lambda x: _is(x, "OBJECT"))).alias("pos", "raw"))
    text = lambda keys: F.coalesce(*(F.nullif(_get(F.col("raw"), f"$.{k}", "string"), F.lit("")) for k in keys))
    some = lambda k: F.when(~F.to_json(_get(F.col("raw"), f"$.{k}")).isin("null", "[]", "{}", '""', "0", "false"), _get(F.col("raw"), f"$.{k}"))
    order = F.coalesce(*(F.nullif(_get(F.col("raw"), f"$.{k}", "int"), F.lit(0)) for k in ORDER_KEYS), F.col("pos") + 1)
    rows = b.select(
        "doc_id", "page", "width", "height", F.coalesce(text(LABEL_KEYS), F.lit("text")).alias("label"), F.trim(F.coalesce(text(CONTENT_KEYS), F.lit(""))).alias("content"), F.coalesce(*map(some, BOX_KEYS)).alias("_box"),
        F.coalesce(some("polygon"), some("poly")).alias("polygon"), order.alias("ord"), confidence(text(("confidence", "score"))).alias("confidence"), "raw",
    )
    return rows.withColumn("box", corners(F.col("_box"))).where("box is not null").drop("_box")


def kind_of(label: Column) -> Column:
    low = F.translate(F.lower(F.trim(label)), "- ", "__")
    return F.when(low.rlike("image|figure|chart|diagram"), "figure").when(low.contains("table"), "table").when(low.rlike("formula|equation"), "formula").when(low.rlike("title|heading|header"), "heading").when(low.rlike("list|reference"), "list").otherwise("text")


def confidence(value: Column) -> Column:
    """Between 0 and 1; null where it is no number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def _whole(numbers: Column) -> Column:
    """The array if none of it is null."""
    return F.when(~F.exists(numbers, lambda v: v.isNull()), numbers)


def corners(box: Column) -> Column:
    """array of 4 doubles from a variant: a list of 4 or more, or an object with x0..y1, left..bottom, or x, y, width and height; null where it is unusable."""
    items = _list(box)
    form = F.when(F.size(items) >= 4, _whole(F.transform(F.slice(items, 1, 4), lambda v: _get(v, kind="double"))))
    keys = F.map_keys(_get(_object(box), kind="map<string,variant>"))
    for names in BOX_FORMS:
        v = F.array(*(_get(box, f"$.{n}", "double") for n in names))
        if names == BOX_FORMS[2]:
            v = F.array(v[0], v[1], v[0] + v[2], v[1] + v[3])
        form = form.when(F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == 4, _whole(v))
    return form


def scaled_box(c: Column, width: Column, height: Column) -> Column:
    """struct x0, y0, x1, y1 on the page: fractions are scaled, corners ordered, all clamped."""
    part = F.array_max(F.transform(c, F.abs)) <= 1.0
    x, y = F.when(part, width).otherwise(1.0), F.when(part, height).otherwise(1.0)
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    xs, ys = (clamp(c[0] * x, width), clamp(c[2] * x, width)), (clamp(c[1] * y, height), clamp(c[3] * y, height))
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def normalised(box: Column, width: Column, height: Column) -> Column:
    return F.struct(F.round(box["x0"] / width, 6).alias("x0"), F.round(box["y0"] / height, 6).alias("y0"), F.round(box["x1"] / width, 6).alias("x1"), F.round(box["y1"] / height, 6).alias("y1"))


def polygon(raw: Column, box: Column, width: Column, height: Column) -> Column:
    """struct of points and normalised points (both arrays of x, y) from a variant.

    A list of numbers is read in pairs; of a list of other things those that are pairs or have x and y are points. Where there
    are none, the box's corners stand. Points of which no coordinate is above 1 are fractions of the page; all are clamped to it.
    """
    items = _list(raw)
    number = lambda v: _get(v, kind="double")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    pairs = F.floor(F.size(items) / 2).cast("int")
    flat = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda i: point(number(F.get(items, 2 * i)), number(F.get(items, 2 * i + 1))))).otherwise(none)
    one = lambda v: F.when(_is(v, "ARRAY"), point(_get(v, "$[0]", "double"), _get(v, "$[1]", "double"))).when(_is(v, "OBJECT"), point(_get(v, "$.x", "double"), _get(v, "$.y", "double")))
    mixed = F.filter(F.transform(items, one), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    plain = ~F.exists(items, lambda v: ~_is(v, "TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL|BOOLEAN"))
    given = F.coalesce(F.when(plain, flat).otherwise(mixed), none)
    own = F.when(F.size(given) > 0, given).otherwise(F.array(point(box["x0"], box["y0"]), point(box["x1"], box["y0"]), point(box["x1"], box["y1"]), point(box["x0"], box["y1"])))
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))

    def placed(points: Column) -> Column:
        part = F.array_max(F.transform(points, lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"])))) <= 1.0
        x, y = F.when(part, width).otherwise(F.lit(1)), F.when(part, height).otherwise(F.lit(1))
        return F.transform(points, lambda p: point(clamp(p["x"] * x, width), clamp(p["y"] * y, height)))

    points = F.get(F.transform(F.array(own), placed), F.lit(0))  # named once
    of_page = lambda p: point(F.round(p["x"] / width, 6), F.round(p["y"] / height, 6))
    return F.get(F.transform(F.array(points), lambda ps: F.struct(ps.alias("points"), F.transform(ps, of_page).alias("normalised"))), F.lit(0))


def unknown_fields(raw: Column) -> Column:
    """The block's fields that no other column holds, as texts."""
    fields = F.map_filter(_get(raw, kind="map<string,variant>"), lambda k, _: ~k.isin(*KNOWN_KEYS))
    return F.transform_values(fields, lambda _, v: _get(v, kind="string"))


def reading_order(elements: DataFrame) -> DataFrame:
    """``seq`` from 1 in a document: by page, order, top, left, id."""
    order = Window.partitionBy("doc_id").orderBy("page", "ord", "y0", "x0", "element_id")
    return elements.withColumn("seq", F.row_number().over(order))


def _places(elements: DataFrame) -> list[Column]:
    if "x0" not in elements.columns:
        return []
    corners = F.array(*(F.array(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    polygon = F.coalesce("polygon", corners) if "polygon" in elements.columns else corners
    return [F.array("x0", "y0", "x1", "y1").alias("bbox"), polygon.alias("polygon")]


def assets(elements: DataFrame) -> DataFrame:
    """asset_id, element_id, doc_id, page, kind, object_key, page_key, bbox, polygon (its corners where elements have none), content_sha256 of figures, tables and formulas."""
    a = elements.where(F.col("kind").isin(*MULTIMODAL)).withColumn("asset_id", stable_id("as", F.col("element_id"), F.col("kind")))
    return a.select("asset_id", "element_id", "doc_id", "page", "kind", F.concat_ws("/", F.lit("assets"), "doc_id", "asset_id").alias("object_key"), F.concat_ws("/", F.lit("pages"), "doc_id", "page").alias("page_key"), *_places(elements), F.sha2("content", 256).alias("content_sha256"))


def counters(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, pages, elements, assets and chunks (doc_id, chunk_id) of each document."""
    e = elements.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("elements"), F.count_if(F.col("kind").isin(*MULTIMODAL)).alias("assets"))
    return e.join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").na.fill(0, ["chunks"])


def citation_regions(cited: DataFrame, elements: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, version, element_id, page, box, page_key and object_key (null for elements that are no assets) of cited elements (doc_id, version, element_id).

    Elements have version, page and x0 to y1; pages (doc_id, version, page, page_key); assets (element_id, object_key). An element or
    page of another version is not found.
    """
    box = F.struct("x0", "y0", "x1", "y1").alias("box")
    placed = cited.join(elements.select("doc_id", "version", "element_id", "page", box), ["doc_id", "version", "element_id"])
    return placed.join(pages.select("doc_id", "version", "page", "page_key"), ["doc_id", "version", "page"]).join(assets.select("element_id", "object_key"), "element_id", "left")


def kinds_per_page(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", "page").pivot("kind", ["figure", "formula", "table", "heading", "text"]).count().na.fill(0)
