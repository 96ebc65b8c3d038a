"""Operators on small fixtures with known results."""

import hashlib
import json
import re
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.functions.text import alias_key, slug, tokens
from docloom.operators import answers as A
from docloom.operators import chunking as C
from docloom.operators import extraction as X
from docloom.operators import graph as G
from docloom.operators import indexing as I
from docloom.operators import jobs as J
from docloom.operators import layout as L
from docloom.operators import retrieval as R
from docloom.operators import wiki as W
from docloom.sources import artifacts as S
from docloom.streaming.jobs import follow_jobs


def test_tokens_of_mixed_scripts(spark):
    df = spark.createDataFrame([("知识图 Agentic_RAG é1",), ("知",), (None,), ("",)], "t string")
    got = [r.w for r in df.select(tokens(F.col("t")).alias("w")).collect()]
    assert got == [["agentic_rag", "1", "知", "识", "图", "知识", "识图"], ["知"], [], []]


def test_alias_and_slug(spark):
    df = spark.createDataFrame([("Ｍodel-X7 ", "00000000abcdef12"), ("Deep Field!", "x12345678"), ("知识", "x12345678")], "t string, id string")
    got = df.select(alias_key(F.col("t")).alias("a"), slug(F.col("t"), F.col("id")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("modelx7", "model-x7-abcdef12"), ("deepfield", "deep-field-12345678"), ("知识", "entity-12345678")]


def test_hybrid_retrieval_keeps_scopes(spark):
    chunks = spark.createDataFrame(
        [("both", "kb-1", "知识图谱检索与 Agentic RAG", [1.0, 0.0]), ("lexical", "kb-1", "知识图谱帮助发现实体关系", [0.0, 1.0]), ("other-kb", "kb-2", "知识图谱检索", [1.0, 0.0])], "chunk_id string, kb_id string, text string, embedding array<float>"
    )
    q = spark.createDataFrame([(1, "kb-1", "知识图谱检索", [1.0, 0.0])], "query_id int, kb_id string, text string, vector array<float>")
    hits = R.fuse(R.top_k(R.bm25(chunks, q), 3), R.top_k(R.cosine(chunks, q), 3), 3).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["both", "lexical"] and hits[0].score == 1.0 and hits[0].dense_rank == 1


def test_layout_pages(spark):
    one = '{"parsing_res_list":[{"block_label":"doc_title","block_content":"Agentic RAG","block_bbox":[80,60,900,150],"score":0.99},{"label":"figure","bbox":[100,300,500,700],"confidence":1.7},{"label":"lost"}]}'
    two = '{"data":{"result":{"pages":[{"page":1,"prunedResult":{"blocks":[]}},{"page":2,"prunedResult":{"elements":[{"type":"table","content":"|a|","bbox":{"x":120,"y":200,"width":900,"height":420}},{"type":"formula","bbox":[0.1,0.55,0.9,0.68]}]}}]}}}'
    pages = spark.createDataFrame([("doc-1", 1, 1000, 1400, one), ("doc-1", 2, 1200, 1600, two), ("doc-1", 3, 10, 10, "no json")], "doc_id string, page int, width int, height int, raw string")
    b = L.explode_blocks(L.unwrap_page(pages)).withColumn("kind", L.kind_of(F.col("label")))
    b = b.withColumn("b", L.scaled_box(F.col("box"), F.col("width"), F.col("height"))).withColumn("n", L.normalised(F.col("b"), F.col("width"), F.col("height")))
    got = {r.kind: r for r in b.collect()}
    assert set(got) == {"heading", "figure", "table", "formula"}
    assert tuple(got["figure"].n) == (0.1, 0.214286, 0.5, 0.5) and got["figure"].confidence == 1.0
    assert tuple(round(v, 9) for v in got["formula"].b) == (120.0, 880.0, 1080.0, 1088.0) and tuple(got["table"].b) == (120.0, 200.0, 1020.0, 620.0)


def test_payload_forms(spark):
    raws = [
        '{"result":{"results":[{"page_number":5,"markdown":"out","input_path":"p","images":{"a":1},"prunedResult":{"blocks":[],"markdown":"in"}}]}}',
        '{"data":{"pages":[{"prunedResult":{"layout":[]}},{"page":2,"elements":[]}]}}', '{"data":[1],"blocks":[]}', "[1]", "no json", None, '{"pages":[3]}', '{"pages":[],"layout":[]}',
    ]
    pages = spark.createDataFrame([("d", i, 10, 10, r) for i, r in enumerate(raws)], "doc_id string, page int, width int, height int, raw string")
    got = {r.page: (sorted(r.k) if r.k else None, r.m, r.code) for r in L.unwrap_page(pages).select("page", F.map_keys("payload").alias("k"), F.try_variant_get(F.col("payload")["markdown"], "$", "string").alias("m"), "code").collect()}
    bad = (None, None, "ocr_invalid_response")
    assert got == {0: (["blocks", "images", "input_path", "markdown"], "in", None), 1: (["layout"], None, None), 2: (["blocks", "data"], None, None), 3: bad, 4: bad, 5: bad, 6: bad, 7: (["layout", "pages"], None, None)}


def test_block_forms(spark):
    blocks = '{"label":"","type":"Table","bbox":{"left":1,"top":2,"right":3,"bottom":4},"order":0},5,{"bbox":[],"box":["1","2","3","4",9],"text":" t ","score":"x"},{"bbox":[1,2,"?",4]},{"coordinate":{"x":1,"y":2,"width":3,"height":4},"block_order":7,"confidence":0.5,"image_base64":"z","more":{"a":[1]}}'
    pages = spark.createDataFrame([("d", 1, 10, 10, f'{{"blocks":3,"layout":[{blocks}]}}')], "doc_id string, page int, width int, height int, raw string")
    got = L.explode_blocks(L.unwrap_page(pages)).select("label", "content", "ord", "box", "confidence", L.unknown_fields(F.col("raw")).alias("more")).collect()
    assert [tuple(r) for r in got] == [("Table", "", 1, [1, 2, 3, 4], None, {}), ("text", "t", 2, [1, 2, 3, 4], None, {}), ("text", "", 7, [1, 2, 4, 6], 0.5, {"more": '{"a":[1]}'})]


def test_polygon_forms(spark):
    forms = {"[1,2,3,4,5]": [(1, 2), (3, 4)], "[[1,2,9],[3],\"x\",[30,-4]]": [(1, 2), (10, 0)], '[{"x":1,"y":2},{"x":3},{"x":"4","y":5}]': [(1, 2), (4, 5)], "[0.5,0.25,1,1]": [(5, 5), (10, 20)], "[]": None, "[7]": None, "{}": None, '"s"': None}
    df = spark.createDataFrame(list(enumerate(forms)), "i int, raw string")
    box = F.struct(F.lit(2.0).alias("x0"), F.lit(4.0).alias("y0"), F.lit(6.0).alias("x1"), F.lit(8.0).alias("y1"))
    corners = [(2, 4), (6, 4), (6, 8), (2, 8)]
    for r in df.select("i", "raw", L.polygon(F.try_parse_json("raw"), box, F.lit(10), F.lit(20)).alias("p")).collect():
        want = forms[r.raw] or corners
        assert [tuple(p) for p in r.p.points] == want and [tuple(p) for p in r.p.normalised] == [(x / 10, y / 20) for x, y in want]


def test_citation_regions_are_of_one_version(spark):
    elements = spark.createDataFrame([("d", 1, "e1", 1, 0.0, 0.0, 1.0, 1.0), ("d", 2, "e1", 3, 0.0, 0.0, 1.0, 2.0)], "doc_id string, version int, element_id string, page int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 1, "p1"), ("d", 2, 3, "p3")], "doc_id string, version int, page int, page_key string")
    assets = spark.createDataFrame([("e2", "k")], "element_id string, object_key string")
    cited = spark.createDataFrame([("d", 2, "e1"), ("d", 3, "e1"), ("d", 1, "none")], "doc_id string, version int, element_id string")
    assert [(r.page, r.page_key, r.object_key) for r in L.citation_regions(cited, elements, pages, assets).collect()] == [(3, "p3", None)]


def test_attempts(spark):
    a = spark.createDataFrame([("d", 1, 1, False, True), ("d", 1, 2, True, False), ("d", 2, 1, False, False), ("d", 2, 2, True, False), ("d", 2, 3, True, False), ("d", 3, 1, False, True), ("d", 3, 2, False, False), ("d", 3, 3, True, False)], "doc_id string, page int, tier int, ok boolean, retryable boolean")
    assert {(r.page, r.tier) for r in L.choose_attempt(a).collect()} == {(1, 2), (2, 3)}
    assert [r.page for r in L.failed_pages(a).collect()] == [3]


def chunk_loop(rows, target):
    """The greedy packing as a plain loop over (kind, md)."""
    out, current, size = [], [], 0

    def flush():
        nonlocal current, size
        if current and any(m for _, m in current):
            out.append([i for i, _ in current])
        current, size = [], 0

    for i, (kind, md) in enumerate(rows):
        if kind == "heading":
            flush()
        if current and size + len(md) + 2 > target:
            flush()
        current.append((i, md))
        size += len(md) + (2 if size else 0)
        if kind in L.MULTIMODAL:
            flush()
    flush()
    return out


def test_chunks_equal_plain_loop(spark):
    import random

    rnd = random.Random(4)
    docs = [[(rnd.choice(["heading", "text", "text", "text", "table"]), "m" * rnd.choice([0, 0, 5, 40, 90, 197, 198, 199, 200, 250])) for _ in range(rnd.randrange(1, 40))] for _ in range(40)]
    rows = [(d, i, k, m, m, f"{d}-{i}", f"a{d}-{i}" if k == "table" else None, 1 + i // 10) for d, doc in enumerate(docs) for i, (k, m) in enumerate(doc)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, kind string, md string, content string, element_id string, asset_id string, page int")
    got = C.chunks(df, 200).collect()
    want = {(d, n): c for d, doc in enumerate(docs) for n, c in enumerate(chunk_loop(doc, 200), 1)}
    assert {(r.doc_id, r.ordinal): [int(e.split("-")[1]) for e in r.element_ids] for r in got} == want
    for r in got:
        assert r.asset_ids == [f"a{e}" for e in r.element_ids if docs[r.doc_id][int(e.split("-")[1])][0] == "table"]
        assert (r.page_start, r.page_end) == (1 + want[r.doc_id, r.ordinal][0] // 10, 1 + want[r.doc_id, r.ordinal][-1] // 10)


def test_a_very_long_part_is_packed_in_linear_work(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("seq"), F.lit("text").alias("kind"), F.expr("repeat('x', cast(id % 7 as int))").alias("md"), F.lit("").alias("content"), F.col("id").cast("string").alias("element_id"), F.lit(1).alias("page"))
    C.chunks(df.limit(10), 300).collect()
    began = datetime.now()
    got = C.chunks(df, 300).orderBy("ordinal").select("element_ids").collect()
    assert (datetime.now() - began).total_seconds() < 20  # a few seconds where the machine is free
    assert [[int(e) for e in r.element_ids] for r in got] == chunk_loop([("text", "x" * (i % 7)) for i in range(n)], 300)


def test_pull_json(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ('Well: {"a": "}{"} done {',), ("{ no",), ("[1]",), (None,)], "text string")
    assert [(r.json, r.code) for r in X.pull_json(df).collect()] == [('{"a": 1}', None), ('{"a": "}{"}', None), (None, "no_json_object"), (None, "no_json_object"), (None, "no_json_object")]


def test_merge_and_resolution(spark):
    d = spark.createDataFrame([("doc", 0, "P", "Model X7", ["X7"], ["chunk-2"]), ("doc", 1, "P", "model-x7", ["Orbit X7"], ["element-1"]), ("doc", 2, "P", "DeepField", ["Deep Field"], ["chunk-1"])], "doc_id string, place int, kind string, name string, aliases array<string>, refs array<string>")
    got = {r.name: (r.ref, r.aliases, r.refs) for r in X.merge_entities(d).collect()}
    assert got == {"Model X7": ("entity_0002", ["Orbit X7", "X7"], ["chunk-2", "element-1"]), "DeepField": ("entity_0001", ["Deep Field"], ["chunk-1"])}
    chain = spark.createDataFrame([(i, "k", [f"n{i}", f"n{i + 1}"]) for i in range(12)] + [(50, "other", ["n3"])], "id int, kind string, names array<string>")
    assert {r.id: r.root for r in X.resolve(chain).collect()} == {i: 0 for i in range(12)} | {50: 50}


def test_merged_extractions(spark):
    """Batch-local references, one of them used for different entities, meet in the document's own."""
    entities = [
        ("doc", 1, 1, "entity_0001", "PRODUCT", " Model X7 ", ["X7", " "], ["chunk-2"]), ("doc", 1, 2, "entity_0002", "ORG", "Acme", [], ["chunk-1"]),
        ("doc", 2, 1, "entity_0001", "ORG", "ACME", ["Acme Inc"], ["chunk-3 ", "chunk-1"]), ("doc", 2, 2, "entity_0002", "PRODUCT", "model-x7", ["Orbit X7"], ["element-1"]), ("doc", 2, 3, "", "PRODUCT", "lost", [], ["c"]),
    ]
    claims = [("doc", 1, 1, "entity_0001", "is fast ", ["chunk-2"]), ("doc", 2, 1, "entity_0002", "is fast", ["element-1"]), ("doc", 2, 2, "entity_0001", "sells", ["chunk-3"]), ("doc", 2, 3, "entity_0009", "lost", ["c"])]
    relations = [("doc", 1, 1, "entity_0002", "entity_0001", "MAKES", "makes it", ["chunk-1"]), ("doc", 2, 1, "entity_0001", "entity_0002", "MAKES", " makes it", ["chunk-3"]), ("doc", 2, 2, "entity_0001", "entity_0009", "MAKES", "lost", ["c"])]
    many = "refs array<string>"
    e, c, r, problems = X.merge_extractions(
        spark.createDataFrame(entities, f"doc_id string, batch int, place int, ref string, kind string, name string, aliases array<string>, {many}"),
        spark.createDataFrame(claims, f"doc_id string, batch int, place int, subject_ref string, statement string, {many}"),
        spark.createDataFrame(relations, f"doc_id string, batch int, place int, source_ref string, target_ref string, predicate string, statement string, {many}"),
    )
    rows = lambda df: sorted(tuple(x) for x in df.drop("doc_id").collect())
    assert rows(e) == [("entity_0001", "ORG", "Acme", ["Acme Inc"], ["chunk-1", "chunk-3"]), ("entity_0002", "PRODUCT", "Model X7", ["Orbit X7", "X7"], ["chunk-2", "element-1"])]
    assert rows(c) == [("claim_0001", "entity_0001", "sells", ["chunk-3"]), ("claim_0002", "entity_0002", "is fast", ["chunk-2", "element-1"])]
    assert rows(r) == [("relation_0001", "entity_0001", "entity_0002", "MAKES", "makes it", ["chunk-1", "chunk-3"])]
    assert rows(problems) == [(2, "claim_of_unknown_entity"), (2, "incomplete_entity"), (2, "relation_of_unknown_entity")]


def test_subgraph_limits(spark):
    edges = spark.createDataFrame([(f"e{i}", "hub", f"n{i:02d}", "R") for i in range(10)] + [("x", "n00", "far", "A")], "id string, source string, target string, relation string")
    seeds = spark.createDataFrame([("hub",)], "id string")
    for limit, want in ((1, ["hub"]), (4, ["hub", "n00", "n01", "n02"]), (12, ["hub", *(f"n{i:02d}" for i in range(10)), "far"])):
        assert [r.node for r in G.local_subgraph(edges, seeds, 2, limit).orderBy("place").collect()] == want
    assert G.neighbourhood(edges, seeds, 1).count() == 11


def test_answer_audit(spark):
    form = "turn_id int, mode string, citation_ids array<string>, coverage_gaps array<string>, blocks array<struct<type:string,markdown:string,asset_id:string,alt:string,citation_ids:array<string>>>"
    good = ("text", "said", None, None, ["c1"])
    rows = [(1, "grounded", ["c1"], [], [good]), (2, "grounded", ["c9"], [], [good]), (3, "grounded", ["c1"], [], [("figure", None, "invented", "alt", ["c1"])]), (4, "general_knowledge", [], [], [("text", "said", None, None, [])])]
    answers = spark.createDataFrame(rows, form)
    evidence = spark.createDataFrame([(t, "c1", ["a1"]) for t in (1, 2, 3)], "turn_id int, citation_id string, asset_ids array<string>")
    assert {r.turn_id: r.codes for r in A.verdicts(answers, evidence).collect()} == {1: "", 2: "unavailable_citation", 3: "unavailable_asset", 4: "no_citation"}


def test_embedding_codes(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string").coalesce(1)
    assert {r.code for r in I.embed(chunks, lambda t: [[1.0, 0.0]] * len(t), dimensions=2, batch=1).collect()} == {None}
    assert {r.code for r in I.embed(chunks, lambda t: [[1.0]] * len(t), dimensions=2).collect()} == {"embedding_dimension_mismatch"}

    def down(texts):
        raise OSError

    assert {r.code for r in I.embed(chunks, down, dimensions=2).collect()} == {"embedding_provider_unavailable"}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b""), ("c.txt", b"hello"), ("d.PDF", b"none")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.title: (r.code, r.length) for r in S.scan_pdfs(spark, str(tmp_path / "in")).collect()}
    assert got == {"a": (None, 10), "c.txt": ("unsupported_media_type", 5), "d": ("invalid_pdf_signature", 4)}  # Spark's reader passes over files of no bytes
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text('{"document_id": "d", "version": 1,\n "chunks": [{"chunk_id": "c1", "ordinal": 1, "markdown": "m", "page_start": 1, "page_end": 2, "element_ids": ["e"], "asset_ids": []}]}')
    row = S.read_chunks(spark, str(tmp_path / "c")).first()
    assert (row.doc_id, row.chunk_id, row.page_end, row.element_ids) == ("d", "c1", 2, ["e"])
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "doc_id string, version int, v string")
    for _ in range(2):  # a second run changes nothing
        S.write_version(rows, rows.where("version = 1").select("doc_id", "version"), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "data"))
    manifests = spark.read.parquet(str(tmp_path / "out" / "manifests"))
    assert [r.v for r in S.visible(stored, manifests).collect()] == ["x"]
    assert S.visible(stored.withColumn("v", F.lit("changed")), manifests).count() == 0


def test_each_secret_name(spark):
    hidden = [*S.SECRET_NAMES, *(n.replace("_", "-").title() for n in S.SECRET_NAMES), " Token ", "my_token", "db-password", "x_authorization_y", "user-credential"]
    shown = ["credential_ref", "configured", "Credential-Ref", "tokens", "secretary", "bearer_id", "key"]
    df = spark.createDataFrame([({n: "v" for n in [*hidden, *shown]},)], "m map<string,string>")
    assert sorted(S.without_secrets(df).first().m) == sorted(shown)
    for name in hidden:
        assert S.without_secrets(spark.createDataFrame([(1, 2)], ["id", name])).columns == ["id"]
    for name in shown:
        assert S.without_secrets(spark.createDataFrame([(1, 2)], ["id", name])).columns == ["id", name]


def test_tokens_are_compatible_forms(spark):
    texts = ["ＡＢＣ１２ ﬁne x²", "㐀䶿 龿", "ｶﾞ½", "e\u0301 é", "①b", "Ｋ２知识", "plain Ünïcode naïve ß 100€ — “q”"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def plain(text):
        text = unicodedata.normalize("NFKC", text).lower()
        runs = re.findall("[\u3400-\u4dbf\u4e00-\u9fff]+", text)
        return re.findall("[a-z0-9_]+", text) + [x for r in runs for x in [*r, *(r[i : i + 2] for i in range(len(r) - 1))]]

    got = {r.i: r.w for r in df.select("i", tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in "\u0130\u2126\u212A"]
    df = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(every)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", tokens(F.col("t")).alias("w")).collect()}
    assert [every[i] for i in got if got[i] != plain(f"a{every[i]}b")] == []


def test_semantic_artifact(spark):
    rows = [("d1", 1, "e2", True, "two", None), ("d1", 1, "e1", False, "one", "pending"), ("d1", 2, "e1", True, "new", None), ("d2", 1, "e9", True, None, None), ("d9", 1, "e", True, "lost", None)]
    notes = [("d1", 1, 2, True, "second", None), ("d1", 1, 1, True, "first", None)]
    documents = spark.createDataFrame([("d1", 1, "h1"), ("d1", 2, "h2"), ("d2", 1, "h3"), ("d3", 1, "h4")], "doc_id string, version int, source_sha256 string")
    form = "publishable boolean, search_text string, code string"
    elements = spark.createDataFrame(rows, f"doc_id string, version int, element_id string, {form}").repartition(3)
    pages = spark.createDataFrame(notes, f"doc_id string, version int, page int, {form}")
    got = {(r.doc_id, r.version): r for r in I.semantic_artifact(documents, pages, elements).collect()}
    assert {k: (r.pages, r.elements) for k, r in got.items()} == {("d1", 1): (2, 2), ("d1", 2): (0, 1), ("d2", 1): (0, 1), ("d3", 1): (0, 0)}
    for (doc, version), r in got.items():
        assert r.sha256 == hashlib.sha256(r.artifact.encode()).hexdigest()
        said = json.loads(r.artifact)
        assert list(said) == sorted(said) and (said["document_id"], said["document_version"]) == (doc, version)
        assert [(x["element_id"], x["publishable"], x.get("search_text"), x.get("code")) for x in said["elements"]] == sorted(x[2:] for x in rows if x[:2] == (doc, version))
        assert [(x["page"], x["search_text"]) for x in said["pages"]] == sorted((x[2], x[4]) for x in notes if x[:2] == (doc, version))


def test_anchors_tell_what_is_unusable(spark):
    chunks = spark.createDataFrame([("ok", ["e1"], [], 1), ("asset", ["e1", "e2"], ["a2"], 1), ("outside", ["e1"], ["a2"], 1), ("unknown", ["e1"], ["a9"], 1), ("bare", [], [], 1), ("boxless", ["e3"], [], 1), ("start", ["e4"], [], 7), ("none", ["e4"], [], 0)], "chunk_id string, element_ids array<string>, asset_ids array<string>, page_start int")
    elements = spark.createDataFrame([("e1", 1, 0.0, 0.0, 1.0, 1.0), ("e2", 2, 0.0, 0.0, 0.5, 0.5), ("e3", 1, 0.0, None, 1.0, 1.0), ("e4", None, 0.0, 0.0, 1.0, 1.0)], "element_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assets = spark.createDataFrame([("a2", "e2", 5)], "asset_id string, element_id string, page int")
    got = {r.chunk_id: (r.page, r.code) for r in I.anchors(chunks, elements, assets).collect()}
    lost, bad = "invalid_asset_lineage", "invalid_element_lineage"
    assert got == {"ok": (1, None), "asset": (5, None), "outside": (5, lost), "unknown": (None, lost), "bare": (1, bad), "boxless": (1, bad), "start": (7, None), "none": (0, bad)}


def test_assets_of_all_versions_and_the_newest_index(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    form = "job_id int, doc_id string, status string, created_at timestamp, updated_at timestamp, index_key string, manifest_key string, page_count int, element_count int, asset_count int, chunk_count int"
    jobs = spark.createDataFrame(
        [(1, "d", "succeeded", at(1), at(9), "i1", "m1", 3, 0, 1, 1), (2, "d", "succeeded", at(5), None, "i2", "m2", 9, 9, 9, 9), (3, "d", "failed", at(20), None, "i3", "m3", 7, 7, 7, 7), (4, "gone", "succeeded", at(2), None, None, "m3", 1, 1, 1, 1), (5, None, "succeeded", at(30), None, "i5", "m1", 1, 1, 1, 1)], form
    )
    manifests = spark.createDataFrame([("m1", [("a", "old"), ("a", "m1/a"), ("", "x")]), ("m2", [("a", "m2/a"), ("b", "m2/b"), ("c", None)]), ("m3", [("g", "m3/g")])], "manifest_key string, assets array<struct<id:string,object_key:string>>")
    assert sorted(map(tuple, J.published_assets(jobs, manifests).collect())) == [("a", "m1/a", "d", 1), ("b", "m2/b", "d", 2), ("g", "m3/g", "gone", 4)]
    documents = spark.createDataFrame([("d", 5, 6, 7, 8), ("new", 1, 2, 3, 4)], "doc_id string, page_count int, element_count int, asset_count int, chunk_count int")
    assert [tuple(r) for r in J.latest_index(jobs, documents).collect()] == [("d", "i1", 2)]
    assert sorted(map(tuple, J.backfill(documents, jobs).collect())) == [("d", 3, 6, 1, 1), ("new", 1, 2, 3, 4)]


def test_locked_conclusions_and_relations_stay(spark):
    form = "page_id string, title string, summary string, sections map<string,string>, conclusions array<string>, related array<string>"
    old = spark.createDataFrame([("a", "t", "s", {}, ["c0"], ["p0"], 1, ["conclusions"]), ("b", "t", "s", {}, ["c0"], ["p0"], 2, ["related_page_ids"]), ("c", "t", "s", {}, ["c0"], ["p0"], 3, [])], form + ", revision int, locked array<string>")
    new = spark.createDataFrame([(p, "t2", "s2", {}, ["c1"], ["p1"]) for p in "abcd"], form)
    got = {r.page_id: (r.title, r.conclusions, r.related, r.revision, r.status) for r in W.publish(old, new).collect()}
    assert got == {"a": ("t2", ["c0"], ["p1"], 2, "locked"), "b": ("t2", ["c1"], ["p0"], 3, "locked"), "c": ("t2", ["c1"], ["p1"], 4, "published"), "d": ("t2", ["c1"], ["p1"], 1, "published")}


def test_cached_outputs_must_echo_page_and_box(spark):
    form = "element_id string, version int, fingerprint string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
    row = ("e", 1, "f", "d", 2, 0.1, 0.1, 0.5, 0.5)
    work = spark.createDataFrame([row], form)
    for i, value, state in ((None, None, "hit"), (4, 3, "todo"), (5, 0.1 + 1e-9, "hit"), (5, 0.1001, "todo"), (8, None, "todo"), (3, "x", "todo"), (1, 2, "todo")):
        cached = [v if k != i else value for k, v in enumerate(row)]
        assert I.reuse(work, spark.createDataFrame([tuple(cached)], form)).first().state == state, (i, value)


def test_commits_replace_a_documents_slice(spark):
    form = "kb_id int, doc_id string, id string"
    stored = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], form)
    batch = spark.createDataFrame([(1, "a", "new"), (1, "c", "first"), (2, "a", "never")], form)
    asked = spark.createDataFrame([(1, "a", 5), (1, "c", None), (2, "a", 9), (3, "q", 0)], "kb_id int, doc_id string, expected_version int")
    versions = spark.createDataFrame([(1, 5), (2, 7)], "kb_id int, version int")
    rows, after, conflicts = G.commit_contributions(stored, batch, asked, versions)
    assert sorted(map(tuple, rows.collect())) == [(1, "a", "new"), (1, "b", "y"), (1, "c", "first"), (2, "a", "z")]
    assert sorted(map(tuple, after.collect())) == [(1, 7), (2, 7), (3, 1)]
    assert [tuple(r) for r in conflicts.collect()] == [(2, "a", "graph_version_conflict", 7)]


def test_secrets_are_left_out_at_any_depth(spark):
    df = spark.createDataFrame([((1, "s", [("t", "u")]), {"access_token": "x", "configured": "y"}, "z")], "a struct<id:int,client_secret:string,l:array<struct<db_password:string,name:string>>>, m map<string,string>, authorization string")
    row = S.without_secrets(df).first()
    assert row.asDict(True) == {"a": {"id": 1, "l": [{"name": "u"}]}, "m": {"configured": "y"}}


def test_job_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[(1, "queued", 0), (1, "running", 10), (2, "running", 20)], [(1, "succeeded", 100), (1, "running", 110), (3, "running", 5000)], [(2, "succeeded", 5100), (4, "queued", 9000)]]
    form = "job_id long, status string, ts timestamp"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(j, s, start + timedelta(seconds=t)) for j, s, t in rows], form)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs = follow_jobs(spark.readStream.schema(form).parquet(str(tmp_path / "in")))
        out = str(tmp_path / "out" / str(i))
        query = jobs.writeStream.foreachBatch(lambda b, e, out=out: b.write.mode("overwrite").parquet(f"{out}/{e}")).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    states = {}
    for i in range(3):
        for e in sorted((tmp_path / "out" / str(i)).iterdir(), key=lambda p: int(p.name)):
            states |= {r.job_id: (r.status, r.ignored) for r in spark.read.parquet(str(e)).collect()}
    assert states[1] == ("succeeded", 1) and states[2] == ("failed", 1)
