from docloom.llm.html_diff import ARTICLE, COPY, OTHER, blocks, common_lines, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>x</p> --><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article class="post"><h1>The &amp; head</h1><p><b>First
  para&nbsp;graph<br>goes on<p>Second &lt;p&gt; a<b>b</b>c<ul><li>one<li>two</ul><aside>Side</aside><section class="comments"><p>Reader</p></section><form><label>x</label></form><p class="share-bar">Share<p>Last</article>
<div class="sidebar"><p>Links</p></div><footer>&copy; x</footer></body></html>"""


def test_zones(spark):
    rows = [(1, "http://h.example/a/1", PAGE), (2, "http://h.example/a/2", PAGE), (3, "nope", None), (None, None, ""), (4, "http://h.example/b", "<p>Just <i>text</i></p> tail")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract_pages(df).collect()}
    want = "The & head\n\nFirst para graph goes on\n\nSecond <p> abc\n\none\n\ntwo\n\nLast"
    assert got[1].text == got[2].text == want and got[1].n_chars == len(want)
    assert got[3].text == "" and got[None].text == "" and got[4].text == "Just text\n\ntail"
    assert extract_pages(df.limit(0)).collect() == []


def test_shared_lines_of_unmarked_pages_go(spark):
    page = lambda body: f"<div><p>Welcome to the site</p></div><div>{body}</div><div><p>All the links</p></div>"
    df = spark.createDataFrame([(1, "http://h.example/x/1", page("<p>alpha</p><p>beta</p>")), (2, "http://h.example/x/2", page("<p>gamma delta epsilon</p>")), (3, "http://other.example/x/1", page("<p>delta</p>"))], "page_id long, url string, html string")
    for parts in (1, 3):
        got = {r.page_id: (r.text, r.n_shared) for r in extract_pages(df.repartition(parts)).collect()}
        assert got[1] == ("alpha\n\nbeta", 2) and got[2] == ("gamma delta epsilon", 2)
        assert got[3] == ("Welcome to the site\n\ndelta\n\nAll the links", 0)


def test_title_in_an_articles_own_header_stays(spark):
    page = '<div class="header"><p>Site</p></div><article><div class="post-header"><h1>Title</h1></div><p>Body</p><div class="share">Share</div></article>'
    assert extract_pages(spark.createDataFrame([(1, "http://h.example/1", page)], "page_id long, url string, html string")).first().text == "Title\n\nBody"


def _plain_extraction(rows):
    """The whole result by definition: lines as built, nearest different page of the host, textbook alignment."""

    def aligned(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = set(), 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    first = {}
    for _, host, path, marked, lines in rows:
        key = (host, marked, tuple(lines))
        if host and lines:
            first[key] = min(first.get(key, path), path)
    result = {}
    for page, host, path, marked, lines in rows:
        key, gone = (host, marked, tuple(lines)), set()
        if key in first:
            order = sorted((p, k) for k, p in first.items() if k[0] == host)
            i = order.index((first[key], key))
            near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order)]
            common = lambda x: next((n for n, (u, v) in enumerate(zip(first[key].split("/"), x[0].split("/"), strict=False)) if u != v), min(first[key].count("/"), x[0].count("/")) + 1)
            if near:
                gone = aligned(lines, list(max(near, key=common)[1][2]))
                if marked or sum(len(lines[i]) for i in gone) >= COPY * sum(map(len, lines)):
                    gone = set()
        result[page] = ("\n\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return result


def test_whole_tables_against_the_plain_extraction(spark):
    import random

    rnd = random.Random(5)
    for marked in (True, False):
        rows, table = [], []
        for i in range(150):
            host, path = f"h{rnd.randrange(6)}.example", f"/{rnd.choice('ab')}/{rnd.choice('cd')}/{i}"  # distinct paths, so that no tie is left to digests
            body = [f"{rnd.choice('xyz')} line {rnd.randrange(12)} of {rnd.randrange(40)}" for _ in range(rnd.randrange(1, 9))]
            lines = [f"Welcome to {host}", *body, *(["Share with friends"] if rnd.random() < 0.7 else []), "All rights to the site"] if i % 9 else [f"Copied line {j}" for j in range(4)]
            lines = list(dict.fromkeys(lines))  # no line twice, so that the longest alignment's lines are few choices
            inner = "".join(f"<p>{x}</p>" for x in lines)
            html = f"<nav><a>Menu {i}</a></nav>{f'<article>{inner}</article>' if marked else f'<div>{inner}</div>'}<footer>End</footer>"
            rows.append((i, host, path, marked, lines))
            table.append((i, f"https://{host}{path}?q={i}", html))
        table.append((150, "https://h1.example/a/c/9999", "<div>" + "<p>long text</p>" * 3 + "x " * 500_000 + "</div>"))
        rows.append((150, "h1.example", "/a/c/9999", False, ["long text"] * 3 + [("x " * 500_000).strip()]))
        df = spark.createDataFrame(table, "page_id long, url string, html string")
        want = _plain_extraction(rows)
        for parts in (2, 7):
            got = {r.page_id: (r.text, r.n_shared) for r in extract_pages(df.repartition(parts)).collect()}
            assert {i for i in want if got[i] != want[i]} == set()
        assert marked or sum(n for _, n in want.values()) > 100


def test_common_lines_are_a_longest_common_subsequence():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = [x for x, s in zip(a, common_lines(a, b), strict=True) if s]
        assert len(shared) == best[-1][-1]
        rest = iter(b)
        assert all(x in rest for x in shared)


def test_names_in_an_article_count_as_a_whole():
    page = "<article>" + "".join(f'<p class="{c}">{c}</p>' for c in ("form-factor", "search-tips", "share-bar", "ad", "post header", "social share-2", "formal", "related-posts big")) + '</article><p class="cookie-law">c</p><p>o</p>'
    assert [x for x, z in blocks(page) if z == ARTICLE] == ["form-factor", "search-tips", "post header", "formal"]
    assert [x for x, z in blocks(page) if z == OTHER] == ["o"]


def test_pages_of_a_megabyte_are_read_in_linear_time():
    import time

    for piece in ("<a ", '<a "', "<a '\"", "<!", "<h1>", "<div></x>", "<p><h1>", "<li><p>", "<script ", '<p class="a\' ', "&", "<title>x", "<"):
        for end in ("", ">", "</p>"):
            began = time.process_time()
            blocks(piece * (1_000_000 // len(piece)) + end)
            assert time.process_time() - began < 10  # some 2 seconds where the machine is free


def test_unclosed_markup():
    assert [x for x, _ in blocks("<p>one<p class='x>two</p><p>three <a href=")] == ["one", "two", "three <a href="]
    assert [x for x, _ in blocks("a < b <3 <p>c<!-- d")] == ["a < b <3", "c"]
    assert [x for x, _ in blocks('<p title="a > b">x</p><P>y</p ><script>if (a<b) "</p>"</SCRIPT >z')] == ["x", "y", "z"]


def test_differencing_decides_on_doubtful_lines_of_articles(spark):
    page = lambda body: f'<article><h1>Said by all</h1>{body}<p class="share-this">Tell <i>your</i> friends</p><p class="form-factor">{len(body)}</p><div class="login-hint">Log in</div><p>a <em class="share-this">b</em> c</p></article>'
    bodies = ["<p>alpha is the first of the letters</p>", "<p>beta comes next</p>", "<p>gamma</p>"]
    rows = [(i, f"http://h.example/x/{i}", page(b)) for i, b in enumerate(bodies)] + [(3, "http://alone.example/x", page(bodies[0]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3):
        got = {r.page_id: (r.text, r.n_shared) for r in extract_pages(df.repartition(parts)).collect()}
        for i, b in enumerate(bodies):
            assert got[i] == ("\n\n".join(["Said by all", b[3:-4], str(len(b)), "a b c"]), 2)
        assert got[3][0].endswith("Tell your friends\n\n40\n\nLog in\n\na b c") and got[3][1] == 0


def test_articles_of_readers_mark_no_article(spark):
    """F4 of round 4: where readers' comments or related posts are article elements, the main text beside them used to be left out."""
    body = "<div class='entry'><h1>Title</h1><p>Body</p></div>"
    comments = "<article id='comment-12' class='comment even'><p>Nice</p></article><article class=\"related-post\"><p>Read this</p></article>"
    pages = [body + comments, f"<main>{body}{comments}</main>", f"<article class='post'>{body}{comments}</article>{comments}", f"<article class='post notice sponsored comments-open'>{body}</article>"]
    df = spark.createDataFrame([(i, f"http://h{i}.example/a", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == dict.fromkeys(range(4), "Title\n\nBody")
