"""The registered queries' SQL is SQL; op1, which SQL can't express, is held against a plain extraction."""

import random
from html.parser import HTMLParser

from docloom.llm.queries import ORACLE_SQL, QUERIES, op1_html_text


def test_sql_is_text_of_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert all(isinstance(sql, str) for sql in ORACLE_SQL.values())


class Plain(HTMLParser):
    """Text of each h1, p and li: in an article if there is one, else anywhere; never in a nav, aside or footer."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)
        if tag in ("h1", "p", "li"):
            self.found.append(["", "article" in self.open, bool({"nav", "aside", "footer"} & set(self.open))])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if {"h1", "p", "li"} & set(self.open):
            self.found[-1][0] += data

    def text(self):
        marked = any(inside and not side for _, inside, side in self.found)
        return "\n\n".join(" ".join(x.split()) for x, inside, side in self.found if not side and (inside or not marked) and x.split())


def test_op1_is_a_plain_extraction(spark, tmp_path):
    rnd = random.Random(3)
    say = lambda: " ".join(rnd.choice(["sun &amp; rain", "<b>red</b>", "é", "a\n b", "x &lt; y", "blue"]) for _ in range(rnd.randrange(1, 6)))
    rows = []
    for i in range(240):
        body = f"<h1>{say()}</h1>" + "".join(rnd.choice(["<p>{}</p>", "<ul><li>{}</li></ul>", "<aside><p>{}</p></aside>"]).format(say()) for _ in range(rnd.randrange(8)))
        host = f"h{min(i % 9, 3)}.example"
        if i % 8:
            body = f"<article>{body}</article>"
        else:
            host = f"alone{i}.example"
        rows.append((i, f"http://{host}/{i % 3}/{i}", f"<html><body><nav><p>Menu</p></nav><div>{body}</div><footer><p>Foot</p></footer></body></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: (Plain(page).text(), url) for i, url, page in rows}
    got = op1_html_text(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.page_id: (r.text, r.url) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
