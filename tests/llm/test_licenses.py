import re

from docloom.llm.licenses import evaluate, scan_licenses, to_postfix
from tests.llm import brute

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_base_columns_equal_brute_force(spark):
    texts = [
        None, "", "CC-BY cc by CC, BY", "All rights reserved. all Rights\nreserved", "x" * 5000 + " gnu GENERAL public license v3", "cc bye", "é cc by 4", "cc by cc by cc",
        "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)\ncode", "general public general public license all rights reserved cc by",
    ]
    df = spark.createDataFrame([(i, t, "l", 0.5) for i, t in enumerate(texts)] + [(None, texts[2], None, None)], "doc_id long, text string, labels string, score double")
    for r in scan_licenses(df).collect():
        w = brute.plain(texts[2] if r.doc_id is None else texts[r.doc_id])
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
        assert (r.score > 0) == bool(r.labels)
        if r.doc_id == 8:
            assert r.labels == "apache,gpl,mit" and r.expressions == ["mit gpl-2.0-only classpath-exception-2.0 with apache-2.0 and or"] and r.duty == 1
    assert scan_licenses(df.limit(0)).collect() == []


def test_shunting_yard():
    assert to_postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert to_postfix("(a or b) and c then prose") == ["a", "b", "or", "c", "and"]
    assert to_postfix("and a") is None and to_postfix("(a or b") is None and to_postfix("") is None and to_postfix("a or") is None
    assert evaluate(to_postfix("GPL-3.0 OR MIT")) == (frozenset({"gpl", "mit"}), 1)
    assert evaluate(to_postfix("GPL-3.0 AND MIT"))[1] == 3 and evaluate(to_postfix("GPL-3.0 WITH x"))[1] == 2
    assert re.fullmatch(r"[a-z0-9. -]+", " ".join(to_postfix("Apache-2.0 WITH LLVM-exception")))


def test_long_line_of_tags(spark):
    from time import monotonic

    from docloom.llm.licenses import scan_text

    began = monotonic()
    row = scan_text("SPDX-License-Identifier: MIT or Apache-2.0 " * 20_000)
    assert monotonic() - began < 20 and "mit" in row[5].lower() and len(row[7]) == 20_000
