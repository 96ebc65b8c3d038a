import random
import zlib

from docloom.llm.toxicity import Lexicon, score_toxicity


def test_levenshtein_product_equals_edit_distance():
    rnd = random.Random(1)
    lexicon = Lexicon({"moron": 2.0, "clown": 2.0, "idiot": 2.0}, frozenset({"moron", "clown", "idiot"}))

    def edits(w):
        letters = "abcdefghijklmnopqrstuvwxyz0"
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}

    near = set().union(*(edits(t) for t in lexicon.fuzzy))
    words = {"".join(rnd.choice("moronclwidt0") for _ in range(rnd.randrange(3, 7))) for _ in range(3000)} | set(rnd.sample(sorted(near), 300))
    assert {w for w in words if lexicon.near(w)} == {w for w in words if w in near}


def test_held_out_accuracy_and_odd_rows(spark):
    rnd = random.Random(3)
    bad = ["moronic", "clownish", "idiotic", "scummy"]
    docs, labels = [], []
    for d in range(700):
        toxic = d % 5 == 0
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 60))]
        if toxic:
            for _ in range(3):
                t = rnd.choice(bad)
                w.insert(rnd.randrange(len(w)), t[:2] + "x" + t[3:] if rnd.random() < 0.1 else t)
        docs.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "w1 w2"), (0, "w1"), (5002, "you moronic idiotic scummy clownish"), (5003, "you idiitic clownsh moronic"), (5004, "w1 w2 " * 4000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, lang string, toxic int")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = score_toxicity(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    held = [(by[d].predicted, y) for d, y in labels if d and zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in labels if d)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert by[5002].predicted == 1 and by[5003].predicted == 1
    assert not any(by[d].predicted for d in (5000, 5001, None, 5004))
    assert score_toxicity(df.limit(0), lab).collect() == []
    assert not any(r.predicted for r in score_toxicity(df.limit(20), lab.limit(0)).collect())
