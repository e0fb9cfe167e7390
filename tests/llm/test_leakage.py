import random

import numpy as np
import pytest

from siltra.llm import leakage as lk
from siltra.llm.common import words_of


def brute(docs, items, n=12):
    runs = {}
    for i, t in items:
        w = words_of(t)
        for p in range(len(w) - n + 1):
            runs.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t)
        for p in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[p:p + n]), ())}
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "bb", "river", "ÄRGER", "東京", "Mapping", "x9", "counted", "the"]
    line = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randrange(5, 40))) for i in range(40)]
    docs = []
    for d in range(150):
        text = line(rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            w = words_of(rng.choice(items)[1])
            k = rng.choice([8, 11, 12, 13, 30])
            at = rng.randrange(max(1, len(w) - k + 1))
            text += rng.choice([" ", "-", " zz "]) + rng.choice([" ", "; "]).join(w[at:at + k]).upper() + " " + line(4)
        docs.append((d, text))
    return docs + [(900, None), (901, ""), (902, items[3][1]), (903, items[3][1])], items + [(800, None), (801, ""), (802, "too short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs, items = corpus(seed)
    a = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items + items[:5]], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in lk.leaked_items(a, b).where("edits = 0").collect()]
    assert len(got) == len(set(got)) and set(got) == brute([x for x in docs if x[1]], [x for x in items if x[1]])
    assert len(got) > 20


def test_long_words():
    long = " ".join(chr(97 + i) * 300 for i in range(15)) + " " + " ".join("abcdefghijklmn")
    docs = [(1, "start " + " ".join(chr(97 + i) * 300 for i in range(12)) + " end"), (2, "b c d e f g h i j k l m"), (3, "b c d e f g h i j k l")]
    items = [(7, long), (8, "b c d e f g h i j k l m n")]
    got = {(d, i) for d, t in docs for i, c in lk.QGramIndex(items).leaks([t])[0].items() if c == 0}
    assert got == brute(docs, items) == {(1, 7), (2, 7), (2, 8)}


def distance(run, doc):
    """Edits between ``run`` and the nearest stretch of ``doc``, by the whole table."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(run, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def near(docs, items, words, edits):
    """Brute force: least distance of any window, where it is within the budget (window long enough for the lemma)."""
    out = {}
    for i, t in items:
        w = words_of(t)
        for p in range(len(w) - words + 1):
            run = " " + " ".join(w[p:p + words]) + " "
            for d, u in docs:
                c = distance(run, " " + " ".join(words_of(u)) + " ")
                if c <= edits and c < out.get((d, i), 99):
                    out[d, i] = c
    return out


def typos(rng, text, n):
    for _ in range(n):
        at = rng.randrange(1, len(text) - 1)
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcxyz")) + text[at + (kind != 1):]
    return text


@pytest.mark.parametrize("seed", [3, 4])
def test_near_copies_match_brute_force(seed):
    rng = random.Random(seed)
    vocab = ["lease", "garden", "harbour", "mapping", "of", "the", "seven", "report", "a", "northern"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randrange(6, 14))) for i in range(12)]
    docs = []
    for d in range(40):
        w = rng.choice(items)[1]
        docs.append((d, line(rng.randrange(4)) + " " + typos(rng, w, rng.randrange(5)) + " " + line(rng.randrange(4))))
    want = near(docs, items, 6, 2)
    found = lk.QGramIndex(items, words=6, q=5).leaks([t for _, t in docs])
    assert {(d, i): c for (d, _), f in zip(docs, found) for i, c in f.items()} == want
    assert {0, 1, 2} <= set(want.values()) and len(want) > 15


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(5)
    item = "the quick brown fox jumps over the lazy dog while seven small birds sing aloud"
    noise = " ".join(f"n{i}" for i in range(3000))
    monkeypatch.setattr(lk, "PORTION", 500)
    docs = [noise[:at] + " " + typos(rng, item, 1) + " " + noise[at:] for at in range(0, 9000, 173)]
    assert all(f == {1: 0} or f == {1: 1} for f in lk.QGramIndex([(1, item)]).leaks(docs))


@pytest.mark.parametrize("seed", [1])
def test_both_ways_give_the_same_rows(spark, seed):
    docs, items = corpus(seed)
    a = spark.createDataFrame(docs + [(5, items[4][1]), (5, "other")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    sent = sorted(map(tuple, lk.leaked_items(a, b).collect()))
    assert sorted(map(tuple, lk.leaked_items(a, b, index_chars=400).collect())) == sent and len(sent) > 20


def test_gram_hashes_depend_on_all_bytes():
    data = np.frombuffer(b"abcdefghijklmnopqrst", dtype=np.uint8)
    for q in (1, 5, 12):
        h = lk._grams(data, q)
        assert len(h) == len(data) - q + 1 == len(set(h.tolist()))
        for at in range(q):
            changed = data.copy()
            changed[at] = 1
            assert lk._grams(changed, q)[0] != h[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs, some = corpus(1)
    assert lk.leaked_items(none, spark.createDataFrame(some, "item_id long, text string")).count() == 0
    assert lk.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).count() == 0
