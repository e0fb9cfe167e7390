import os
import random

import pytest

from siltra.llm import tokenizing as tk

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tk.TOKENIZERS, f"{tk.VOCABULARY}.tiktoken")), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world", "it's we'll I'VE 'tis !'s ?'re", "a b 　c d", "😀 ok 👍🏽 الصفحة 7", "文書によると 42 です。", "x" * 5000, "ab " * 3000, "  lead\ttabs\r\n\r\n  and   runs   ",
    "<|endoftext|> is text", "é́ ﬁ ß İ", "1234567890" * 400, "----====....,,,," * 200,
]


def test_fragments_change_nothing():
    e = tk.ForcedEncoder()
    rng = random.Random(3)
    alphabet = ["a", "b", "Q", "é", "ß", "日", "😀", " ", " ", "\n", "\t", " ", "'", "s", "re", "!", "7", "_", "́", "x y", "qz", "zx"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    for t in texts:
        want = e.encoding.encode_ordinary(t)
        for size in (1, 2, 7, 50):
            parts = e.fragments(t, size)
            assert "".join(parts) == t
            assert sum(map(e.encoding.encode_ordinary, parts), []) == want, (t, size)
        assert e.encode(t) == want


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tk.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = tk.ForcedEncoder()
    for x in TEXTS:
        assert e.encode(x) == (t.encode(x, add_special_tokens=False).ids if x else [])


@pytest.mark.parametrize("fragment", [tk.FRAGMENT, 5])
def test_corpus_keeps_every_row(spark, fragment):
    long = "a longer text, said again and again. " * 400
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, "short", "again"), (90, "short", "again"), (91, long, "a"), (91, long + "z", "b"), (None, long, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = tk.encode_corpus(df, fragment=fragment).collect()
    e = tk.ForcedEncoder()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((k or -1, tuple(e.encoding.encode_ordinary(t) if t else ())) for k, t, _ in rows)


def test_every_row_comes_through_the_cuts():
    e = tk.ForcedEncoder()
    texts = [f"line {i} of a text about leases and their terms " * 12 for i in range(20)]
    assert all(len(e.fragments(t, tk.FRAGMENT)) > 1 for t in texts)


def test_empty_table(spark):
    assert tk.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
