import random

import pytest

from siltra.llm.splitting import RANGE_CHARS, coverage, piece_offsets, scan_range, split_files, split_oversized, text_files


def text_of(rng, n, sentence=True):
    out = []
    for i in range(n):
        end = rng.choice([". ", ".\n", "\n\n", " ", " ", " ", " "]) if sentence else " "
        out.append(f"w{i}" + ("." if end.startswith(".") else "") + end.lstrip("."))
    return "".join(out)


def check(text, pieces, limit=400, overlap=80):
    """Pieces are in order, hold at most the limit, lose no word and overlap by about what's asked."""
    words = text.split()
    upto, first = 0, True
    for p in pieces:
        got = p.piece.split()
        assert len(got) == p.n_words <= limit
        at = max(i for i in range(upto + 1) if words[i:i + len(got)] == got) if not first else 0
        assert words[at:at + len(got)] == got
        if not first:
            assert overlap - overlap // 4 <= upto - at <= overlap + overlap // 4
        assert at + len(got) > upto or not words
        upto, first = at + len(got), False
    assert upto == len(words)


@pytest.mark.parametrize("range_chars", [1 << 16, RANGE_CHARS, 300])
def test_pieces_cover_the_text(spark, range_chars):
    rng = random.Random(4)
    texts = [text_of(rng, n) for n in (0, 1, 399, 400, 401, 1000, 2500)] + [text_of(rng, 900, False), "x" * 3000, "   ", None, "no end " * 300]
    df = spark.createDataFrame([(i, t, "other", i) for i, t in enumerate(texts)], "chunk_no long, text string, key string, piece int")
    got = split_oversized(df, range_chars=range_chars).orderBy("chunk_no", "piece_no").collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r.chunk_no == i]
        assert [r.piece_no for r in mine] == list(range(len(mine)))
        if t is None or not t.strip():
            assert not mine
            continue
        assert {r.total_words for r in mine} == {len(t.split())}
        if len(t.split()) <= 400:
            assert len(mine) == 1
        if len(set(t.split())) == len(t.split()):
            check(t, mine)


def test_cuts_at_sentence_ends(spark):
    text = " ".join(f"This is sentence number {i} of the long text." for i in range(150))
    df = spark.createDataFrame([(1, text)], "chunk_no long, text string")
    pieces = split_oversized(df).orderBy("piece_no").collect()
    assert len(pieces) > 3
    assert all(p.piece.endswith(".") and p.piece.startswith("This") for p in pieces)


def test_many_groups_meet_at_anchors(spark):
    rng = random.Random(5)
    text = text_of(rng, 9000)
    df = spark.createDataFrame([(1, text)], "chunk_no long, text string")
    check(text, split_oversized(df, range_chars=1000, group_words=2000).orderBy("piece_no").collect())


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice(["größe", "naïve", "日本", "plain", "end."]) + f"{i} " for i in range(5000))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    got = split_files(spark, [(str(path), path.stat().st_size)], range_bytes=5000).orderBy("piece_no").collect()
    check(text, got)


def test_files_with_blanks_and_ends_beyond_ascii(spark, tmp_path):
    rng = random.Random(8)
    text = "".join(rng.choice(["größe", "à", "日本", "Ѕ…x", "end"]) + f"{i}" + rng.choice(["\u00a0", "\u2003", "\u3000", " ", "\u2028", "\x85"]) for i in range(3000))
    path = tmp_path / "blanks.txt"
    path.write_text(text, encoding="utf-8", newline="")
    for range_bytes in (5000, 4999, 4998):
        check(text, split_files(spark, [(str(path), path.stat().st_size)], range_bytes=range_bytes).orderBy("piece_no").collect())
    text = "\u3000".join(f"第 {i} 文 は この 長い 文書 の 中 に あります。" for i in range(150))
    path = tmp_path / "stops.txt"
    path.write_text(text, encoding="utf-8", newline="")
    got = split_files(spark, [(str(path), path.stat().st_size)], range_bytes=3000).orderBy("piece_no").collect()
    assert len(got) > 3 and all(p.piece.endswith("。") and p.piece.startswith("第") for p in got)


def test_empty_table_and_bad_options(spark):
    df = spark.createDataFrame([], "chunk_no long, text string")
    assert piece_offsets(df).count() == 0
    with pytest.raises(ValueError):
        piece_offsets(df, limit=400, overlap=400)


def test_ranges_count_each_word_once():
    text = "alpha beta gamma delta. epsilon zeta"
    for width in range(1, len(text) + 1):
        assert sum(scan_range(text, lo, min(len(text), lo + width))[0] for lo in range(0, len(text), width)) == 6


def test_rows_of_one_key_stay_apart(spark):
    rng = random.Random(9)
    texts = [text_of(rng, n) for n in (50, 900, 900, 1200)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(None, texts[1])], "chunk_no long, text string")
    got = split_oversized(df).collect()
    assert sorted(r.total_words for r in got if r.piece_no == 0) == [50, 900, 900, 1200]
    for t in texts:
        mine = [r.piece for r in got if r.piece in t]
        assert mine and set(" ".join(mine).split()) == set(t.split())


def test_columns_and_files_agree(spark, tmp_path):
    rng = random.Random(10)
    text = text_of(rng, 6000)
    df = spark.createDataFrame([(1, text)], "chunk_no long, text string")
    want = [r.piece for r in split_oversized(df, group_words=2500).orderBy("piece_no").collect()]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text(text)
    files = text_files(spark, str(tmp_path / "f"))
    got = [r.piece for r in split_files(spark, files, range_bytes=3000, group_words=2500).orderBy("piece_no").collect()]
    assert got == want
    (row,) = coverage(piece_offsets(df, group_words=2500)).collect()
    assert (row.n_words, row.covered, row.within_limit) == (6000, 6000, True)
