import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltra.functions.shared import number_rows
from siltra.operators import chunking as ch


def pages(spark, rows):
    return spark.createDataFrame(rows, "source string, page int, text string")


def test_windows(spark):
    df = pages(spark, [("a", 1, " ".join(f"w{i}" for i in range(2000))), ("a", 2, ""), ("a", 3, None), ("a", 4, " \n "), ("b", 1, "x y"), ("c", 1, "n " * 400), ("d", 1, "n " * 401)])
    got = ch.sliding_chunks(df).orderBy("source", "page", "window_no").collect()
    n = {}
    for r in got:
        n.setdefault((r.source, r.page), []).append(r.n_tokens)
    assert n == {("a", 1): [400] * 6, ("b", 1): [2], ("c", 1): [400], ("d", 1): [400, 81]}
    assert got[1].text.split()[0] == "w320" and all(r.id == hashlib.sha256(r.text.encode()).hexdigest()[:16] for r in got)
    assert ch.sliding_chunks(df, 5, 0).where("source = 'd'").count() == 81
    for size, overlap in ((5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            ch.sliding_chunks(df, size, overlap)


def fold(units, size, overlap):
    """Plain packing of (key, text) in order."""
    out, buf, held, key = [], [], 0, None

    def flush():
        nonlocal buf, held
        if buf:
            out.append((key, "\n\n".join(buf), held))
        buf, held = [], 0

    for k, t in units:
        w = t.split()
        if k != key:
            flush()
            key = k
        if len(w) > size:
            flush()
            at = 0
            while True:
                out.append((k, " ".join(w[at:at + size]), len(w[at:at + size])))
                if at + size >= len(w):
                    break
                at += size - overlap
            continue
        if held + len(w) > size:
            flush()
        buf.append(t)
        held += len(w)
    flush()
    return out


def test_packs_like_a_plain_fold(spark):
    rng = random.Random(3)
    units = sorted((rng.choice(["a", "b", None]) or "", rng.choice([1, 2]), i, "w " * rng.choice([0, 1, 50, 100, 150, 200, 390, 450, 1000])) for i in range(200))
    df = spark.createDataFrame([(s or None, p, i, t) for s, p, i, t in units], "source string, page int, unit_no int, text string")
    got = ch.pack_units(df, ["source", "page"], ["unit_no"]).orderBy(F.asc_nulls_first("source"), "page", "pack_no", "window_no").collect()
    want = fold([((s or None, p), t) for s, p, _, t in units], 400, 80)
    assert [((r.source, r.page), r.n_tokens) for r in got] == [(k, n) for k, _, n in want]
    assert [r.text for r in got if r.n_tokens < 390] == [t for _, t, n in want if n < 390]


def test_stated_packs(spark):
    df = spark.createDataFrame([("a", i, "w " * n) for i, n in enumerate([150, 200, 100, 390])], "source string, unit_no int, text string")
    assert [r.n_tokens for r in ch.pack_units(df, ["source"], ["unit_no"]).orderBy("pack_no").collect()] == [350, 100, 390]


def test_sections(spark):
    rows = [("d", 0, "Normal", "lead"), ("d", 1, "Heading 1", "Top"), ("d", 2, None, "body"), ("d", 3, "Normal", "  "), ("d", 4, "TITLE", "Next"), ("e", 0, "heading 3", "Only")]
    got = ch.fold_sections(spark.createDataFrame(rows, "doc string, para_no int, style string, text string"), ["doc"]).orderBy("doc", "section_no").collect()
    assert [tuple(r) for r in got] == [("d", 0, "lead"), ("d", 1, "Top\nbody"), ("d", 2, "Next"), ("e", 1, "Only")]


def test_first_copy_survives_and_null_ids_stay(spark):
    rows = [("x", "b.md", 1, 0), ("x", "a.md", 2, 0), ("y", "a.md", 1, 0), (None, "c", 1, 0), (None, "c", 2, 0), ("x", "a.md", 10, 0)]
    got = ch.dedup_first(spark.createDataFrame(rows, "id string, source string, page int, key int"), ["source", "page"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", "a.md", 2, 0), ("y", "a.md", 1, 0), (None, "c", 1, 0), (None, "c", 2, 0)], key=str)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as k", "'t' as t")
    got = number_rows(df, ["k"], "no").orderBy("k").collect()
    assert [r.no for r in got] == list(range(1, 5001))
    assert number_rows(df.where("false"), ["k"], "no").count() == 0


def test_counters_and_flags(spark):
    df = pages(spark, [("a", 1, "short"), ("a", 2, None), ("b", 1, "w " * 500), ("c", 1, "w " * 500)])
    slid = ch.sliding_chunks(df)
    r = ch.ingest_counters(df, slid, ch.dedup_first(slid, ["source", "page", "window_no"])).first()
    assert tuple(r) == (4, 2, 5, 2, 1 + 400 + 180, 3)
    none = ch.sliding_chunks(df.where("false"))
    assert tuple(ch.ingest_counters(df.where("false"), none, none).first()) == (0, 0, 0, 0, 0, 0)
