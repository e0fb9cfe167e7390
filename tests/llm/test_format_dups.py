import random
import re

from pyspark.sql import functions as F

from siltra.llm import format_dups as fd

TEXTS = [
    "Rate: 5 %\nLot: 7", "LOT = 7 | rate = 5", "lot: 7; Rate: 5%", "Rate: 7\nLot: 5", "Rate 5 Lot 7", "Hello, world", "hello WORLD!", "helloworld", "Hello word", "Straße 5", "STRASSE 5", "...", "!?", "", None,
    "Note: a:b\nLot: 7", "Lot:7|Note:ab", "Rate: 5 %\nLot: 7",
]


def brute(rows):
    """Union by equal letters and digits, and by equal sets of fields."""
    parent = {k: k for k, t in rows if t is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def canon(t):
        return "".join(c for c in t.upper().lower() if c.isalnum())

    seen = {}
    for k, t in sorted(r for r in rows if r[1] is not None):
        keys = [("t", canon(t))]
        parts = [p for p in re.split(r"[\n\r|;]+", t) if canon(p)]
        if len(parts) > 1 and all(re.match(r"(?s)[^:=]*[:=]", p) and canon(re.split("[:=]", p, maxsplit=1)[0]) and canon(re.split("[:=]", p, maxsplit=1)[1]) for p in parts):
            keys.append(("f", tuple(sorted(tuple(map(canon, re.split("[:=]", p, maxsplit=1))) for p in parts))))
        for key in keys:
            if key in seen:
                a, b = sorted((root(k), root(seen[key])))
                parent[b] = a
            seen.setdefault(key, k)
    return {(root(k), k) for k in parent if root(k) != k}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(TEXTS)) for i in range(1, 200)]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "chunk_no long, text string, key string, grp int")
    ledger, members = fd.format_duplicates(df)
    assert {tuple(r) for r in members.collect()} == brute(rows)
    copies = {r.keep_no: r.copies for r in ledger.collect()}
    assert sum(copies.values()) == sum(t is not None for _, t in rows)


def test_one_text_read_as_fields_in_two_ways(spark):
    # 2 and 3 have the letters of each other but other fields; 1 links to 2 and 4 to 3 by their fields
    rows = [(1, "cd: 2\nab: 1"), (2, "ab: 1\ncd: 2"), (3, "a: b1\ncd: 2"), (4, "cd: 2\na: b1"), (5, "other: 1\nx: 2")]
    df = spark.createDataFrame(rows, "chunk_no long, text string")
    assert {tuple(r) for r in fd.format_duplicates(df)[1].collect()} == {(1, 2), (1, 3), (1, 4)} == brute(rows)


def test_batches_are_grouped_on_their_own(spark, tmp_path):
    # the second batch's text has no fields; the third links two groups of the first; each opens the stored ledger
    rows = [(1, "cd: 2\nab: 1"), (2, "cd: 2\na: b1"), (3, "e: 5\nf: 6"), (4, "lone")], [(11, "cd 2 ab 1"), (12, "a: b1\ncd: 2"), (13, "LONE"), (0, "f: 6\ne: 5")], [(21, "ab: 1\ncd: 2"), (22, "new")]
    for i, part in enumerate(rows):
        ledger = fd.Ledger(spark, str(tmp_path / "ledger"))
        ledger.take(fd.keyed(spark.createDataFrame(part, "chunk_no long, text string")))
        so_far = [r for part in rows[:i + 1] for r in part]
        links = brute(so_far)
        again = {k for _, k in links}
        groups = {k: 1 + sum(a == k for a, _ in links) for k, _ in so_far if k not in again}
        named = fd.Ledger(spark, str(tmp_path / "ledger")).named()
        assert {(r.keep_no, r.copies) for r in fd.distinct_records(named).collect()} == set(groups.items())
        assert {tuple(r) for r in fd.repeats(fd.keyed(spark.createDataFrame(so_far, "chunk_no long, text string")), named).collect()} == links


def test_truly_separate_batches(spark, tmp_path):
    rows = [(1, "cd: 2\nab: 1"), (2, "other"), (3, "ab: 1\ncd: 3"), (4, "cd 2 ab 1")]
    df = spark.createDataFrame(rows, "chunk_no long, text string")
    got = []
    for part in ("chunk_no <= 2", "chunk_no > 2"):
        got += [tuple(r) for r in fd.format_duplicates(df.where(part), batches=1, folder=str(tmp_path / "l"))[1].collect()]
    assert got == [(1, 4)]


def test_only_matching_buckets_are_read_and_written(spark, tmp_path):
    ledger = fd.Ledger(spark, str(tmp_path / "l"), buckets=16)
    ledger.take(fd.keyed(spark.createDataFrame([(i, f"text {i}") for i in range(300)], "chunk_no long, text string")))
    assert set(ledger.at["counts"]) == set(range(16)) and set(ledger.at["counts"].values()) == {1}
    again = fd.Ledger(spark, str(tmp_path / "l"))
    again.take(fd.keyed(spark.createDataFrame([(900, "TEXT-5"), (901, "text 5")], "chunk_no long, text string")))
    (met,) = [b for b, v in again.at["counts"].items() if v == 2]
    files = again.read("counts", {met}).inputFiles()
    assert len(files) == 1 and f"v=2/bucket={met}" in files[0]
    assert {(r.keep_no, r.copies) for r in again.read("counts").where("copies > 1").collect()} == {(5, 3)}
    assert again.read("counts").count() == 300 and all(len({f for f in again.read("counts", {b}).inputFiles()}) == 1 for b in range(16))


def test_a_batch_that_was_cut_off_counts_for_nothing(spark, tmp_path):
    ledger = fd.Ledger(spark, str(tmp_path / "l"))
    batch = fd.keyed(spark.createDataFrame([(1, "a"), (2, "A")], "chunk_no long, text string"))
    ledger.take(batch)
    (tmp_path / "l" / "counts" / "v=2" / "bucket=1").mkdir(parents=True)  # written, but in no manifest
    assert fd.distinct_records(fd.Ledger(spark, str(tmp_path / "l")).named()).first().copies == 2
    again = fd.Ledger(spark, str(tmp_path / "l"))
    again.take(batch)
    assert fd.distinct_records(again.named()).first().copies == 4


def test_random_batches_match_one(spark):
    rng = random.Random(3)
    field = lambda: rng.choice(["a", "ab", "b"]) + ": " + rng.choice(["1", "b1", "2"])
    rows = [(i, rng.choice(["\n", " ", "|"]).join(field() for _ in range(rng.choice([1, 2, 3])))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "chunk_no long, text string")
    for batches in (1, 4):
        assert {tuple(r) for r in fd.format_duplicates(df, batches=batches)[1].collect()} == brute(rows)


def test_hot_group_and_empty_table(spark):
    df = spark.range(1, 9001).select(F.col("id").alias("chunk_no"), F.when(F.col("id") % 3 == 0, F.lit("Same; text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    members = fd.format_duplicates(df)[1]
    assert members.count() == 2999 and members.select("keep_no").distinct().collect()[0][0] == 3
    ledger, members = fd.format_duplicates(spark.createDataFrame([], "chunk_no long, text string"))
    assert ledger.count() == 0 and members.count() == 0
