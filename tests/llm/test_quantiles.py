import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltra.llm import quantiles as q


def rank_error(values, got, p):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, got, "left") + 1, np.searchsorted(s, got, "right")
    want = math.ceil(p * len(s))
    return max(0, lo - want, want - hi) / len(s)


@pytest.mark.parametrize("k", [64, 2048])
@pytest.mark.parametrize("n", [1, 10, 5000, 300_000])
def test_rank_error_within_one_percent(k, n):
    values = np.random.default_rng(n).lognormal(3, 2, n)
    parts = np.array_split(values, 7)
    whole, merged = q.Sketch(k), q.Sketch(k)
    whole.add(values)
    for p in parts:
        s = q.Sketch(k)
        s.add(p)
        for level, buffer in s.rows():
            merged.take(level, buffer)
    for s in (whole, merged):
        assert s.n == n
        for p, got in zip((0.5, 0.9, 0.95, 0.99), s.quantiles([0.5, 0.9, 0.95, 0.99])):
            assert rank_error(values, got, p) <= (0.01 if k == 2048 else math.log2(max(2, n / k) + 1) / (2 * k) + 1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60), st.floats(0.01, 1))
def test_exact_while_small(values, p):
    s = q.Sketch(64)
    s.add(np.array(values))
    assert s.quantiles([p])[0] == sorted(values)[max(1, math.ceil(p * len(values) - 1e-9)) - 1]


def test_presorted_and_tied_values():
    for values in (np.arange(200_000.0), np.arange(200_000.0)[::-1], np.repeat([1.0, 2.0], 50_000)):
        s = q.Sketch(2048)
        for part in np.array_split(values, 50):
            s.add(part)
        assert all(rank_error(values, g, p) <= 0.01 for p, g in zip((0.5, 0.99), s.quantiles([0.5, 0.99])))


def rows(spark, data):
    import datetime

    schema = "span_no long, ts double, config string, stage string, ms double, error string, ingested_at timestamp_ntz"
    return spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1 + i % 20)) for i, r in enumerate(data)], schema)


def test_days_combine_and_bad_spans_go(spark):
    data = [(i, 86400.0 * (i % 5), "a" if i % 3 else None, " Parse " if i % 2 else "PARSE", float(i), None) for i in range(400)]
    data += [data[7]] * 3 + [(1000, 0.0, "a", "parse", None, None), (1001, 0.0, "a", "parse", float("nan"), None), (1002, 0.0, "a", "parse", -1.0, None), (1003, 0.0, "a", "parse", 9e9, "Boom: x"), (None, 0.0, "a", "parse", 5e9, None)]
    got = {(r.config, r.stage): r for r in q.stage_percentiles(rows(spark, data)).collect()}
    for config in ("a", None):
        want = sorted(float(i) for i in range(400) if (None if i % 3 == 0 else "a") == config)
        r = got[config, "parse"]
        assert r.n == len(want) and r.p50 == want[math.ceil(0.5 * len(want)) - 1] and r.p99 == want[math.ceil(0.99 * len(want)) - 1]
    assert len(got) == 2
    assert q.stage_percentiles(rows(spark, [])).count() == 0


def test_hot_group_through_salted_merge(spark):
    df = spark.range(0, 60_000, 1, 12).selectExpr("'g' as g", "cast((id * 7919) % 60000 as double) as v")
    got = q.read_quantiles(q.merge_sketches(q.partial_sketches(df, ["g"], "v", k=128, most_held=10_000), ["g"], 128), ["g"], q.QS, 128).collect()
    assert len(got) == 1 and got[0].n == 60_000 and abs(got[0].p50 - 30_000) < 60_000 * 0.04
