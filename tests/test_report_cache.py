import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltra import config
from siltra.operators import cache as ca
from siltra.operators import report as rp


def spans(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        stage = rng.choice([*rp.INGEST, *rp.QUERY, "answer", "phase", "rerank"])
        ms = [None, float("nan"), float(rng.integers(1, 99))][int(rng.choice(3, p=[0.05, 0.05, 0.9]))]
        rows.append((float(i), f"r{i % 3}", [None, "a", "b"][i % 3], str(stage), ms, "Boom" if rng.random() < 0.1 else None, float(rng.integers(1, 50)) if stage == "answer" and rng.random() < 0.8 else None, 5.0 if stage == "answer" else None))
    return spark.createDataFrame(rows, "ts double, run_id string, config string, stage string, ms double, error string, ttft_ms double, tok_per_s double"), pd.DataFrame(rows, columns="ts run_id config stage ms error ttft_ms tok_per_s".split())


def test_report_against_pandas(spark):
    df, p = spans(spark)
    ok = p[p.error.isna() & p.config.notna()]
    got = {r.config: r.asDict() for r in rp.ingest_waterfall(df).collect()}
    want = ok[ok.stage.isin(rp.INGEST)].groupby(["config", "stage"]).ms.sum().unstack(fill_value=0)
    for c in ("a", "b"):
        assert all(got[c][s] == want.loc[c].get(s, 0) for s in rp.INGEST) and got[c]["TOTAL"] == want.loc[c].sum()
    assert None in got
    got = {r.config: r.asDict() for r in rp.query_waterfall(df).collect()}
    want = ok[ok.stage.isin(rp.QUERY)].groupby(["config", "stage"]).ms.median().unstack(fill_value=0)
    assert all(got[c][s] == want.loc[c].get(s, 0) for c in ("a", "b") for s in rp.QUERY)
    a = ok[ok.stage == "answer"].groupby("config")
    for r in rp.perceived_latency(df).where("config is not null").collect():
        assert r.ttft_p50 == a.ttft_ms.median()[r.config] and r.ttft_p95 == pytest.approx(a.ttft_ms.quantile(0.95)[r.config]) and r.n == a.size()[r.config]
    errors = {(r.config, r.stage): (r["count"], r["first"]) for r in rp.errors_by_stage(df, ["ts"]).collect()}
    assert sum(n for n, _ in errors.values()) == p.error.notna().sum()


def test_quantiles_interpolate(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in ("x", None) for v in rng.integers(0, 30, 101)] + [("x", None), ("one", 4.0), ("none", float("nan"))]
    got = {r.k: r for r in rp.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.1, "med": 0.5, "top": 1.0}).collect()}
    for k in ("x", None):
        v = [b for a, b in rows if a == k and b is not None]
        assert (got[k].q1, got[k].med, got[k].top) == (pytest.approx(np.quantile(v, 0.1)), np.median(v), max(v)) and got[k].n == len(v)
    assert got["one"].med == 4.0 and "none" not in got


def test_warmup_throughput_split_and_levels(spark):
    rows = [(0.0, "r", "c", "phase", 0.0), (1.0, "r", "c", "retrieve", 900.0), (2.0, "r", "c", "phase", 0.0), (3.0, "r", "c", "retrieve", 10.0), (4.0, "r", "c", "embed_chunks", 500.0), (5.0, "r", "c", "embed_throughput", 0.0), (6.0, "s", "c", "embed_chunks", 0.0)]
    df = spark.createDataFrame(rows, "ts double, run_id string, config string, stage string, ms double").selectExpr("*", "cast(null as string) error", "if(stage = 'embed_throughput', 200, null) tokens")
    assert rp.query_waterfall(df).first().retrieve == 455.0 and rp.query_waterfall(df, exclude_warmup=True).first().retrieve == 10.0
    assert tuple(rp.embed_throughput(df).first()) == ("c", "r", 200, 500.0, 400.0)
    assert rp.server_split(df) is None and rp.succeeded(df.drop("error")).count() == 7
    req = spark.createDataFrame([(2, 10.0, 3, 1, 2.0), (2, 30.0, 5, 0, 2.0), (1, 7.0, 1, 0, 1.0)], "level int, ttft_ms double, n_content int, n_reasoning int, wall_s double")
    assert [tuple(r) for r in rp.load_levels(req).orderBy("level").collect()] == [(1, 7.0, 7.0, 1.0, 1.0, 0.0), (2, 20.0, 30.0, 2.0, 4.5, 0.5)]
    assert [tuple(r) for r in rp.rounded(spark.createDataFrame([(0.25, "x"), (0.35, "y")], "v double, s string"), 1).collect()] == [(0.2, "x"), (0.4, "y")]
    with pytest.raises(ValueError):
        rp.report(df.where("false"))
    assert set(rp.report(df.selectExpr("*", "cast(null as double) ttft_ms", "cast(null as double) tok_per_s"))) == {"errors", "ingest", "query", "perceived", "throughput"}


def test_lookup(spark):
    v = "embedding array<float>"
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], f"seq long, {v}")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.6, 0.8]), (12, [0.9396926, 0.3420201])], f"query_id long, {v}")
    assert {tuple(r) for r in ca.cache_lookup(stored, q).collect()} == {(10, 1, 1.0), (12, 1, 0.9397)}
    assert ca.cache_lookup(stored.where("false"), q).count() == 0
    more = ca.put(stored, spark.createDataFrame([([0.5, 0.5], 2.0), ([0.1, 0.1], 1.0)], f"{v}, at double"))
    assert [(r.seq, round(r.embedding[0], 1)) for r in more.orderBy("seq").collect()][3:] == [(4, 0.1), (5, 0.5)]


def test_replay_follows_the_order(spark):
    rows = [("k", 1, 1, [1.0, 0.0], "fast", False, False), ("k", 2, 2, [1.0, 0.0], "fast", False, False), ("k", 3, 3, [1.0, 0.0], "deep", True, False), ("k", 4, 4, [0.99, 0.1411], "fast", False, True), ("k", 5, 5, [0.0, 1.0], "deep", False, False), ("j", 6, 6, [1.0, 0.0], "fast", False, False), ("k", 7, 7, None, "fast", False, False)]
    df = spark.createDataFrame(rows[::-1], "config string, at int, request_id long, embedding array<float>, lane string, forced boolean, low_confidence boolean")
    got = {r.request_id: (r.lane, r.hit_of, r.stored) for r in ca.cache_replay(df, ["config"], ["at"]).collect()}
    assert got == {1: ("fast", None, True), 2: ("cache", 1, False), 3: ("deep", None, True), 4: ("cache", 1, False), 5: ("deep", None, True), 6: ("fast", None, True), 7: ("fast", None, False)}


def test_replay_waits_for_answers(spark):
    """Against a plain fold over all requests of a key: an answer serves from the moment it is ready."""
    rng = random.Random(2)
    rows = []
    for i in range(120):
        v = rng.choice([[1.0, 0.0], [0.0, 1.0], [0.8, 0.6], None])
        rows.append((rng.choice("kj"), i, float(i), v, rng.choice(["fast", "deep"]), rng.random() < 0.1, rng.random() < 0.3, rng.choice([0.5, 3.0, None]), 20.0))
    df = spark.createDataFrame(rows, "config string, request_id long, at double, embedding array<double>, lane string, forced boolean, low_confidence boolean, elapsed_s double, check_s double")
    want, stored = {}, {"k": [], "j": []}
    for key, i, at, v, lane, forced, low, took, check in rows:
        known = [(ready, r) for ready, r, w in sorted(stored[key]) if ready <= at and v is not None and round(sum(a * b for a, b in zip(v, w)), 6) >= 0.93]
        exact = [(ready, r) for ready, r, w in sorted(stored[key]) if ready <= at and v is not None and w == v]
        assert not known or exact[0] == known[0]
        hit = None if forced or not known else known[0][1]
        want[i] = ("cache" if hit is not None else lane, hit)
        if hit is None and v is not None:
            stored[key].append((at + (took or 0.0) + (check if lane == "fast" and low else 0.0), i, v))
    got = {r.request_id: (r.lane, r.hit_of) for r in ca.cache_replay(df, ["config"], ["at", "request_id"]).collect()}
    assert got == want and sum(h is not None for _, h in want.values()) > 20


def test_answer_cache(spark, tmp_path):
    store = ca.IndexStore(spark, str(tmp_path))
    store.publish({"chunks": spark.range(1)})
    c = ca.AnswerCache(spark, store)
    assert len(c) == 0
    new = spark.createDataFrame([("b", [0.0, 1.0], "2", ["x p.1"], "fast", 2), ("a", [1.0, 0.0], "1", None, "deep", 1)], "question string, embedding array<float>, answer string, sources array<string>, lane string, at int")
    c.put(new, ["at"])
    assert [(r.seq, r.question) for r in c.entries().orderBy("seq").collect()] == [(1, "a"), (2, "b")]
    c.clear()
    assert len(c) == 0
    c.put(new, ["at"])
    assert [r.seq for r in c.entries().orderBy("seq").collect()] == [3, 4]
    store.publish({"chunks": spark.range(2)})  # another version of the index begins with no answers
    assert len(c) == 0


def test_quantiles_of_a_hot_key_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"c{i % 7}", float(rng.randrange(500)) if i % 11 else None, rng.random(), "generate", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "config string, v double, w double, stage string, error string")
    got = {r.config: r for r in rp.exact_quantiles(df, ["config"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for key in {r[0] for r in rows}:
        mine = np.array([r[1] for r in rows if r[0] == key and r[1] is not None])
        assert got[key].n == len(mine) and np.isclose(got[key].a, np.quantile(mine, 0.5)) and np.isclose(got[key].b, np.quantile(mine, 0.95))
    spans = df.select("config", "stage", "error", *[F.col("v").alias(c) for c in rp.SERVER.values()])
    split = {r.config: r.prefill_ms for r in rp.server_split(spans).collect()}
    assert split.keys() == got.keys() and all(split[k] == got[k].a for k in got)  # a null config is one row


def test_jobs_and_versions(spark, tmp_path):
    job = ca.new_job("q", "auto-escalated: x")
    assert len(job["job_id"]) == 12 and job["status"] == "running"
    events = spark.createDataFrame([("a", "running", 1, None), ("a", "done", 2, "x"), ("b", "running", 1, None), ("b", "error", 3, None)], "job_id string, status string, at int, answer string")
    assert {r.job_id: r.status for r in ca.latest_jobs(events, "at").collect()} == {"a": "done", "b": "error"}
    store = ca.IndexStore(spark, str(tmp_path))
    first = store.publish({"chunks": spark.range(3)})
    second = store.publish({"chunks": spark.range(5)})
    assert store.current() == second != first and store.read("chunks").count() == 5


def test_configs():
    assert len(config.CONTROL.as_dict()) == 23 and len(config.EMBED_MATRIX) == 5 and len(config.GENERATION_MATRIX) == 12
    assert all(c.gen_keep_alive == "-1s" for c in config.EMBED_MATRIX[3:]) and len(config.ALL) == 19
    assert config.ALL["llamacpp-8b-filtered"].llama_host.endswith("8081") and config.DEEP.gen_think and config.FAST.metadata_filter
