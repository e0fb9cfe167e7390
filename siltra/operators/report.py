"""Reports over timing spans: errors, waterfalls, latency, throughput, load levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltra.functions.shared import materialize

# The stages of each waterfall in order; the last of each list belongs to the full form only.
INGEST = ["embed_model_load", "parse", "chunk", "dedup", "embed_chunks", "index_build"]
QUERY = ["embed_query", "retrieve", "prompt_build", "generate"]
INGEST_FULL = [INGEST[0], "reranker_model_load", *INGEST[1:]]
QUERY_FULL = [*QUERY[:2], "rerank", *QUERY[2:]]
SERVER = {"prefill_ms": "server_prompt_ms", "prefill_tok_per_s": "server_prompt_tok_per_s", "decode_ms": "server_predict_ms", "decode_tok_per_s": "server_predict_tok_per_s"}


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, n, one column a quantile): exact quantiles with linear interpolation, nulls and NaN left out; null keys are
    a group.

    Values are counted first, with a partial aggregation, then laid out in ranges of (keys, value). Ranks are running
    sums within a range plus what the ranges before it hold of the key (one row a key and range), so no task has to take
    all values of a hot key.
    """
    group = F.struct(*keys).alias("_k")
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group, F.col(value).cast("double").alias("_v"))
    counts = ok.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")).repartitionByRange("_k", "_v")
    laid = materialize(counts.withColumn("_p", F.spark_partition_id()), "counted")
    held = laid.groupBy("_k", "_p").agg(F.sum("_c").alias("_s"))
    every = Window.partitionBy("_k")
    held = held.select("_k", "_p", (F.sum("_s").over(every.orderBy("_p")) - F.col("_s")).alias("_base"), F.sum("_s").over(every).alias("n"))
    inside = Window.partitionBy("_k", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = laid.withColumn("_upto", F.sum("_c").over(inside)).join(held, ["_k", "_p"])
    lo, hi = F.col("_base") + F.col("_upto") - F.col("_c"), F.col("_base") + F.col("_upto")
    out = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        pick = lambda r: F.max(F.when((lo <= r) & (r < hi), F.col("_v")))
        a, b = pick(low), pick(high)
        out.append((a + (b - a) * F.max(at - low)).alias(name))
    return ranked.groupBy("_k").agg(F.max("n").alias("n"), *out).select("_k.*", "n", *qs)


def quantiles_of_columns(df: DataFrame, keys: list[str], values: dict[str, str], q: float) -> DataFrame:
    """(keys, one column a value): the same quantile of several columns in one pass; names map to columns. A key comes if
    any of its columns has a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("_m"), F.col(c).cast("double").alias("_x")) for name, c in values.items()])).alias("_p")
    long = df.select(*keys, pairs).select(*keys, "_p._m", "_p._x")
    return exact_quantiles(long, [*keys, "_m"], "_x", {"_q": q}).groupBy(*keys).pivot("_m", list(values)).agg(F.max("_q"))


def errors_by_stage(spans: DataFrame, order: list[str]) -> DataFrame:
    """(config, stage, count, first): failed spans and the first error in the order of ``order``."""
    return spans.where("error is not null").groupBy("config", "stage").agg(F.count("error").alias("count"), F.min_by("error", F.struct(*order)).alias("first"))


def succeeded(spans: DataFrame) -> DataFrame:
    """Spans without error; all of them where no span can have one."""
    return spans.where("error is null") if "error" in spans.columns else spans


def _total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]).alias("TOTAL")


def ingest_waterfall(spans: DataFrame, stages: list[str] = INGEST, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """Milliseconds a config spent in each ingest stage, summed over its runs, absent ones 0, and their TOTAL.

    All of ``stages`` are columns whether they occur or not. Null and NaN count as 0.
    """
    ms = F.when(~F.isnan("ms"), F.col("ms"))
    wide = succeeded(spans).where(F.col("stage").isin(stages)).groupBy(*keys).pivot("stage", stages).agg(F.sum(ms)).na.fill(0.0, stages)
    return wide.select(*keys, *stages, _total(stages))


def query_waterfall(spans: DataFrame, stages: list[str] = QUERY, exclude_warmup: bool = False) -> DataFrame:
    """Median milliseconds of each query stage by config, absent ones 0, and the sum of the medians as TOTAL.

    ``exclude_warmup`` leaves out, in each run, what lies from its first ``phase`` span up to the second, later one.
    """
    ok = succeeded(spans)
    if exclude_warmup:  # the bounds are one row a run, so a long run is no hot key of a window
        phases = ok.where("stage = 'phase'").select("run_id", "ts")
        begin = phases.groupBy(F.col("run_id").alias("_r")).agg(F.min("ts").alias("_t1"))
        later = phases.join(begin, F.col("run_id").eqNullSafe(F.col("_r"))).where("ts > _t1").groupBy(F.col("run_id").alias("_s")).agg(F.min("ts").alias("_t2"))
        bounds = begin.join(later, F.col("_r").eqNullSafe(F.col("_s")), "left").select("_r", "_t1", "_t2")
        ok = ok.join(bounds, F.col("run_id").eqNullSafe(F.col("_r")), "left").where("_t1 is null or ts < _t1 or ts >= _t2")
    med = exact_quantiles(ok.where(F.col("stage").isin(stages)), ["config", "stage"], "ms", {"med": 0.5})
    wide = med.groupBy("config").pivot("stage", stages).agg(F.max("med")).na.fill(0.0, stages)
    return wide.select("config", *stages, _total(stages))


def perceived_latency(spans: DataFrame) -> DataFrame:
    """(config, ttft_p50, ttft_p95, tok_per_s, n) of the answers; n counts all of them, measured or not."""
    answers = succeeded(spans).where("stage = 'answer'")
    long = answers.select("config", F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("x")) for c in ("ttft_ms", "tok_per_s")])).alias("p")).select("config", "p.*")
    both = exact_quantiles(long, ["config", "m"], "x", {"p50": 0.5, "p95": 0.95})
    cell = lambda m, q, name: F.max(F.when(F.col("m") == m, F.col(q))).alias(name)
    got = both.groupBy(F.col("config").alias("_c")).agg(cell("ttft_ms", "p50", "ttft_p50"), cell("ttft_ms", "p95", "ttft_p95"), cell("tok_per_s", "p50", "tok_per_s"))
    n = answers.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    return n.join(got, F.col("config").eqNullSafe(F.col("_c")), "left").select("config", "ttft_p50", "ttft_p95", "tok_per_s", "n")


def embed_throughput(spans: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(config, run_id, tokens, ms, tok_per_s): tokens of an ``embed_throughput`` span over the seconds its run spent in
    ``embed_chunks``; runs that lack either, and runs of no time, are left out."""
    ok = succeeded(spans)
    t = ok.where(f"stage = 'embed_throughput' and {tokens} is not null").groupBy("config", "run_id").agg(F.sum(tokens).alias("tokens"))
    e = ok.where("stage = 'embed_chunks' and ms is not null and not isnan(ms)").groupBy("config", "run_id").agg(F.sum("ms").alias("ms"))
    return t.join(e, ["config", "run_id"]).where("ms > 0").withColumn("tok_per_s", F.col("tokens") / (F.col("ms") / 1000))


def server_split(spans: DataFrame) -> DataFrame | None:
    """Medians of the server's own timings of ``generate`` by config; None where spans have no such columns."""
    if not set(SERVER.values()) <= set(spans.columns):
        return None
    gen = succeeded(spans).where("stage = 'generate' and server_prompt_ms is not null")
    return quantiles_of_columns(gen, ["config"], SERVER, 0.5)


def load_levels(requests: DataFrame, level: str = "level") -> DataFrame:
    """(level, ttft_p50, ttft_max, wall_s, aggregate_tok_s, reasoning_tok_median) of requests fired together.

    A request has ttft_ms, total_ms, n_content, n_reasoning and wall_s of its level.
    """
    base = requests.groupBy(F.col(level).alias("_l")).agg(F.max("ttft_ms").alias("ttft_max"), F.max("wall_s").alias("wall_s"), F.sum(F.col("n_content") + F.col("n_reasoning")).alias("_t"))
    mid = quantiles_of_columns(requests, [level], {"ttft_p50": "ttft_ms", "reasoning_tok_median": "n_reasoning"}, 0.5)
    j = base.join(mid, F.col("_l").eqNullSafe(F.col(level)), "left")
    return j.select(F.col("_l").alias(level), "ttft_p50", "ttft_max", "wall_s", (F.col("_t") / F.col("wall_s")).alias("aggregate_tok_s"), "reasoning_tok_median")


def rounded(df: DataFrame, decimals: int) -> DataFrame:
    """For display: doubles rounded half to even."""
    return df.select(*[F.bround(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def report(spans: DataFrame, order: list[str] | None = None, full: bool = False) -> dict[str, DataFrame]:
    """All tables of the report by name; an empty span table is an error, as there is nothing to report."""
    if spans.isEmpty():
        raise ValueError("no spans yet")
    tables = {
        "errors": errors_by_stage(spans, order or ["ts"]),
        "ingest": ingest_waterfall(spans, INGEST_FULL if full else INGEST),
        "query": query_waterfall(spans, QUERY_FULL if full else QUERY, exclude_warmup=full),
        "perceived": perceived_latency(spans),
    }
    if "tokens" in spans.columns:
        tables["throughput"] = embed_throughput(spans)
    if (split := server_split(spans)) is not None:
        tables["server"] = split
    return tables
