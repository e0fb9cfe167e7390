"""Questions and spans as streams."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltra.operators.cache import THRESHOLD, ReplayState


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answers each micro-batch of a question stream in one plan and appends it to ``out``, once a batch.

    The batch number is a folder of the output, so a batch that runs again after a failure replaces itself.
    """
    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def span_windows(spans: DataFrame, late: str = "3 days", width: str = "1 day") -> DataFrame:
    """(window, config, stage, n, ms_sum, ms_max) of event-time windows over a span stream (``at`` timestamp, span_no).

    A span that comes again within the watermark counts once; later ones are dropped. Partial aggregates combine before the shuffle.
    """
    once = spans.withWatermark("at", late).dropDuplicatesWithinWatermark(["span_no"])
    return once.groupBy(F.window("at", width), "config", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms_sum"), F.max("ms").alias("ms_max"))


def cached_stream(requests: DataFrame, key: str = "config", threshold: float = THRESHOLD) -> DataFrame:
    """(key, request_id, lane, hit_of, cache_sim) of a request stream (key, request_id, at, embedding, lane, forced, low_confidence):
    the cache policy with one cache a key in the state store. Requests of a batch are taken in the order of ``at``; null vectors
    miss and are not stored. ``elapsed_s`` and ``check_s`` may be there as in :func:`cache.cache_replay`. A key's state are the vectors of
    its answers; bound a batch with the source's trigger options."""
    out = f"`{key}` string, request_id long, lane string, hit_of long, cache_sim double"
    state = "ids array<long>, ready array<double>, vecs array<array<double>>"
    slim = [c for c in (key, "request_id", "at", "embedding", "lane", "forced", "low_confidence", "elapsed_s", "check_s") if c in requests.columns]

    def step(k, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        cache = ReplayState(threshold)
        stored: list[tuple[int, float, list[float]]] = list(zip(*held.get)) if held.exists else []
        for request, ready, v in stored:
            heapq.heappush(cache.waiting, (ready, request, list(v)))
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        got = []
        for r in rows.itertuples():
            v = None if r.embedding is None else [float(x) for x in r.embedding]
            lane, hit, sim, ready = cache.request(int(r.request_id), v, float(r.at), r.lane, bool(r.forced), bool(r.low_confidence), float(getattr(r, "elapsed_s", 0.0) or 0.0), float(getattr(r, "check_s", 0.0) or 0.0))
            got.append((k[0], int(r.request_id), lane, hit, sim))
            if ready is not None:
                stored.append((int(r.request_id), ready, v))
        held.update(tuple(map(list, zip(*stored))) if stored else ([], [], []))
        yield pd.DataFrame(got, columns=[key, "request_id", "lane", "hit_of", "cache_sim"]).astype({"hit_of": "Int64"})

    return requests.select(slim).groupBy(key).applyInPandasWithState(step, out, state, "append", "NoTimeout")
