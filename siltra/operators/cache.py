"""Answer cache by similarity, the service's policy over it, jobs, and the index as versions."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltra.operators.retrieval import dense_topk

THRESHOLD = 0.93


def cache_lookup(stored: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, seq, cache_sim): the nearest stored entry of each query where its similarity reaches ``threshold``.

    ``stored`` has seq and the vector; of equal entries the first stored wins. The query set is stated and goes against
    all entries in blocks.
    """
    best = dense_topk(stored, queries, 1, row="seq", query=query, vector=vector)
    return best.where(F.col("score") >= threshold).select(query, "seq", F.bround("score", 4).alias("cache_sim"))


def put(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after ``new`` ones (without seq) were appended in the order of their ``at``; nothing is deduplicated or evicted."""
    from siltra.functions.shared import number_rows

    last = stored.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return stored.unionByName(number_rows(new, ["at"], "seq", last + 1).select(stored.columns))


class ReplayState:
    """One cache in the order of its requests: what a lookup finds depends on all answers that are ready before it.

    An answer is stored when it is ready: a confident or deep one after its own time, a doubtful one after its check in
    the deep lane; until then the same question misses. Hits are not stored again, forced requests skip the lookup.
    """

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.vecs = np.empty((0, 0))
        self.n = 0
        self.ids: list[int] = []
        self.waiting: list[tuple[float, int, list[float]]] = []  # heap by time and request

    def get(self, v: np.ndarray) -> tuple[int | None, float | None]:
        if not self.n:
            return None, None
        sims = np.round(self.vecs[:self.n] @ v, 6)
        at = int(np.argmax(sims))
        return (self.ids[at], round(float(sims[at]), 4)) if sims[at] >= self.threshold else (None, None)

    def put(self, request: int, v: np.ndarray) -> None:
        if self.n == len(self.vecs):
            grown = np.empty((max(64, 2 * self.n), len(v)))
            grown[:self.n] = self.vecs[:self.n] if self.n else 0
            self.vecs = grown
        self.vecs[self.n] = v
        self.ids.append(request)
        self.n += 1

    def settle(self, at: float) -> None:
        """Store what is ready at ``at``, in the order in which it became so."""
        while self.waiting and self.waiting[0][0] <= at:
            _, request, v = heapq.heappop(self.waiting)
            self.put(request, np.asarray(v, dtype=float))

    def request(self, request: int, v: list[float] | None, at: float, lane: str, forced: bool, low_confidence: bool, elapsed: float, check: float) -> tuple[str, int | None, float | None, float | None]:
        """(lane taken, request that answers it, similarity, time its own answer is in the cache). Without vector: a miss
        that is not stored."""
        self.settle(at)
        if v is None:
            return lane, None, None, None
        if not forced:
            hit, sim = self.get(np.asarray(v, dtype=float))
            if hit is not None:
                return "cache", hit, sim, None
        ready = at + elapsed + (check if lane != "deep" and low_confidence else 0.0)
        heapq.heappush(self.waiting, (ready, request, v))
        return lane, None, None, ready


#: What a request may lack, and what stands for it then.
_OPTIONAL = {"at": None, "elapsed_s": 0.0, "check_s": 0.0}


def cache_replay(requests: DataFrame, keys: list[str], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(keys, request_id, lane, hit_of, cache_sim, stored, ready) of requests replayed against one cache a key.

    ``requests`` has keys, ``order``, request_id, embedding, lane, forced and low_confidence, and may have ``at`` (seconds,
    ascending in ``order``; else the place in the order), ``elapsed_s`` (until its answer) and ``check_s`` (of the deep check of a
    doubtful one; both else 0). Each key's requests are streamed in order through one task; what it holds are the vectors
    of answers, never the requests. Null vectors miss and are not stored. A single key is sequential by nature: what it
    finds depends on all before it.
    """
    have = [c for c in _OPTIONAL if c in requests.columns]
    cols = [*keys, "request_id", "embedding", "lane", "forced", "low_confidence", *have]
    laid = requests.repartition(*keys).sortWithinPartitions(*keys, *order).select(cols)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, place = object(), None, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                now = tuple(r[k] for k in keys)
                if now != key:
                    key, state, place = now, ReplayState(threshold), 0
                at, elapsed, check = (r.get(c) if r.get(c) is not None else v for c, v in _OPTIONAL.items())
                at = float(place if at is None else at)
                place += 1
                lane, hit, sim, ready = state.request(r["request_id"], r["embedding"], at, r["lane"], bool(r["forced"]), bool(r["low_confidence"]), elapsed, check)
                out.append((*now, r["request_id"], lane, hit, sim, ready is not None, ready))
            cols_ = list(zip(*out)) if out else [()] * (len(keys) + 6)
            types = [*(b.schema.field(k).type for k in keys), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols_, types)], names=[*keys, "request_id", "lane", "hit_of", "cache_sim", "stored", "ready"])

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return laid.mapInArrow(run, f"{head}, request_id long, lane string, hit_of long, cache_sim double, stored boolean, ready double")


ENTRY = "seq long, question string, embedding array<float>, answer string, sources array<string>, lane string"


class AnswerCache:
    """Stored answers in a folder; they belong to one version of the index, so a new version begins with none."""

    def __init__(self, spark: SparkSession, store: IndexStore):
        self.spark, self.store = spark, store

    def _read(self, name: str, shape: str) -> DataFrame:
        try:
            return self.spark.read.schema(shape).parquet(self._path(name))
        except AnalysisException:
            return self.spark.createDataFrame([], shape)

    def _path(self, name: str) -> str:
        return f"{self.store.root}/cache/v={self.store.current()}/{name}"

    def entries(self) -> DataFrame:
        """(seq, question, embedding, answer, sources, lane) of all entries since the last :meth:`clear`."""
        upto = self._read("cleared", "upto long").agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
        return self._read("entries", ENTRY).where(F.col("seq") > upto)

    def _last(self) -> int:
        return self._read("entries", ENTRY).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def put(self, new: DataFrame, order: list[str]) -> None:
        """Append entries (without seq) in the order of ``order``; nothing is deduplicated or evicted."""
        from siltra.functions.shared import number_rows

        names = [x.split()[0] for x in ENTRY.split(", ")]
        number_rows(new, order, "seq", self._last() + 1).select(names).write.mode("append").parquet(self._path("entries"))

    def clear(self) -> None:
        self.spark.createDataFrame([(self._last(),)], "upto long").coalesce(1).write.mode("append").parquet(self._path("cleared"))

    def __len__(self) -> int:
        return self.entries().count()


class IndexStore:
    """Versions of an index in a shared folder and a pointer to the one in use; replacing it clears the cache."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _pointer(self) -> str:
        return f"{self.root}/_versions"

    def _path(self, version: str, name: str) -> str:
        return f"{self.root}/v={version}/{name}"

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write a whole new version, then point to it: readers see the old one or the new one, never parts."""
        version = self.begin()
        for name, df in tables.items():
            self.add(version, name, df)
        return self.point(version, sorted(tables))

    def begin(self) -> str:
        """The name of a version that no reader sees before :meth:`point`."""
        return uuid.uuid4().hex[:12]

    def add(self, version: str, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a version and read it back."""
        df.write.mode("errorifexists").parquet(self._path(version, name))
        return self.spark.read.parquet(self._path(version, name))

    def point(self, version: str, tables: list[str]) -> str:
        names = ",".join(tables)
        row = self.spark.createDataFrame([(version, names)], "version string, tables string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self._pointer)
        return version

    def current(self) -> str:
        """The version published last."""
        last = self.spark.read.parquet(self._pointer).orderBy(F.desc("at")).first()
        return last["version"]

    def tables(self) -> list[str]:
        """Names of the tables of the version in use."""
        return self.spark.read.parquet(self._pointer).orderBy(F.desc("at")).first()["tables"].split(",")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(self.current(), name))


JOB = "job_id string, status string, question string, trigger string, lane string, answer string, sources array<string>, error string, elapsed_s double, at double"


def new_job(question: str, trigger: str | None = None) -> dict:
    """A running job; ids are 12 random hex digits."""
    return {"job_id": uuid.uuid4().hex[:12], "status": "running", "question": question, "trigger": trigger}


class Jobs:
    """Background jobs as appended states, ``running`` and then ``done`` or ``error``; nothing is pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, states: DataFrame) -> None:
        """New states; columns of JOB that they lack are null, ``at`` is now."""
        full = states.withColumn("at", F.unix_micros(F.current_timestamp()) / 1e6)
        kinds = [(f.name, f.dataType) for f in StructType.fromDDL(JOB)]
        full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds]).write.mode("append").parquet(self.folder)

    def latest(self) -> DataFrame:
        """The last state of each job; an ended one is never running again."""
        try:
            events = self.spark.read.schema(JOB).parquet(self.folder)
        except AnalysisException:
            events = self.spark.createDataFrame([], JOB)
        return latest_jobs(events.withColumn("_o", F.struct(F.col("status") != "running", "at")), "_o").drop("_o")


def job_ids() -> Column:
    """12 random hex digits a row; write the rows before they are read twice."""
    return F.expr("substring(replace(uuid(), '-', ''), 1, 12)")


def latest_jobs(events: DataFrame, order: str = "at") -> DataFrame:
    """The last state of each job from its appended states (running, then done or error); nothing is pruned."""
    rest = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("s")).select("job_id", "s.*")


def remove(path: str) -> None:
    """Drop an old version's folder (local or mounted)."""
    import shutil

    shutil.rmtree(Path(path.removeprefix("file://")), ignore_errors=True)
