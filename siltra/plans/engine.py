"""The engine: ingest a corpus once, answer many questions in one plan, serve them with a cache, measure, report."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.config import Config
from siltra.functions.shared import materialize, number_rows
from siltra.functions.tokens import tokenizer
from siltra.operators import adapters, answers, cache, chunking, prompts, report, retrieval, scoping
from siltra.sources import files, records

#: Figures of a generated answer that its span keeps.
_FIGURES = ["ttft_ms", "total_ms", "n_chunks_streamed", "n_reasoning", "tok_per_s", *report.SERVER.values()]


class Engine:
    """Retrieval and answering under one configuration; tables live in an :class:`cache.IndexStore`.

    With a ``log`` every step is timed. Questions go through a step together; its span says the time a question (``ms``)
    and how many there were, so medians compare with those of questions that are asked one by one.
    """

    def __init__(
        self, spark: SparkSession, cfg: Config, root: str, log: records.RunLog | None = None,
        make_embedder: Callable[[], adapters.Embedder] | None = None, make_scorer: Callable[[], adapters.Scorer] | None = None,
    ):
        self.spark, self.cfg, self.log = spark, cfg, log
        self.store = cache.IndexStore(spark, root)
        if make_embedder is None:
            known = adapters.EMBEDDERS[cfg.embed_backend]
            make_embedder = lambda: known(cfg)
        self.make_embedder = make_embedder
        self.make_scorer = make_scorer or (lambda: adapters.scorer(cfg))

    def _timer(self, stage: str, share: int = 1, **fields):
        return self.log.timer(stage, share, **fields) if self.log else nullcontext(fields)

    def _share(self, questions: DataFrame) -> int:
        return questions.count() if self.log else 1

    # -- ingest

    def parsed(self, corpus: str | DataFrame) -> DataFrame:
        """Units (structured) or pages of a folder, or of a table (source, page, text)."""
        if not isinstance(corpus, str):
            return corpus
        return (files.read_units if self.cfg.chunk_strategy == "structured" else files.read_pages)(self.spark, corpus)

    def chunks_of(self, parsed: DataFrame) -> DataFrame:
        """Chunks by the configured strategy and tokenizer."""
        cfg, make = self.cfg, tokenizer(self.cfg.tokenizer)
        if cfg.chunk_strategy == "structured":
            keys = [c for c in ("path", "source", "page") if c in parsed.columns]
            return chunking.pack_units(parsed, keys, ["unit_no"], cfg.chunk_tokens, cfg.chunk_overlap, make=make)
        return chunking.sliding_chunks(parsed, cfg.chunk_tokens, cfg.chunk_overlap, make=make)

    def ingest(self, corpus: str | DataFrame) -> str:
        """Parses, chunks, deduplicates, numbers and embeds a corpus, builds its BM25 index where fusion is on, and publishes
        all as a new version, whose name is returned. Answers cached for the version before are no longer served."""
        cfg = self.cfg
        with self._timer("embed_model_load", backend=cfg.embed_backend, device=cfg.embed_device, model=cfg.embed_model) as s:
            probe = self.spark.createDataFrame([("",)], "text string")
            s["dim"] = dim = adapters.embed(probe, self.make_embedder).select(F.size("embedding")).first()[0]
        if cfg.reranker:
            with self._timer("reranker_model_load", model=cfg.reranker_model, device=cfg.reranker_device):
                pair = self.spark.createDataFrame([(0, 0, "a", "a")], "query_id long, chunk_no long, question string, text string")
                adapters.rerank(pair, 1, self.make_scorer).collect()
        with self._timer("parse", strategy=cfg.chunk_strategy) as s:
            parsed = materialize(self.parsed(corpus), "parsed")
            if cfg.chunk_strategy == "structured":
                s["n_units"] = parsed.count()
            else:
                flags = chunking.flag_scanned(parsed) if "suspect_scanned" not in parsed.columns else parsed
                s["n_pages"], s["n_suspect_scanned"] = flags.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("suspect_scanned").cast("long")), F.lit(0))).first()
        with self._timer("chunk", size=cfg.chunk_tokens, overlap=cfg.chunk_overlap, strategy=cfg.chunk_strategy) as s:
            chunks = materialize(self.chunks_of(parsed), "chunks")
            s["n_chunks"] = n_all = chunks.count()
        with self._timer("dedup") as s:
            place = [c for c in ("path", "source", "page", "pack_no", "window_no", "unit_no", "doc_id") if c in chunks.columns]
            unique = materialize(chunking.numbered_chunks(chunking.dedup_first(chunks, place), [*place, "id"]), "unique")
            n, tokens = unique.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0))).first()
            s["n_dropped"] = n_all - n
        version = self.store.begin()
        with self._timer("embed_chunks", batch=cfg.embed_batch, device=cfg.embed_device, n_chunks=n, n_tokens=tokens):
            stored = self.store.add(version, "chunks", adapters.embed(unique, self.make_embedder))
        if self.log:
            self.log.note("embed_throughput", tokens=tokens, dim=dim)
        with self._timer("index_build", hybrid=cfg.hybrid, n_vectors=n):
            names = ["chunks"]
            if cfg.hybrid:
                index = retrieval.bm25_index(stored)
                self.store.add(version, "postings", index.postings)
                self.store.add(version, "terms", index.terms)
                self.store.add(version, "bm25", self.spark.createDataFrame([(index.n, index.avgdl, index.mean_idf)], "n long, avgdl double, mean_idf double"))
                names += ["postings", "terms", "bm25"]
            self.store.point(version, names)
        return version

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def bm25(self) -> retrieval.Bm25Index:
        """The index built at ingest; one built without fusion gets it now."""
        if "postings" not in self.store.tables():
            return retrieval.bm25_index(self.chunks)
        n, avgdl, mean = self.store.read("bm25").first()
        return retrieval.Bm25Index(self.store.read("postings"), self.store.read("terms"), n, avgdl, mean)

    # -- queries

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(query_id, chunk_no, rank): the chunks each question gets, after scoping, fusion and reranking as configured.

        What later steps read more than once is written to the shared folder, so no step is computed twice.
        """
        cfg, chunks, n = self.cfg, self.chunks, self._share(questions)
        with self._timer("embed_query", n, n_questions=n):
            asked = materialize(adapters.embed(questions.select("query_id", "question"), self.make_embedder, text="question"), "asked")
        with self._timer("retrieve", n, n_questions=n, hybrid=cfg.hybrid, k=cfg.top_k) as s:
            scoped = scoping.allowed_sources(asked, chunks, cfg.metadata_filter)
            scoped = materialize(scoped, "scoped") if cfg.metadata_filter else scoped
            ranking = retrieval.dense_topk(chunks, scoped, cfg.candidates, allowed="allowed", group="source").select("query_id", "chunk_no", "rank")
            if cfg.hybrid:
                limited = scoped.where("allowed is not null").select("query_id", F.explode("allowed").alias("source"))
                index = self.bm25()
                free = retrieval.bm25_topk(chunks, scoped.where("allowed is null").select("query_id", "question"), cfg.candidates, index)
                pool = limited.join(chunks.select("source", "chunk_no"), "source").select("query_id", "chunk_no")
                bound = retrieval.bm25_topk(chunks, scoped.where("allowed is not null").select("query_id", "question"), cfg.candidates, index, allowed=pool)
                ranking = retrieval.hybrid(materialize(ranking, "dense"), free.unionByName(bound).select("query_id", "chunk_no", "rank"), cfg.candidates).select("query_id", "chunk_no", "rank")
            ranking = materialize(ranking, "candidates")
            if self.log:
                s["n_candidates"] = ranking.count()
        if not cfg.reranker:
            return retrieval.cut(ranking, cfg.top_k)
        with self._timer("rerank", n, n_questions=n, model=cfg.reranker_model) as s:
            pool = ranking.join(chunks.select("chunk_no", "text"), "chunk_no").join(questions.select("query_id", "question"), "query_id")
            best = materialize(adapters.rerank(pool, cfg.top_k, self.make_scorer).select("query_id", "chunk_no", "rank"), "reranked")
            s["n_reranked"] = s.get("n_reranked", 0) + (ranking.count() if self.log else 0)
        return best

    def prompts(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, hits, sources, ctx_tokens, conflicts, messages) of each question."""
        ranking, n = self.retrieve(questions), self._share(questions)
        with self._timer("prompt_build", n, n_questions=n) as s:
            built = materialize(self._built(questions, ranking), "prompts")
            if self.log:
                s["ctx_tokens"], s["conflicts_detected"] = built.agg(F.sum("ctx_tokens"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0))).first()
        return built

    def _built(self, questions: DataFrame, ranking: DataFrame) -> DataFrame:
        hits = materialize(prompts.gather_hits(ranking, self.chunks), "hits")
        flat = hits.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*")
        j = questions.select("query_id", "question").join(hits, "query_id", "left").join(answers.conflicting_dates(flat), "query_id", "left")
        none = F.array().cast(hits.schema["hits"].dataType)
        j = j.withColumn("hits", F.coalesce("hits", none))
        return j.select(
            "query_id", "question", "hits", prompts.citations(F.col("hits")).alias("sources"), prompts.context_tokens(F.col("hits")).alias("ctx_tokens"), "conflicts",
            prompts.messages(F.col("question"), F.col("hits"), F.col("conflicts")).alias("messages"),
        )

    def answer(self, questions: DataFrame, cfg: Config | None = None, partitions: int | None = None) -> DataFrame:
        """The prompts' columns with the generator's output, the reason for low confidence (null: confident) and the route."""
        own = cfg or self.cfg
        got = materialize(adapters.generate(self.prompts(questions), own, partitions=partitions), "answers")  # one call a prompt
        if self.log:
            spans = got.select(F.lit("generate").alias("stage"), F.coalesce("total_ms", F.lit(0.0)).alias("ms"), F.lit(own.gen_model).alias("model"), F.lit(own.gen_keep_alive).alias("keep_alive"), "error", *_FIGURES)
            self.log.append(spans)
        context = F.array_join(F.transform("hits", lambda h: h["text"]), " ")
        missing = answers.missing_named(got, self.chunks)
        checked = got.join(missing, "query_id", "left").withColumn(
            "low_confidence_reason", answers.confidence_reason(answers.ungrounded(F.col("answer"), context), answers.hedges(F.col("answer")), F.col("conflicts"), F.col("missing"))
        )
        return answers.route(checked, self.chunks).drop("missing", "messages")

    def ask_batch(self, questions: DataFrame, stored: DataFrame | None, deep: Config) -> DataFrame:
        """One batch without state: cached answers first, the rest by lane.

        (query_id, question, lane, answer, sources, low_confidence, low_confidence_reason, trigger). ``questions`` may force a
        lane in ``force_lane``; forced ones skip the cache. Hits carry what was stored, only the lane reads ``cache``.
        """
        q = questions if "force_lane" in questions.columns else questions.withColumn("force_lane", F.lit(None).cast("string"))
        served = None
        if stored is not None:
            served = self.cached(q.where("force_lane is null"), stored)
            q = q.join(served.select("query_id"), "query_id", "left_anti")
        routed = answers.route(q, self.chunks).withColumn("lane", F.coalesce("force_lane", "route"))
        fast = _fast(self.answer(routed.where("lane = 'fast'").select("query_id", "question")))
        slow = _deep(self.answer(routed.where("lane = 'deep'").select("query_id", "question"), deep))
        out = fast.unionByName(slow)
        return out if served is None else served.unionByName(out)

    def cached(self, questions: DataFrame, stored: DataFrame) -> DataFrame:
        """The rows of :meth:`ask_batch` for the questions that a stored entry answers."""
        asked = adapters.embed(questions.select("query_id", "question"), self.make_embedder, text="question")
        hits = cache.cache_lookup(stored.select("seq", "embedding"), asked).join(stored.select("seq", "answer", "sources"), "seq")
        j = hits.join(questions.select("query_id", "question"), "query_id")
        return _row(j, "cache", F.lit(False), F.lit(None), F.lit(None))

    def verify(self, asked: DataFrame, deep: Config) -> DataFrame:
        """Deep answers (query_id, question, lane, answer, sources) to the doubtful rows of :meth:`ask_batch`."""
        doubtful = asked.where("low_confidence").select("query_id", "question")
        return self.answer(doubtful, deep).select("query_id", "question", F.lit("deep").alias("lane"), "answer", "sources")


def _row(df: DataFrame, lane: str, low, reason, trigger) -> DataFrame:
    return df.select("query_id", "question", F.lit(lane).alias("lane"), "answer", "sources", low.cast("boolean").alias("low_confidence"), reason.cast("string").alias("low_confidence_reason"), trigger.cast("string").alias("trigger"))


def _fast(answered: DataFrame) -> DataFrame:
    reason = F.col("low_confidence_reason")
    return _row(answered, "fast", reason.isNotNull(), reason, F.concat(F.lit("auto-escalated: "), reason))


def _deep(answered: DataFrame) -> DataFrame:
    return _row(answered, "deep", F.lit(None), F.lit(None), F.lit(None))


class Service:
    """Cache, two lanes and background jobs over one index, a batch of questions at a time.

    Confident fast answers are stored at once. Doubtful ones are served, and like questions of the deep lane become jobs;
    what :meth:`work` makes of them is stored when it is done.
    """

    def __init__(self, engine: Engine, deep: Config):
        self.engine, self.deep, self.spark = engine, deep, engine.spark
        self.cache = cache.AnswerCache(engine.spark, engine.store)
        self.jobs = cache.Jobs(engine.spark, f"{engine.store.root}/jobs")

    def health(self) -> dict:
        return {"status": "ok", "lanes": ["fast", "deep"], "cache_size": len(self.cache)}

    def ingest(self, corpus: str | DataFrame) -> str:
        """A new version of the index; its cache is empty."""
        return self.engine.ingest(corpus)

    def _store(self, answered: DataFrame) -> None:
        entries = adapters.embed(answered.select("query_id", "question", "answer", "sources", "lane"), self.engine.make_embedder, text="question")
        self.cache.put(entries, ["query_id"])

    def ask(self, questions: DataFrame) -> DataFrame:
        """The columns of :meth:`Engine.ask_batch` with ``job_id``: of the check of a doubtful answer, or of a deep question, which
        has no answer yet. ``force_lane`` in ``questions`` skips cache and routing."""
        e = self.engine
        q = questions if "force_lane" in questions.columns else questions.withColumn("force_lane", F.lit(None).cast("string"))
        served = materialize(e.cached(q.where("force_lane is null"), self.cache.entries()), "served")
        rest = answers.route(q.join(served.select("query_id"), "query_id", "left_anti"), e.chunks).withColumn("lane", F.coalesce("force_lane", "route"))
        rest = materialize(rest.select("query_id", "question", "lane"), "routed")
        fast = _fast(e.answer(rest.where("lane = 'fast'").select("query_id", "question"))).withColumn("job_id", F.when(F.col("low_confidence"), cache.job_ids()))
        waiting = rest.where("lane = 'deep'").select("query_id", "question", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("array<string>").alias("sources"))
        out = materialize(fast.unionByName(_deep(waiting).withColumn("job_id", cache.job_ids())), "asked")
        self._store(out.where("lane = 'fast' and not low_confidence"))
        self.jobs.append(out.where("job_id is not null").select("job_id", F.lit("running").alias("status"), "question", "trigger"))
        return served.withColumn("job_id", F.lit(None).cast("string")).unionByName(out)

    def work(self) -> DataFrame:
        """Runs all jobs that are running, in the deep lane, and returns the last states of all jobs."""
        todo = materialize(number_rows(self.jobs.latest().where("status = 'running'").select("job_id", "question", "trigger"), ["job_id"], "query_id"), "jobs")
        got = self.engine.answer(todo.select("query_id", "question"), self.deep).select("query_id", "answer", "sources", "error", "total_ms")
        ended = materialize(todo.join(got, "query_id").withColumn("lane", F.lit("deep")), "ended")
        self._store(ended.where("error is null"))
        failed = F.col("error").isNotNull()
        self.jobs.append(ended.select("job_id", F.when(failed, "error").otherwise("done").alias("status"), "question", "trigger", "lane", "answer", "sources", "error", F.round(F.col("total_ms") / 1000, 2).alias("elapsed_s")))
        return self.jobs.latest()


def run_config(spark: SparkSession, cfg: Config, corpus: str | DataFrame, questions: DataFrame, root: str, log_folder: str, warmups: int = 1, make_embedder=None, make_scorer=None) -> None:
    """Ingests and answers under one configuration and logs all spans: the first ``warmups`` questions are asked before, in
    a phase of their own. ``questions`` may have ``expect``, which goes along with the answers."""
    with records.RunLog(spark, log_folder, cfg.name, **cfg.as_dict()) as log:
        engine = Engine(spark, cfg, f"{root}/{cfg.name}", log, make_embedder, make_scorer)
        engine.ingest(corpus)
        for i, r in enumerate(questions.orderBy("query_id").limit(warmups).collect()):
            log.note("phase", phase="warmup", i=i)
            engine.answer(questions.where(F.col("query_id") == r["query_id"])).count()
        log.note("phase", phase="measure")
        got = engine.answer(questions).join(questions.select("query_id", (F.col("expect") if "expect" in questions.columns else F.lit("")).alias("expect")), "query_id")
        log.append(got.where("error is null").select(
            F.lit("answer").alias("stage"), F.lit(0.0).alias("ms"), F.col("query_id").alias("i"), "ttft_ms", "tok_per_s", "sources", "expect", prompts.logged_answer(F.col("answer")).alias("answer"),
        ))


def run_matrix(spark: SparkSession, configs: list[Config], corpus: str | DataFrame, questions: DataFrame, root: str, log_folder: str, make_embedder=None, make_scorer=None) -> None:
    """:func:`run_config` for each configuration; read the spans with ``records.read_spans``."""
    for cfg in configs:
        run_config(spark, cfg, corpus, questions, root, log_folder, make_embedder=make_embedder, make_scorer=make_scorer)


def load_prompts(engine: Engine, questions: DataFrame, n: int) -> DataFrame:
    """``n`` prompts (turn, query_id, messages) for a load test: the questions in order, from the first again when they are
    used up, each with its nearest chunks and nothing else (no scoping, fusion or reranking)."""
    total = questions.count()
    if not total:
        raise ValueError("no questions")
    asked = adapters.embed(questions.select("query_id", "question"), engine.make_embedder, text="question")
    near = retrieval.cut(retrieval.dense_topk(engine.chunks, asked, engine.cfg.candidates), engine.cfg.top_k)
    hits = prompts.gather_hits(near, engine.chunks)
    none = F.array().cast(hits.schema["hits"].dataType)
    built = questions.select("query_id", "question").join(hits, "query_id", "left").select("query_id", prompts.messages(F.col("question"), F.coalesce("hits", none)).alias("messages"))
    turns = engine.spark.range(n).select(F.col("id").alias("turn"), F.pmod("id", F.lit(total)).alias("at"))
    picked = turns.join(number_rows(questions.select("query_id"), ["query_id"], "at", 0), "at")
    return built.join(picked.select("turn", "query_id"), "query_id").select("turn", "query_id", "messages")


def load_test(engine: Engine, questions: DataFrame, levels: tuple[int, ...] = (1, 2, 4, 8), think: bool = False) -> DataFrame:
    """The report of load levels (``report.load_levels``) of bursts of as many requests, after one request to warm the server."""
    from dataclasses import replace

    cfg = replace(engine.cfg, gen_think=think)
    ready = materialize(load_prompts(engine, questions, max(levels)), "bursts")
    adapters.burst(ready, cfg, 1).count()
    fired = None
    for n in levels:  # one after the other: the levels must not meet on the server
        one = materialize(adapters.burst(ready, cfg, n), "burst")
        fired = one if fired is None else fired.unionByName(one)
    return report.load_levels(fired.where("error is null"))
