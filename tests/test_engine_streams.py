import datetime
import json
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltra import config
from siltra.operators import adapters as ad
from siltra.operators import report
from siltra.plans import engine as en
from siltra.sources import records
from siltra.streaming import streams

ROOT = Path(__file__).resolve().parents[1]
CFG = replace(config.CONTROL, name="test", gen_backend="extractive", chunk_tokens=40, chunk_overlap=8, metadata_filter=True, hybrid=True, reranker=True, reranker_model="overlap")


@pytest.fixture
def folder(tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "camp_alder.txt").write_text("The rent of the camp is 400 EUR. " * 8)
    (corpus / "dunes_trip.md").write_text("Day 1 - 3 Mar at the dunes. The bus leaves early. " * 3)
    (corpus / "ferry_plan.md").write_text("Day 1 - 3 Apr by ferry. The bus leaves late.")
    (corpus / "twin.txt").write_text("The rent of the camp is 400 EUR. " * 8)
    return tmp_path


def questions(spark):
    return spark.createDataFrame([(0, "what is the rent of the camp"), (1, "what of dunes and ferry on day 1"), (2, "compare all bus times")], "query_id long, question string")


@pytest.mark.parametrize("strategy", ["sliding", "structured"])
def test_ingest_and_answer(spark, folder, strategy):
    e = en.Engine(spark, replace(CFG, chunk_strategy=strategy), str(folder / strategy), make_embedder=ad.HashEmbedder)
    e.ingest(str(folder / "corpus"))
    chunks = e.chunks.orderBy("chunk_no").collect()
    assert [c.chunk_no for c in chunks] == list(range(1, len(chunks) + 1)) and len({c.id for c in chunks}) == len(chunks)
    assert "twin.txt" not in {c.source for c in chunks}
    if strategy == "structured":
        return
    got = {r.query_id: r for r in e.answer(questions(spark)).collect()}
    assert got[0].route == "fast" and got[2].route == "deep" and got[1].route == "deep"
    assert {s.split(" p.")[0] for s in got[0].sources} == {"camp_alder.txt"} and "400" in got[0].answer and got[0].low_confidence_reason is None
    assert {s.split(" p.")[0] for s in got[1].sources} == {"dunes_trip.md", "ferry_plan.md"}
    assert got[1].low_confidence_reason.startswith("sources disagree on Day 1's date")
    assert got[1].ctx_tokens > 0 and len(got[1].hits) <= 5


def test_service_batch(spark, folder):
    e = en.Engine(spark, replace(CFG, hybrid=False, reranker=False), str(folder / "s"), make_embedder=ad.HashEmbedder)
    e.ingest(str(folder / "corpus"))
    q = questions(spark).union(spark.createDataFrame([(3, "what is the rent of the camp"), (4, "which bus")], "query_id long, question string"))
    q = q.withColumn("force_lane", F.when(F.col("query_id") == 4, "deep").when(F.col("query_id") == 0, "fast"))
    stored = ad.embed(spark.createDataFrame([(1, "what is the rent of the camp", "400", ["x p.1"])], "seq long, question string, answer string, sources array<string>"), ad.HashEmbedder, text="question")
    got = {r.query_id: r for r in e.ask_batch(q, stored, e.cfg).collect()}
    assert {k: r.lane for k, r in got.items()} == {0: "fast", 1: "deep", 2: "deep", 3: "cache", 4: "deep"}
    assert got[3].answer == "400" and got[3].low_confidence is False and got[4].low_confidence is None and got[0].low_confidence is False
    doubtful = e.ask_batch(questions(spark).where("query_id = 1").withColumn("force_lane", F.lit("fast")), None, e.cfg)
    r = doubtful.first()
    assert r.low_confidence and r.trigger == "auto-escalated: " + r.low_confidence_reason
    assert [x.lane for x in e.verify(doubtful, e.cfg).collect()] == ["deep"]
    turns = en.load_prompts(e, questions(spark), 7).orderBy("turn").collect()
    assert [t.query_id for t in turns] == [0, 1, 2, 0, 1, 2, 0]


def test_matrix_is_logged_and_reported(spark, folder):
    cfgs = [replace(CFG, name="one"), replace(CFG, name="two", hybrid=False, reranker=False, chunk_strategy="structured")]
    q = questions(spark).withColumn("expect", F.lit("400"))
    en.run_matrix(spark, cfgs, str(folder / "corpus"), q, str(folder / "m"), str(folder / "log"), ad.HashEmbedder)
    spans = records.read_spans(spark, str(folder / "log"))
    by = {(r.config, r.stage): r["count"] for r in spans.groupBy("config", "stage").count().collect()}
    once = ["run_start", "embed_model_load", "parse", "chunk", "dedup", "embed_chunks", "embed_throughput", "index_build", "run_end"]
    assert all(by[c, s] == 1 for c in ("one", "two") for s in once) and by["one", "reranker_model_load"] == 1 and ("two", "reranker_model_load") not in by
    # one warm-up question and three measured ones
    assert all(by[c, s] == n for c in ("one", "two") for s, n in (("phase", 2), ("embed_query", 2), ("retrieve", 2), ("prompt_build", 2), ("generate", 4), ("answer", 3)))
    row = lambda c, s: spans.where((F.col("config") == c) & (F.col("stage") == s)).first()
    assert row("one", "parse").n_pages == 4 and row("two", "parse").n_units == 4 and row("one", "dedup").n_dropped > 0 and row("one", "embed_model_load").dim == 64
    assert row("one", "answer").expect == "400" and row("one", "answer").sources and row("one", "rerank").n_reranked > 0
    tables = report.report(spans, full=True)
    assert set(tables) == {"errors", "ingest", "query", "perceived", "throughput", "server"}
    for name, stages in (("ingest", report.INGEST), ("query", [s for s in report.QUERY if s != "generate"])):
        for r in tables[name].collect():
            assert all(r[s] > 0 for s in stages), (name, r)
    assert tables["throughput"].count() == 2 and {r.n for r in tables["perceived"].collect()} == {3}


def test_reranker_of_the_config(spark, folder):
    e = en.Engine(spark, replace(CFG, reranker_model="no such model"), str(folder / "r"), make_embedder=ad.HashEmbedder)
    with pytest.raises(Exception, match="sentence_transformers"):
        e.ingest(str(folder / "corpus"))

    class Shortest:
        def predict(self, pairs):
            return [-len(t) for _, t in pairs]

    e = en.Engine(spark, CFG, str(folder / "r"), make_embedder=ad.HashEmbedder, make_scorer=Shortest)
    e.ingest(str(folder / "corpus"))
    best = {r.query_id: r.chunk_no for r in e.retrieve(questions(spark).where("query_id = 2")).where("rank = 1").collect()}
    sizes = {r.chunk_no: len(r.text) for r in e.chunks.collect()}
    assert sizes[best[2]] == min(sizes.values())


def test_service_keeps_cache_and_jobs(spark, folder):
    cfg = replace(CFG, hybrid=False, reranker=False)
    s = en.Service(en.Engine(spark, cfg, str(folder / "v"), make_embedder=ad.HashEmbedder), replace(cfg, name="deep"))
    s.ingest(str(folder / "corpus"))
    q = questions(spark).withColumn("force_lane", F.when(F.col("query_id") == 1, "fast"))
    first = {r.query_id: r for r in s.ask(q).collect()}
    assert first[0].lane == "fast" and first[0].job_id is None and first[1].low_confidence and first[1].job_id and first[2].lane == "deep" and first[2].answer is None
    assert len(s.cache) == 1  # the confident answer alone
    again = {r.query_id: r for r in s.ask(questions(spark).where("query_id <> 2")).collect()}
    assert again[0].lane == "cache" and again[0].answer == first[0].answer and again[1].lane == "deep"  # the doubtful one isn't stored yet
    assert {r.status for r in s.jobs.latest().collect()} == {"running"}
    done = s.work().collect()
    assert {r.status for r in done} == {"done"} and {r.trigger is None for r in done} == {True, False} and all(len(r.job_id) == 12 and r.answer for r in done)
    assert {r.lane for r in s.ask(questions(spark)).collect()} == {"cache"} and s.health()["cache_size"] == 4
    s.cache.clear()
    assert len(s.cache) == 0
    s.engine.cfg = replace(cfg, gen_backend="none")
    failed = en.Service(s.engine, replace(cfg, gen_backend="extractive", chunk_tokens=30))
    failed.ingest(str(folder / "corpus"))
    assert len(failed.cache) == 0


def test_jobs_end_in_error(spark, folder):
    cfg = replace(CFG, hybrid=False, reranker=False)
    s = en.Service(en.Engine(spark, cfg, str(folder / "w"), make_embedder=ad.HashEmbedder), replace(cfg, gen_backend="llamacpp", llama_host="http://127.0.0.1:9"))
    s.ingest(str(folder / "corpus"))
    s.ask(questions(spark).where("query_id = 2")).collect()
    (job,) = s.work().collect()
    assert job.status == "error" and "URLError" in job.error and len(s.cache) == 0


def test_chunks_of_a_byte_level_vocabulary(spark, folder):
    pytest.importorskip("tiktoken")
    from siltra.functions import tokens

    if not Path(tokens.FOLDER, "byte_bpe_50k.tiktoken").exists():
        pytest.skip("no vocabulary files")
    own = tokens.tokenizer("byte_bpe_50k")()
    for strategy in ("sliding", "structured"):
        e = en.Engine(spark, replace(CFG, name=strategy, tokenizer="byte_bpe_50k", chunk_strategy=strategy, hybrid=False, reranker=False), str(folder / strategy), make_embedder=ad.HashEmbedder)
        e.ingest(str(folder / "corpus"))
        rows = e.chunks.collect()
        assert max(r.n_tokens for r in rows) == 40 and all(abs(len(own.encode(r.text)) - r.n_tokens) <= 1 for r in rows)
    text = "The rent of the camp is 400 EUR. " * 8
    ids = own.encode(text)
    pages = spark.createDataFrame([("a", 1, text), ("b", 1, None), ("c", 1, "")], "source string, page int, text string")
    from siltra.operators.chunking import sliding_chunks

    got = [r.text for r in sliding_chunks(pages, 40, 8, make=tokens.tokenizer("byte_bpe_50k")).orderBy("window_no").collect()]
    assert got == [own.decode(ids[i:i + 40]) for i in range(0, len(ids) - 8, 32)]
    with pytest.raises(ValueError):
        tokens.tokenizer("no such file")


def test_question_stream(spark, tmp_path):
    src = tmp_path / "in"
    questions(spark).write.json(str(src))
    stream = spark.readStream.schema("query_id long, question string").json(str(src))
    q = streams.answer_stream(stream, lambda b: b.withColumn("answer", F.upper("question")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_span_windows_drop_repeats(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 5)
    rows = [(1, "a", "parse", 5.0, at), (1, "a", "parse", 5.0, at), (2, "a", "parse", 7.0, at), (3, "a", "parse", 1.0, at + datetime.timedelta(days=30))]
    spark.createDataFrame(rows, "span_no long, config string, stage string, ms double, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("span_no long, config string, stage string, ms double, at timestamp").parquet(str(tmp_path / "in"))
    q = streams.span_windows(stream).writeStream.format("memory").queryName("spans").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.ms_sum, r.ms_max) for r in spark.table("spans").orderBy("window").collect()] == [(2, 12.0, 7.0), (1, 1.0, 1.0)]


def test_cached_stream_keeps_its_state(spark, tmp_path):
    src = tmp_path / "in"
    schema = "config string, request_id long, at long, embedding array<double>, lane string, forced boolean, low_confidence boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    for i, v in enumerate(([1.0, 0.0], [1.0, 0.0], [0.0, 1.0])):
        spark.createDataFrame([("k", i, i, v, "fast", False, False)], schema).coalesce(1).write.parquet(str(src / f"{i}"))
    q = streams.cached_stream(stream).writeStream.format("memory").queryName("cached").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.request_id: (r.lane, r.hit_of) for r in spark.table("cached").collect()}
    assert sum(lane == "cache" for lane, _ in got.values()) == 1 and len(got) == 3


def test_entry_works_without_the_training_package(tmp_path):
    code = """
import importlib, sys, json
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("siltra.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n.startswith("siltra.llm") else real(n, *a)
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and len(q) > 40 and not any(n[0] == "p" and n[1].isdigit() for n in q)
print(json.dumps(sorted(m for m in sys.modules if m.startswith("siltra.llm"))))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert json.loads(out.stdout) == []


def test_nothing_imports_the_training_package():
    for p in (ROOT / "siltra").rglob("*.py"):
        if "llm" not in p.parts:
            assert "siltra.llm" not in p.read_text(encoding="utf-8"), p
