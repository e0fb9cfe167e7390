"""Models behind protocols: embedders, scorers and generators, with deterministic stand-ins.

All run as Arrow passes: a model loads once a Python worker, and the number of partitions bounds the load on a server.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.config import Config


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


Generator = Callable[[Config, list[dict]], dict]


class HashEmbedder:
    """Feature hashing: a lower-case word counts in the bucket of the first 8 hex digits of its MD5; unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.bucket = lru_cache(maxsize=1 << 16)(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            out[i] = np.bincount(list(map(self.bucket, (t or "").lower().split())) or np.empty(0, dtype=int), minlength=self.dim)
        return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


class OverlapScorer:
    """Share of the question's distinct words that the text has."""

    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return np.array([len(set((q or "").lower().split()) & set((t or "").lower().split())) / max(1, len(set((q or "").lower().split()))) for q, t in pairs])


def cross_encoder(cfg: Config) -> Scorer:
    """The configured reranker model, where its library is installed."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError as e:
        raise RuntimeError(f"reranker_model {cfg.reranker_model!r} needs the sentence_transformers library") from e
    return CrossEncoder(cfg.reranker_model, device=cfg.reranker_device)


#: Scorers by model name; any other name is a model for :func:`cross_encoder`.
SCORERS: dict[str, Callable[[Config], Scorer]] = {"overlap": lambda cfg: OverlapScorer()}


def scorer(cfg: Config) -> Scorer:
    return SCORERS.get(cfg.reranker_model, cross_encoder)(cfg)


def sentence_transformer(cfg: Config) -> Embedder:
    """The configured model, where its library is installed."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError("embed_backend 'st' needs the sentence_transformers library") from e
    model = SentenceTransformer(cfg.embed_model, device=cfg.embed_device)

    class Own:
        def encode(self, texts: list[str]) -> np.ndarray:
            return model.encode(texts, batch_size=cfg.embed_batch, normalize_embeddings=True)

    return Own()


class OllamaEmbedder:
    """Embeddings of an Ollama server, brought to unit length."""

    def __init__(self, cfg: Config):
        self.cfg = cfg

    def encode(self, texts: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), self.cfg.embed_batch):
            with _post(f"{self.cfg.ollama_host}/api/embed", {"model": self.cfg.embed_model, "input": texts[i:i + self.cfg.embed_batch]}) as r:
                out += json.load(r)["embeddings"]
        v = np.array(out, dtype=float)
        return v / (np.sqrt((v**2).sum(axis=1, keepdims=True)) + 1e-9)


EMBEDDERS: dict[str, Callable[[Config], Embedder]] = {"st": sentence_transformer, "ollama": OllamaEmbedder, "hash": lambda cfg: HashEmbedder()}


def embed(df: DataFrame, make: Callable[[], Embedder], text: str = "text", out: str = "embedding") -> DataFrame:
    """All columns of ``df`` and ``out`` (array<float>, unit length). Null text is embedded as empty text. No shuffle."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            v = np.asarray(model.encode([t or "" for t in b.column(at).to_pylist()]), dtype=np.float32)
            dim = v.shape[1] if v.ndim == 2 else 1
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, vec], names=[*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {out} array<float>")


def rerank(pool: DataFrame, top_k: int, make: Callable[[], Scorer] = OverlapScorer, query: str = "query_id", row: str = "chunk_no", question: str = "question", text: str = "text", decimals: int = 6) -> DataFrame:
    """(query, row, score, rank): the pool ordered by joint scores of question and text, which replace the old order."""
    from siltra.operators.retrieval import rank_top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            s = np.asarray(model.predict(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))), dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, decimals))], names=[query, row, "score"])

    scored = pool.select(F.col(query).cast("long"), F.col(row).cast("long"), question, text).mapInArrow(run, f"{query} long, {row} long, score double")
    return rank_top(scored, top_k, query, row)


# ---- generators -----------------------------------------------------------------------------------------------------


def _post(url: str, body: dict):
    return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=600)


def _timed(pieces: Iterator[tuple[str, str]]) -> dict:
    """Text and timings of streamed (text, reasoning) pieces; the first text ends the wait, reasoning is only counted."""
    began, first, parts, thoughts = time.perf_counter(), None, [], 0
    for said, thought in pieces:
        thoughts += bool(thought)
        if said:
            first = first or time.perf_counter()
            parts.append(said)
    total = (time.perf_counter() - began) * 1000
    ttft = (first - began) * 1000 if first else None
    seconds = max(total - (ttft or 0), 1e-6) / 1000
    return {
        "text": "".join(parts), "ttft_ms": round(ttft or total, 2), "total_ms": round(total, 2), "n_chunks_streamed": len(parts), "n_reasoning": thoughts,
        "tok_per_s": round(len(parts) / seconds, 2),
    }


def ollama_generate(cfg: Config, messages: list[dict]) -> dict:
    """One answer of an Ollama server, from its stream of JSON lines."""
    body = {"model": cfg.gen_model, "messages": messages, "stream": True, "keep_alive": cfg.gen_keep_alive, "think": cfg.gen_think, "options": {"num_predict": cfg.max_tokens}}

    def pieces() -> Iterator[tuple[str, str]]:
        with _post(f"{cfg.ollama_host}/api/chat", body) as r:
            for event in map(json.loads, filter(None, map(bytes.strip, r))):
                said = event.get("message") or {}
                yield said.get("content") or "", said.get("thinking") or ""
                if event.get("done"):
                    return

    return _timed(pieces())


def llama_generate(cfg: Config, messages: list[dict]) -> dict:
    """One answer of a llama-server, from its event stream, with the server's own timings where it sends them."""
    body = {
        "model": cfg.gen_model, "messages": messages, "stream": True, "max_tokens": cfg.max_tokens, "chat_template_kwargs": {"enable_thinking": cfg.gen_think}, "stream_options": {"include_usage": True},
    }
    own: dict = {}

    def pieces() -> Iterator[tuple[str, str]]:
        with _post(f"{cfg.llama_host}/v1/chat/completions", body) as r:
            for line in r:
                if not line.startswith(b"data: "):
                    continue
                if (said := line[6:].strip()) == b"[DONE]":
                    return
                event = json.loads(said)
                own.update(event.get("timings") or {})
                for choice in (event.get("choices") or [])[:1]:
                    delta = choice.get("delta") or {}
                    yield delta.get("content") or "", delta.get("reasoning_content") or ""

    out = _timed(pieces())
    names = {"server_prompt_ms": "prompt_ms", "server_prompt_tok_per_s": "prompt_per_second", "server_predict_ms": "predicted_ms", "server_predict_tok_per_s": "predicted_per_second"}
    return out | ({k: own.get(v) for k, v in names.items()} if own else {})


def extractive_generate(cfg: Config, messages: list[dict]) -> dict:
    """Stand-in: the first line of the first context block, cited; no server, no time."""
    block = messages[-1]["content"].removeprefix("Context:\n").partition("\n\nQuestion: ")[0]
    head, _, body = block.partition("\n")
    text = f"{body.splitlines()[0] if body.strip() else 'The context does not say.'} {head}".strip()
    return {"text": text, "ttft_ms": 0.0, "total_ms": 0.0, "n_chunks_streamed": len(text.split()), "n_reasoning": 0, "tok_per_s": 0.0}


GENERATORS: dict[str, Generator] = {"ollama": ollama_generate, "llamacpp": llama_generate, "extractive": extractive_generate}


def generator(name: str) -> Generator:
    if name not in GENERATORS:
        raise ValueError(f"unknown gen_backend: {name!r}")
    return GENERATORS[name]


GENERATED = "answer string, ttft_ms double, total_ms double, n_chunks_streamed int, n_reasoning int, tok_per_s double, server_prompt_ms double, server_prompt_tok_per_s double, server_predict_ms double, server_predict_tok_per_s double, error string"


def generate(df: DataFrame, cfg: Config, messages: str = "messages", partitions: int | None = None) -> DataFrame:
    """All columns of ``df`` but ``messages``, with the generator's output. A call that fails leaves ``error`` and no answer.

    ``partitions`` bounds how many requests are in flight at once.
    """
    rows = df.repartition(partitions) if partitions else df
    keep = [c for c in df.columns if c != messages]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != messages)
    names = [x.split()[0] for x in GENERATED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = generator(cfg.gen_backend)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.string()]
        for b in batches:
            out = []
            for m in b.column(b.schema.get_field_index(messages)).to_pylist():
                try:
                    got = call(cfg, m)
                    got["answer"] = got.pop("text")
                except Exception as e:  # noqa: BLE001 - a failed call is a row of the result
                    got = {"error": f"{type(e).__name__}: {e}"}
                out.append([got.get(n) for n in names])
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *cols], names=[*keep, *names])

    return rows.mapInArrow(run, f"{fields}, {GENERATED}")


def burst(prompts: DataFrame, cfg: Config, level: int, turn: str = "turn", messages: str = "messages") -> DataFrame:
    """(level, turn, ttft_ms, total_ms, n_content, n_reasoning, wall_s, error): the first ``level`` prompts sent at the same moment.

    One task holds the ``level`` connections in as many threads, for tasks don't start together. A failed request has an
    ``error`` and no figures. Fewer prompts make a smaller burst.
    """
    from concurrent.futures import ThreadPoolExecutor

    def call(m: list[dict]) -> dict:
        try:
            return generator(cfg.gen_backend)(cfg, m)
        except Exception as e:  # noqa: BLE001 - a failed call is a row of the result
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        began = time.perf_counter()
        with ThreadPoolExecutor(max(1, len(rows))) as pool:
            got = list(pool.map(call, [r["m"] for r in rows]))
        wall = time.perf_counter() - began
        cols = {
            "level": pa.array([level] * len(rows), pa.int32()), "turn": pa.array([r["t"] for r in rows], pa.int64()),
            **{k: pa.array([g.get(k) for g in got], pa.float64()) for k in ("ttft_ms", "total_ms")},
            "n_content": pa.array([g.get("n_chunks_streamed") for g in got], pa.int32()), "n_reasoning": pa.array([g.get("n_reasoning") for g in got], pa.int32()),
            "wall_s": pa.array([wall] * len(rows), pa.float64()), "error": pa.array([g.get("error") for g in got], pa.string()),
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    first = prompts.select(F.col(turn).cast("long").alias("t"), F.col(messages).alias("m")).orderBy("t").limit(level).coalesce(1)
    return first.mapInArrow(run, "level int, turn long, ttft_ms double, total_ms double, n_content int, n_reasoning int, wall_s double, error string")
