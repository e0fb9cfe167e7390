"""One immutable description of an experiment: every parameter an operator reads."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    """Parameters by group. ``name`` labels every span and row that was made under them."""

    name: str
    # embedding
    embed_backend: str = "st"
    embed_model: str = "BAAI/bge-small-en-v1.5"
    embed_device: str = "cpu"
    embed_batch: int = 32
    # chunking: "structured" packs units, any other value slides a window
    chunk_tokens: int = 400
    chunk_overlap: int = 80
    chunk_strategy: str = "sliding"
    tokenizer: str = "words"
    # retrieval
    top_k: int = 5
    candidates: int = 20
    hybrid: bool = False
    metadata_filter: bool = False
    reranker: bool = False
    reranker_model: str = "BAAI/bge-reranker-base"
    reranker_device: str = "mps"
    # generation
    gen_backend: str = "ollama"
    gen_model: str = "qwen3:8b"
    gen_keep_alive: str = "5m"
    gen_think: bool = False
    max_tokens: int = 400
    ollama_host: str = "http://127.0.0.1:11434"
    llama_host: str = "http://127.0.0.1:8081"

    def as_dict(self) -> dict:
        return asdict(self)


#: The control that every other configuration is read against.
CONTROL = Config("naive-cpu")
_WIDE = {"embed_batch": 128}
_GPU = {**_WIDE, "embed_device": "mps"}

EMBED_MATRIX = [
    CONTROL,
    replace(CONTROL, name="batched-cpu", **_WIDE),
    replace(CONTROL, name="batched-mps", **_GPU),
    replace(CONTROL, name="mps-pinned", **_GPU, gen_keep_alive="-1s"),
    replace(CONTROL, name="hybrid-pinned", **_GPU, gen_keep_alive="-1s", hybrid=True),
]

# The port each model size is served on, and the variants of the generation matrix as
# (suffix, model sizes, what differs from the plain one).
_PORTS = {"8b": 8081, "4b": 8082, "1.7b": 8083, "0.6b": 8084}
_VARIANTS = [
    ("", ("8b", "4b", "1.7b", "0.6b"), {}),
    ("-filtered", ("8b", "4b", "1.7b", "0.6b"), {"metadata_filter": True}),
    ("-structured", ("4b",), {"metadata_filter": True, "chunk_strategy": "structured"}),
    ("-reranked", ("4b",), {"reranker": True}),
    ("-best", ("4b",), {"metadata_filter": True, "reranker": True}),
]


def served(size: str, **changes) -> Config:
    """A configuration that generates with the model of ``size`` on its own llama-server."""
    base = Config(f"llamacpp-{size}", gen_backend="llamacpp", gen_model=f"qwen3-{size}", llama_host=f"http://127.0.0.1:{_PORTS[size]}", **_GPU)
    return replace(base, **changes)


GENERATION_MATRIX = [
    Config("ollama-4b", **_GPU, gen_keep_alive="-1s", gen_model="qwen3:4b"),
    *(served(size, name=f"llamacpp-{size}{suffix}", **changes) for suffix, sizes, changes in _VARIANTS for size in sizes),
]

#: The two lanes of the service.
FAST = served("4b", name="service-fast", metadata_filter=True)
DEEP = served("8b", name="service-deep", metadata_filter=True, gen_think=True, max_tokens=2000)

ALL = {c.name: c for c in (*EMBED_MATRIX, *GENERATION_MATRIX, FAST, DEEP)}
