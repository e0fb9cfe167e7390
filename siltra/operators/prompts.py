"""Prompts and citations from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltra.functions.shared import few

#: What a hit has beside its rank.
FIELDS = ("source", "page", "text", "n_tokens")
# The system text and the notice on disagreeing sources.
SYSTEM = "You answer strictly from the provided context. If the context does not contain the answer, say so. Cite sources as [source p.N]. Be concise."
NOTICE = (
    "\n\nNote: your sources disagree with each other on the following - do not silently pick one. State that sources disagree and name what each one says:\n"
)


def gather_hits(ranking: DataFrame, chunks: DataFrame, query: str = "query_id", row: str = "chunk_no", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(query, hits): the ranked chunks in order as array<struct<rank, source, page, text, n_tokens>>, or with other ``fields``.

    ``ranking`` is a cut list (k rows a query), so it prunes the chunk table; texts are fetched only here.
    """
    got = chunks.select(row, *fields).join(few(ranking.select(query, row, "rank"), "ranking"), row)
    return got.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("hits"))


def citations(hits: Column) -> Column:
    """``source p.N`` of each hit in order, repeated ones kept."""
    return F.transform(hits, lambda h: F.concat_ws("", h["source"], F.lit(" p."), h["page"].cast("string")))


def context_tokens(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + F.coalesce(h["n_tokens"], F.lit(0)))


def conflict_notice(conflicts: Column) -> Column:
    """The notice that names each day's dates and sources; empty without conflicts."""
    line = lambda c: F.concat(F.lit("Day "), c["day"].cast("string"), F.lit(": "), F.array_join(F.transform(c["vals"], lambda v: F.concat(v["date"], F.lit(" per "), v["source"])), "; "))
    return F.when(F.size(conflicts) > 0, F.concat(F.lit(NOTICE), F.array_join(F.transform(conflicts, line), "\n"))).otherwise(F.lit(""))


def messages(question: Column, hits: Column, conflicts: Column | None = None) -> Column:
    """Two messages: the fixed system text, and the context blocks in rank order with the question after them."""
    block = lambda h: F.concat(F.lit("["), h["source"], F.lit(" p."), h["page"].cast("string"), F.lit("]\n"), h["text"])
    user = F.concat(F.lit("Context:\n"), F.array_join(F.transform(hits, block), "\n\n"), F.lit("\n\nQuestion: "), question, conflict_notice(conflicts) if conflicts is not None else F.lit(""))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.lit(SYSTEM)), said("user", user))


def logged_answer(answer: Column, chars: int = 500) -> Column:
    """What the span log keeps of an answer."""
    return F.substring(answer, 1, chars)
