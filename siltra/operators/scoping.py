"""Which sources a question means: by file name or by what the documents are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.functions.text import quoted

# File-name words that name nothing, and document kinds by how their first page and a question show them.
STOPWORDS = ["final", "fixed", "copy", "new", "old", "draft", "tech"]
CATEGORIES = {"resume": {"content": r"\b\d+\s+years?\s+of\s+(progressive\s+)?experience\b", "asked": r"\bresumes?\b"}}
MAX_OWNERS = 4
_U = "(?U)"


def filename_tokens(sources: DataFrame, source: str = "source") -> DataFrame:
    """(source, tokens): the telling words of each file name, distinct.

    Without the last extension and a closing ``(N)``, in lower case, parted at ``_``, ``-`` and white space; words under
    four characters, stop words, numbers and versions such as ``v2`` tell nothing. A null source is left out.
    """
    names = sources.where(F.col(source).isNotNull()).select(source).distinct()
    stem = F.regexp_replace(F.col(source), r"(?<=.)(?<!^\.)\.[^.]+$", "")
    stem = F.regexp_replace(stem, _U + r"\s*\(\d+\)\s*$", "")
    parts = F.split(F.lower(stem), _U + r"[_\-\s]+")
    telling = F.filter(parts, lambda t: (F.length(t) >= 4) & ~t.isin(STOPWORDS) & ~t.rlike(_U + r"^\d+$") & ~t.rlike(_U + r"^v\d+$"))
    return names.select(source, F.array_sort(F.array_distinct(telling)).alias("tokens"))


def token_owners(tokens: DataFrame, source: str = "source") -> DataFrame:
    """(token, owners): in how many sources each token occurs."""
    return tokens.select(source, F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("owners"))


def source_hints(sources: DataFrame, source: str = "source") -> DataFrame:
    """(source, hints): tokens that belong to this source alone; sources without any keep an empty array."""
    tokens = filename_tokens(sources, source)
    unique = token_owners(tokens, source).where("owners = 1")
    own = tokens.select(source, F.explode("tokens").alias("token")).join(unique, "token").groupBy(source).agg(F.array_sort(F.collect_list("token")).alias("hints"))
    return tokens.select(source).join(own, source, "left").select(source, F.coalesce("hints", F.array().cast("array<string>")).alias("hints"))


def _runs(text):
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_U + r"\w+"), F.lit(0)))


def token_mentions(questions: DataFrame, tokens: DataFrame, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """(query, source) where one of the source's tokens (source, token) stands in the question as a whole word.

    A token's first run of word characters is one of the question's, so the two meet in an equi-join on it; the whole
    token is then looked for. Tokens without a word character are never mentioned.
    """
    asked = questions.where(F.col(question).isNotNull()).select(query, F.lower(question).alias("_q"))
    asked = asked.select(query, "_q", F.explode(_runs(F.col("_q"))).alias("_run"))
    keyed = tokens.select(source, "token", F.regexp_extract("token", _U + r"\w+", 0).alias("_run")).where("_run <> ''")
    hit = F.expr(r"rlike(_q, concat('(?U)\\b', _lit, '\\b'))")
    return asked.join(keyed, "_run").withColumn("_lit", quoted("token")).where(hit).select(query, source).distinct()


def exact_mentions(questions: DataFrame, sources: DataFrame, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """(query, source) where the whole file name stands in the question, without regard to case.

    The shapes of the names (characters before and after the last dot; -1 where there is none) are collected; file
    names are short, so there are few. A question is cut into all stretches of these shapes, around its dots for names
    with a dot and anywhere for others, and the stretches meet the names by equality: no chance partners, and no key that
    many names share.
    """
    names = sources.where(F.col(source).isNotNull() & (F.col(source) != "")).select(source).distinct().withColumn("_s", F.lower(source))
    tail = F.length(F.substring_index("_s", ".", -1))
    shapes = names.select((F.length("_s") - tail - 1).alias("a"), tail.alias("z")).distinct().collect()
    asked = questions.where(F.col(question).isNotNull()).select(query, F.lower(question).alias("_q"))
    size = F.length("_q")
    whole = sorted({r.z for r in shapes if r.a < 0})
    dotted = sorted({(r.a, r.z) for r in shapes if r.a >= 0})
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    cut = lambda at, n: F.when((at >= 1) & (at + n - 1 <= size), F.substring(F.col("_q"), at, n))
    parts = []
    if dotted:
        shape = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in dotted])
        dots = F.filter(places, lambda i: F.substring(F.col("_q"), i, F.lit(1)) == ".")
        parts.append(F.flatten(F.transform(dots, lambda i: F.transform(shape, lambda s: cut(i - s["a"], s["a"] + s["z"] + 1)))))
    if whole:
        parts.append(F.flatten(F.transform(places, lambda i: F.transform(F.array(*map(F.lit, whole)), lambda n: cut(i, n)))))
    keys = F.concat(*parts) if parts else F.array().cast("array<string>")
    found = asked.select(query, F.explode(F.array_distinct(keys)).alias("_s")).where("_s is not null")
    return found.join(names, "_s").select(query, source).distinct()


def matched_sources(questions: DataFrame, sources: DataFrame, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """(query, source): the one source whose full name a question has; else (none, or two and more full names) every
    source one of whose own tokens it has as a word."""
    exact = exact_mentions(questions, sources, query, question, source)
    single = exact.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.first(source).alias(source)).where("n = 1").select(query, source)
    hints = source_hints(sources, source).select(source, F.explode("hints").alias("token"))
    by_token = token_mentions(questions, hints, query, question, source)
    return single.unionByName(by_token.join(single.select(query), query, "left_anti"))


def loose_sources(questions: DataFrame, sources: DataFrame, max_owners: int = MAX_OWNERS, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """(query, source): sources named in full, or by a token that at most ``max_owners`` sources share."""
    tokens = filename_tokens(sources, source)
    few = token_owners(tokens, source).where(F.col("owners") <= max_owners).select("token")
    own = tokens.select(source, F.explode("tokens").alias("token")).join(few, "token")
    return exact_mentions(questions, sources, query, question, source).unionByName(token_mentions(questions, own, query, question, source)).distinct()


def classify_sources(chunks: DataFrame, order: str = "chunk_no", source: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """(category, source) by the first chunk of each source: of its least page, ties by ``order``.

    The first chunk is found by a partial and a final aggregation over flags, not texts.
    """
    flags = [F.coalesce(F.col(text).rlike("(?iU)" + c["content"]), F.lit(False)).alias(name) for name, c in CATEGORIES.items()]
    first = chunks.where(F.col(source).isNotNull()).select(source, page, order, *flags).groupBy(source).agg(F.min_by(F.struct(*CATEGORIES), F.struct(page, order)).alias("f"))
    kinds = F.filter(F.array(*[F.when(F.col(f"f.{n}"), F.lit(n)) for n in CATEGORIES]), lambda x: x.isNotNull())
    return first.select(F.explode(kinds).alias("category"), source)


def category_sources(questions: DataFrame, categories: DataFrame, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """(query, source): all sources of each category whose word a question has, where it has two sources or more."""
    asked = F.filter(F.array(*[F.when(F.col(question).rlike("(?iU)" + c["asked"]), F.lit(n)) for n, c in CATEGORIES.items()]), lambda x: x.isNotNull())
    q = questions.select(query, F.explode(asked).alias("category"))
    several = categories.groupBy("category").agg(F.count_distinct(source).alias("n")).where("n >= 2").select("category")
    return q.join(several, "category").join(categories, "category").select(query, source).distinct()


def allowed_sources(questions: DataFrame, chunks: DataFrame, enabled: bool = True, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """All of ``questions`` with ``allowed``: the union of the named sources, else those of its category, else null
    (no limit); always null if not ``enabled``."""
    if not enabled:
        return questions.withColumn("allowed", F.lit(None).cast("array<string>"))
    named = matched_sources(questions, chunks, query, question, source)
    kind = category_sources(questions, classify_sources(chunks, source=source), query, question, source).join(named.select(query).distinct(), query, "left_anti")
    sets = named.unionByName(kind).groupBy(query).agg(F.array_sort(F.collect_set(source)).alias("allowed"))
    return questions.join(sets, query, "left")
