"""Checks of answers against what they were built on, and routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltra.operators.scoping import loose_sources, matched_sources

# The wording of an unsure answer, the wording that asks for synthesis, and the months.
HEDGE = (
    r"(?iU)\b(might be|may be|possibly|not (entirely )?certain|unclear|i'm not sure|difficult to (determine|say)|unable to (determine|confirm)|"
    r"appears to|seems to|approximately|roughly)\b"
)
DEEP = r"(?iU)\b(across|combin\w*|both|compar\w*|agree\w*|differ\w*|every|all\b|summar\w*|chronolog\w*|how many)"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

NUMBER = r"(?U)\b\d{1,4}\b"
CITATION = r"\[[^\]]*\]"
DAY_DATE = rf"(?iUd)\bDay\s*(\d+)\b.{{0,40}}?\b(\d{{1,2}})\s*({'|'.join(MONTHS)})\w*\b"


def numbers(text: Column) -> Column:
    """Distinct whole numbers of one to four digits, as written; longer runs of digits hold none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def ungrounded(answer: Column, context: Column) -> Column:
    """Numbers of the answer, citations aside, that the context lacks, sorted as text; a null context grounds nothing."""
    return F.array_sort(F.array_except(numbers(F.regexp_replace(F.coalesce(answer, F.lit("")), CITATION, "")), numbers(context)))


def hedges(answer: Column) -> Column:
    """Whether the answer hedges; false for null."""
    return F.coalesce(answer.rlike(HEDGE), F.lit(False))


def day_dates(hits: DataFrame, group: str = "query_id", rank: str = "rank", source: str = "source", text: str = "text") -> DataFrame:
    """(group, day, date, source, pos): each ``Day N`` with a date soon after it, as ``5 Nov``; pos is rank and place."""
    grab = lambda i: F.regexp_extract_all(F.col(text), F.lit(DAY_DATE), F.lit(i))
    found = hits.where(F.col(text).rlike(DAY_DATE)).select(group, rank, source, F.posexplode(F.arrays_zip(grab(1).alias("d"), grab(2).alias("n"), grab(3).alias("m"))).alias("_at", "_x"))
    date = F.concat("_x.n", F.lit(" "), F.initcap("_x.m"))
    return found.select(group, F.expr("try_cast(_x.d as int)").alias("day"), date.alias("date"), source, F.struct(F.col(rank), "_at").alias("pos")).where("day is not null")


def conflicting_dates(hits: DataFrame, group: str = "query_id", rank: str = "rank", source: str = "source", text: str = "text") -> DataFrame:
    """(group, conflicts): days with several dates, array<struct<day, vals: array<struct<date, source>>>> in order of first
    mention; groups without conflict are absent. Of a date the first source in rank order counts. Mentions are reduced
    per (group, day, date) before the shuffle, so what a group gathers is bounded by the dates that can be written."""
    claims = day_dates(hits, group, rank, source, text).groupBy(group, "day", "date").agg(F.min_by(source, "pos").alias("source"), F.min("pos").alias("pos"))
    days = claims.groupBy(group, "day").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "date", "source"))).alias("v")).where(F.size("v") > 1)
    vals = F.transform("v", lambda x: F.struct(x["date"].alias("date"), x["source"].alias("source")))
    per = days.select(group, F.struct("pos", "day", vals.alias("vals")).alias("d")).groupBy(group).agg(F.array_sort(F.collect_list("d")).alias("d"))
    return per.select(group, F.transform("d", lambda x: F.struct(x["day"].alias("day"), x["vals"].alias("vals"))).alias("conflicts"))


def cited_source(citation: Column) -> Column:
    """The source of a citation ``source p.N``: what stands before the last `` p.``."""
    return F.regexp_replace(citation, r"(?s) p\.(?!.* p\.).*$", "")


def missing_named(questions: DataFrame, sources: DataFrame, query: str = "query_id", question: str = "question", used: str = "sources", source: str = "source") -> DataFrame:
    """(query, missing): sources a question names, two or more, that are not among those used, sorted; others are absent."""
    named = loose_sources(questions, sources, query=query, question=question, source=source).groupBy(query).agg(F.collect_set(source).alias("named")).where(F.size("named") >= 2)
    have = questions.select(query, F.transform(F.coalesce(F.col(used), F.array().cast("array<string>")), cited_source).alias("have"))
    return named.join(have, query).select(query, F.array_sort(F.array_except("named", "have")).alias("missing")).where(F.size("missing") > 0)


def as_list(items: Column) -> Column:
    """``['a', 'b']``, as reasons show sets."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def confidence_reason(ungrounded_numbers: Column, hedged: Column, conflicts: Column, missing: Column) -> Column:
    """The first check that fires, in order of cost: numbers, hedging, disagreeing dates (the first), missing sources; null if
    none does."""
    first = F.element_at(conflicts, 1)
    detail = F.array_join(F.transform(first["vals"], lambda v: F.concat(v["date"], F.lit("="), v["source"])), ", ")
    return (
        F.when(F.size(ungrounded_numbers) > 0, F.concat(F.lit("ungrounded numbers: "), as_list(ungrounded_numbers)))
        .when(hedged, F.lit("hedging language"))
        .when(F.size(F.coalesce(conflicts, F.array().cast("array<struct<day:int,vals:array<struct<date:string,source:string>>>>"))) > 0, F.concat(F.lit("sources disagree on Day "), first["day"].cast("string"), F.lit("'s date: "), detail))
        .when(F.size(F.coalesce(missing, F.array().cast("array<string>"))) > 0, F.concat(F.lit("question named "), as_list(missing), F.lit(" but it was never retrieved")))
    )


def route(questions: DataFrame, sources: DataFrame, query: str = "query_id", question: str = "question", source: str = "source") -> DataFrame:
    """All of ``questions`` with ``route``: ``deep`` if the wording asks for synthesis or two sources or more are named."""
    named = matched_sources(questions, sources, query, question, source).groupBy(query).agg(F.count(F.lit(1)).alias("_named"))
    deep = F.coalesce(F.col(question).rlike(DEEP), F.lit(False)) | (F.coalesce("_named", F.lit(0)) >= 2)
    return questions.join(named, query, "left").withColumn("route", F.when(deep, "deep").otherwise("fast")).drop("_named")


def routing_confusion(routed: DataFrame, kind: str = "qtype") -> DataFrame:
    """(kind, fast, deep): how many questions of each kind took each lane."""
    count = lambda lane: F.sum((F.col("route") == lane).cast("long")).alias(lane)
    return routed.groupBy(kind).agg(count("fast"), count("deep"))
