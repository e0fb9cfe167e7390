import re

import pytest
from pyspark.sql import functions as F

from siltra.operators import answers as an
from siltra.operators import prompts as pm
from siltra.operators import scoping as sc

FILES = ["Permit.pdf", "Camp_Alder_Final_Fixed_v2.pdf", "Ida_Holm.pdf", "Resume-Ida-Holm-Northsoft.pdf", "Trip_Dunes_Itinerary_SandTheme.pdf", "SandTheme_TIMES.pdf", "notes (3).md", ".hidden", "archive.tar.gz", "no_extension", "Über-straße_plan.txt"]


def sources(spark, names=FILES):
    return spark.createDataFrame([(n,) for n in [*names, names[0], None]], "source string")


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, question string")


def sets(df, n):
    out = {i: set() for i in range(n)}
    for r in df.collect():
        assert r.source not in out[r.query_id]
        out[r.query_id].add(r.source)
    return [out[i] for i in range(n)]


def test_filename_tokens(spark):
    got = {r.source: r.tokens for r in sc.filename_tokens(sources(spark)).collect()}
    assert got["Camp_Alder_Final_Fixed_v2.pdf"] == ["alder", "camp"]
    assert got["notes (3).md"] == ["notes"] and got["archive.tar.gz"] == ["archive.tar"] and got[".hidden"] == [".hidden"] and got["Ida_Holm.pdf"] == ["holm"]
    assert got["Über-straße_plan.txt"] == ["plan", "straße", "über"] and len(got) == len(FILES)


def test_hints_belong_to_one_source(spark):
    got = {r.source: set(r.hints) for r in sc.source_hints(sources(spark)).collect()}
    assert "holm" not in got["Ida_Holm.pdf"] | got["Resume-Ida-Holm-Northsoft.pdf"] and got["Ida_Holm.pdf"] == set()
    assert got["Resume-Ida-Holm-Northsoft.pdf"] == {"resume", "northsoft"} and "sandtheme" not in got["SandTheme_TIMES.pdf"]


def test_matching(spark):
    q = asked(
        spark, "What does Ida_Holm.pdf say?", "which resume is longer?", "compare the resumes", "the camp and the itinerary", "Ida_Holm.pdf or Permit.pdf?", "sandtheme please", "(the) XPermit.pdfs", "nothing", None, "see no_extension now", "plan für Über-straße", "permits",
    )
    got = sets(sc.matched_sources(q, sources(spark)), 12)
    assert got[0] == {"Ida_Holm.pdf"} and got[1] == {"Resume-Ida-Holm-Northsoft.pdf"} and got[2] == set()
    assert got[3] == {"Camp_Alder_Final_Fixed_v2.pdf", "Trip_Dunes_Itinerary_SandTheme.pdf"}
    assert got[4] == {"Permit.pdf"}  # two full names fall through to the words, and "permit" is one
    assert got[5] == set() and got[6] == {"Permit.pdf"} and got[7] == got[8] == got[11] == set() and got[9] == {"no_extension"} and got[10] == {"Über-straße_plan.txt"}
    loose = sets(sc.loose_sources(q, sources(spark)), 12)
    assert loose[5] == {"Trip_Dunes_Itinerary_SandTheme.pdf", "SandTheme_TIMES.pdf"} and loose[4] == {"Ida_Holm.pdf", "Permit.pdf"}
    many = sources(spark, [f"trip{i}_itinerary.pdf" for i in range(5)])
    assert sets(sc.loose_sources(asked(spark, "the itinerary"), many), 1) == [set()]


def test_full_names_like_plain_containment(spark):
    names = ["a.b", "x.pdf", "longer_name_here.pdf", "q", "ab", ".md", "dots.in.name.txt", "A b.PDF"]
    texts = ["see x.pdf.", "xx.pdf", "longer_name_here.pd", "my longer_name_here.pdf2", "a.b.c", "dots.in.name.txt!", "a B.pdf and Q", "abc", "none at all"]
    got = sets(sc.exact_mentions(asked(spark, *texts), sources(spark, names)), len(texts))
    assert got == [{n for n in names if n.lower() in t.lower()} for t in texts]


def test_categories(spark):
    rows = [(1, "a", 2, "12 years of experience"), (2, "a", 1, "other"), (3, "b", 1, "10 Years of progressive experience"), (4, "c", 1, "1 year of experience"), (5, "c", 1, "later tie"), (6, None, 1, "9 years of experience"), (7, "d", 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_no long, source string, page int, text string")
    kinds = sc.classify_sources(chunks)
    assert {tuple(r) for r in kinds.collect()} == {("resume", "b"), ("resume", "c")}
    q = asked(spark, "Compare the Resumes", "what is a resumé", "resume it")
    assert sets(sc.category_sources(q, kinds), 3) == [{"b", "c"}, set(), {"b", "c"}]
    assert sets(sc.category_sources(q, kinds.where("source = 'b'")), 3) == [set()] * 3
    got = {r.query_id: r.allowed for r in sc.allowed_sources(asked(spark, "the resumes", "what of d?", "x"), chunks).collect()}
    assert got == {0: ["b", "c"], 1: None, 2: None}
    assert {r.allowed for r in sc.allowed_sources(q, chunks, enabled=False).collect()} == {None}


@pytest.mark.parametrize(
    ("answer", "context", "want"),
    [("In 2019 [doc 7.pdf p.9] 3.14 of 12345", "x 3", ["14", "2019"]), ("12 years", "12 years", []), ("13 years", "12 years", ["13"]), (None, "1", []), ("5", None, ["5"]), ("a5b 6", "", ["6"]), ("10 2 1", "", ["1", "10", "2"])],
)
def test_ungrounded_numbers(spark, answer, context, want):
    df = spark.createDataFrame([(answer, context)], "a string, c string")
    assert df.select(an.ungrounded(F.col("a"), F.col("c"))).first()[0] == want


def test_hedges(spark):
    for text, want in (("It might be so", True), ("That is UNCLEAR.", True), ("unclearly", False), ("not entirely certain", True), ("I'm not sure", True), ("", False), (None, False), ("approximately 5", True)):
        assert spark.createDataFrame([(text,)], "a string").select(an.hedges(F.col("a"))).first()[0] is want


def brute_conflicts(hits):
    rx = re.compile(r"\bDay\s*(\d+)\b.{0,40}?\b(\d{1,2})\s*(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\b", re.I)
    claims: dict = {}
    for _, source, text in hits:
        for m in rx.finditer(text or ""):
            claims.setdefault(int(m[1]), {}).setdefault(f"{m[2]} {m[3].title()}", source)
    return [(d, list(v.items())) for d, v in claims.items() if len(v) > 1]


def test_conflicting_dates(spark):
    cases = [
        [(1, "a.pdf", "Day 1 - 3 Mar"), (2, "b.docx", "day 01: the 3 APRIL")], [(1, "a", "Day 1 - 3 Mar, Day 2 - 4 Mar")], [(2, "b", "Day 3 is 05 Nov"), (1, "a", "Day 3 5 Nov; Day 9 on 1 Jan")], [(1, "a", "Day 5\n6 Nov"), (2, "b", "Day 5 7 Nov")],
        [(1, "a", "Day 7 1 May Day 7 2 May Day 6 1 Jun"), (2, "b", "Day 6 2 Jun Day 7 1 May")], [(1, "a", None)],
    ]
    rows = [(i, *h) for i, hits in enumerate(cases) for h in hits]
    got = {r.query_id: [(c.day, [(v.date, v.source) for v in c.vals]) for c in r.conflicts] for r in an.conflicting_dates(spark.createDataFrame(rows, "query_id long, rank int, source string, text string")).collect()}
    assert got == {i: b for i, hits in enumerate(cases) if (b := brute_conflicts(sorted(hits)))}
    assert 0 in got and 1 not in got


def test_missing_sources_and_reasons(spark):
    q = spark.createDataFrame([(0, "trip dunes and camp alder", ["Camp_Alder_Final_Fixed_v2.pdf p.3"]), (1, "trip dunes", []), (2, "camp and northsoft", None)], "query_id long, question string, sources array<string>")
    got = {r.query_id: r.missing for r in an.missing_named(q, sources(spark)).collect()}
    assert got == {0: ["Trip_Dunes_Itinerary_SandTheme.pdf"], 2: ["Camp_Alder_Final_Fixed_v2.pdf", "Resume-Ida-Holm-Northsoft.pdf"]}
    assert spark.createDataFrame([("a p.b.pdf p.12",), ("x",)], "c string").select(an.cited_source(F.col("c"))).collect() == [("a p.b.pdf",), ("x",)]
    one = "array<struct<day:int,vals:array<struct<date:string,source:string>>>>"
    conflicts = [(1, [("3 Mar", "a.pdf"), ("3 Apr", "b.pdf")]), (2, [("1 Jan", "c")])]
    rows = [(["9"], True, conflicts, ["x"]), ([], True, conflicts, ["x"]), ([], False, conflicts, ["x"]), ([], False, [], ["x", "y"]), ([], False, None, None)]
    df = spark.createDataFrame(rows, f"u array<string>, h boolean, c {one}, m array<string>")
    got = [r[0] for r in df.select(an.confidence_reason(F.col("u"), F.col("h"), F.col("c"), F.col("m"))).collect()]
    assert got == ["ungrounded numbers: ['9']", "hedging language", "sources disagree on Day 1's date: 3 Mar=a.pdf, 3 Apr=b.pdf", "question named ['x', 'y'] but it was never retrieved", None]


def test_routes(spark):
    q = spark.createDataFrame([(0, "Compare both", "multihop"), (1, "how many files?", "aggregation"), (2, "what is the rent", "factual"), (3, "camp and itinerary", "multihop"), (4, "allowance", "factual"), (5, None, None)], "query_id long, question string, qtype string")
    routed = an.route(q, sources(spark))
    assert [r.route for r in routed.orderBy("query_id").collect()] == ["deep", "deep", "fast", "deep", "fast", "fast"]
    assert {r.qtype: (r.fast, r.deep) for r in an.routing_confusion(routed).collect()} == {"multihop": (0, 2), "aggregation": (0, 1), "factual": (2, 0), None: (1, 0)}


def test_prompts(spark):
    chunks = spark.createDataFrame([(1, "a.pdf", 3, "alpha", 1), (2, "b.md", 1, "beta", None), (3, "c", 1, "unused", 5)], "chunk_no long, source string, page int, text string, n_tokens int")
    ranking = spark.createDataFrame([(7, 2, 1), (7, 1, 2)], "query_id long, chunk_no long, rank int")
    hits = pm.gather_hits(ranking, chunks).withColumn("conflicts", F.expr("array(named_struct('day', 1, 'vals', array(named_struct('date', '3 Mar', 'source', 'a.pdf'), named_struct('date', '3 Apr', 'source', 'b.md'))))"))
    r = hits.select(pm.citations(F.col("hits")).alias("c"), pm.context_tokens(F.col("hits")).alias("t"), pm.messages(F.lit("Q?"), F.col("hits")).alias("m"), pm.messages(F.lit("Q?"), F.col("hits"), F.col("conflicts")).alias("n"), pm.logged_answer(F.lit("x" * 600)).alias("l")).first()
    assert r.c == ["b.md p.1", "a.pdf p.3"] and r.t == 1 and len(r.l) == 500
    assert [m.role for m in r.m] == ["system", "user"] and r.m[1].content == "Context:\n[b.md p.1]\nbeta\n\n[a.pdf p.3]\nalpha\n\nQuestion: Q?"
    assert r.n[1].content.startswith(r.m[1].content) and r.n[1].content.endswith("Day 1: 3 Mar per a.pdf; 3 Apr per b.md") and "disagree" not in r.m[1].content
