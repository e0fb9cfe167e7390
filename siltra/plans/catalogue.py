"""Queries of the engine over the test tables, whole, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.functions.shared import few
from siltra.functions.text import strip
from siltra.operators import adapters, answers, cache, chunking, prompts, report, retrieval, scoping

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The character class of white space for RE2, and words of a text.
_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _WORDS(c: str) -> str:  # noqa: N802
    return f"regexp_extract_all({c}, '[^{_WS}]+')"


# ---- ingest ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(length(text), 0) < 40 AS suspect_scanned FROM documents")
def pages_scan_flags(spark, sf):
    return chunking.flag_scanned(table(spark, sf, "documents")).select("doc_id", "suspect_scanned")


_SLIDING = f"""
w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 400) / 320.0), 0)::BIGINT + 1)) AS window_no FROM w WHERE len(w) > 0),
slide AS (SELECT doc_id, window_no::INT AS window_no, w[window_no * 320 + 1 : window_no * 320 + 400] AS t FROM cut),
chunks AS (SELECT doc_id, window_no, substr(sha256(array_to_string(t, ' ')), 1, 16) AS id, array_to_string(t, ' ') AS text, len(t)::INT AS n_tokens FROM slide)
"""


def _slid(spark, sf):
    return chunking.sliding_chunks(table(spark, sf, "documents").select("doc_id", "source", "text"))


@query(f"WITH {_SLIDING} SELECT doc_id, window_no, id, n_tokens FROM chunks")
def chunk_sliding(spark, sf):
    return _slid(spark, sf).select("doc_id", "window_no", "id", "n_tokens")


_DEDUP = f"WITH {_SLIDING}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, window_no) AS r FROM chunks) WHERE r = 1)"


@query(_DEDUP + " SELECT doc_id, window_no, id, n_tokens FROM firsts")
def chunk_dedup_first(spark, sf):
    return chunking.dedup_first(_slid(spark, sf), ["doc_id", "window_no"]).select("doc_id", "window_no", "id", "n_tokens")


@query(_DEDUP + " SELECT row_number() OVER (ORDER BY doc_id, window_no)::BIGINT AS chunk_no, doc_id, window_no, id FROM firsts")
def chunk_numbered(spark, sf):
    first = chunking.dedup_first(_slid(spark, sf), ["doc_id", "window_no"])
    return chunking.numbered_chunks(first, ["doc_id", "window_no"]).select("chunk_no", "doc_id", "window_no", "id")


@query(
    _DEDUP
    + """ SELECT (SELECT count(*) FROM documents) AS n_pages, (SELECT count(*) FROM documents WHERE coalesce(length(text), 0) < 40) AS n_suspect_scanned,
    (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM chunks) - count(*) AS n_dropped, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_vectors FROM firsts"""
)
def ingest_counters(spark, sf):
    slid = _slid(spark, sf)
    return chunking.ingest_counters(table(spark, sf, "documents"), slid, chunking.dedup_first(slid, ["doc_id", "window_no"]))


@query(
    f"""
WITH RECURSIVE u AS (
  SELECT source, page, text, len({_WORDS('text')})::INT AS n, row_number() OVER (PARTITION BY source, page ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL
), fold AS (
  -- packs opened so far, and what the open one holds (-1: none is open)
  SELECT source, page, r, CASE WHEN n > 400 THEN 0 ELSE 0 END AS pack_no, CASE WHEN n > 400 THEN -1 ELSE n END AS held FROM u WHERE r = 1
  UNION ALL
  SELECT u.source, u.page, u.r, CASE WHEN u.n > 400 OR f.held < 0 OR f.held + u.n > 400 THEN f.pack_no + 1 ELSE f.pack_no END,
         CASE WHEN u.n > 400 THEN -1 WHEN f.held < 0 OR f.held + u.n > 400 THEN u.n ELSE f.held + u.n END
  FROM fold f JOIN u ON u.source IS NOT DISTINCT FROM f.source AND u.page IS NOT DISTINCT FROM f.page AND u.r = f.r + 1
), packs AS (
  SELECT u.source, u.page, f.pack_no::INT AS pack_no, sum(u.n)::INT AS n, string_agg(u.text, chr(10) || chr(10) ORDER BY u.r) AS text
  FROM u JOIN fold f ON u.source IS NOT DISTINCT FROM f.source AND u.page IS NOT DISTINCT FROM f.page AND u.r = f.r GROUP BY ALL
), long AS (
  SELECT source, page, pack_no, w, unnest(range(0, ceil((len(w) - 400) / 320.0)::BIGINT + 1)) AS window_no FROM (SELECT *, {_WORDS('text')} AS w FROM packs WHERE n > 400)
), cut AS (SELECT source, page, pack_no, window_no::INT AS window_no, w[window_no * 320 + 1 : window_no * 320 + 400] AS t FROM long)
SELECT source, page, pack_no, 0 AS window_no, substr(sha256(text), 1, 16) AS id, n AS n_tokens FROM packs WHERE n <= 400
UNION ALL SELECT source, page, pack_no, window_no, substr(sha256(array_to_string(t, ' ')), 1, 16), len(t)::INT FROM cut
"""
)
def chunk_structured_pack(spark, sf):
    units = table(spark, sf, "documents").select("source", "page", "doc_id", "text")
    return chunking.pack_units(units, ["source", "page"], ["doc_id"]).select("source", "page", "pack_no", "window_no", "id", "n_tokens")


@query(
    f"""
WITH lines AS (SELECT chunk_no, unnest(range(len(l))) AS para_no, unnest(l) AS text FROM (SELECT chunk_no, string_split(text, chr(10)) AS l FROM chunk_structured WHERE text IS NOT NULL)),
marked AS (SELECT chunk_no, para_no, text, sum(CASE WHEN length(text) < 50 AND NOT regexp_matches(text, '[.:;!?]') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_no ORDER BY para_no) AS section_no
  FROM lines WHERE len({_WORDS('text')}) > 0)
SELECT chunk_no, section_no::INT AS section_no, string_agg(text, chr(10) ORDER BY para_no) AS text FROM marked GROUP BY ALL
"""
)
def section_fold(spark, sf):
    lines = table(spark, sf, "chunk_structured").select("chunk_no", F.posexplode(F.split("text", "\n")).alias("para_no", "text"))
    styled = lines.withColumn("style", F.when((F.length("text") < 50) & ~F.col("text").rlike("[.:;!?]"), "Heading 2").otherwise("Normal"))
    return chunking.fold_sections(styled, ["chunk_no"])


# ---- search ---------------------------------------------------------------------------------------------------------

_DOT = """
SELECT q.vec_id AS query_id, e.vec_id AS chunk_no, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 {0}
"""
_TOP = "SELECT query_id, chunk_no, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM ({0})) WHERE rank <= {1}"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_no"), "embedding", "label")
    return e, e.where("chunk_no % 100 = 0").select(F.col("chunk_no").alias("query_id"), "embedding", F.array(F.col("label").cast("string")).alias("allowed"))


@query(_TOP.format(_DOT.format(""), 20))
def dense_topk(spark, sf):
    rows, asked = _vectors(spark, sf)
    return retrieval.dense_topk(rows, asked, 20)


@query(_TOP.format(_DOT.format("AND e.label = q.label"), 20))
def dense_topk_filtered(spark, sf):
    rows, asked = _vectors(spark, sf)
    return retrieval.dense_topk(rows, asked, 20, allowed="allowed", group="label")


_TERMS = f"""
toks AS (SELECT chunk_no, unnest({_WORDS('lower(text)')}) AS term FROM chunk_structured WHERE text IS NOT NULL),
post AS (SELECT term, chunk_no, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT chunk_no, len({_WORDS("coalesce(lower(text), '')")}) AS dl FROM chunk_structured),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, size),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)
"""


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_idf(spark, sf):
    index = retrieval.bm25_index(table(spark, sf, "chunk_structured"))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


_ASKED = f"asked AS (SELECT question_id AS query_id, unnest({_WORDS('lower(q)')}) AS term FROM questions WHERE question_id % 100 = 0)"
_BM25 = f"""
{_TERMS}, {_ASKED},
hits AS (SELECT query_id, p.chunk_no, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM asked JOIN terms USING (term) JOIN post p USING (term) JOIN lens USING (chunk_no), size GROUP BY ALL),
sparse AS (SELECT q.question_id AS query_id, l.chunk_no, round(coalesce(s, 0), 6) AS score
  FROM (SELECT question_id FROM questions WHERE question_id % 100 = 0) q CROSS JOIN lens l LEFT JOIN hits h ON h.query_id = q.question_id AND h.chunk_no = l.chunk_no)
"""


def _asked(spark, sf):
    """The questions stated for the searches: each hundredth."""
    return _all_asked(spark, sf).where("query_id % 100 = 0")


def _all_asked(spark, sf):
    return table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), F.col("q").alias("question"))


def _all_said(sql: str) -> str:
    """SQL of a search for all questions."""
    return sql.replace(" WHERE question_id % 100 = 0", "")


@query(f"WITH {_BM25} {_TOP.format('SELECT * FROM sparse', 20)}")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(table(spark, sf, "chunk_structured"), _asked(spark, sf), 20)


_HASHED = f"""
texts AS (SELECT chunk_no AS id, 0 AS q, lower(text) AS t FROM chunk_structured UNION ALL SELECT question_id, 1, lower(q) FROM questions WHERE question_id % 100 = 0),
buckets AS (SELECT id, q, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b FROM (SELECT id, q, unnest({_WORDS('t')}) AS w FROM texts WHERE t IS NOT NULL)),
counts AS (SELECT id, q, b, count(*) AS c FROM buckets GROUP BY ALL),
norms AS (SELECT id, q, sqrt(sum(c * c)) AS norm FROM counts GROUP BY ALL),
vecs AS (SELECT id, q, b, (c / norm)::FLOAT::DOUBLE AS v FROM counts JOIN norms USING (id, q)),
dots AS (SELECT x.id AS query_id, y.id AS chunk_no, sum(x.v * y.v) AS s FROM vecs x JOIN vecs y ON x.q = 1 AND y.q = 0 AND x.b = y.b GROUP BY ALL),
dense AS (SELECT q.question_id AS query_id, c.chunk_no, round(coalesce(s, 0), 6) AS score
  FROM (SELECT question_id FROM questions WHERE question_id % 100 = 0) q CROSS JOIN (SELECT chunk_no FROM chunk_structured) c LEFT JOIN dots d ON d.query_id = q.question_id AND d.chunk_no = c.chunk_no)
"""
_FUSED = f"""
WITH {_BM25}, {_HASHED}, d AS ({_TOP.format('SELECT * FROM dense', 20)}), s AS ({_TOP.format('SELECT * FROM sparse', 20)}),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_no, s.chunk_no) AS chunk_no, d.rank AS r1, s.rank AS r2,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS rrf FROM d FULL JOIN s ON d.query_id = s.query_id AND d.chunk_no = s.chunk_no),
fused AS (SELECT query_id, chunk_no, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2)::INT AS rank FROM f)
"""


def _dense(spark, sf, asked):
    chunks = adapters.embed(table(spark, sf, "chunk_structured").select("chunk_no", "text"), adapters.HashEmbedder)
    return retrieval.dense_topk(chunks, adapters.embed(asked, adapters.HashEmbedder, text="question"), 20)


@query(_all_said(_FUSED) + "SELECT query_id, chunk_no, rrf, rank FROM fused")
def rrf_fused(spark, sf):
    asked = _all_asked(spark, sf)
    return retrieval.fuse(_dense(spark, sf, asked), retrieval.bm25_topk(table(spark, sf, "chunk_structured"), asked, 20))


def _hybrid(spark, sf, asked):
    return retrieval.hybrid(_dense(spark, sf, asked), retrieval.bm25_topk(table(spark, sf, "chunk_structured"), asked, 20))


@query(_all_said(_FUSED) + "SELECT query_id, chunk_no, rrf, rank FROM fused WHERE rank <= 5")
def hybrid_candidates(spark, sf):
    return retrieval.cut(_hybrid(spark, sf, _all_asked(spark, sf)), 5)


@query(
    _FUSED
    + f""", pool AS (SELECT f.query_id, f.chunk_no, list_distinct({_WORDS('lower(q)')}) AS qw, {_WORDS('lower(text)')} AS tw FROM fused f JOIN questions ON question_id = query_id
      JOIN chunk_structured c ON c.chunk_no = f.chunk_no WHERE rank <= 20),
    scored AS (SELECT query_id, chunk_no, round(len(list_filter(qw, lambda w: list_contains(tw, w))) / greatest(1, len(qw))::DOUBLE, 6) AS score FROM pool)
    {_TOP.format('SELECT * FROM scored', 5)}"""
)
def rerank_overlap(spark, sf):
    chunks, asked = table(spark, sf, "chunk_structured").select("chunk_no", "text"), _asked(spark, sf)
    pool = chunks.join(few(_hybrid(spark, sf, asked), "pool"), "chunk_no").join(asked, "query_id")
    return adapters.rerank(pool, 5)


# ---- scoping --------------------------------------------------------------------------------------------------------

_NAMES = "(SELECT DISTINCT source FROM (SELECT source FROM chunk_structured UNION ALL SELECT source FROM documents) WHERE source IS NOT NULL)"
_STEM = r"regexp_replace(regexp_replace(source, '(.)\.[^.]+$', '\1'), '\s*\(\d+\)\s*$', '')"
_TOKENS = f"""
names AS {_NAMES},
tokens AS (SELECT source, list_sort(list_distinct(list_filter(regexp_split_to_array(lower({_STEM}), '[_\\-\\s]+'), lambda t: length(t) >= 4 AND NOT list_contains(['final', 'fixed', 'copy', 'new', 'old', 'draft', 'tech'], t)
  AND NOT regexp_matches(t, '^\\d+$') AND NOT regexp_matches(t, '^v\\d+$')))) AS tokens FROM names),
owners AS (SELECT token, count(*) AS owners FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token)
"""
# All questions, and one that spells out the file name of each hundredth document or only its words.
_SAID = """
said AS (SELECT question_id AS query_id, q AS question FROM questions
  UNION ALL SELECT 1000000 + doc_id, 'What does ' || source || ' say on rent?' FROM documents WHERE doc_id % 100 = 0 AND source IS NOT NULL
  UNION ALL SELECT 2000000 + doc_id, 'Compare the ' || replace(replace(source, '_', ' '), '.', ' ') || ' with others' FROM documents WHERE doc_id % 100 = 1 AND source IS NOT NULL)
"""


def _names(spark, sf):
    return table(spark, sf, "chunk_structured").select("source").union(table(spark, sf, "documents").select("source")).where("source is not null").distinct()


def _said(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null")
    whole = docs.where("doc_id % 100 = 0").select((F.lit(1000000) + F.col("doc_id")).alias("query_id"), F.concat(F.lit("What does "), "source", F.lit(" say on rent?")).alias("question"))
    words = docs.where("doc_id % 100 = 1").select((F.lit(2000000) + F.col("doc_id")).alias("query_id"), F.concat(F.lit("Compare the "), F.translate("source", "_.", "  "), F.lit(" with others")).alias("question"))
    return table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), F.col("q").alias("question")).union(whole).union(words)


@query(f"WITH {_TOKENS} SELECT source, tokens FROM tokens")
def filename_tokens(spark, sf):
    return scoping.filename_tokens(_names(spark, sf))


@query(f"WITH {_TOKENS} SELECT token, owners FROM owners")
def token_owners(spark, sf):
    return scoping.token_owners(scoping.filename_tokens(_names(spark, sf)))


@query(f"WITH {_TOKENS}, own AS (SELECT source, list_sort(list(token)) AS hints FROM (SELECT source, unnest(tokens) AS token FROM tokens) JOIN owners USING (token) WHERE owners = 1 GROUP BY source) SELECT source, coalesce(hints, []) AS hints FROM tokens LEFT JOIN own USING (source)")
def source_hints(spark, sf):
    return scoping.source_hints(_names(spark, sf))


_MENTIONS = f"""
WITH {_TOKENS}, {_SAID},
exact AS (SELECT query_id, source FROM said, names WHERE contains(lower(question), lower(source))),
runs AS (SELECT query_id, question, unnest(list_distinct(regexp_extract_all(lower(question), '[\\w]+'))) AS run FROM said),
named AS (SELECT DISTINCT query_id, source, owners FROM (SELECT source, unnest(tokens) AS token FROM tokens) JOIN owners USING (token) JOIN runs ON run = regexp_extract(token, '\\w+')
  WHERE regexp_matches(lower(question), '\\b' || regexp_escape(token) || '\\b')),
single AS (SELECT query_id, min(source) AS source FROM exact GROUP BY query_id HAVING count(*) = 1),
matched AS (SELECT query_id, source FROM single UNION ALL SELECT DISTINCT query_id, source FROM named WHERE owners = 1 AND query_id NOT IN (SELECT query_id FROM single)),
loose AS (SELECT query_id, source FROM exact UNION SELECT query_id, source FROM named WHERE owners <= 4)
"""


@query(_MENTIONS + "SELECT query_id, source FROM matched")
def matched_sources(spark, sf):
    return scoping.matched_sources(_said(spark, sf), _names(spark, sf))


@query(_MENTIONS + "SELECT query_id, source FROM loose")
def loose_sources(spark, sf):
    return scoping.loose_sources(_said(spark, sf), _names(spark, sf))


# Résumés are rare in the tables: a few rows are added to theirs on both sides.
_CVS = [(-3, "cv_a.pdf", 1, "Eleven pages. 12 years of progressive experience in audits."), (-2, "cv_b.pdf", 2, "Later page."), (-1, "cv_b.pdf", 1, "She has 3 Years of Experience."), (-4, "cv_c.pdf", 1, "Nothing of that.")]
_CV_SQL = "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({n}, '{s}', {p}, '{t}')" for n, s, p, t in _CVS) + ")"
_KINDS = f"""
all_chunks AS (SELECT chunk_no, source, page, text FROM chunk_structured {_CV_SQL}),
firsts AS (SELECT source, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, chunk_no) AS r FROM all_chunks WHERE source IS NOT NULL) WHERE r = 1),
kinds AS (SELECT 'resume' AS category, source FROM firsts WHERE regexp_matches(text, '(?i)\\b\\d+\\s+years?\\s+of\\s+(progressive\\s+)?experience\\b'))
"""


def _with_cvs(spark, sf):
    more = spark.createDataFrame(_CVS, "chunk_no long, source string, page int, text string")
    return table(spark, sf, "chunk_structured").select("chunk_no", "source", "page", "text").unionByName(more)


@query(f"WITH {_KINDS} SELECT category, source FROM kinds")
def category_sources(spark, sf):
    return scoping.classify_sources(_with_cvs(spark, sf))


_CV_ASKED = "SELECT 3000001, 'Which of the resumes mention audits?' UNION ALL SELECT 3000002, 'Nothing about it'"


@query(
    f"""WITH {_KINDS}, said AS (SELECT question_id AS query_id, q AS question FROM questions UNION ALL {_CV_ASKED})
    SELECT DISTINCT query_id, source FROM said, kinds WHERE regexp_matches(question, '(?i)\\bresumes?\\b') AND (SELECT count(DISTINCT source) FROM kinds) >= 2"""
)
def category_match(spark, sf):
    said = table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), F.col("q").alias("question")).union(spark.createDataFrame([(3000001, "Which of the resumes mention audits?"), (3000002, "Nothing about it")], "query_id long, question string"))
    return scoping.category_sources(said, scoping.classify_sources(_with_cvs(spark, sf)))


@query(
    f"""WITH {_TOKENS.replace('names AS ' + _NAMES, 'names AS (SELECT DISTINCT source FROM chunk_structured WHERE source IS NOT NULL)')},
    said AS (SELECT question_id AS query_id, q AS question FROM questions WHERE question_id % 100 = 0 UNION ALL SELECT 1000000 + min(chunk_no), 'What does ' || source || ' say on rent?' FROM chunk_structured GROUP BY source),
    exact AS (SELECT query_id, source FROM said, names WHERE contains(lower(question), lower(source))),
    single AS (SELECT query_id, min(source) AS source FROM exact GROUP BY query_id HAVING count(*) = 1),
    named AS (SELECT DISTINCT query_id, source FROM said, (SELECT source, unnest(tokens) AS token FROM tokens) JOIN owners USING (token) WHERE owners = 1 AND regexp_matches(lower(question), '\\b' || regexp_escape(token) || '\\b')),
    matched AS (SELECT * FROM single UNION ALL SELECT * FROM named WHERE query_id NOT IN (SELECT query_id FROM single)),
    texts AS (SELECT chunk_no AS id, 0 AS q, lower(text) AS t FROM chunk_structured UNION ALL SELECT query_id, 1, lower(question) FROM said),
    buckets AS (SELECT id, q, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b FROM (SELECT id, q, unnest({_WORDS('t')}) AS w FROM texts WHERE t IS NOT NULL)),
    counts AS (SELECT id, q, b, count(*) AS c FROM buckets GROUP BY ALL), norms AS (SELECT id, q, sqrt(sum(c * c)) AS norm FROM counts GROUP BY ALL),
    vecs AS (SELECT id, q, b, (c / norm)::FLOAT::DOUBLE AS v FROM counts JOIN norms USING (id, q)),
    dots AS (SELECT x.id AS query_id, y.id AS chunk_no, sum(x.v * y.v) AS s FROM vecs x JOIN vecs y ON x.q = 1 AND y.q = 0 AND x.b = y.b GROUP BY ALL),
    pool AS (SELECT s.query_id, c.chunk_no, round(coalesce(d.s, 0), 6) AS score FROM said s CROSS JOIN chunk_structured c LEFT JOIN dots d ON d.query_id = s.query_id AND d.chunk_no = c.chunk_no
      WHERE s.query_id NOT IN (SELECT query_id FROM matched) OR EXISTS (SELECT 1 FROM matched m WHERE m.query_id = s.query_id AND m.source = c.source))
    {_TOP.format('SELECT * FROM pool', 5)}"""
)
def scoped_retrieval(spark, sf):
    chunks = table(spark, sf, "chunk_structured")
    whole = chunks.groupBy("source").agg((F.lit(1000000) + F.min("chunk_no")).alias("query_id")).select("query_id", F.concat(F.lit("What does "), "source", F.lit(" say on rent?")).alias("question"))
    scoped = scoping.allowed_sources(_asked(spark, sf).union(whole), chunks)
    asked = adapters.embed(scoped, adapters.HashEmbedder, text="question")
    rows = adapters.embed(chunks.select("chunk_no", "source", "text"), adapters.HashEmbedder)
    return retrieval.dense_topk(rows, asked, 5, allowed="allowed", group="source")


# ---- answers --------------------------------------------------------------------------------------------------------

_NUMS = "list_distinct(regexp_extract_all({0}, '\\b\\d{{1,4}}\\b'))"
_UNGROUNDED = f"""list_sort(list_filter({_NUMS.format("regexp_replace(coalesce(answer, ''), '\\[[^\\]]*\\]', '', 'g')")}, lambda n: NOT list_contains({_NUMS.format("coalesce(expect, '')")}, n)))"""


def _answers(spark, sf):
    q = table(spark, sf, "questions").select("question_id", "expect")
    return table(spark, sf, "query_results").join(q, "question_id", "left")


@query(f"SELECT result_id, received_at, {_UNGROUNDED} AS ungrounded FROM query_results LEFT JOIN questions USING (question_id)")
def ungrounded_numbers(spark, sf):
    return _answers(spark, sf).select("result_id", "received_at", answers.ungrounded(F.col("answer"), F.col("expect")).alias("ungrounded"))


_UNSURE = ["It is possibly 12.", "I'm not sure; unclear.", "That is certain.", "Roughly ten", "roughlyish", "it may  be"]
_HEDGE_SQL = answers.HEDGE.replace("(?iU)", "(?i)").replace("'", "''")


@query(f"SELECT answer, coalesce(regexp_matches(answer, '{_HEDGE_SQL}'), false) AS hedged FROM (SELECT answer FROM query_results UNION ALL SELECT unnest([{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in _UNSURE)}]))")
def hedge_flag(spark, sf):
    rows = table(spark, sf, "query_results").select("answer").union(spark.createDataFrame([(x,) for x in _UNSURE], "answer string"))
    return rows.select("answer", answers.hedges(F.col("answer")).alias("hedged"))


_ROUTE = answers.DEEP.replace("(?iU)", "(?i)")
_ROUTED = _MENTIONS + f", lanes AS (SELECT s.query_id, CASE WHEN regexp_matches(question, '{_ROUTE}') OR coalesce(n, 0) >= 2 THEN 'deep' ELSE 'fast' END AS route FROM said s LEFT JOIN (SELECT query_id, count(*) AS n FROM matched GROUP BY query_id) USING (query_id))"


@query(_ROUTED + " SELECT query_id, route FROM lanes")
def route_lane(spark, sf):
    return answers.route(_said(spark, sf), _names(spark, sf)).select("query_id", "route")


@query(_ROUTED + " SELECT qtype, count(*) FILTER (route = 'fast')::BIGINT AS fast, count(*) FILTER (route = 'deep')::BIGINT AS deep FROM lanes JOIN questions ON question_id = query_id GROUP BY qtype")
def routing_confusion(spark, sf):
    routed = answers.route(_said(spark, sf), _names(spark, sf)).join(table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), "qtype"), "query_id")
    return answers.routing_confusion(routed)


_DAYS = [(-9, "x.pdf", 1, "Day 1 - 28 Nov"), (-8, "y.docx", 1, "DAY 1 starts on 28 dec, Day 02 is 3 March"), (-7, "z.md", 1, "Day 2: 3 Mar; Day 3 is 05 Nov; Day 3 was 5 Nov")]
_DAY_SQL = "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({n}, '{s}', {p}, '{t}')" for n, s, p, t in _DAYS) + ")"
_DAY_RX = answers.DAY_DATE.replace("(?iUd)", "(?i)")


@query(
    f"""WITH t AS (SELECT chunk_no, source, page, text FROM chunk_structured {_DAY_SQL}),
    m AS (SELECT page, chunk_no, source, regexp_extract_all(text, '{_DAY_RX}', 1) AS d, regexp_extract_all(text, '{_DAY_RX}', 2) AS n, regexp_extract_all(text, '{_DAY_RX}', 3) AS mo FROM t WHERE regexp_matches(text, '{_DAY_RX}')),
    x AS (SELECT page, chunk_no, source, unnest(range(len(d))) AS i, unnest(d) AS day, unnest(n) || ' ' || unnest(list_transform(mo, lambda s: upper(s[1:1]) || lower(s[2:]))) AS date FROM m),
    c AS (SELECT page, TRY_CAST(day AS INT) AS day, date, arg_min(source, (chunk_no, i)) AS source FROM x GROUP BY ALL)
    SELECT page, day, date, source FROM c WHERE (page, day) IN (SELECT (page, day) FROM c GROUP BY page, day HAVING count(*) > 1)"""
)
def day_date_conflicts(spark, sf):
    more = spark.createDataFrame(_DAYS, "chunk_no long, source string, page int, text string")
    rows = table(spark, sf, "chunk_structured").select("chunk_no", "source", "page", "text").unionByName(more)
    found = answers.conflicting_dates(rows, group="page", rank="chunk_no")
    return found.select("page", F.explode("conflicts").alias("c")).select("page", "c.day", F.explode("c.vals").alias("v")).select("page", "day", "v.date", "v.source")


_USED = """used AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN NULL ELSE (SELECT list(source || ' p.3') FROM loose l WHERE l.query_id = said.query_id AND l.source < 'N') END AS sources FROM said)"""
_MISSING = _MENTIONS + f""", {_USED}, gone AS (SELECT query_id, list_sort(list(source)) AS missing FROM loose l WHERE (SELECT count(*) FROM loose k WHERE k.query_id = l.query_id) >= 2
  AND NOT coalesce((SELECT list_contains(sources, l.source || ' p.3') FROM used u WHERE u.query_id = l.query_id), false) GROUP BY query_id)"""


def _missing(spark, sf):
    said, names = _said(spark, sf), _names(spark, sf)
    own = scoping.loose_sources(said, names).where("source < 'N'").groupBy("query_id").agg(F.collect_list(F.concat("source", F.lit(" p.3"))).alias("sources"))
    asked = said.join(own, "query_id", "left").withColumn("sources", F.when(F.col("query_id") % 2 == 1, F.col("sources")))
    return answers.missing_named(asked, names)


@query(_MISSING + " SELECT query_id, missing FROM gone")
def missing_named_sources(spark, sf):
    return _missing(spark, sf)


# the days on which the sources of page 1 disagree, in order of first mention, with what each source says
_DISAGREE = f"""dt AS (SELECT chunk_no, source, page, text FROM chunk_structured {_DAY_SQL}),
    dm AS (SELECT chunk_no, source, regexp_extract_all(text, '{_DAY_RX}', 1) AS d, regexp_extract_all(text, '{_DAY_RX}', 2) AS n, regexp_extract_all(text, '{_DAY_RX}', 3) AS mo FROM dt WHERE page = 1 AND regexp_matches(text, '{_DAY_RX}')),
    dx AS (SELECT chunk_no, source, unnest(range(len(d))) AS i, unnest(d) AS day, unnest(n) || ' ' || unnest(list_transform(mo, lambda s: upper(s[1:1]) || lower(s[2:]))) AS date FROM dm),
    dc AS (SELECT TRY_CAST(day AS INT) AS day, date, arg_min(source, (chunk_no, i)) AS source, min((chunk_no, i)) AS pos FROM dx GROUP BY ALL),
    dd AS (SELECT day, min(pos) AS pos, string_agg(date || '=' || source, ', ' ORDER BY pos) AS reason, string_agg(date || ' per ' || source, '; ' ORDER BY pos) AS line FROM dc GROUP BY day HAVING count(*) > 1)"""


def _disagree(spark, sf):
    more = spark.createDataFrame(_DAYS, "chunk_no long, source string, page int, text string")
    rows = table(spark, sf, "chunk_structured").select("chunk_no", "source", "page", "text").unionByName(more).where("page = 1")
    return answers.conflicting_dates(rows, group="page", rank="chunk_no")


@query(
    _MISSING
    + f""", {_DISAGREE} SELECT result_id, received_at, CASE WHEN len(u) > 0 THEN 'ungrounded numbers: [' || array_to_string(list_transform(u, lambda x: '''' || x || ''''), ', ') || ']'
    WHEN coalesce(regexp_matches(answer, '{_HEDGE_SQL}'), false) THEN 'hedging language'
    WHEN result_id % 2 = 0 AND (SELECT count(*) FROM dd) > 0 THEN (SELECT 'sources disagree on Day ' || day || '''s date: ' || reason FROM dd ORDER BY pos LIMIT 1)
    WHEN len(missing) > 0 THEN 'question named [' || array_to_string(list_transform(missing, lambda x: '''' || x || ''''), ', ') || '] but it was never retrieved' END AS reason
    FROM (SELECT *, {_UNGROUNDED} AS u FROM query_results LEFT JOIN questions USING (question_id)) LEFT JOIN gone ON question_id = query_id"""
)
def low_confidence_reason(spark, sf):
    """All four checks: every second answer is held against the disagreeing sources of page 1."""
    rows = _answers(spark, sf).withColumn("page", F.when(F.col("result_id") % 2 == 0, F.lit(1)))
    j = rows.join(_disagree(spark, sf), "page", "left").join(_missing(spark, sf), F.col("question_id") == F.col("query_id"), "left")
    reason = answers.confidence_reason(answers.ungrounded(F.col("answer"), F.col("expect")), answers.hedges(F.col("answer")), F.col("conflicts"), F.col("missing"))
    return j.select("result_id", "received_at", reason.alias("reason"))


_SYSTEM = prompts.SYSTEM.replace("'", "''")
_HITS = f"WITH {_BM25}, top AS ({_TOP.format('SELECT * FROM sparse', 5)}), got AS (SELECT top.query_id, rank, source, page, text, n_tokens FROM top JOIN chunk_structured USING (chunk_no))"


def _hits(spark, sf, asked, fields=prompts.FIELDS):
    chunks = table(spark, sf, "chunk_structured")
    return prompts.gather_hits(retrieval.bm25_topk(chunks, asked, 5), chunks, fields=fields).join(asked, "query_id")


_NOTICE = prompts.NOTICE.replace("'", "''")


@query(
    _HITS
    + f""", {_DISAGREE} SELECT query_id, '{_SYSTEM}' AS system, 'Context:' || chr(10) || string_agg('[' || source || ' p.' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(q)
    || CASE WHEN query_id % 200 = 0 AND (SELECT count(*) FROM dd) > 0 THEN '{_NOTICE}' || (SELECT string_agg('Day ' || day || ': ' || line, chr(10) ORDER BY pos) FROM dd) ELSE '' END AS user
    FROM got JOIN questions ON question_id = query_id GROUP BY query_id"""
)
def prompt_messages(spark, sf):
    """Every second prompt carries the notice on disagreeing sources."""
    hits = _hits(spark, sf, _asked(spark, sf)).withColumn("page", F.when(F.col("query_id") % 200 == 0, F.lit(1))).join(_disagree(spark, sf), "page", "left")
    m = hits.select("query_id", prompts.messages(F.col("question"), F.col("hits"), F.col("conflicts")).alias("m"))
    return m.select("query_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))


@query(_all_said(_HITS) + " SELECT query_id, list(source || ' p.' || page ORDER BY rank) AS sources, sum(coalesce(n_tokens, 0))::BIGINT AS ctx_tokens FROM got GROUP BY query_id")
def citations(spark, sf):
    hits = _hits(spark, sf, _all_asked(spark, sf), ("source", "page", "n_tokens"))
    return hits.select("query_id", prompts.citations(F.col("hits")).alias("sources"), prompts.context_tokens(F.col("hits")).alias("ctx_tokens"))


@query("SELECT source, count(*)::BIGINT AS n FROM (SELECT regexp_replace(unnest(sources), '^(.*) p\\..*$', '\\1', 's') AS source FROM query_results) GROUP BY source")
def cited_sources(spark, sf):
    return table(spark, sf, "query_results").select(F.explode("sources").alias("c")).groupBy(answers.cited_source(F.col("c")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


# ---- state ----------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS seq, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0)
    SELECT query_id, seq, round_even(sim, 4) AS cache_sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, seq) AS r FROM s) WHERE r = 1 AND sim >= 0.93"""
)
def cache_lookup(spark, sf):
    rows, asked = _vectors(spark, sf)
    return cache.cache_lookup(rows.select(F.col("chunk_no").alias("seq"), "embedding"), asked.drop("allowed"))


def _requests(spark, sf):
    r = table(spark, sf, "query_results").where("result_id is not null").groupBy("result_id").agg(F.min_by(F.struct("question", "lane", "config", "asked_at", "answer", "ttft_ms"), "received_at").alias("r")).select("result_id", "r.*")
    rows = r.select(F.col("result_id").alias("request_id"), "config", "asked_at", F.when(F.col("lane") == "deep", "deep").otherwise("fast").alias("lane"), (F.col("result_id") % 10 == 0).alias("forced"), answers.hedges(F.col("answer")).alias("low_confidence"), "question",
        (F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6).alias("at"), (F.coalesce("ttft_ms", F.lit(0.0)) / 1000).alias("elapsed_s"), F.lit(22.0).alias("check_s"))
    return adapters.embed(rows, adapters.HashEmbedder, text="question")


@query()
def cache_replay(spark, sf):
    return cache.cache_replay(_requests(spark, sf), ["config"], ["asked_at", "request_id"])


@query("SELECT result_id, lane, config, received_at FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY received_at DESC) AS r FROM query_results) WHERE r = 1")
def latest_results(spark, sf):
    events = table(spark, sf, "query_results").select(F.col("result_id").alias("job_id"), "lane", "config", "received_at")
    return cache.latest_jobs(events, "received_at").withColumnRenamed("job_id", "result_id").select("result_id", "lane", "config", "received_at")


# ---- report ---------------------------------------------------------------------------------------------------------


@query("SELECT config, stage, count(error)::BIGINT AS count, arg_min(error, (ts, span_no)) AS first FROM run WHERE error IS NOT NULL GROUP BY config, stage")
def errors_by_stage(spark, sf):
    return report.errors_by_stage(table(spark, sf, "run"), ["ts", "span_no"])


def _wide(stages: list[str], agg: str) -> str:
    cells = ", ".join(f"coalesce({agg.format(f'''CASE WHEN stage = '{s}' AND NOT isnan(ms) THEN ms END''')}, 0) AS {s}" for s in stages)
    return f"SELECT *, {' + '.join(stages)} AS \"TOTAL\" FROM (SELECT config, {cells} FROM run WHERE error IS NULL AND stage IN ({', '.join(repr(s) for s in stages)}) GROUP BY config)"


@query(_wide(report.INGEST, "sum({0})"))
def ingest_waterfall(spark, sf):
    return report.ingest_waterfall(table(spark, sf, "run"))


@query(_wide(report.QUERY, "median({0})"))
def query_waterfall(spark, sf):
    return report.query_waterfall(table(spark, sf, "run"))


@query(_wide(report.INGEST_FULL, "sum({0})"))
def ingest_waterfall_full(spark, sf):
    return report.ingest_waterfall(table(spark, sf, "run"), report.INGEST_FULL)


@query("SELECT config, quantile_cont(ttft_ms, 0.5) AS ttft_p50, quantile_cont(ttft_ms, 0.95) AS ttft_p95, median(tok_per_s) AS tok_per_s, count(*)::BIGINT AS n FROM run WHERE error IS NULL AND stage = 'answer' GROUP BY config")
def perceived_latency(spark, sf):
    return report.perceived_latency(table(spark, sf, "run"))


@query(
    """WITH t AS (SELECT config, run_id, sum(rss_mb * 100) AS tokens FROM run WHERE error IS NULL AND stage = 'embed_throughput' AND rss_mb IS NOT NULL GROUP BY ALL),
    e AS (SELECT config, run_id, sum(ms) AS ms FROM run WHERE error IS NULL AND stage = 'embed_chunks' AND ms IS NOT NULL AND NOT isnan(ms) GROUP BY ALL)
    SELECT config, run_id, round(tokens, 3) AS tokens, round(ms, 3) AS ms, round(tokens / (ms / 1000), 3) AS tok_per_s FROM t JOIN e USING (config, run_id) WHERE ms > 0"""
)
def embed_throughput(spark, sf):
    spans = table(spark, sf, "run").withColumn("tokens", F.when(F.col("stage") == "embed_throughput", F.col("rss_mb") * 100))
    got = report.embed_throughput(spans)
    return got.select("config", "run_id", *[F.round(c, 3).alias(c) for c in ("tokens", "ms", "tok_per_s")])


_SERVER = {"server_prompt_ms": "ttft_ms", "server_prompt_tok_per_s": "tok_per_s", "server_predict_ms": "ms", "server_predict_tok_per_s": "rss_mb"}


@query("SELECT config, median(ttft_ms) AS prefill_ms, median(tok_per_s) AS prefill_tok_per_s, median(CASE WHEN NOT isnan(ms) THEN ms END) AS decode_ms, median(rss_mb) AS decode_tok_per_s FROM run WHERE error IS NULL AND stage = 'generate' AND ttft_ms IS NOT NULL GROUP BY config")
def server_split(spark, sf):
    spans = table(spark, sf, "run").select("config", "stage", "error", *[F.col(v).alias(k) for k, v in _SERVER.items()])
    return report.server_split(spans)


@query(
    """SELECT lane AS level, median(ttft_ms) AS ttft_p50, max(ttft_ms) AS ttft_max, max(ttft_ms) / 1000 AS wall_s, round(sum(length(coalesce(answer, '')) + length(coalesce(question, ''))) / (max(ttft_ms) / 1000), 3) AS aggregate_tok_s,
    median(length(coalesce(question, ''))) AS reasoning_tok_median  FROM query_results GROUP BY lane"""
)
def concurrency_levels(spark, sf):
    r = table(spark, sf, "query_results").select(F.col("lane").alias("level"), "ttft_ms", (F.col("ttft_ms") / 1000).alias("wall_s"), F.length(F.coalesce("answer", F.lit(""))).alias("n_content"), F.length(F.coalesce("question", F.lit(""))).alias("n_reasoning"))
    return report.load_levels(r).withColumn("aggregate_tok_s", F.round("aggregate_tok_s", 3))


@query(f"SELECT lower(regexp_replace(stage, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS stage, count(*)::BIGINT AS n FROM run GROUP BY ALL")
def spans_by_stage(spark, sf):
    return table(spark, sf, "run").groupBy(F.lower(strip("stage")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source FROM chunk_structured WHERE source IS NOT NULL")
def distinct_sources(spark, sf):
    return table(spark, sf, "chunk_structured").select("source").where("source is not null").distinct()


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to chunks, chunks to an index, questions to prompts: windows, first copies, numbers, BM25, citations."""
    chunks = chunking.numbered_chunks(chunking.dedup_first(chunking.sliding_chunks(table(spark, sf, "documents").select("doc_id", "source", "page", "text")), ["doc_id", "window_no"]), ["doc_id", "window_no"])
    asked = table(spark, sf, "questions").select(F.col("question_id").alias("query_id"), F.col("q").alias("question"))
    hits = prompts.gather_hits(retrieval.bm25_topk(chunks, asked, 5), chunks).join(asked, "query_id")
    return hits.select("query_id", "question", prompts.citations(F.col("hits")).alias("sources"), prompts.context_tokens(F.col("hits")).alias("ctx_tokens"))
