"""Queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.llm import format_dups, leakage, packing, pairs, pii, quantiles, repetition, splitting, tokenizing
from siltra.llm.common import materialize, shared_dir, table

#: Key of the surrogates in the queries; a deployment passes its own secret.
DEMO_KEY = "not a secret"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_structured")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    offs = splitting.piece_offsets(_chunks(spark, sf))
    return offs.where((F.col("total_words") > splitting.LIMIT) & (F.col("piece_no") == 0)).select(F.col("key").alias("chunk_no"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(_chunks(spark, sf)).where(F.col("total_words") > splitting.LIMIT)


def p1_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each split text and words that its pieces cover."""
    return splitting.coverage(splitting.piece_offsets(_chunks(spark, sf)).where(F.col("total_words") > splitting.LIMIT))


def p1_files(spark: SparkSession, sf: str) -> DataFrame:
    """The texts written as plain files in the shared folder and split by byte ranges, no file being read as a whole."""
    folder = f"{shared_dir(spark)}/siltra/files-{uuid.uuid4().hex}"
    rows = _chunks(spark, sf).where("text is not null").repartitionByRange(8, "chunk_no").sortWithinPartitions("chunk_no")
    rows.select("text").write.option("lineSep", "\n\n").text(folder)
    pieces = splitting.split_files(spark, splitting.text_files(spark, folder))
    return pieces.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file_no"), "piece_no", "start", "end", "n_words")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_dups.format_duplicates(_chunks(spark, sf))[1]


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    return format_dups.format_duplicates(_chunks(spark, sf))[0]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf, "query_results"), table(spark, sf, "questions"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("record_set", "row_id", "defect")


def p3_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that got a surrogate."""
    return pii.replaced(_chunks(spark, sf), DEMO_KEY)[0].select(F.col("key").alias("chunk_no"), "field", "pii_kind", "nth")


def p4_clashes(spark: SparkSession, sf: str) -> DataFrame:
    """Surrogates that two values share or that are real values, by kind."""
    return pii.clashes(pii.replaced(_chunks(spark, sf), DEMO_KEY)[1])


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_chunks(spark, sf))


def p4_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymise(_chunks(spark, sf), DEMO_KEY)


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The table again, from its pseudonymised form: nothing but the values was touched."""
    return pii.pseudonymise(_chunks(spark, sf), DEMO_KEY, back=True)


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each record over its containers, none of which is overfull."""
    return packing.membership(packing.pack_containers(_chunks(spark, sf))).select("chunk_no", "n_words", "fits")


def p5_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_containers(_chunks(spark, sf))


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.stage_percentiles(table(spark, sf, "run"))


def p6_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same percentiles for each day of ``ts``, from the sketches that combine to those of the whole."""
    return quantiles.day_percentiles(table(spark, sf, "run"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, sf, "documents"))


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of what the ids stand for."""
    return tokenizing.decoded_digests(p7_ids(spark, sf)).select("doc_id", "digest")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_near(spark, sf).where("edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which a run stands in a document with at most two edits."""
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Share of repeated words of every document."""
    return repetition.repetition(table(spark, sf, "documents")).select("doc_id", "n_words", "n_repeated")


def p9_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    measured = materialize(repetition.repetition(table(spark, sf, "documents")).where("n_words > 0"), "repetition")
    return repetition.adaptive_thresholds(measured)


def p9_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetitive_documents(table(spark, sf, "documents")).select("doc_id", "share", "cutoff")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.share_at_least(table(spark, sf, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_pieces, p1_cover, p1_files, p2_found, p2_copies, p3_found, p3_posteriors, p4_found, p4_redacted, p4_surrogates, p4_clashes, p4_restored, p5_containers, p5_members, p6_percentiles, p6_days,
        p7_ids, p7_round_trip, p8_found, p8_near, p9_found, p9_repetition, p9_thresholds, p9_flagged,
    )
    return {f.__name__: f for f in own}


_WS = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CANON = "lower(regexp_replace(replace(replace({0}, 'ß', 'ss'), 'ẞ', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"

_P2 = f"""
WITH parts AS (
  SELECT chunk_no, text, {_CANON.format('text')} AS k1,
         list_filter(regexp_split_to_array(text, '[\\n\\r|;]+'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')) AS ps
  FROM chunk_structured WHERE text IS NOT NULL AND chunk_no IS NOT NULL
), keyed AS (
  SELECT chunk_no, k1,
         CASE WHEN len(ps) > 1 AND len(list_filter(ps, lambda p: regexp_matches(p, '(?s)^[^:=]*[\\p{{L}}\\p{{N}}][^:=]*[:=].*[\\p{{L}}\\p{{N}}].*$'))) = len(ps)
         THEN array_to_string(list_sort(list_transform(ps, lambda p:
           {_CANON.format("regexp_extract(p, '(?s)^([^:=]*)[:=](.*)$', 1)")} || chr(1) || {_CANON.format("regexp_extract(p, '(?s)^([^:=]*)[:=](.*)$', 2)")})), chr(2)) END AS k2
  FROM parts
), grouped AS (
  SELECT chunk_no, coalesce('f' || min(k2) OVER (PARTITION BY k1), 't' || k1) AS grp FROM keyed
), kept AS (SELECT grp, min(chunk_no) AS keep_no, count(*) AS copies FROM grouped GROUP BY grp)
"""

_P6 = """
WITH one AS (
  SELECT config, lower(trim(stage, chr(9) || chr(10) || chr(13) || ' ' || chr(160))) AS stage, floor(ts / 86400)::BIGINT AS day, ms, error,
         row_number() OVER (PARTITION BY span_no ORDER BY ingested_at) AS r
  FROM run WHERE span_no IS NOT NULL
)
SELECT {0}, count(*)::BIGINT AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
FROM one WHERE r = 1 AND error IS NULL AND ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0 GROUP BY {0}
"""

_WORDS12 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ir AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""

_REPEATS = """
WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
runs AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, run ORDER BY p) > 1 AS rep FROM runs),
covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS x FROM again WHERE rep) GROUP BY doc_id),
shares AS (SELECT d.doc_id, lower(trim(lang)) AS lang, source, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_repeated FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id)
"""

_FENCES = _REPEATS + """, m AS (SELECT doc_id, lang, source, n_repeated / n_words AS share FROM shares WHERE n_words > 0),
by_group AS (SELECT lang, source, count(*)::BIGINT AS n, quantile_disc(share, 0.25) AS q1, quantile_disc(share, 0.75) AS q3 FROM m GROUP BY lang, source),
by_lang AS (SELECT lang, quantile_disc(share, 0.25) AS q1, quantile_disc(share, 0.75) AS q3 FROM m GROUP BY lang),
t AS (SELECT g.lang, g.source, g.n, CASE WHEN g.n >= 20 THEN g.q3 + 3.0::DOUBLE * (g.q3 - g.q1) ELSE l.q3 + 3.0::DOUBLE * (l.q3 - l.q1) END AS threshold
      FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT chunk_no FROM chunk_structured WHERE len(regexp_extract_all(text, '{_WS}')) > 400",
        "p1_cover": f"WITH n AS (SELECT chunk_no, len(regexp_extract_all(text, '{_WS}')) AS n FROM chunk_structured) SELECT chunk_no, n AS n_words, n AS covered, true AS within_limit FROM n WHERE n > 400",
        "p2_found": _P2 + "SELECT keep_no, chunk_no FROM grouped JOIN kept USING (grp) WHERE chunk_no > keep_no",
        "p2_copies": _P2 + "SELECT keep_no, copies FROM kept",
        "p4_clashes": "SELECT unnest(['person', 'email', 'phone', 'id_number', 'address']) AS pii_kind, 0::BIGINT AS shared, 0::BIGINT AS real",
        "p4_restored": "SELECT chunk_no, text, source FROM chunk_structured",
        "p5_members": f"SELECT chunk_no, coalesce(len(regexp_extract_all(text, '{_WS}')), 0)::BIGINT AS n_words, true AS fits FROM chunk_structured",
        "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p6_percentiles": _P6.format("config, stage"),
        "p6_days": _P6.format("config, stage, day"),
        "p8_found": _WORDS12,
        "p9_repetition": _REPEATS + "SELECT doc_id, n_words, n_repeated FROM shares",
        "p9_thresholds": _FENCES + "SELECT lang, source, n, threshold FROM t",
        "p9_flagged": _FENCES + """SELECT doc_id, share, greatest(0.1::DOUBLE, threshold) AS cutoff
            FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source WHERE share >= greatest(0.1::DOUBLE, threshold)""",
        "p9_found": _REPEATS + "SELECT doc_id FROM shares WHERE n_words > 0 AND n_repeated >= 0.3 * n_words",
    }
