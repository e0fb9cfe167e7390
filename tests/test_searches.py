"""Searches of the catalogue over small tables."""

import pytest

from siltra.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    chunks = [(i, f"i{i}", f"lease {i} of town{i % 7} on rent", f"f{i % 5}.pdf", 1, 6) for i in range(60)]
    spark.createDataFrame(chunks, "chunk_no long, id string, text string, source string, page int, n_tokens int").write.parquet(f"{d}/chunk_structured.parquet")
    asked = [(i, f"What is the rent of town{i % 7}?") for i in (1, 2, 99, 100, 101, 200)] + [(7, None)]
    spark.createDataFrame(asked, "question_id long, q string").write.parquet(f"{d}/questions.parquet")
    return d


@pytest.mark.parametrize("name", ["citations", "rrf_fused", "hybrid_candidates"])
def test_all_questions_are_searched(spark, tables, name):
    """F7, F8, F9: not each hundredth."""
    got = {r.query_id for r in catalogue.queries()[name](spark, tables).select("query_id").collect()}
    assert got == {1, 2, 7, 99, 100, 101, 200} and "% 100" not in catalogue.oracle_sql()[name]


@pytest.mark.parametrize("name", ["rerank_overlap", "prompt_messages"])
def test_texts_are_not_shuffled_for_short_lists(spark, tables, name):
    """the list goes to the tasks, before the planner would shuffle the table."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.queries()[name](spark, tables)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and {r.query_id for r in df.collect()} == {100, 200}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
