from collections import Counter

import pytest

import corpus_pipeline
from shelfspark.llm import bpe, queries, simhash, suffix_dedup
from shelfspark.llm.common import table
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same_columns, ours, theirs = differences(connect(SF), queries.queries()[name](spark, SF), queries.oracle_sql()[name])
    assert same_columns and not ours and not theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs_over_all_rows(spark, name):
    n = queries.queries()[name](spark, SF).count()
    rows = {"op1_url_filter": "pages", "op7_token_counts": "documents", "op8_toxicity": "documents", "op9_simhash": "documents", "op10_bpe": "documents"}
    assert n == table(spark, SF, rows[name]).count() if name in rows else n > 0


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name.startswith("simhash"):
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left == {r.doc_id for r in simhash.near_duplicates(before).where("keep").collect()}
        if name.startswith("suffix"):
            assert suffix_dedup.repeated_passages(docs).where("removed_words > 0").count() <= suffix_dedup.repeated_passages(before).where("removed_words > 0").count()
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in bpe.decode(docs).collect():
        assert r.text == texts[r.doc_id]


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, block string, key int, end string, c0 string, th long, score double"


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns named as the stages name theirs."""
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(None,) * 12, (1, None, "en", "src1", 0, "r", "b", 1, "e", "c", 2, 0.5), (2, "", "en", "src1", 0, None, None, None, None, None, None, None), (3, " \n ", None, "src2", 3, "r", "b", 1, "e", "c", 2, 0.5)]
    rows += [(10 + i, f"own{i} words{i} here{i} " + passage + f" and{i} after{i}", "en", f"src{i}", 500, "r", "b", 1, "e", "c", 2, 0.5) for i in range(6)]
    rows += [rows[5], (40, "long " + " ".join(f"word{i % 977}" for i in range(300_000)), "de", "src3", 1, "r", "b", 1, "e", "c", 2, 0.5), (None, "a text without an id " * 3, "fr", None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_rows(spark, name, stage):
    d = spark.createDataFrame(odd_rows(), ODD)
    got = stage(spark, d, SF)
    assert got.columns == d.columns and [f.dataType for f in got.schema] == [f.dataType for f in d.schema]
    rows = [tuple(r) for r in got.collect()]
    if name == "toxicity":  # nothing of this is toxic
        assert sorted(map(str, rows)) == sorted(map(str, odd_rows()))
    if name.startswith("simhash"):  # equal rows are one; rows without words all stay
        assert len(rows) == len(set(rows)) and {1, 2, 3, None, 40} <= {r[0] for r in rows}
    if name.startswith("suffix"):  # the passage stays where it stands first
        assert [r[0] for r in rows if r[1] and "shared59" in r[1]] == [10]
        assert all(r[2:4] == o[2:4] for r in rows for o in odd_rows() if r[0] == o[0] and r[0] is not None)
    if name.startswith("mixing"):  # texts without tokens are never read, others come whole
        assert {r[0] for r in rows} <= {None, 40, *range(10, 16)} and set(rows) <= set(map(tuple, odd_rows()))
    assert stage(spark, d.limit(0), SF).count() == 0


def test_last_stage_on_odd_rows(spark):
    d = spark.createDataFrame(odd_rows(), ODD)
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, d, SF)
    assert got.columns == [c for c in d.columns if c != "text"] + ["tokens", "n_tokens", "offsets"]
    assert sorted(map(str, (r.text for r in bpe.decode(got).collect()))) == sorted(map(str, (r[1] for r in odd_rows())))
    assert stage(spark, d.limit(0), SF).count() == 0


def test_toxicity_stage_drops_what_the_scores_call_toxic(spark):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.toxic for r in queries.op8_toxicity(spark, SF).collect()}
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SF).collect()}
    assert left == {i for i, toxic in scores.items() if not toxic}


def test_mixing_stage_reads_what_the_plan_says(spark):
    docs = table(spark, SF, "documents")
    want = Counter(r.doc_id for r in queries.op2_mixing(spark, SF).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.mixing_weights(spark, docs, SF).collect()) == want


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert "tokens" in got.columns and got.count() > 0
