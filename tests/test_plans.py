"""Plan shapes: no Cartesian products, pruned scans, partial
top-k before the shuffle, literal dimensions broadcast."""
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# Queries that compute eagerly (checkpoint / model fit) are covered elsewhere.
EAGER = {"dialogue_replay", "dialogue_branch_counts", "severity_model", "complaint_classifier",
         "emotion_classifier"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EAGER))
def test_no_cartesian_product(spark, name):
    p = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p


def test_scan_prunes_columns(spark):
    p = _plan(entry.queries()["language_tag_counts"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all(s == "struct<text:string,lang:string>" for s in schemas)


def test_filters_pushed_to_scan(spark):
    p = _plan(entry.queries()["severity_keyword"](spark, SF))
    assert "EqualTo(role,user)" in p


def test_top_k_is_cut_before_shuffle(spark):
    p = _plan(entry.queries()["quiz_sample"](spark, SF))
    assert p.count("WindowGroupLimit") >= 1


def test_literal_dims_are_broadcast(spark):
    p = _plan(entry.queries()["law_text_lookup"](spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["tfidf_recommend", "semantic_top1"])
def test_score_blocks_keep_their_partitions(spark, name):
    """Blocked scoring: both cogroup sides are hashed by block with an explicit
    partition count (AQE keeps it, so CPU-heavy blocks are not coalesced into
    one task), and the cogroup adds no second shuffle on the same keys."""
    p = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"hashpartitioning\(qb#\d+, cb#\d+, \d+\), REPARTITION_BY_NUM", p)) == 2
    assert not re.search(r"hashpartitioning\(qb#\d+, cb#\d+, \d+\), ENSURE_REQUIREMENTS", p)


def test_document_frequency_reuses_term_counts(spark):
    """The (doc, term) count feeds both the IDF and the weights; it must stay
    one aggregate (a count(1) would become a distinct and tokenise twice)."""
    from civicflow.operators import tfidf
    from civicflow.plans import inputs
    idx = tfidf.build_index(inputs.complaint_corpus(spark, SF), "doc_id", "text")
    p = idx.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id#" in p and "functions=[]" not in p
    aggs = re.findall(r"Aggregate \[doc_id#\d+L?, term#\d+\], \[([^\]]*)\]", p)
    assert len(aggs) == 2 and all("count(1)" in a for a in aggs)


def test_only_text_tables_are_spread(spark):
    """Single-split scans are round-robin spread only for text tables."""
    from civicflow.sources.readers import read_table
    spread = read_table(spark, SF, "documents", ["doc_id", "text"])._jdf.queryExecution().sparkPlan().toString()
    plain = read_table(spark, SF, "nation", ["n_nationkey"])._jdf.queryExecution().sparkPlan().toString()
    assert "RoundRobinPartitioning" in spread
    assert "RoundRobinPartitioning" not in plain
