"""Properties: results do not depend on input partitioning,
keep-first is idempotent, and report accuracy equals the confusion diagonal
over n. Inputs are random but seeded, drawn with hypothesis."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicflow.operators import report, tfidf
from civicflow.operators.common import keep_first
from civicflow.plans import dialogue

WORDS = ["the", "police", "help", "case", "lawyer", "de", "la", "harassment", "cyber", "x1"]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(WORDS)), min_size=1, max_size=40))
def test_keep_first_idempotent_and_partition_free(spark, rows):
    df = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(rows)], "id long, k long, w string")
    once = keep_first(df, F.col("k"), "id")
    assert _rows(keep_first(once, F.col("k"), "id"), ["id", "k", "w"]) == _rows(once, ["id", "k", "w"])
    assert _rows(keep_first(df.repartition(7), F.col("k"), "id"), ["id", "k", "w"]) == _rows(once, ["id", "k", "w"])
    # the survivor of each key is its smallest id
    want = {}
    for i, (k, w) in enumerate(rows):
        want.setdefault(k, (i, k, w))
    assert _rows(once, ["id", "k", "w"]) == sorted(want.values())


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8), min_size=4, max_size=25),
       st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), min_size=1, max_size=8))
def test_tfidf_search_partition_free(spark, docs, queries):
    ddf = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    qdf = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(queries)], "qid long, text string")
    cols = ["query_id", "doc_id", "rank", F.round("score", 9).alias("s")]
    a = tfidf.search(tfidf.build_index(ddf, "doc_id", "text"), qdf, "qid", "text", k=2)
    b = tfidf.search(tfidf.build_index(ddf.repartition(5), "doc_id", "text"), qdf.repartition(3), "qid", "text", k=2)
    assert _rows(a, cols) == _rows(b, cols)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.booleans(), st.booleans()), min_size=1, max_size=9),
                min_size=1, max_size=6))
def test_dialogue_replay_partition_free(spark, convs):
    rows = [(c, t, s, lg, sv, "posh_act" if lg else None, "english")
            for c, turns in enumerate(convs) for t, (s, lg, sv) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, short boolean, legal boolean, severe boolean, "
                                     "hit_law string, lang string")
    cols = ["conv_id", "turn", "stage_in", "branch", "stage_out", "law_key"]
    base = _rows(dialogue.replay(df), cols)
    assert _rows(dialogue.replay(df.repartition(4)), cols) == base
    assert _rows(dialogue.replay(df.repartition(3), block=2), cols) == base


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_report_accuracy_is_diagonal_over_n(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r.class_name: r for r in report.classification_report(df).collect()}
    assert got["accuracy"].support == len(pairs)
    assert got["accuracy"].f1 == round(sum(1 for a, b in pairs if a == b) / len(pairs), 6)
    # per-class support sums to n
    assert sum(r.support for k, r in got.items() if k.isdigit()) == len(pairs)
