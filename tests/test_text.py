"""Expression parity with the reference's Python semantics."""
import pytest
from pyspark.sql import functions as F

from civicflow.functions import codes, text


def _one(spark, col_fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


LANG_CASES = [
    ("வணக்கம் நண்பரே", "tamil"),
    ("मुझे मदद चाहिए", "hindi"),
    ("வணக்கம் मदद", "tamil"),                 # both scripts: Tamil wins
    ("வணக்கம் romba kastam", "tamil"),        # script beats romanised words
    ("Enakku romba bayam", "tanglish"),
    ("Mujhe dar lagta hai", "hinglish"),
    ("romba kastam, mujhe madad", "tanglish"),  # Tamil list wins
    ("I need legal advice", "english"),
    ("I live in Chennai", "tanglish"),         # T1: 'enna' inside Chennai
    ("a chain of events", "hinglish"),        # T1: 'hai' inside chain
    ("Calendar reminder", "hinglish"),        # 'dar' inside calendar
    ("", "english"),
]


def test_language_tag(spark):
    got = _one(spark, text.language_tag, [v for v, _ in LANG_CASES])
    assert got == [e for _, e in LANG_CASES]


def test_language_tag_total(spark):
    got = _one(spark, text.language_tag, [None, "x", "123", "ÉLAN"])
    assert all(g in text.LANGUAGES for g in got)



def test_language_tag_equals_plain_ordered_chain(spark):
    """The one-scan form gives the plain rule's answer: Tamil script, then
    Devanagari, then the two keyword lists, else english."""
    from pyspark.sql import functions as F
    def plain(t):
        low = F.lower(t)
        return (F.when(t.rlike(text.TAMIL_PATTERN), "tamil").when(t.rlike(text.DEVANAGARI_PATTERN), "hindi")
                .when(low.rlike(text.any_substring_pattern(text.TANGLISH_WORDS)), "tanglish")
                .when(low.rlike(text.any_substring_pattern(text.HINGLISH_WORDS)), "hinglish").otherwise("english"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    extra = spark.createDataFrame([(v,) for v, _ in LANG_CASES] + [(None,), ("मदद தமிழ்",), ("कानून enna",)], "text string")
    df = docs.unionByName(extra)
    bad = df.where(~F.equal_null(text.language_tag(F.col("text")), plain(F.col("text")))).count()
    assert bad == 0

LAW_CASES = [
    ("Domestic Violence Act 2005", "domestic_violence"),
    ("IPC 498A", "domestic_violence"),
    ("POSH Act 2013", "posh_act"),
    ("POSH domestic", "domestic_violence"),       # precedence: domestic first
    ("IT Act 354", "it_act_cyber"),               # 'it act' before '354'
    ("IPC 367", "it_act_cyber"),                  # T1: '67' inside 367
    ("Section 66E", "it_act_cyber"),
    ("IPC 354", "ipc_assault_354"),
    ("IPC 506", "ipc_criminal_intimidation_506"),
    ("IPC 504", "ipc_criminal_intimidation_506"),
    ("Article 21", "general"),
    (None, "general"),
]


def test_law_key(spark):
    got = _one(spark, text.law_key, [v for v, _ in LAW_CASES])
    assert got == [e for _, e in LAW_CASES]


def test_kb_category_case_sensitive(spark):
    assert _one(spark, text.kb_category, ["IPC 354", "ipc 354", "Domestic"]) == [
        text.CATEGORY_CRIMINAL, text.CATEGORY_CIVIL, text.CATEGORY_CIVIL]


WS_CASES = ["  a b  ", " x ", "\t\n y \x1c", "", "   ", "one", "a　b\u0085"]


def test_strip_and_words_match_python(spark):
    assert _one(spark, text.py_strip, WS_CASES) == [s.strip() for s in WS_CASES]
    assert _one(spark, text.word_count, WS_CASES) == [len(s.split()) for s in WS_CASES]
    assert _one(spark, text.is_blank, WS_CASES + [None]) == [not s.strip() for s in WS_CASES] + [True]


def test_short_message(spark):
    assert _one(spark, text.is_short_message, ["Yes", "I am in", "Chennai now", "Yes please  "]) == [
        True, False, True, True]


def test_severity_keyword(spark):
    assert _one(spark, text.severity_keyword, ["YES please", "I need a LAWYER", "just sad", "haan ji", None]) == [
        True, True, False, True, False]


def test_tokens_match_python_word_rule(spark):
    """Same tokens as Python's (?u)\\b\\w\\w+\\b on lowercased text."""
    import re
    vals = ["Hello, World! a_b c 42", "மனித உரிமை", "Ünïcode café x", "मुझे मदद चाहिए", "x1 ab-cd"]
    got = _one(spark, text.tokens, vals)
    assert got == [re.findall(r"(?u)\b\w\w+\b", v.lower()) for v in vals]



def test_possessive_token_pattern_same_matches(spark):
    """The JVM tokenizer pattern finds exactly what TOKEN_PATTERN (and DuckDB's
    RE2 on the oracle side) finds."""
    import duckdb
    from pyspark.sql import functions as F
    vals = ["a bb ccc d ee", "x_y__z 1 22 333", "மனித உரிமை à", "ab-cd.ef,g h", "", "z"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    spec = [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(text.TOKEN_PATTERN), 0)).collect()]
    fast = [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(text.TOKEN_PATTERN_JVM), 0)).collect()]
    duck = [duckdb.execute("SELECT regexp_extract_all(?, ?)", [v, text.TOKEN_PATTERN]).fetchone()[0] for v in vals]
    assert fast == spec == duck

def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(text.word_bigrams("t")).collect()] == [["a b", "b c"], [], []]


def test_gov_id_validation(spark):
    vals = [" 123456789012 ", "12345678901", "12345678901a", "१२३४५६७८९०१२", None, "1234 5678 9012"]
    assert _one(spark, codes.valid_gov_id, vals) == [True, False, False, True, False, False]


def test_md5_bucket_stable(spark):
    df = spark.range(100).select(codes.md5_bucket(F.col("id"), 10).alias("b"))
    a = sorted(r[0] for r in df.collect())
    b = sorted(r[0] for r in df.repartition(7).collect())
    assert a == b and set(a) <= set(range(10))


def test_parse_options(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("",), (None,), ("not json",)], "o string")
    assert [r[0] for r in df.select(codes.parse_options("o")).collect()] == [["a", "b"], [], [], []]


@pytest.mark.parametrize("gate,score,expected", [(text.LEGAL_GATE, 0.45, False), (text.LEGAL_GATE, 0.450001, True)])
def test_gate_is_strict(spark, gate, score, expected):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(F.round("s", 6) > F.lit(gate)).first()[0] is expected
