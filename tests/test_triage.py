"""Flagship triage end to end on invented fixtures: rules 6-8 and the fallbacks."""
from civicflow.plans import triage

CORPUS = [
    (1, "my husband beats me every night at home", "en", "s", "IPC 498A"),
    (2, "someone posted my private photos online without consent", "en", "s", "IT Act 67"),
    (3, "my manager harasses me at the office every day", "en", "s", "POSH Act"),
]
DIRECTORY = [
    (1, "A", "9000000001", "Chennai", "Criminal", 10.0),
    (2, "B", "9000000002", "Chennai", "Civil", 20.0),
    (3, "C", "9000000003", "Delhi", "Criminal", 5.0),
    (4, "D", "9000000004", "New-Delhi", "Family", 7.0),
    (5, "E", "9000000005", "Mumbai", "Civil", None),
]
TURNS = [
    # conv 1: greet, legal (domestic), severe, place known -> recommender (Chennai Criminal)
    (1, 0, "hello there friend"), (1, 1, "my husband beats me every night"),
    (1, 2, "it is very severe please help"), (1, 3, "I am staying in Chennai now"),
    # conv 2: workplace case -> Corporate practice, unknown place: no shared term -> no adviser
    (2, 0, "good morning to you"), (2, 1, "my manager harasses me at the office"),
    (2, 2, "yes I want police action"), (2, 3, "somewhere far away from here"),
    # conv 3: emotional, then a one-word answer resets to a greeting
    (3, 0, "hi hi hi"), (3, 1, "I feel so sad and alone today"), (3, 2, "Yes"),
    # conv 4: not severe -> actions; blank-free
    (4, 0, "hello again friend"), (4, 1, "someone posted my private photos online"),
    (4, 2, "it is fine I will manage it"),
]
CORPUS_SCHEMA = "doc_id long, text string, lang string, source string, law string"
DIR_SCHEMA = ("lawyer_id long, name string, mobile string, location string, practice_area string, "
              "experience_years double")


def _run(spark, directory, turns=TURNS):
    t = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    c = spark.createDataFrame(CORPUS, CORPUS_SCHEMA)
    d = spark.createDataFrame(directory, DIR_SCHEMA)
    return {(r.conv_id, r.turn): r for r in triage.triage(spark, t, c, d).collect()}


def test_triage_rules(spark):
    out = _run(spark, DIRECTORY)
    assert [out[(1, i)].branch for i in range(4)] == ["greet", "legal", "ask_location", "lawyer"]
    assert out[(1, 1)].law_key == "domestic_violence" and out[(1, 1)].hit_doc == 1
    assert out[(1, 3)].place == "chennai" and out[(1, 3)].lawyer_id == 1
    assert out[(1, 3)].match_kind == "recommender"
    assert [out[(2, i)].branch for i in range(4)] == ["greet", "legal", "ask_location", "no_lawyer"]
    assert out[(2, 3)].law_key == "posh_act" and out[(2, 3)].lawyer_id is None
    assert [out[(3, i)].branch for i in range(3)] == ["greet", "emotional", "greet"]
    assert [out[(4, i)].branch for i in range(3)] == ["greet", "legal", "actions"]
    assert out[(4, 1)].law_key == "it_act_cyber"
    assert all(r.lang == "english" for r in out.values())


def test_small_directory_uses_location_filter(spark):
    small = [(3, "C", "x", "Delhi", "Criminal", 5.0), (4, "D", "y", "New-Delhi", "Family", 7.0),
             (6, "F", "z", "delhi", "Civil", 9.0)]
    turns = [(1, 0, "hello there friend"), (1, 1, "my husband beats me every night"),
             (1, 2, "please help it is severe"), (1, 3, "I moved to New-Delhi last year")]
    out = _run(spark, small, turns)
    # < 5 rows: no recommender; first place in directory order contained in the text is "delhi"
    # (inside "new-delhi"), and the best-experienced adviser there wins (id 6, 9 years).
    assert out[(1, 3)].place == "delhi" and out[(1, 3)].match_kind == "location_filter"
    assert out[(1, 3)].lawyer_id == 6 and out[(1, 3)].branch == "lawyer"


def test_no_corpus(spark):
    t = spark.createDataFrame(TURNS[:2], "conv_id long, turn long, text string")
    c = spark.createDataFrame([], CORPUS_SCHEMA)
    d = spark.createDataFrame(DIRECTORY, DIR_SCHEMA)
    out = {(r.conv_id, r.turn): r for r in triage.triage(spark, t, c, d).collect()}
    assert out[(1, 1)].branch == "no_corpus" and out[(1, 1)].score is None
