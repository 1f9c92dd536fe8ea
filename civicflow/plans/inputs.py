"""Adapters from the shared test tables to the inputs the jobs expect.

The service's own inputs (complaint corpus, adviser directory, chat turns,
quiz, registrations) are not shipped, so each is derived from the given
tables by a fixed, documented rule. Every derivation is a lazy projection or
join over the whole table, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.text import is_blank
from civicflow.operators.common import broadcast_checked, drop_null_rows, keep_first, keep_first_in_place
from civicflow.sources.readers import read_table

# Our own binding rules (not behaviour being reproduced).
# part.p_type -> act name used to build a law title "<act> <p_partkey>".
ACT_BY_PART_TYPE = [
    ("STANDARD", "IPC"),
    ("MEDIUM", "IT Act"),
    ("PROMO", "POSH Act"),
    ("LARGE", "Domestic Violence Act"),
    ("SMALL", "Section"),
    ("ECONOMY", "CrPC"),
]
DEFAULT_ACT = "Act"
PRACTICE_BY_SUPPKEY_MOD3 = ["Criminal", "Civil", "Corporate"]
EXPERIENCE_UNIT = 250.0           # s_acctbal / 250 -> years; negative balance -> unknown
EXISTING_USER_SEGMENT = "BUILDING"  # customers of this segment are already registered
MISSING_PASSWORD_VALUE = 300.0    # signup events with value >= this omit the password
SHORT_ID_VALUE = 3.0              # signup events with value < this send an 11-digit id
QUIZ_ANSWER_BRANDS = 25
SEARCH_TERMS = ["red", "anvil", "Brand#1", "econ", "l_rg", "sm%ll", "PROMO", "xyz", ""]
QUIZ_SEED_TEXT = "quiz-2024"
NATION_ROWS_BOUND = 10_000


def _act_expr(p_type: F.Column) -> F.Column:
    expr = None
    for t, act in ACT_BY_PART_TYPE:
        expr = F.when(p_type == t, F.lit(act)) if expr is None else expr.when(p_type == t, F.lit(act))
    return expr.otherwise(F.lit(DEFAULT_ACT))


def part_laws(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, law): one law title per part, e.g. "IPC 354"."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_type"])
    return part.select("p_partkey", F.concat(_act_expr(F.col("p_type")), F.lit(" "),
                                             F.col("p_partkey").cast("string")).alias("law"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return broadcast_checked(read_table(spark, sf, "nation", ["n_nationkey", "n_name"]), NATION_ROWS_BOUND)


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """Adviser directory: supplier joined with its nation as the location."""
    sup = read_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    practice = F.element_at(F.array(*[F.lit(p) for p in PRACTICE_BY_SUPPKEY_MOD3]),
                            (F.pmod(F.col("s_suppkey"), F.lit(3)) + 1).cast("int"))
    return (sup.join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").alias("lawyer_id"), F.col("s_name").alias("name"),
                    F.concat(F.lit("98"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("mobile"),
                    F.col("n_name").alias("location"), practice.alias("practice_area"),
                    F.when(F.col("s_acctbal") < 0, F.lit(None).cast("double"))
                    .otherwise(F.floor(F.col("s_acctbal") / F.lit(EXPERIENCE_UNIT)).cast("double"))
                    .alias("experience_years")))


def customers_with_nation(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return cust.join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"), "left")


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns typed by users; blank ones are never logged."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.where((F.col("role") == "user") & ~is_blank("text")).select("conv_id", "turn", "text")


def complaint_corpus(spark: SparkSession, sf: str, in_place: bool = False) -> DataFrame:
    """Labelled complaint corpus: documents with nulls dropped (P1), first
    copy of each text kept (A1), and a law title "IPC <doc_id>". With
    ``in_place`` the copies are looked for at once and no text is moved."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    kept = keep_first_in_place if in_place else keep_first
    clean = kept(drop_null_rows(docs, ["text", "lang", "source"]), F.sha2(F.col("text"), 256), "doc_id")
    return clean.withColumn("law", F.concat(F.lit("IPC "), F.col("doc_id").cast("string")))


def quiz_from_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Quiz questions: which brand makes a part (options JSON, some empty)."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    options = (F.when(F.col("p_size") < 3, F.lit(None).cast("string"))
               .when(F.col("p_size") < 5, F.lit(""))
               .otherwise(F.concat(F.lit('["'), F.col("p_brand"), F.lit('", "'), F.col("p_type"), F.lit('"]'))))
    return part.select(F.col("p_partkey").alias("id"),
                       F.concat(F.lit("Which brand makes the "), F.col("p_name"), F.lit(" (part "),
                                F.col("p_partkey").cast("string"), F.lit(")?")).alias("question"),
                       options.alias("options"), F.col("p_brand").alias("correct_answer"),
                       F.col("p_type").alias("explanation"), F.col("p_type").alias("category"),
                       F.when(F.pmod(F.col("p_size"), F.lit(2)) == 0, F.lit("MCQ"))
                       .otherwise(F.lit("True/False")).alias("type"))


def quiz_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase events as quiz submissions: answers map {question id: answer}.

    The answer text carries stray whitespace and odd case on purpose, and a
    non-numeric key ("bonus") that grading must ignore.
    """
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value", "props"])
    k = F.get_json_object(F.col("props"), "$.k")
    answer = F.concat(F.lit("\tbrand#"),
                      (F.pmod(F.floor(F.col("value")).cast("long"), F.lit(QUIZ_ANSWER_BRANDS)) + 1).cast("string"),
                      F.lit(" "))
    return (ev.where(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("submission_id"), "user_id",
                    F.map_from_arrays(F.array(k, F.lit("bonus")), F.array(answer, F.lit("x"))).alias("answers")))


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Signup events as registration requests (mobile, password, gov id)."""
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])
    eid = F.col("event_id").cast("string")
    return (ev.where(F.col("event_type") == "signup")
            .select("event_id", "user_id",
                    F.concat(F.lit("9"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("mobile"),
                    F.when(F.col("value") >= MISSING_PASSWORD_VALUE, F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("pw"), F.col("user_id").cast("string"))).alias("password"),
                    F.when(F.col("value") < SHORT_ID_VALUE, F.lpad(eid, 11, "0"))
                    .otherwise(F.concat(F.lit(" "), F.lpad(eid, 12, "0"), F.lit(" "))).alias("gov_id")))


def part_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled examples from parts: the words of name, type and brand, and a law title by type (see ``part_laws``)."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    return part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"),
                       F.concat(_act_expr(F.col("p_type")), F.lit(" "), F.col("p_partkey").cast("string")).alias("law"))


def case_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A scripted conversation for every customer, so that each rule of the dialogue is met: a greeting, an example's
    own words (or, for every fifth customer, none), an answer to the follow-up question (severe for two of three), the
    customer's nation (or, for every seventh, no place), a short message, and an example again."""
    cust = customers_with_nation(spark, sf)
    parts = part_corpus(spark, sf).select(F.col("doc_id").alias("_part"), F.col("text").alias("_example"))
    parts = cust.join(parts, cust["c_custkey"] == parts["_part"], "left")
    key = F.col("c_custkey")
    unknown = F.lit("zzqx yyqx wwqx nothing known")
    example = F.coalesce(F.col("_example"), unknown)
    script = F.array(
        F.lit("good morning to you"),
        F.when(F.pmod(key, F.lit(5)) == 0, unknown).otherwise(example),
        F.when(F.pmod(key, F.lit(3)) == 0, F.lit("what may I do now")).otherwise(F.lit("they hurt me please send the police")),
        F.when(F.pmod(key, F.lit(7)) == 0, F.lit("I would rather not tell")).otherwise(
            F.concat(F.lit("I live in "), F.coalesce("n_name", F.lit("nowhere")), F.lit(" at the moment"))),
        F.lit("ok thanks"), example)
    return parts.select(key.alias("conv_id"), F.posexplode(script).alias("turn", "text")).withColumn("turn", F.col("turn").cast("long"))


def existing_users(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    return (cust.where(F.col("c_mktsegment") == EXISTING_USER_SEGMENT)
            .select(F.col("c_custkey").alias("user_id"),
                    F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("mobile")))
