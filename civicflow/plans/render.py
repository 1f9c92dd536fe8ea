"""Render the reply text of triaged turns (structured columns first,
text last). The reply blocks and law texts are literals of fixed size, so they
are looked up as literal maps inside the projection: no join, no shuffle.
Only the adviser card needs the directory (an equi join on lawyer_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.codes import pick_variant
from civicflow.sources.literals import FALLBACK_LANG, LAW_TEXT, REPLY_BLOCKS

CLOSING_NOTE = "You can always ask for an adviser if things get worse."


def _literal_map(pairs: list[tuple[str, Column]]) -> Column:
    args: list[Column] = []
    for k, v in pairs:
        args += [F.lit(k), v]
    return F.create_map(*args)


def _blocks() -> Column:
    return _literal_map([(f"{lang}|{block}", F.array(*[F.lit(v) for v in variants]))
                         for lang, block, variants in REPLY_BLOCKS])


def _laws() -> Column:
    return _literal_map([(f"{k}|{lang}", F.lit(t)) for k, lang, t in LAW_TEXT])


def block_variants(lang: Column, block: str) -> Column:
    """Variants of a block in ``lang``, else the English block."""
    m = _blocks()
    return F.coalesce(F.try_element_at(m, F.concat(lang, F.lit(f"|{block}"))),
                      F.try_element_at(m, F.lit(f"{FALLBACK_LANG}|{block}")))


def law_text(law: Column, lang: Column) -> Column:
    """(law, lang) -> (law, english) -> (general, lang) -> (general, english)."""
    m = _laws()

    def probe(k: Column, lg: Column) -> Column:
        return F.try_element_at(m, F.concat(k, F.lit("|"), lg))
    return F.coalesce(probe(law, lang), probe(law, F.lit(FALLBACK_LANG)),
                      probe(F.lit("general"), lang), probe(F.lit("general"), F.lit(FALLBACK_LANG)))


def render_replies(triaged: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds ``reply`` (plain text) to the output of ``plans.triage.triage``."""
    lang = F.col("lang")

    def pick(block: str) -> Column:
        return pick_variant(block_variants(lang, block), F.col("conv_id"), F.col("turn"))

    def first(block: str) -> Column:
        return F.element_at(block_variants(lang, block), 1)

    card = F.concat_ws("\n", first("lawyer_title"),
                       F.concat(F.lit("Name: "), F.coalesce(F.col("_name"), F.lit(""))),
                       F.concat(F.lit("Contact: "), F.coalesce(F.col("_mobile"), F.lit(""))),
                       F.concat(F.lit("Location: "), F.coalesce(F.col("_location"), F.lit(""))),
                       F.concat(F.lit("Practice: "), F.coalesce(F.col("_practice"), F.lit("")), F.lit(" ("),
                                F.coalesce(F.col("_years").cast("string"), F.lit("")), F.lit(" yrs)")),
                       first("lawyer_footer"))
    law = law_text(F.col("law_key"), lang)
    b = F.col("branch")
    reply = (F.when(b == "greet", pick("greeting"))
             .when(b == "emotional", F.concat_ws("\n\n", pick("empathy_pure"), first("share_more")))
             .when(b == "legal", F.concat_ws("\n\n", pick("empathy_legal"), first("follow_up_question")))
             .when(b == "ask_location", F.concat_ws("\n\n", law, first("ask_location")))
             .when(b == "actions", F.concat_ws("\n\n", law, pick("actions"), F.lit(CLOSING_NOTE)))
             .when(b == "lawyer", card)
             .when(b == "no_lawyer", first("no_lawyer_found"))
             .otherwise(first("share_more")))
    d = directory.select(F.col("lawyer_id").alias("_lid"), F.col("name").alias("_name"),
                         F.col("mobile").alias("_mobile"), F.col("location").alias("_location"),
                         F.col("practice_area").alias("_practice"), F.col("experience_years").alias("_years"))
    return (triaged.join(d, F.col("lawyer_id") == F.col("_lid"), "left")
            .withColumn("reply", reply)
            .drop("_lid", "_name", "_mobile", "_location", "_practice", "_years"))
