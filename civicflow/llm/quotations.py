"""Operator 6, quotation linking: quoted passages are traced to the messages they come from.

A line's quote level is the number of leading ``>`` marks. A passage is a run of lines of one level; a
message's own text is what stands at level 0. Own texts, their paragraphs and lines, and quoted passages
and their lines are normalised (A-Z as a-z, blanks collapsed) and hashed to 128 bits. A passage is linked to
the first message of the same conversation, before the quoting one, whose own text has it (as a whole
first, else by its first line found); failing that, to the first message of any other conversation. A
message answers the message of its outermost, longest linked passage of the same conversation; threads are
ordered by their first message, then by reply depth and turn, and texts come back without quotes.

Hashes are pre-aggregated to their first message before joining, so a phrase that many messages share
is one row. Numbering cuts a conversation larger than a partition into several (``frames.numbered``).

Defined results: a null text has no passages and stays null; blank passages are counted and not linked; rows with a
null conversation or turn link with nothing and are their own thread; a message that holds only quotes
has the empty text; repeated rows stay separate rows of one message; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import numbered, stored, table

QUOTE = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?(.*)$", re.S)


def parse_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """(own text, [(level, lines) of each passage in order])."""
    own, passages, before = [], [], 0
    for line in text.split("\n"):
        m = QUOTE.match(line)
        level = m.group(1).count(">") if m else 0
        if not level:
            own.append(line)
        elif level == before:
            passages[-1][1].append(m.group(2))
        else:
            passages.append((level, [m.group(2)]))
        before = level
    return ("\n".join(own).strip("\r\n") if passages else text), passages


def passage_hash(text: str) -> bytes | None:
    """128-bit hash of the normalised text, None if it is blank."""
    words = text.encode("utf-8", "replace").lower().split()
    return hashlib.md5(b" ".join(words)).digest() if words else None


def _own_units(own: str) -> set[bytes]:
    parts = {own, *re.split(r"\n[ \t\r]*\n", own), *own.split("\n")}
    return {h for h in map(passage_hash, parts) if h}


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages with clean text, own units and quoted units (passage, level, part, hash, words)."""
    def run(frames):
        for df in frames:
            clean, units, quotes, number = [], [], [], []
            for t in df["text"]:
                own, passages = parse_quotes(t) if isinstance(t, str) else (None, [])
                clean.append(own)
                units.append(sorted(_own_units(own)) if own else [])
                found = []
                for nth, (level, lines) in enumerate(passages):
                    n = sum(len(x.split()) for x in lines)
                    parts = ["\n".join(lines), *(lines if len(lines) > 1 else ())]
                    found += [(nth, level, k, h, n) for k, h in enumerate(map(passage_hash, parts)) if h]
                quotes.append(found)
                number.append(len(passages))
            yield pd.DataFrame({"conv_id": df["conv_id"], "turn": df["turn"], "role": df["role"], "clean": clean,
                                "n_passages": number, "units": units, "quotes": quotes})

    return (messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                            F.col(role).alias("role"), F.col(text).alias("text"))
            .mapInPandas(run, "conv_id long, turn long, role string, clean string, n_passages int, units array<binary>, "
                              "quotes array<struct<nth int, level int, part int, hash binary, words int>>"))


def link_passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, level, words, source_conv, source_turn) of every passage that is found."""
    units = (rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
             .select("conv_id", "turn", F.explode("units").alias("hash")))
    near = units.groupBy("conv_id", "hash").agg(F.min("turn").alias("first")).select(
        F.col("conv_id").alias("n_conv"), F.col("hash").alias("n_hash"), "first")
    # the two first conversations of a hash suffice to find one that is not the quoting one's
    least = near.groupBy("n_hash").agg(F.min(F.struct("n_conv", "first")).alias("far"))
    second = (near.join(least.select(F.col("n_hash").alias("l_hash"), F.col("far.n_conv").alias("l_conv")),
                        (F.col("n_hash") == F.col("l_hash")) & (F.col("n_conv") != F.col("l_conv")))
              .groupBy(F.col("n_hash").alias("s_hash")).agg(F.min(F.struct("n_conv", "first")).alias("next")))
    quoted = (rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
              .select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct())
    found = (quoted.join(near, (F.col("conv_id") == F.col("n_conv")) & (F.col("hash") == F.col("n_hash"))
                         & (F.col("first") < F.col("turn")), "left")
             .drop("n_conv", "n_hash")
             .join(least.withColumnRenamed("n_hash", "f_hash"), F.col("hash") == F.col("f_hash"), "left")
             .join(second, F.col("hash") == F.col("s_hash"), "left")
             .withColumn("far", F.when(F.col("far.n_conv") != F.col("conv_id"), F.col("far")).otherwise(F.col("next"))))
    source = F.struct(F.coalesce("first", "far.first").alias("t"),
                      F.when(F.col("first").isNotNull(), F.col("conv_id")).otherwise(F.col("far.n_conv")).alias("c"))
    return (found.where(F.col("first").isNotNull() | F.col("far").isNotNull())
            .groupBy("conv_id", "turn", "nth", "level", "words")
            .agg(F.min(F.struct(F.col("first").isNull().alias("away"), "part", source.alias("s"))).alias("b"))
            .select("conv_id", "turn", "nth", "level", "words", F.col("b.s.c").alias("source_conv"),
                    F.col("b.s.t").alias("source_turn")))


def _threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) by pointer doubling; parents always come earlier."""
    now = stored(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"),
                                F.lit(1).alias("depth")))
    while True:
        up = now.select(F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"),
                        F.col("root_turn").alias("u_root"), F.col("depth").alias("u_depth"))
        after = now.join(up, (F.col("conv_id") == F.col("u_conv")) & (F.col("root_turn") == F.col("u_turn")), "left")
        if after.where(F.col("u_turn").isNotNull()).limit(1).count() == 0:
            return now
        now = stored(after.select("conv_id", "turn", "parent_turn", F.coalesce("u_root", "root_turn").alias("root_turn"),
                                  (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth")))


def reply_ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Every message: conv_id, turn, role, position, parent_turn, root_turn, depth, n_passages, n_linked,
    source_conv and source_turn of its first link, and ``clean``, the text without quotes."""
    rows = stored(parsed(messages, conv, turn, role, text))
    links = stored(link_passages(rows))
    per_message = links.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_linked"),
        F.min(F.struct("level", "nth", "source_conv", "source_turn")).alias("source"),
        F.min(F.when(F.col("source_conv") == F.col("conv_id"), F.struct(
            F.col("level"), (-F.col("words")).alias("short"), F.col("nth"), F.col("source_turn").alias("parent"))))
        .alias("best"))
    parents = (per_message.where(F.col("best").isNotNull())
               .select("conv_id", "turn", F.col("best.parent").alias("parent_turn")))
    threads = _threads(parents).select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), "parent_turn",
                                       "root_turn", "depth")
    linked = per_message.select(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn"), "n_linked", "source")
    out = (rows.drop("units", "quotes")
           .join(linked, (F.col("conv_id") == F.col("m_conv")) & (F.col("turn") == F.col("m_turn")), "left")
           .join(threads, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left")
           .select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
                   F.coalesce("depth", F.lit(0)).alias("depth"), "n_passages",
                   F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"),
                   F.col("source.source_conv").alias("source_conv"), F.col("source.source_turn").alias("source_turn"),
                   "clean", F.md5("clean").alias("_clean")))
    ordered = numbered(out, ["conv_id", "root_turn", "depth", "turn", "role", "_clean"], group=["conv_id"])
    return ordered.withColumnRenamed("_row", "position").drop("_clean")


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reply_ordered(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return out.withColumn("clean_md5", F.md5("clean")).drop("clean")
