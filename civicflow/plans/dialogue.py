"""ST-FSM: replay of the per-conversation dialogue state machine, in batch.

Transition rules (first match wins; the language is fixed elsewhere, W1):

====  ===============  ====================  ==============  ============
 #    stage in         condition             branch          stage out
====  ===============  ====================  ==============  ============
 1    any              start, or <= 2 words  greet           investigating
 2    investigating    top-1 score <= gate   emotional       investigating
 3    investigating    top-1 score >  gate   legal           followup (law_key := hit's law)
 4    followup         severe                ask_location    location
 5    followup         not severe            actions         investigating
 6-8  location         (adviser lookup)      location        investigating
====  ===============  ====================  ==============  ============

A turn is a function from the 4 stages to (stage, law set or null). Function
composition is associative, so the replay is a parallel prefix scan instead
of a sequential loop over one conversation:

* up-sweep: turns are grouped by (conv, turn div B); each group of at most B
  turns is composed into one summary; summaries are grouped again by
  (conv, pos div B) and so on, until one summary per conversation remains;
* down-sweep: each group is replayed from its parent's start state, giving
  every child its own start state, down to the turns.

Every group holds at most ``block`` items, so a conversation holding a third
of all turns is spread over many tasks. With turns numbered below ``block``
(the usual case) there is a single level: one shuffle by (conv, 0) and a
Catalyst ``aggregate`` fold per conversation, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVESTIGATING, FOLLOWUP, LOCATION, START = 0, 1, 2, 3
STAGE_NAMES = ["investigating", "followup", "location", "start"]
DEFAULT_BLOCK = 256

BRANCH_GREET = "greet"
BRANCH_EMOTIONAL = "emotional"
BRANCH_LEGAL = "legal"
BRANCH_NO_CORPUS = "no_corpus"
BRANCH_ASK_LOCATION = "ask_location"
BRANCH_ACTIONS = "actions"
BRANCH_LOCATION = "location"



def _step(s: Column, short: Column, legal: Column, severe: Column, law: Column) -> Column:
    """(next stage, law set by this turn) for input stage ``s``."""
    null_law = F.lit(None).cast("string")
    reset = (s == START) | F.coalesce(short, F.lit(False))
    st = (F.when(reset, F.lit(INVESTIGATING))
          .when(s == INVESTIGATING, F.when(F.coalesce(legal, F.lit(False)), F.lit(FOLLOWUP))
                .otherwise(F.lit(INVESTIGATING)))
          .when(s == FOLLOWUP, F.when(F.coalesce(severe, F.lit(False)), F.lit(LOCATION))
                .otherwise(F.lit(INVESTIGATING)))
          .otherwise(F.lit(INVESTIGATING)))
    law_set = F.when(~reset & (s == INVESTIGATING) & F.coalesce(legal, F.lit(False)), law).otherwise(null_law)
    return F.struct(st.cast("int").alias("st"), law_set.alias("law"))


def turn_summary(short: Column, legal: Column, severe: Column, law: Column) -> Column:
    """The turn as a 4-entry transition table (index = input stage)."""
    return F.transform(F.array(*[F.lit(i) for i in range(4)]),
                       lambda s: _step(s, short, legal, severe, law))


def _compose(children: Column) -> Column:
    """Compose child summaries in order (first applied first)."""
    identity = F.transform(F.array(*[F.lit(i) for i in range(4)]),
                           lambda s: F.struct(s.cast("int").alias("st"), F.lit(None).cast("string").alias("law")))

    def step(acc, ch):
        return F.transform(acc, lambda a: F.struct(
            F.element_at(ch["summ"], a["st"] + 1)["st"].alias("st"),
            F.coalesce(F.element_at(ch["summ"], a["st"] + 1)["law"], a["law"]).alias("law")))
    return F.aggregate(children, identity, step)


def _replay(children: Column, start_st: Column, start_law: Column) -> Column:
    """Start (stage, law) of every child, given the group's start."""
    def out_of(ch, st, law):
        return F.struct(ch["pos"].alias("pos"), st.cast("int").alias("st"), law.cast("string").alias("law"),
                        ch["payload"].alias("payload"))
    # an empty array of the output element type, typed from the first child
    empty = F.filter(F.array(out_of(F.element_at(children, 1), start_st, start_law)), lambda x: F.lit(False))
    init = F.struct(start_st.cast("int").alias("st"), start_law.cast("string").alias("law"), empty.alias("outs"))

    def step(acc, ch):
        nxt = F.element_at(ch["summ"], acc["st"] + 1)
        return F.struct(nxt["st"].alias("st"), F.coalesce(nxt["law"], acc["law"]).alias("law"),
                        F.concat(acc["outs"], F.array(out_of(ch, acc["st"], acc["law"]))).alias("outs"))
    return F.aggregate(children, init, step, lambda acc: acc["outs"])


def levels_needed(max_pos: int, block: int) -> int:
    levels, span = 1, block
    while max_pos >= span:
        levels += 1
        span *= block
    return levels


def replay_stages(turns: DataFrame, payload_cols: list[str], block: int = DEFAULT_BLOCK,
                  levels: int | None = None) -> DataFrame:
    """Start stage/law of every turn.

    ``turns`` needs conv_id, turn (>= 0, unique per conversation), short,
    legal (null = no corpus), severe, hit_law. Output: conv_id, turn,
    stage_in (int), law_in, and the ``payload_cols`` carried through.
    """
    if levels is None:
        max_turn = turns.agg(F.max("turn")).first()[0]
        levels = levels_needed(int(max_turn or 0), block)
    payload = F.struct(*[F.col(c) for c in payload_cols]) if payload_cols else F.lit(None)
    items = turns.select(
        "conv_id", F.col("turn").cast("long").alias("pos"),
        turn_summary(F.col("short"), F.col("legal"), F.col("severe"), F.col("hit_law")).alias("summ"),
        payload.alias("payload"))
    grouped: list[DataFrame] = []
    for lvl in range(1, levels + 1):
        child = F.struct(F.col("pos"), F.col("summ"), F.col("payload"))
        g = (items.groupBy("conv_id", F.floor(F.col("pos") / F.lit(block)).cast("long").alias("parent"))
             .agg(F.array_sort(F.collect_list(child)).alias("children")))
        grouped.append(g)
        if lvl < levels:
            items = g.select("conv_id", F.col("parent").alias("pos"), _compose(F.col("children")).alias("summ"),
                             F.lit(None).alias("payload"))
    # Top level: one group per conversation, starting from START.
    starts = grouped[-1].select("conv_id", "parent", "children", F.lit(START).alias("st"),
                                F.lit(None).cast("string").alias("law"))
    for lvl in range(levels, 0, -1):
        kids = (starts.select("conv_id", F.explode(_replay(F.col("children"), F.col("st"), F.col("law")))
                              .alias("o"))
                .select("conv_id", F.col("o.pos").alias("pos"), F.col("o.st").alias("st"),
                        F.col("o.law").alias("law"), F.col("o.payload").alias("payload")))
        if lvl == 1:
            out = kids.select("conv_id", F.col("pos").alias("turn"), F.col("st").alias("stage_in"),
                              F.col("law").alias("law_in"),
                              *[F.col("payload")[c].alias(c) for c in payload_cols])
            return out
        below = grouped[lvl - 2]
        starts = below.join(kids.select("conv_id", F.col("pos").alias("parent"), "st", "law"),
                            ["conv_id", "parent"])
    raise AssertionError("unreachable")


def branch_of(stage_in: Column, short: Column, legal: Column, severe: Column) -> Column:
    return (F.when((stage_in == START) | F.coalesce(short, F.lit(False)), F.lit(BRANCH_GREET))
            .when(stage_in == INVESTIGATING,
                  F.when(legal.isNull(), F.lit(BRANCH_NO_CORPUS))
                  .when(legal, F.lit(BRANCH_LEGAL)).otherwise(F.lit(BRANCH_EMOTIONAL)))
            .when(stage_in == FOLLOWUP,
                  F.when(F.coalesce(severe, F.lit(False)), F.lit(BRANCH_ASK_LOCATION))
                  .otherwise(F.lit(BRANCH_ACTIONS)))
            .otherwise(F.lit(BRANCH_LOCATION)))


def stage_name(stage: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in STAGE_NAMES]), stage + 1)


def replay(turns: DataFrame, payload_cols: list[str] | None = None, block: int = DEFAULT_BLOCK,
           levels: int | None = None) -> DataFrame:
    """Replay with readable columns: stage_in/stage_out names, branch, law_key.

    ``law_key`` is the law in force when the turn is answered (the state's
    law, defaulting to "general"), shown on follow-up and location turns.
    """
    payload_cols = list(dict.fromkeys(["short", "legal", "severe", "hit_law"] + (payload_cols or [])))
    r = replay_stages(turns, payload_cols, block, levels)
    nxt = _step(F.col("stage_in"), F.col("short"), F.col("legal"), F.col("severe"), F.col("hit_law"))
    return (r.withColumn("branch", branch_of(F.col("stage_in"), F.col("short"), F.col("legal"), F.col("severe")))
            .withColumn("_next", nxt)
            .withColumn("stage_out", stage_name(F.col("_next")["st"]))
            .withColumn("law_key", F.coalesce(F.col("_next")["law"], F.col("law_in"), F.lit("general")))
            .withColumn("stage_in", stage_name(F.col("stage_in")))
            .drop("_next"))
