"""ST-FSM / ST-CNT / ST-LOG as Structured Streaming jobs.

* ``dialogue_stream``: scored turns (conv_id, turn, short, legal, severe,
  hit_law, lang) -> one output row per turn, keyed state per conversation
  with ``applyInPandasWithState``. Within a micro-batch a conversation's
  turns are sorted by ``turn``; a turn not above the last seen turn is
  emitted with ``late = true`` and does not change the state.
* ``progress_stream``: running per-user counters (update mode).
* ``chat_log_sink``: append-only Parquet chat log partitioned by day.

Checkpoints live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from civicflow.plans.dialogue import FOLLOWUP, INVESTIGATING, LOCATION, START, STAGE_NAMES
from civicflow.sources.sinks import chat_log_rows
from civicflow.session import ensure_checkpoint_dir
from civicflow.sources.batch_table import BatchTable

OUTPUT_SCHEMA = ("conv_id long, turn long, lang string, stage_in string, branch string, stage_out string, "
                 "law_key string, late boolean")
STATE_SCHEMA = "stage int, law string, lang string, last_turn long, last_ms long"


def make_advance(carry: tuple[str, ...] = (), idle_ms: int | None = None):
    """The state function as a self-contained closure (pandas only), so Python
    workers need not import this package.

    ``carry`` names input columns that are passed on with each turn. With ``idle_ms`` (event times in ``ts``) a
    turn that comes later than that after the conversation's last one starts it anew, and the state of a
    conversation that was idle so long is removed once the watermark has passed."""
    start_, inv, fol, loc, names = START, INVESTIGATING, FOLLOWUP, LOCATION, list(STAGE_NAMES)

    def step(stage, short, legal, severe, law):
        """Python mirror of the transition table (plans.dialogue) for one turn:
        (branch, next stage, law set or None)."""
        if stage == start_ or short:
            return "greet", inv, None
        if stage == inv:
            if legal is None:
                return "no_corpus", inv, None
            return ("legal", fol, law) if legal else ("emotional", inv, None)
        if stage == fol:
            return ("ask_location", loc, None) if severe else ("actions", inv, None)
        return "location", inv, None

    def advance(key, batches, state):
        (conv_id,) = key
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("turn", kind="stable")
        if state.exists:
            stage, law, lang, last, last_ms = state.get
        else:
            stage, law, lang, last, last_ms = start_, None, None, -1, None
        rows = []
        for r in pdf.itertuples(index=False):
            rest = tuple(getattr(r, c) for c in carry)
            if idle_ms is not None and r.turn > last:
                now = int(r.ts.timestamp() * 1000)
                if last_ms is not None and now - last_ms > idle_ms:
                    stage, law, lang = start_, None, None
                last_ms = max(now, last_ms or now)
            if lang is None:
                lang = r.lang  # W1: the first message fixes the language
            if r.turn <= last:
                rows.append((conv_id, r.turn, lang, None, None, None, None, True, *rest))
                continue
            legal = None if pd.isna(r.legal) else bool(r.legal)
            branch, nxt, law_set = step(stage, bool(r.short), legal, bool(r.severe), r.hit_law)
            law_shown = law_set if law_set is not None else (law if law is not None else "general")
            rows.append((conv_id, r.turn, lang, names[stage], branch, names[nxt], law_shown, False, *rest))
            stage, law, last = nxt, (law_set if law_set is not None else law), r.turn
        state.update((stage, law, lang, last, last_ms))
        if idle_ms is not None and last_ms is not None:
            state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "lang", "stage_in", "branch", "stage_out",
                                          "law_key", "late", *carry])
    return advance


def dialogue_stream(scored_turns: DataFrame, carry: tuple[str, ...] = (), idle_minutes: float | None = None,
                    delay: str = "10 minutes") -> DataFrame:
    """Streaming replay; ``scored_turns`` is a streaming DataFrame. Output: a row a turn, with the columns ``carry``.

    With ``idle_minutes`` conversations expire (see ``make_advance``): turns need an event time ``ts``, and
    those that come more than ``delay`` behind the newest are dropped."""
    types = {f.name: f.dataType.simpleString() for f in scored_turns.schema}
    output = ", ".join([OUTPUT_SCHEMA, *(f"`{c}` {types[c]}" for c in carry)])
    if idle_minutes is None:
        advance, timeout = make_advance(carry), GroupStateTimeout.NoTimeout
    else:
        scored_turns = scored_turns.withWatermark("ts", delay)
        advance, timeout = make_advance(carry, int(idle_minutes * 60_000)), GroupStateTimeout.EventTimeTimeout
    return scored_turns.groupBy("conv_id").applyInPandasWithState(advance, output, STATE_SCHEMA, "append", timeout)


def progress_stream(activity: DataFrame) -> DataFrame:
    """ST-CNT: running counters per user from an activity stream
    (user_id, kind in search/chat/quiz, points); emit with outputMode update."""
    return activity.groupBy("user_id").agg(
        F.sum(F.when(F.col("kind") == "search", 1).otherwise(0)).cast("long").alias("articles_viewed"),
        F.sum(F.when(F.col("kind") == "quiz", 1).otherwise(0)).cast("long").alias("topics_completed"),
        F.sum(F.when(F.col("kind") == "chat", 1).otherwise(0)).cast("long").alias("chatbot_usage_count"),
        F.sum(F.coalesce(F.col("points"), F.lit(0))).cast("long").alias("quiz_score"))


COUNTERS = ["articles_viewed", "topics_completed", "chatbot_usage_count", "quiz_score"]
COUNTER_TABLE = "user_id long, " + ", ".join(f"{c} long" for c in COUNTERS)


class ProgressTable:
    """ST-CNT/A5: running counters in a table, each micro-batch counted once.

    A micro-batch adds its own sums a user as a batch of the table (map-side combined, so a user with a third of all
    events is one row a task); a replayed batch is found committed and adds nothing. Counters are the sums over
    batches; ``compact`` merges the batches so far.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, COUNTER_TABLE)

    def merge_batch(self, activity: DataFrame, batch_id: int) -> None:
        self.table.append(progress_stream(activity), batch_id)

    def counters(self) -> DataFrame:
        return self.table.read().groupBy("user_id").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])

    def compact(self) -> None:
        known = self.table.snapshot()
        live = [b for b in known if not any(b in m["replaces"] for m in known.values())]
        if len(live) > 1:
            self.table.commit(self.table.stage(self.counters()), f"merged-{known[live[-1]]['order']}", replaces=live)

    def start(self, activity: DataFrame, name: str, **trigger) -> StreamingQuery:
        return (activity.writeStream.foreachBatch(self.merge_batch).outputMode("update")
                .trigger(**(trigger or {"availableNow": True}))
                .option("checkpointLocation", checkpoint_location(activity.sparkSession, name)).start())


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def chat_log_sink(chats: DataFrame, path: str, name: str = "chat_log", trigger_once: bool = False) -> StreamingQuery:
    """ST-LOG/K1: append answered, non-blank messages as Parquet by day."""
    out = chat_log_rows(chats)
    w = (out.writeStream.format("parquet").outputMode("append").partitionBy("dt")
         .option("path", path).option("checkpointLocation", checkpoint_location(chats.sparkSession, name)))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
