"""ST-FSM / ST-LOG end to end: raw turns in, rendered replies and a chat log out.

Two streaming queries share a folder:

* ``start_scoring``: every micro-batch of raw turns is scored against a version of a saved index by the
  blocked top-k (``foreachBatch``: a stream cannot be aggregated against a table otherwise); of a batch with few
  terms only their postings are read, one with many meets the version's packed blocks. The scored turns go to a folder named after the batch, written once.
* ``start_replies``: the scored turns run through the dialogue's keyed state, conversations expire after
  ``idle_minutes``, and each micro-batch of branches is joined with the directory, rendered, and committed to the
  tables of replies and of chats under its batch id.

Scoring before the state keeps the state small (five numbers a conversation), and lets both halves be scaled
and restarted apart. A replayed batch changes nothing: scored folders and table batches are skipped if they are
complete, and a turn that the state has seen is marked late and answered no second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicflow.functions.text import is_blank, language_tag, tokens
from civicflow.operators.common import row_count_at_most
from civicflow.operators.saved_index import SavedIndex
from civicflow.plans import triage
from civicflow.plans.render import render_replies
from civicflow.session import cut_lineage
from civicflow.sources.batch_table import BatchTable
from civicflow.sources.readers import _exists
from civicflow.sources.sinks import chat_log_rows
from civicflow.streaming.dialogue_stream import checkpoint_location, dialogue_stream

TURNS = "conv_id long, turn long, user_id long, text string, ts timestamp"
SCORED = TURNS + ", lang string, score double, hit_doc long, hit_law string, short boolean, legal boolean, severe boolean"
FEW_TERMS = 2_000  # of a batch's distinct terms: up to so many, postings are picked by term
KEEP = ("user_id", "text", "ts")
REPLIES = ("conv_id long, turn long, lang string, stage_in string, branch string, stage_out string, law_key string, "
           "score double, hit_doc long, place string, lawyer_id long, match_kind string, reply_block string, "
           "variant_key long, user_id long, text string, ts timestamp, reply string")
CHATS = "conv_id long, turn long, user_id long, message string, reply string, ts timestamp, dt date"


class TriageStream:
    """``laws``: (doc_id, law) of the indexed examples; ``path``: a shared folder; ``name`` tells checkpoints apart."""

    def __init__(self, spark: SparkSession, path: str, name: str, index: SavedIndex, laws: DataFrame, directory: DataFrame,
                 idle_minutes: float | None = None, delay: str = "10 minutes"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.index, self.laws, self.directory = index, laws, directory
        self.idle_minutes, self.delay = idle_minutes, delay
        self.replies = BatchTable(spark, f"{self.path}/replies", REPLIES)
        self.chats = BatchTable(spark, f"{self.path}/chats", CHATS)

    def scored(self, turns: DataFrame) -> DataFrame:
        """Raw turns with the columns of the dialogue's rules; blank ones are left out."""
        turns = turns.where(~is_blank("text"))
        version = self.index.version()
        terms = cut_lineage(turns.select(F.explode(tokens("text")).alias("term")).distinct())
        few = row_count_at_most(terms, FEW_TERMS)
        loaded = self.index.load(version, terms) if few else self.index.packed(version)
        near = triage.nearest_example(turns, self.laws, index=loaded, n_docs=max(version.n_docs, 1))
        return triage.gated(near.withColumn("lang", language_tag("text")))

    def score_batch(self, turns: DataFrame, batch_id: int) -> None:
        folder = f"{self.path}/scored/batch_id={batch_id}"
        if not _exists(self.spark, f"{folder}/_SUCCESS"):
            names = [f.split()[0] for f in SCORED.split(", ")]
            self.scored(cut_lineage(turns)).select(*names).write.mode("overwrite").parquet(folder)

    def answer_batch(self, turns: DataFrame, batch_id: int) -> None:
        if not self.replies.is_committed(str(batch_id)):
            fresh = cut_lineage(turns.where(~F.col("late")).drop("late"))
            done = triage.answered(self.spark, fresh.withColumn("law_in", F.col("law_key")), self.directory, keep=KEEP)
            self.replies.append(render_replies(done, self.directory), batch_id)
        if not self.chats.is_committed(str(batch_id)):
            known = self.replies.snapshot()
            mine = self.replies.read({str(batch_id): known[str(batch_id)]})
            self.chats.append(chat_log_rows(mine.withColumnRenamed("text", "message")), batch_id)

    def start_scoring(self, turns: DataFrame, **trigger) -> StreamingQuery:
        """``turns``: a stream of conv_id, turn, user_id, text, ts; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return (turns.writeStream.foreachBatch(self.score_batch).trigger(**(trigger or {"availableNow": True}))
                .option("checkpointLocation", checkpoint_location(self.spark, f"{self.name}-scoring")).start())

    def start_replies(self, **trigger) -> StreamingQuery:
        scored = self.spark.readStream.schema(SCORED).parquet(f"{self.path}/scored/batch_id=*")
        out = dialogue_stream(scored, ("score", "hit_doc", *KEEP), self.idle_minutes, self.delay)
        return (out.writeStream.foreachBatch(self.answer_batch).outputMode("append").trigger(**(trigger or {"availableNow": True}))
                .option("checkpointLocation", checkpoint_location(self.spark, f"{self.name}-replies")).start())

    def run(self, turns: DataFrame) -> None:
        """Both queries over what has arrived, one after the other."""
        for start in (lambda: self.start_scoring(turns), self.start_replies):
            query = start()
            query.awaitTermination()
            if query.exception():
                raise query.exception()
