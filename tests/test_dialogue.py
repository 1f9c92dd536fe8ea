"""ST-FSM: golden conversations (FIXTURES.md), prefix-scan levels, batch = stream."""
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from civicflow.plans import dialogue, triage
from civicflow.streaming import dialogue_stream as ds

# (short, legal, severe, hit_law) per turn; scores/severity are given, no model.
FIRST = (False, False, False, None)
LEGAL = (False, True, False, "posh_act")
SEVERE = (False, False, True, None)
PLACE = (False, False, False, None)
EMO = (False, False, False, None)
NOT_SEVERE = (False, False, False, None)
YES = (True, False, True, None)

GOLDEN = {
    1: ([FIRST, LEGAL, SEVERE, PLACE], ["greet", "legal", "ask_location", "location"]),
    2: ([FIRST, LEGAL, YES, LEGAL, SEVERE, PLACE], ["greet", "legal", "greet", "legal", "ask_location", "location"]),
    3: ([FIRST, EMO], ["greet", "emotional"]),
    4: ([FIRST, LEGAL, NOT_SEVERE], ["greet", "legal", "actions"]),
    5: ([FIRST, LEGAL, SEVERE, (True, False, False, None)], ["greet", "legal", "ask_location", "greet"]),
    8: ([FIRST, EMO, EMO, LEGAL], ["greet", "emotional", "emotional", "legal"]),
    11: ([LEGAL, LEGAL, SEVERE, LEGAL], ["greet", "legal", "ask_location", "location"]),  # first never analysed
    12: ([FIRST, (False, None, False, None)], ["greet", "no_corpus"]),                    # T6
}


def _turns(spark, convs, lang="english"):
    rows = [(cid, t, *f, lang) for cid, (fs, _) in convs.items() for t, f in enumerate(fs)]
    return spark.createDataFrame(rows, "conv_id long, turn long, short boolean, legal boolean, severe boolean, "
                                       "hit_law string, lang string")


def _branches(df):
    got = {}
    for r in df.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append(r.branch)
    return got


def test_golden_branches(spark):
    out = dialogue.replay(_turns(spark, GOLDEN))
    assert _branches(out) == {c: b for c, (_, b) in GOLDEN.items()}


def test_law_key_survives_reset(spark):
    out = {(r.conv_id, r.turn): r for r in dialogue.replay(_turns(spark, GOLDEN)).collect()}
    assert out[(2, 2)].law_key == "posh_act"           # "Yes" resets the stage, not the law
    assert out[(1, 2)].law_key == "posh_act" and out[(1, 0)].law_key == "general"


@pytest.mark.parametrize("block,levels", [(2, None), (3, None), (2, 6)])
def test_prefix_scan_levels_agree(spark, block, levels):
    long_conv = {99: ([FIRST] + [(False, True, True, f"l{i}") for i in range(20)] + [YES, LEGAL], None)}
    convs = {**{c: (f, None) for c, (f, _) in GOLDEN.items()}, **long_conv}
    df = _turns(spark, convs)
    cols = ["conv_id", "turn", "stage_in", "branch", "stage_out", "law_key"]
    one = sorted(tuple(r) for r in dialogue.replay(df).select(*cols).collect())
    many = sorted(tuple(r) for r in dialogue.replay(df, block=block, levels=levels).select(*cols).collect())
    assert one == many


def test_session_language_fixed_by_first_turn(spark):
    turns = spark.createDataFrame([(7, 0, "मुझे मदद चाहिए"), (7, 1, "It happened again at work"),
                                   (8, 0, "Hello there"), (8, 1, "Mujhe dar lagta hai")],
                                  "conv_id long, turn long, text string")
    got = {r.conv_id: r.lang for r in triage.session_language(turns).collect()}
    assert got == {7: "hindi", 8: "english"}


ARROW_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("short", pa.bool_()),
                          ("legal", pa.bool_()), ("severe", pa.bool_()), ("hit_law", pa.string()),
                          ("lang", pa.string())])


def _write_batches(spark, batches, root):
    paths = []
    for i, rows in enumerate(batches):
        p = os.path.join(root, f"b{i:03d}")
        cols = list(zip(*rows)) if rows else [[] for _ in ARROW_SCHEMA]
        pq.write_table(pa.table([pa.array(list(c), type=f.type) for c, f in zip(cols, ARROW_SCHEMA)],
                                schema=ARROW_SCHEMA), p + ".parquet")
        paths.append(p)
    return paths


def _stream(spark, batches):
    root = tempfile.mkdtemp(prefix="civicflow-stream-src-")
    _write_batches(spark, batches, root)
    schema = "conv_id long, turn long, short boolean, legal boolean, severe boolean, hit_law string, lang string"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    name = f"replay_{os.path.basename(root).replace('-', '_')}"
    q = (ds.dialogue_stream(src).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ds.checkpoint_location(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name)


def test_batch_equals_stream(spark):
    rows = [(c, t, *f, "english") for c, (fs, _) in GOLDEN.items() for t, f in enumerate(fs)]
    # three micro-batches, each turn in one of them, turn order kept per conversation
    batches = [[r for r in rows if r[1] <= 1], [r for r in rows if 2 <= r[1] <= 3], [r for r in rows if r[1] >= 4]]
    out = _stream(spark, batches)
    assert out.where("late").count() == 0
    assert _branches(out) == {c: b for c, (_, b) in GOLDEN.items()}


def test_stream_reorders_in_batch_and_flags_late(spark):
    # FIXTURES #10: turn 3 arrives before turn 2 in one batch; turn 1 arrives late.
    b1 = [(10, 0, *FIRST, "english"), (10, 3, *SEVERE, "english"), (10, 2, *LEGAL, "english")]
    b2 = [(10, 1, *LEGAL, "english")]
    out = {r.turn: r for r in _stream(spark, [b1, b2]).collect()}
    assert [out[t].branch for t in (0, 2, 3)] == ["greet", "legal", "ask_location"]
    assert out[1].late and out[1].branch is None
