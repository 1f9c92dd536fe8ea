"""Near copies through the pipeline's stages, rows that share ids, and long texts."""

import pathlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from civicflow.llm import decontaminate, frames, line_windows, near_dups, topk, words

WORDS = [f"w{i}x" for i in range(3000)]
DOCS = "doc_id long, text string"


def prose(rng, n, line=40):
    words = rng.choices(WORDS, k=n)
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, n, line))


def test_line_dedup_leaves_near_copies_to_near_dedup(spark):
    rng = random.Random(1)
    docs, originals = [], {}
    shared = " ".join(rng.choices(WORDS, k=70))          # a passage in every original
    for i in range(12):
        originals[i] = prose(rng, 300) + "\n" + shared + "\n" + prose(rng, 100)
        docs.append((i, originals[i]))
    for i in range(12):                                   # copies with a word changed in about 80, not in the passage
        words = re.split(r"(\s)", originals[i])
        for at in range(40 + i, len(words), 160):
            if not 600 <= at - at % 2 < 742:
                words[at - at % 2] = "edited"
        docs.append((100 + i, "".join(words)))
    docs += [(200, originals[0]), (201, None), (202, "")]
    table = spark.createDataFrame(docs, DOCS)
    cut = corpus_pipeline.line_dedup(spark, table, "").cache()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] == originals[0] and all(shared not in texts[i] for i in range(1, 12))
    assert all(len(texts[i]) == len(originals[i]) - len(shared) - 1 for i in range(1, 12))  # nothing else is cut
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cut, "").collect()}
    assert kept == {*range(12), 201, 202}
    alone = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()}
    assert alone == kept


def test_hot_windows_are_found_on_every_path(spark, monkeypatch):
    """The broadcast of windows with many occurrences and the join of all others give the same lines."""
    rng = random.Random(2)
    pool = [f"line {i} of the text" for i in range(8)]
    docs = [(i if i % 9 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(150)]
    groups = [(i, i // 75) for i in range(150) if i % 9]
    table, named = spark.createDataFrame(docs, DOCS), spark.createDataFrame(groups, "id long, g long")
    out = lambda g: sorted(map(str, line_windows.remove_repeated_lines(table, groups=g).collect()))
    plain, grouped = out(None), out(named)
    monkeypatch.setattr(line_windows, "HOT_LEAST", 1)
    monkeypatch.setattr(line_windows, "HOT", 50)
    assert out(None) == plain and out(named) == grouped != plain


def test_repeated_text_of_many_lines(spark):
    long = "\n".join(f"{i} lines of one text" for i in range(100_000))
    covered = pa.array([list(range(99_998)), None, [1]], pa.list_(pa.int32()))
    started = time.time()
    out = line_windows.without_covered(pa.array([long + "\nlast", "a\nb", "p\nq\nr\ns"]), covered, False).to_pylist()
    assert time.time() - started < 5
    assert out == [{"text": "last", "removed": 100_000}, {"text": "a\nb", "removed": 0}, {"text": "p", "removed": 3}]


def test_block_hashes_depend_on_the_span_alone():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab cd") for _ in range(n)) for n in (1, 511, 512, 513, 1024, 1500, 70_000)]

    def hashes(some):
        data, offsets = words.text_buffer(pa.array(some))
        return words.block_hashes(data, offsets[:-1], offsets[1:], np.uint64(12345)).tolist()
    alone = [hashes([t])[0] for t in texts]
    assert hashes(texts) == alone and len(set(alone)) == len(texts)
    long = texts[-1]
    assert len({*hashes([long, long[512:] + long[:512], long[:-1] + "x", "x" + long[1:]])}) == 4


def test_probability_of_lost_pairs_is_as_stated():
    for threshold, stated in (((85, 100), 9.91e-7), ((4, 5), 8.6e-7)):
        assert 0.9 * stated < sum(near_dups.miss_probability(threshold)) < 1e-6
    rng = np.random.default_rng(3)                        # the sketch's part against simulated differing samples
    bands, rows, margin = near_dups.scheme((85, 100))
    k, over, n = bands * rows, 0, 40_000
    most = near_dups._most_differing((85, 100)) - 15      # a nearer cut, so that it is met often enough
    for m in rng.binomial(k, 0.15, n):
        over += (np.bincount(rng.integers(0, near_dups.SKETCH_BITS, 2 * m), minlength=near_dups.SKETCH_BITS) & 1).sum() > most
    old = near_dups._most_differing
    near_dups._most_differing = lambda threshold: most
    want = near_dups.miss_probability((85, 100))[1]
    near_dups._most_differing = old
    assert abs(over / n - want) < 5 * (want / n) ** 0.5 + 1e-4


def test_ids_with_several_texts_link_their_classes(spark):
    rng = random.Random(4)
    a, b, c = (rng.choices(WORDS, k=60) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, near(c)), (5, near(c)),
            (6, " ".join(c).upper()), (None, " ".join(a)), (7, "alone here")]
    got = near_dups.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    comps = {(r["doc_id"], r["component_id"]) for r in got}
    assert comps == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (None, None)} and len(got) == len(docs)


def test_top_k_with_repeated_ids(spark):
    rows = [(1, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (50, [1.0, 0.0]), (50, [-1.0, 0.0]), (3, [0.7, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("id") % 50 == 0, k=3).collect()
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    want = []
    for q, (qi, qe) in enumerate(v):
        if qi % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(qe, e)), i) for n, (i, e) in enumerate(v) if n != q)[:3]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    rng = np.random.default_rng(5)                        # a few huge rows among ordinary ones
    q, c = rng.integers(-300, 300, (40, 6)).astype(float), rng.integers(-300, 300, (90, 6)).astype(float)
    c[7] *= 2.0**45
    q[3] *= 2.0**50
    out = topk.best_of_tile(np.arange(1000, 1040), q, np.arange(90), c, 4)
    for i in range(40):
        exact = sorted((-max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(q[i], c[j])))), j) for j in range(90))[:4]
        mine = out[out["query_id"] == 1000 + i]
        assert list(zip((-s for s in mine["score"].tolist()), mine["vec_id"])) == exact


def test_long_items_and_documents_are_tiled_in_proportion(spark):
    rng = random.Random(6)
    item = rng.choices(WORDS, k=20_000)
    parts = [item[i:i + 500] for i in range(0, 20_000, 500)]
    rng.shuffle(parts)
    doc = sum((p + ["between"] * 3 for p in parts), [])
    started = time.time()
    hashed = lambda w: next(iter(decontaminate.texts_as_words(pa.array([" ".join(w)]))))
    got = decontaminate.tiles(hashed(item), hashed(doc))
    assert sum(n for *_, n in got) == 20_000 and len(got) <= 45 and time.time() - started < 20
    same = decontaminate.tiles(hashed(["a"] * 3000), hashed(["a"] * 5000))
    assert [n for *_, n in same] == [3000]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:100]))], "item_id long, text string")
    table = spark.createDataFrame([(9, " ".join(doc)), (None, " ".join(item[:100])), (None, "clean text of no item at all"),
                                   (8, "clean"), (8, " ".join(item[:100]))], DOCS)
    found = decontaminate.contamination(table, bench)
    assert {(r["id"], r["item_id"], r["n_items"]) for r in found.collect()} == {(9, 1, 2), (None, 2, 1), (8, 2, 1)}
    seeds = decontaminate._seeds(decontaminate._items(bench, "item_id", "text"))
    assert seeds.schema.names == ["item", "seed", "size"] and seeds.count() < 20_200  # no words travel with seeds


def test_pipeline_tells_rows_without_an_id_apart(spark, tmp_path):
    rng = random.Random(7)
    item = " ".join(rng.choices(WORDS, k=50))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item + " and more"), (None, "clean words only here"), (None, None), (4, item), (4, "clean of it"), (5, "")]
    kept = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)), str(tmp_path))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted(
        (str(i), str(t)) for i, t in rows if t is None or item not in t) and kept.columns == ["doc_id", "text", "key"]


def test_many_partitions_of_few_rows_are_written_in_few_files(spark, tmp_path):
    """Each file a task writes costs the executor a few processes on a local store, so 150 partitions must not give 150."""
    rng = random.Random(7)
    docs = []
    for i in range(400):
        text = prose(rng, 60)
        docs += [(2 * i, text), (2 * i + 1, text + " edited")]
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    held = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    table = spark.createDataFrame(docs, DOCS).repartition(8)
    expected = {tuple(r) for r in near_dups.near_duplicates(table).collect()}
    lines = {tuple(r) for r in corpus_pipeline.line_dedup(spark, table, "").collect()}
    spark.createDataFrame([(i, docs[20 * i][1]) for i in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = {tuple(r) for r in corpus_pipeline.decontaminated(spark, table, str(tmp_path)).collect()}
    assert 0 < len(clean) < len(docs)
    before = {k: spark.conf.get(k) for k in held}
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    old = set(folder.glob("stored-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in near_dups.near_duplicates(table).collect()} == expected
        cut = corpus_pipeline.line_dedup(spark, table, "")
        cut.write.parquet(str(tmp_path / "out"))
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == lines
        assert {tuple(r) for r in corpus_pipeline.decontaminated(spark, table, str(tmp_path)).collect()} == clean
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written = [len(list(x.glob("part-*"))) for x in (*set(folder.glob("stored-*")) - old, tmp_path / "out")]
    assert len(written) > 20 and max(written) <= max(8, spark.sparkContext.defaultParallelism)  # 8: the input's partitions


def test_files_follow_rows_and_bytes(spark):
    least = spark.sparkContext.defaultParallelism
    assert frames.files_for(spark, 0) == least and frames.files_for(spark, 10, None) == least
    assert frames.files_for(spark, 8_000_000) == 1000 and frames.files_for(spark, 10, 1 << 30) == 256
    df = spark.range(100).repartition(40)
    assert frames.in_files(df, least) is df  # as many as the shuffle partitions or more: the plan stays
