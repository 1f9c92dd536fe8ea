"""Operator 8, MinHash near-dedup with odd sketches.

1. Every text's set of distinct five-word shingles (hashed to 64 bits) gives MinHash samples (bands times
   rows, by the threshold's ``scheme``), their band keys, and an odd sketch: the samples folded into
   ``SKETCH_BITS`` parity bits.
2. Texts with the same set (compared by a 128-bit digest) are one class from here on.
3. Each band bucket names leaders; members are compared with them by XOR population count, which
   estimates high similarities closely, and pairs that may reach the threshold are confirmed on the full
   shingle sets. These links are merged into components.
4. Buckets that still hold several components are compared across components in blocks, sketch against
   sketch inside the task; only pairs that may reach the threshold leave it, and are confirmed.
So no group is ever expanded into all pairs, pairs inside a component need no test, and every pair of
texts sharing a bucket is either in one component or was tested. A pair at the threshold is lost with
probability below 1e-6: that it shares no bucket, and that its estimate falls short by more than the margin,
are added up exactly by ``miss_probability`` (9.9e-7 at 0.85, 8.5e-7 at 0.8; less above). A second bitmap folds
the whole set: its XOR count is at most the number of differing shingles, so it rules pairs out surely.

A class is known by a number of its own, not by an id, and keeps one row (id and text hash) that gives its text.

Defined results: null texts and texts without words have an empty set, link with nothing and are kept;
fewer than five words form one shingle; rows with a null id take no part and come back as kept singles;
repeated rows are one class; an id with several texts stands in the class of each and links them, so all its
rows have one component; an empty table gives an empty result. Only id and text are read, so other columns'
names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.components import components
from civicflow.llm.frames import files_for, in_files, stored, table
from civicflow.llm.words import chunks, mix, odd_constants, run_hashes, text_buffer, word_hashes, word_spans

SHINGLE = 5
BANDS, ROWS = 36, 7
SKETCH_BITS = 512
SET_BITS = 1024        # parity bitmap of the whole set
MARGIN = 0.16          # a sample estimate this far below the threshold rules a pair out
SCHEMES = [(0.85, BANDS, ROWS, MARGIN), (0.8, 48, 6, 0.17)]  # least threshold, bands, rows, margin
GROUP = 256            # members confirmed, or sketches compared, in one task's group
THRESHOLD = (85, 100)  # op8's: linked if 100 * intersection >= 85 * union


def scheme(threshold: tuple[int, int]) -> tuple[int, int, float]:
    """(bands, rows, margin) for a threshold of 4/5 or more: pairs at it miss all bands with probability below 1e-6."""
    for least, bands, rows, margin in SCHEMES:
        if threshold[0] / threshold[1] >= least:
            return bands, rows, margin
    raise ValueError(f"no bands for a threshold below {SCHEMES[-1][0]}: {threshold}")


def shingle_sets(column, n: int = SHINGLE):
    """Sorted distinct shingle hashes of each row of an Arrow text column, a chunk of rows at a time."""
    data, offsets = text_buffer(column)
    for a, b in chunks(offsets):
        part, spans = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, ptr = word_spans(part, spans)
        hashes = word_hashes(part, starts, ends)
        runs = run_hashes(hashes, n)
        for lo, hi in zip(ptr[:-1], ptr[1:]):
            s = np.sort(runs[lo:hi - n + 1] if hi - lo >= n else run_hashes(hashes[lo:hi], int(hi - lo)))
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def min_hashes(s: np.ndarray, multipliers: np.ndarray, block: int = 256) -> np.ndarray:
    """The smallest value of each multiplicative permutation over the set's 32-bit values."""
    values = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), block):
        np.minimum(least, (values[at:at + block, None] * multipliers).min(axis=0), out=least)
    return least


def parity_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of hashed values as 64-bit words; equal values of two texts cancel under XOR."""
    place = (values & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The (position, sample) pairs of a MinHash signature folded into a parity bitmap."""
    return parity_bits(mix(samples.astype(np.uint64) ^ odd_constants(len(samples), 77)), bits)


def sketch_similarity(xor_count, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS):
    """Estimated similarity from the number of differing bits (1 - expected differing samples / samples)."""
    odd = np.minimum(np.asarray(xor_count) / bits, 0.4999)
    return 1 + bits * np.log1p(-2 * odd) / (4 * samples)


def miss_probability(threshold: tuple[int, int]) -> tuple[float, float]:
    """For a pair at the threshold: probabilities that it shares no bucket, and that its estimate is beyond the margin.

    Each of the samples differs with probability 1 - threshold, and a differing one flips two places of the sketch;
    the chain of the number of odd places gives the distribution of the XOR count.
    """
    bands, rows, _ = scheme(threshold)
    t, k = threshold[0] / threshold[1], bands * rows
    odd, places = np.zeros(SKETCH_BITS + 1), np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    odd[0], beyond = 1, 0.0
    for differing in range(k + 1):
        log_share = (math.lgamma(k + 1) - math.lgamma(differing + 1) - math.lgamma(k - differing + 1)
                     + differing * math.log(1 - t) + (k - differing) * math.log(t))
        beyond += math.exp(log_share) * odd[_most_differing(threshold) + 1:].sum()
        for _ in range(2):
            odd = np.append(0, odd[:-1] * (1 - places[:-1])) + np.append(odd[1:] * places[1:], 0)
    return (1 - t ** rows) ** bands, float(beyond)


def signatures(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(id, th, n_shingles, digest, bands, sketch of the samples, bitmap of the whole set); ``th`` is a text hash."""
    n_bands, n_rows, _ = scheme(threshold)
    multipliers = (odd_constants(n_bands * n_rows, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    row_weights = odd_constants(n_rows, 6)
    band_weights = odd_constants(n_bands, 7)

    def sign(batches):
        for batch in batches:
            n, digest, bands, sketch, full = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                if not len(s):
                    for column in (digest, bands, sketch, full):
                        column.append(None)
                    continue
                digest.append(mix(s).sum().tobytes() + np.bitwise_xor.reduce(mix(s * row_weights[0])).tobytes())
                least = min_hashes(s, multipliers)
                keys = mix((least.astype(np.uint64).reshape(n_bands, n_rows) * row_weights).sum(axis=1) ^ band_weights)
                bands.append(keys.view(np.int64))
                sketch.append(odd_sketch(least))
                full.append(parity_bits(s, SET_BITS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 *[pa.array(x, pa.list_(pa.int64())) for x in (bands, sketch, full)]],
                names=["id", "th", "n_shingles", "digest", "bands", "sketch", "full"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
            .mapInArrow(sign, "id long, th long, n_shingles long, digest binary, bands array<long>, "
                        "sketch array<long>, full array<long>"))


def _may_link(threshold: tuple[int, int]):
    """Column test of two classes (columns na, nb, sa, sb, fa, fb): can they be linked?

    Sure bounds: the sets' sizes, and the XOR count of the whole-set bitmaps, which never exceeds the
    number of differing shingles. Then the estimate from the folded samples, with its margin.
    """
    num, den = threshold
    count = lambda a, b, k: sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, k)),
                                F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return ((F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
            & (count("fa", "fb", SET_BITS // 64) * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
            & (count("sa", "sb", SKETCH_BITS // 64) <= _most_differing(threshold)))


def _most_differing(threshold: tuple[int, int]) -> int:
    """The largest XOR count of sample sketches whose estimate is within the margin."""
    bands, rows, margin = scheme(threshold)
    counts = np.arange(SKETCH_BITS + 1)
    return int(counts[sketch_similarity(counts, bands * rows) >= threshold[0] / threshold[1] - margin].max())


def confirm(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose full shingle sets reach the threshold.

    Members of one ``a`` are spread over groups of about ``GROUP``; each text is shuffled once to meet
    its roles and once a role to its group, so a leader's text is repeated a group, not a pair.
    """
    num, den = threshold
    per_a = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = (pairs.join(per_a, "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).cast("int")).select("a", "b", "salt"))
    roles = (salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("role"))
             .unionByName(salted.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("role")).distinct()))
    texts_of = texts.select(F.col("id").alias("text_id"), "text")
    rows = roles.join(texts_of, F.col("id") == F.col("text_id")).select("a", "salt", "role", "id", "text")

    def check(tbl: pa.Table) -> pa.Table:
        role = np.array(tbl.column("role"))
        ids = np.array(tbl.column("id"))
        lead, found = None, []
        sets = list(shingle_sets(tbl.column("text")))
        for i in np.flatnonzero(role == 0)[:1]:
            lead = sets[i]
        for i in np.flatnonzero(role == 1):
            both = len(np.intersect1d(lead, sets[i], assume_unique=True))
            if den * both >= num * (len(lead) + len(sets[i]) - both):
                found.append(ids[i])
        lead_id = np.array(tbl.column("a"))[0]
        return pa.table({"a": pa.array([lead_id] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("a", "salt").applyInArrow(check, "a long, b long")


def _block_pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of one bucket but different components whose sketches may reach the threshold.

    ``rows``: (key, id, comp, sketch, full, size, n) with ``n`` members a bucket. A bucket of more than ``GROUP``
    members is cut into blocks; every pair of blocks is one task's group.
    """
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = (rows.withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                      "own", "id", "comp", "size", "sketch", "full"))
    num, den = threshold
    most = _most_differing(threshold)

    def compare(tbl: pa.Table) -> pa.Table:
        ids, comp, own, size = (np.array(tbl.column(c)) for c in ("id", "comp", "own", "size"))
        sketch, full = (np.array(tbl.column(c).combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
                        for c in ("sketch", "full"))
        x, y = tbl.column("x")[0].as_py(), tbl.column("y")[0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        a_out, b_out = [], []
        for i in left:
            r = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) if x == y else True)]
            r = r[np.minimum(size[r], size[i]) * den >= np.maximum(size[r], size[i]) * num]
            r = r[np.bitwise_count(full[r] ^ full[i]).sum(axis=1) * (den + num) <= (size[r] + size[i]) * (den - num)]
            r = r[np.bitwise_count(sketch[r] ^ sketch[i]).sum(axis=1) <= most]
            a_out.append(np.minimum(ids[i], ids[r]))
            b_out.append(np.maximum(ids[i], ids[r]))
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(a_out), pa.int64()), "b": pa.array(cat(b_out), pa.int64())})

    return placed.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; a component's smallest id is kept."""
    seen = Observation()
    signed = stored(signatures(docs.select(id_col, text_col).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_col)).alias("size")), id_col, text_col, threshold))
    # no more files than the documents are worth: frames of links are small, and many partitions of them hold a few rows
    files = files_for(docs.sparkSession, seen.get["rows"], seen.get["size"])
    # a class: all rows with one set; its smallest id, and the text of one row with that id
    classes = (signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
               .groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("least"), F.min_by("th", "id").alias("t")))
    reps = stored(in_files(signed.join(classes, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("least")) & (F.col("th") == F.col("t")))
                           .dropDuplicates(["digest"]), files)
                  .select(F.monotonically_increasing_id().alias("rep"), "digest", "id", "th",
                          F.col("n_shingles").alias("size"), "bands", "sketch", "full"))
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead0"),
                                        F.max("rep").alias("lead1")).where(F.col("n") > 1))
    members = stored(keyed.join(buckets, "key"), files)  # buckets of at least two classes, with two leaders
    # texts of classes that share a bucket: the one shuffle of texts, by merge join at every size
    wanted = (reps.select("rep", "id", "th").join(members.select("rep").distinct(), "rep")
              .select("rep", F.col("id").alias("of_id"), F.col("th").alias("of_th")))
    texts = stored(docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
                   .join(wanted.hint("merge"), (F.col("doc") == F.col("of_id")) & (F.col("h") == F.col("of_th")))
                   .dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "text"), files)
    sketches = reps.select("rep", "size", "sketch", "full")
    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("size").alias(f"n{x}"),
                                     F.col("sketch").alias(f"s{x}"), F.col("full").alias(f"f{x}"))
    pairs = (members.select(F.explode(F.array("lead0", "lead1")).alias("l"), "rep").where(F.col("l") != F.col("rep"))
             .select(F.greatest("l", "rep").alias("b"), F.least("l", "rep").alias("a")).distinct())
    near = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(threshold)).select("a", "b"), files)
    links = stored(confirm(near, texts, threshold).unionByName(_shared_ids(signed, reps)), files)
    # buckets of two were settled by their leader; others are compared on while they hold several components
    comp = components(links, files=files).select(F.col("id").alias("c_rep"), "comp")
    with_comp = (members.where(F.col("n") > 2).join(comp, F.col("rep") == F.col("c_rep"), "left")
                 .select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
    mixed = (with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("key"))
    rows = (with_comp.join(mixed, "key").join(sketches, "rep")
            .select("key", F.col("rep").alias("id"), "comp", "sketch", "full", "size", "n"))
    rest = stored(_block_pairs(rows, threshold).join(near, ["a", "b"], "left_anti"), files)
    links = stored(links.unionByName(confirm(rest, texts, threshold)), files)
    comp = stored(components(links, files=files).select(F.col("id").alias("c_rep"), "comp"), files)
    least = (comp.join(reps.select("rep", "id"), F.col("c_rep") == F.col("rep")).groupBy(F.col("comp").alias("c"))
             .agg(F.min("id").alias("component")))
    linked = comp.join(least, F.col("comp") == F.col("c")).select("c_rep", "component")
    by_class = (reps.select("rep", "digest", "id").join(linked, F.col("rep") == F.col("c_rep"), "left")
                .select(F.col("digest").alias("d"), F.coalesce("component", "id").alias("component")))
    return (signed.select("id", "n_shingles", "digest")
            .join(by_class, F.col("digest") == F.col("d"), "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def _shared_ids(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links between the classes that rows of one id stand in."""
    rows = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).select("id", "digest")
    several = (rows.groupBy(F.col("id").alias("i")).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
               .where(F.col("lo") != F.col("hi")).select("i", "lo"))
    number = lambda d, rep: reps.select(F.col("digest").alias(d), F.col("rep").alias(rep))
    return (rows.join(several, F.col("id") == F.col("i")).where(F.col("digest") != F.col("lo")).select("digest", "lo").distinct()
            .join(number("digest", "x"), "digest").join(number("lo", "y"), "lo")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]), threshold=THRESHOLD)


NEAR_DUPS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
