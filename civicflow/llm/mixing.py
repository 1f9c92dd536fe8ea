"""Operator 11, mixing sources to target weights by capped water-filling.

Targets: every source has a weight, and the budget (all words) is shared in proportion to the weights. A source
whose share is above ``MAX_EPOCHS`` times its own words is clamped there, what it leaves is shared again among
the others by weight, and so on until no share is above its cap. A round is one aggregate over the table of
sources, and only its two sums reach the driver; amounts are exact integers until the final division.

Sampling: target over size gives whole repetitions of all of a source's documents and a fractional one. For the
latter, documents stand in a seeded order (hash of seed, id and text), and those within the first words of the
order up to the fraction go once more. At the cut, the next ``FILL`` documents of the order are taken as they fit,
and a last one if it comes nearer to the target than stopping short. Documents are always taken whole, so a source
misses its target by at most half of its smallest document at the cut (by half of its only document, say, if
it has one). The order is built by range partitions and prefix sums of per-partition totals (``frames.numbered``),
so a source with a third of all rows is spread over many tasks; the per-source arrays hold ``FILL`` sizes.

Defined results: a null or blank text has size 0, and takes no words however often it is repeated; a null source is a
source, the last one; null ids and repeated rows are rows like any other (rows equal in id, source and text are
interchangeable); a source without words has target 0; an empty table gives an empty result; other columns are
carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import numbered, stored, table

WEIGHTS = (1, 2, 3)  # of the sources by code point, repeating
MAX_EPOCHS = 3
SEED = 11
FILL = 256
SMALL_BYTES = 16 << 20  # a table of sources is broadcast up to this size
EXACT = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than 09-0D and 20; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_key(id_: Column, text: Column, seed: int = SEED) -> Column:
    """The hash that orders documents within a source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("-")),
                             F.coalesce(F.md5(text), F.lit("-"))))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): words of each source, weights by the order of names, null last."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull())
    turns = F.array(*[F.lit(int(w)) for w in weights])
    return stored(numbered(sums, ["absent", "source"]).select(
        "source", "source_size", F.get(turns, F.pmod("_row", F.lit(len(weights))).cast("int")).cast("long").alias("weight")))


def water_filling(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` with ``target``, and ``whole`` and ``rest``: whole repetitions and words of the fractional one."""
    cap, weight = (F.col("source_size") * max_epochs).cast(EXACT), F.col("weight").cast(EXACT)
    exact = lambda n: F.lit(str(n)).cast(EXACT)  # noqa: E731
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    free, shares, clamped = total["size"] or 0, total["weight"] or 0, F.lit(False)
    while shares:
        clamped = cap * exact(shares) < weight * exact(free)
        held = sources.where(clamped).agg(F.sum(cap).alias("cap"), F.sum("weight").alias("weight")).first()
        left = (total["size"] - int(held["cap"] or 0), total["weight"] - int(held["weight"] or 0))
        if left == (free, shares):
            break
        free, shares = left
    part = weight * exact(free)  # of ``shares``
    some = F.greatest(F.col("source_size"), F.lit(1)).cast(EXACT) * exact(max(shares, 1))
    return (sources.withColumn("_clamped", clamped)
            .withColumn("target", F.when(F.col("_clamped"), cap.cast("double"))
                        .otherwise(part.cast("double") / F.lit(float(max(shares, 1)))))
            .withColumn("whole", F.when(F.col("_clamped"), F.lit(max_epochs))
                        .otherwise(F.floor((part - part % some) / some)).cast("int"))
            .withColumn("rest", F.when(F.col("_clamped"), F.lit(0.0))
                        .otherwise(F.col("target") - F.col("whole") * F.col("source_size"))).drop("_clamped"))


def _held(df: DataFrame) -> DataFrame:
    """Broadcast a table with one row a source if its names and numbers take at most ``SMALL_BYTES``."""
    size = df.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 8 * FILL + 64).alias("b")).first()["b"]
    return F.broadcast(df) if (size or 0) <= SMALL_BYTES else df


def _fitting(left: Column, rows: Column) -> Column:
    """The places of ``rows`` (array of structs (place, size), in order) that fill ``left`` words."""
    start = F.struct(left.alias("left"), F.array().cast("array<long>").alias("picked"))
    fill = F.aggregate(rows, start, lambda acc, x: F.when(x["size"] <= acc["left"], F.struct(
        (acc["left"] - x["size"]).alias("left"), F.concat(acc["picked"], F.array(x["place"])).alias("picked"))).otherwise(acc))
    nearer = F.filter(rows, lambda x: (x["size"] < 2 * fill["left"]) & ~F.array_contains(fill["picked"], x["place"]))
    least = F.array_min(F.transform(nearer, lambda x: F.struct(x["size"].alias("size"), x["place"].alias("place"))))
    return F.concat(fill["picked"], F.when(least.isNull(), F.array().cast("array<long>")).otherwise(F.array(least["place"])))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and size, source_size, target, repeats, taken, in one struct ``mix``.

    ``repeats`` is how often the mix takes the document and ``taken`` the words this makes; what is kept is
    shuffled once with the order, so leave the text out where only amounts are needed.
    """
    keep = docs.columns if keep is None else keep
    rows = stored(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"),
                              seeded_key(F.col(id_col), F.col(text_col), seed).alias("key"),
                              F.struct(*[F.col(c) for c in keep]).alias("kept")))
    sources = stored(water_filling(weighted_sources(rows.select("source", "size"), weights), max_epochs))
    order = stored(numbered(rows, ["source", "key", "id", "size"], F.col("size")))
    starts = order.groupBy("source").agg(F.min("_before").alias("start"), F.min("_row").alias("first"))
    known = sources.join(starts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = stored(known)
    placed = _with_source(order, known).select(
        "source", "id", "size", "kept", (F.col("_before") - F.col("start")).alias("before"), (F.col("_row") - F.col("first")).alias("place"))
    within = F.col("before") + F.col("size") <= F.col("rest")
    cut = (_with_source(placed, known).where(within & (F.col("rest") > 0)).groupBy("source")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    cut = known.select(F.col("source"), "rest").join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    cut = stored(cut.select("source", "rest", F.coalesce("n", F.lit(0)).alias("n"),
                            (F.col("rest") - F.coalesce("words", F.lit(0))).alias("left")))
    after = (_with_source(placed.select("source", "place", "size"), cut)
             .where((F.col("place") >= F.col("n")) & (F.col("place") < F.col("n") + FILL) & (F.col("rest") > 0))
             .groupBy("source").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("place", "size"))).alias("rows")))
    picked = after.select(F.col("source").alias("_s"), _fitting(F.col("left"), F.col("rows")).alias("picked"))
    plan = stored(known.join(picked, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    once_more = (F.col("rest") > 0) & (within | F.coalesce(F.array_contains("picked", F.col("place")), F.lit(False)))
    repeats = F.col("whole") + F.when(once_more, 1).otherwise(0)
    return (_with_source(placed, plan).select("kept", F.struct(
        "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken")).alias("mix"))
        .select("kept.*", "mix"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    other = _held(sources).withColumnRenamed("source", "_s")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, in a seeded order within tasks' output."""
    return (mixed.where(F.col("mix.repeats") > 0)
            .withColumn("mix", F.explode(F.sequence(F.lit(1), F.col("mix.repeats")))).withColumnRenamed("mix", "repetition"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    mixed = mix(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), keep=["doc_id"])
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


MIXING_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
    [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::HUGEINT AS weight
  FROM d GROUP BY source),
total AS (SELECT sum(source_size)::HUGEINT AS free, sum(weight)::HUGEINT AS shares FROM s),
lv AS (
  SELECT 0 AS i, free, shares FROM total
  UNION ALL
  SELECT i + 1, (max(t.free) - coalesce(sum({MAX_EPOCHS} * source_size) FILTER ({MAX_EPOCHS} * source_size * lv.shares < weight * lv.free), 0))::HUGEINT,
    coalesce(sum(weight) FILTER ({MAX_EPOCHS} * source_size * lv.shares >= weight * lv.free), 0)::HUGEINT
  FROM lv, s, total t GROUP BY i, lv.free, lv.shares
  HAVING coalesce(sum(weight) FILTER ({MAX_EPOCHS} * source_size * lv.shares >= weight * lv.free), 0) <> lv.shares),
level AS (SELECT free, shares FROM lv ORDER BY i DESC LIMIT 1),
a AS (
  SELECT source, source_size, {MAX_EPOCHS} * source_size * shares < weight * free AS clamped,
    CASE WHEN {MAX_EPOCHS} * source_size * shares < weight * free THEN ({MAX_EPOCHS} * source_size)::DOUBLE
      ELSE (weight * free)::DOUBLE / shares::DOUBLE END AS target,
    CASE WHEN {MAX_EPOCHS} * source_size * shares < weight * free THEN {MAX_EPOCHS}
      ELSE (weight * free) // (greatest(source_size, 1) * shares) END AS whole FROM s, level),
b AS (SELECT *, CASE WHEN clamped THEN 0 ELSE target - whole::DOUBLE * source_size::DOUBLE END AS rest FROM a),
o AS (
  SELECT d.*, b.source_size, target, whole, rest, row_number() OVER w - 1 AS place,
    coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
  WINDOW w AS (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size)),
c AS (SELECT source, count(*) FILTER (before + size <= rest) AS n, max(rest) - coalesce(sum(size) FILTER (before + size <= rest), 0)::DOUBLE AS lft
  FROM o WHERE rest > 0 GROUP BY source),
f AS (SELECT c.source, n, lft, list({{'place': place, 'size': size}} ORDER BY place) AS rows FROM c JOIN o
  ON o.source IS NOT DISTINCT FROM c.source AND place >= n AND place < n + {FILL} GROUP BY 1, 2, 3),
g AS (
  SELECT source, 1 AS i, lft, []::BIGINT[] AS picked FROM f
  UNION ALL
  SELECT g.source, i + 1, CASE WHEN rows[i].size <= g.lft THEN g.lft - rows[i].size ELSE g.lft END,
    CASE WHEN rows[i].size <= g.lft THEN list_append(picked, rows[i].place) ELSE picked END
  FROM g JOIN f ON g.source IS NOT DISTINCT FROM f.source WHERE i <= len(rows)),
h AS (
  SELECT f.source, picked, (SELECT min({{'size': x.size, 'place': x.place}}) FROM (SELECT unnest(f.rows) AS x)
    WHERE x.size < 2 * g.lft AND NOT list_contains(picked, x.place)) AS more
  FROM f JOIN g ON g.source IS NOT DISTINCT FROM f.source AND g.i = len(f.rows) + 1)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, ((whole + CASE WHEN rest > 0 AND (before + size <= rest
    OR coalesce(list_contains(picked, place), FALSE) OR coalesce(more.place = place, FALSE)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o LEFT JOIN h ON h.source IS NOT DISTINCT FROM o.source
"""
