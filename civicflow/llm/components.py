"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one aggregation of neighbour minima and one equi-join back, so a hub with a third of all
links is pre-aggregated and its join side can be split. Each step's links are written to the shared
checkpoint folder, with their count and a checksum that show when nothing moves any more. The number of
steps grows with the logarithm of the links; nothing is collected but these three numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from civicflow.llm.frames import files_for, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with u > v: larger (or smaller) neighbours move to the smallest."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        moved = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.where(F.col("u") > F.col("v")).distinct()


def _stored_with_state(links: DataFrame, files: int | None = None) -> tuple[DataFrame, tuple]:
    """The links written out, with their number and a checksum taken while writing."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    out = stored(links.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                               F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")), files)
    return out, tuple(seen.get[k] for k in ("n", "x", "s"))


def components(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(id, comp): every id of a link with the smallest id reachable from it. Null and self links are ignored.

    ``files``: of the links as they are first written; later ones follow the number of links.
    """
    edges, state = _stored_with_state(links.where(F.col(a) != F.col(b))
                                      .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), files)
    while state[0]:
        before = state
        edges, state = _stored_with_state(_star(_star(edges, True), False), files_for(edges.sparkSession, state[0]))
        if state == before:
            break
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
            .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct())
