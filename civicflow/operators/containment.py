"""Substring (containment) joins: J6 first place in a text, P4 pattern search.

Substring semantics cannot be an equi-join on whole values ("nation_1" is inside "nation_12"), so there are two ways:

* ``first_contained`` with patterns of a checked number and size: an Aho-Corasick automaton of all of them runs over
  every text once (map-only, Arrow batches), so its time does not depend on how many there are;
* an inverted q-gram index, for more patterns and for searches with wildcards: texts and patterns are cut into runs
  of ``Q`` characters, every pattern picks its rarest one, texts and patterns meet on it by equi-join, and
  what meets is confirmed on the whole text. Shorter patterns use their longest run, patterns of wildcards only an
  empty one that every text has. Only runs that some pattern has are kept of a text; a frequent run is salted.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.operators.common import row_count_at_most
from civicflow.session import cut_lineage

DEFAULT_MAX_BROADCAST = 20_000
MAX_PATTERN_BYTES = 4 << 20  # of all patterns of an automaton: some 100 bytes of a task's memory each
DEFAULT_SALT = 16
FEW_SEARCHES = 64  # so many search terms at most are tried on every row as it is read
Q = 3


def _automaton_udf(patterns: list[tuple[int, str]], rank_type: T.DataType):
    """A column function: the (rank, value) of the first pattern, in the list's order, that a text contains."""
    kind = pa.struct([("rank", pa.int64()), ("value", pa.string())])

    def first(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        automaton, least_empty = ahocorasick.Automaton(), None
        for place, (_, value) in enumerate(patterns):
            if value == "":
                least_empty = place if least_empty is None else least_empty
            elif value not in automaton:
                automaton.add_word(value, place)
        automaton.make_automaton()
        some = len(automaton) > 0
        for column in texts:
            found = []
            for text in column.to_pylist():
                places = [least_empty] if least_empty is not None and text is not None else []
                if text and some:
                    places += [place for _, place in automaton.iter(text)]
                found.append(dict(zip(("rank", "value"), patterns[min(places)])) if places else None)
            yield pa.array(found, kind)

    return F.arrow_udf(first, T.StructType([T.StructField("rank", T.LongType()), T.StructField("value", T.StringType())]))


def text_grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of ``sizes`` characters of a text (null: none); size 0 is the empty run."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    none = F.array().cast("array<string>")

    def runs(size: int) -> Column:
        if size == 0:
            return F.array(F.lit(""))
        at = F.sequence(F.lit(0), F.size(chars) - size)
        return F.when(F.size(chars) >= size, F.transform(at, lambda i: F.concat(*[chars[i + k] for k in range(size)]))).otherwise(none)
    return F.coalesce(F.array_distinct(F.concat(*[runs(s) for s in sizes])), none)


def pattern_grams(pieces: Column) -> Column:
    """The runs of a pattern's literal pieces, all of the greatest size up to ``Q`` that any piece has."""
    most = F.least(F.array_max(F.transform(pieces, lambda p: F.char_length(p))), F.lit(Q))

    def of_size(size: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(pieces, lambda p: text_grams(p, [size]))))
    by_size = [of_size(s) for s in range(Q + 1)]
    return reduce(lambda rest, s: F.when(most == s, by_size[s]).otherwise(rest), range(1, Q + 1), by_size[0])


def candidates(texts: DataFrame, id_cols: list[str], text_cols: list[Column], patterns: DataFrame, pattern_col: str,
               salt: int = DEFAULT_SALT) -> DataFrame:
    """(id columns, pattern): texts that have a pattern's rarest run in some column; a superset of what contains it.

    ``patterns``: the distinct patterns with their runs in an array ``grams``.
    """
    wanted = cut_lineage(patterns.select(F.col(pattern_col).alias("_pattern"), F.explode("grams").alias("_gram")))
    sizes = sorted(r[0] for r in wanted.select(F.char_length("_gram")).distinct().collect())  # at most Q + 1 numbers
    ids = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    if not sizes:
        return texts.limit(0).select(*id_cols).crossJoin(patterns.limit(0).select(pattern_col))
    grams = F.array_distinct(F.flatten(F.array(*[text_grams(t, sizes) for t in text_cols])))
    found = cut_lineage(texts.select(*ids, F.explode(grams).alias("_gram"))
                        .join(wanted.select("_gram").distinct(), "_gram", "left_semi"))
    often = found.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (wanted.join(often, "_gram", "left").groupBy("_pattern")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
              .where(F.col("_r.n") > 0).select("_pattern", F.col("_r.gram").alias("_gram"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    keys = [f"_id{i}" for i in range(len(id_cols))]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salt)).cast("int"))
    return (salted.join(rarest, ["_gram", "_salt"])
            .select(*[F.col(k).alias(c) for k, c in zip(keys, id_cols)], F.col("_pattern").alias(pattern_col)))


def first_contained(texts: DataFrame, text_expr: Column, patterns: DataFrame, value_col: str,
                    rank_col: str, out_value: str, out_rank: str, key_cols: list[str],
                    max_broadcast: int = DEFAULT_MAX_BROADCAST, salt: int = DEFAULT_SALT) -> DataFrame:
    """For every text row: the lowest-rank pattern that is a substring of
    ``text_expr`` (left semantics: null when none). Adds two columns.

    ``key_cols`` identify a text row; the path by index joins its per-row
    minimum back on them (a generated row id could differ between the two
    reads of ``texts`` when a task is recomputed)."""
    pats = patterns.select(F.col(rank_col).alias("rank"), F.col(value_col).alias("value")).where(F.col("value").isNotNull())
    rank_type = patterns.schema[rank_col].dataType
    small = row_count_at_most(pats, max_broadcast) and importlib.util.find_spec("ahocorasick") is not None
    if small and (pats.agg(F.sum(F.octet_length("value"))).first()[0] or 0) <= MAX_PATTERN_BYTES:
        held = sorted((r["rank"], r["value"]) for r in pats.collect())
        hit = texts.withColumn("_hit", _automaton_udf(held, rank_type)(text_expr))
        return (hit.withColumn(out_value, F.col("_hit")["value"]).withColumn(out_rank, F.col("_hit")["rank"].cast(rank_type))
                .drop("_hit"))
    keyed = texts.select(*key_cols, text_expr.alias("_text"))
    named = pats.withColumn("grams", pattern_grams(F.array("value"))).select("value", "grams").distinct()
    met = candidates(keyed, key_cols, [F.col("_text")], named, "value", salt)
    best = (met.join(keyed, key_cols).where(F.col("_text").contains(F.col("value"))).select(*key_cols, "value")
            .join(pats, "value").groupBy(*key_cols).agg(F.min(F.struct("rank", "value")).alias("_hit")))
    return (texts.join(best, key_cols, "left")
            .withColumn(out_value, F.col("_hit")["value"]).withColumn(out_rank, F.col("_hit")["rank"])
            .drop("_hit"))


def like_escape(q: Column) -> Column:
    """Keep % and _ as wildcards but make a backslash literal."""
    return F.regexp_replace(q, r"\\", r"\\\\")


def search_hits(items: DataFrame, item_cols: list[str], queries: DataFrame, query_col: str,
                salt: int = DEFAULT_SALT) -> DataFrame:
    """Rows of ``items`` where any of ``item_cols`` ILIKE '%q%', per query
    q (lowercased; empty queries refused). Output: item columns + ``query``.

    A few searches are tried on each row where it is read, without a shuffle; more go through the q-gram index."""
    terms = queries.select(F.lower(F.col(query_col)).alias("query")).where(F.col("query") != "").dropDuplicates(["query"])
    few = [r["query"] for r in terms.limit(FEW_SEARCHES + 1).collect()]
    if 0 < len(few) <= FEW_SEARCHES and "query" not in items.columns:
        met = [F.when(_any_like(item_cols, F.lit(q)), F.lit(q)) for q in few]
        return items.withColumn("query", F.explode(F.filter(F.array(*met), lambda q: q.isNotNull())))
    qs = terms.withColumn("grams", pattern_grams(F.split("query", "[%_]")))
    rows = cut_lineage(items.withColumn("_item", F.monotonically_increasing_id()))  # numbers that stay once written
    met = candidates(rows, ["_item"], [F.lower(F.col(c)) for c in item_cols], qs, "query", salt)
    return rows.join(met, "_item").where(_any_like(item_cols, F.col("query"))).drop("_item")


def _any_like(item_cols: list[str], query: Column) -> Column:
    pattern = F.concat(F.lit("%"), like_escape(query), F.lit("%"))
    return reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), pattern), F.lit(False)) for c in item_cols])
