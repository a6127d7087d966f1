"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (partial sums before the shuffle, so a hot source costs no more than a
cold one), targets follow from them, and each document is emitted floor(rate) times plus once more
with a probability equal to the fraction, decided by a hash of its id and a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window

from orogen.llm.cluster import small, written

#: Characters of a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: source, source_size, target.

    Sources by code point, null last, weigh as ``weights`` repeats.  They divide ``share`` of all
    sizes by weight; none gets more than ``most`` times its size, and what is over is shared again
    by weight until none is above.  That ends with target = min(cap, level * weight) for one level:
    with sources by cap / weight, the level of the first source whose cap it does not exceed.
    The windows run over one row per source, not over documents.
    """
    w = window.Window.orderBy(F.col("source").asc_nulls_last())
    number = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("double")
    ranked = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    w = window.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = w.rowsBetween(window.Window.unboundedPreceding, -1), w.rowsBetween(0, window.Window.unboundedFollowing)
    every = w.rowsBetween(window.Window.unboundedPreceding, window.Window.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.sum("source_size").over(every) * share)
    ranked = ranked.withColumn("own", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("own") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("own")))).over(every)["own"])
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def copies(rate: Column, id: Column, seed: str) -> Column:
    """floor(rate), plus one with the fraction as probability: the same in every run and engine.

    A null id draws as the text ``null``; rows that repeat an id draw alike.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: bool = False, mark: str = "") -> DataFrame:
    """Copies of each document: id, size (words), source_size, target (of its source), taken, copies.

    ``keep`` retains the columns of docs beside these, whose names begin with ``mark``.  Null sources are one
    source; null texts and sources without words have size 0, target 0 and are taken 0 times; an empty table gives
    an empty result; repeated rows each count.  Columns of docs named like a result are replaced.
    """
    size, source_size, target, made_copies, taken = made = [mark + x for x in ("size", "source_size", "target", "copies", "taken")]
    base = docs if keep else docs.select(id, text, source)
    base = base.drop(*(c for c in made if c in base.columns and c not in (id, text, source)))
    sized = base.withColumn(size, word_count(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    aims = written(targets(sizes, weights, share, most), "mixing-targets")
    aims = small(aims).select(F.col("source").alias("__source"), F.col("source_size").alias(source_size), F.col("target").alias(target))
    joined = sized.join(aims, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.coalesce(F.try_divide(target, F.col(source_size).cast("double")), F.lit(0.0))
    out = joined.withColumn(made_copies, copies(rate, F.col(id), seed)).withColumn(taken, F.col(size) * F.col(made_copies))
    return out if keep else out.select(id, size, source_size, target, taken, made_copies)


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs as they are."""
    mixed = mix(docs, keep=True, mark="__mix_", **options)
    repeated = mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int"))))
    return repeated.select(*docs.columns)


#: The same mix as DuckDB SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * CAST(2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM ranked),
level AS (
  SELECT arg_min(own, cap / weight) AS level FROM levels WHERE own * weight <= cap),
aims AS (
  SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM levels, level),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size = 0 THEN CAST(0 AS DOUBLE) ELSE target / CAST(source_size AS DOUBLE) END AS rate,
         CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM drawn
"""
