"""Mixing sources to target weights by repetition rates.

Words are summed for each source, weights become targets by water filling under a cap on
repetition, and rate = target / size of the source. Each document is taken floor(rate)
times, plus once more when a hash of its id and the seed falls below the fraction: the
draw needs no state, so reruns and retries take the same copies, and copies of a source
need not meet anywhere. Few documents may hold most words of a source, so each source
takes, of a fixed number of seeds, the one whose copies come nearest to its target. With one
seed a source of 50 documents missed its target by up to 57 %, one of 500 by up to 19 %. The
choice bends the probabilities a little: over 12 sets of seeds on 10,000 documents, documents
were drawn within 0.5 points of their fraction in every tenth by size, 0.9 points below it
among the largest hundredth, and 1.4 below where they hold over 2 % of their source's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import native
from .store import written

MAX_REPEATS = 3
#: Seeds that each source chooses from.
DRAWS = 16
#: Up to so many sources, their targets are broadcast (under 100 bytes each, names besides); beyond, they are joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000


def uniform(id_col: Column, seed: Column) -> Column:
    """A value in [0, 1) from 52 bits of a hash of the seed and the id; a null id counts as an empty one."""
    digits = F.substring(F.md5(F.concat(seed, F.lit(":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """source, source_size: words of each source, the null source included."""
    return docs.groupBy(native.quoted(source_col).alias("source")).agg(F.sum(native.quoted(size_col)).cast("long").alias("source_size"))


def default_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point of the source, null last; over one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))


def targets(weighted: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, weight -> and target, rate.

    Targets share the sum of all sizes by weight; one that would be above ``max_repeats``
    times its source's size stops there, and the excess is shared by weight among the others
    until none is above. Sources are capped in order of size / weight, so the level is found
    by running sums over one row for each source. A source without words has target 0 and rate 0.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    df = weighted.withColumns(
        {
            "_left": F.sum("source_size").over(everything) - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_share": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    cap = (max_repeats * F.col("source_size")).cast("double")
    level = F.col("_left").cast("double") / F.col("_share").cast("double")
    # levels fall after the first source that is not capped: that one has the level of all after it
    df = df.withColumn("_level", F.max(F.when(cap >= F.col("weight") * level, level)).over(everything))
    target = F.when(F.col("_level").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("_level")))
    df = df.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return df.select("source", "source_size", "weight", "target", rate.alias("rate"))


def _copies(id_col: Column, rate: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (uniform(id_col, seed) < rate - whole).cast("long")).cast("long")


def _joined(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Rows (_mix_source) with the columns of their source; ``small``: the table may be broadcast."""
    table = table.withColumnRenamed("source", "_mix_key")
    on = F.col("_mix_source").eqNullSafe(F.col("_mix_key"))
    return rows.join(F.broadcast(table) if small else table, on).drop("_mix_key")


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, table, small): _mix_id, _mix_source, _mix_size of every document; source, source_size, target, rate, seed of every source; whether the table is small.

    Size is the number of words, 0 for a null text. ``weights``: source, weight (long, over
    0) for every source; default: ``default_weights``. A source's seed is the one of DRAWS
    whose copies come nearest to its target, the first of equals.
    """
    rows = written(docs.select(native.quoted(id_col).alias("_mix_id"), native.quoted(source_col).alias("_mix_source"), native.n_words(native.quoted(text_col)).alias("_mix_size")))
    sizes = source_sizes(rows, "_mix_source", "_mix_size")
    small = sizes.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    if weights is None:
        weighted = default_weights(sizes)
    else:
        named = weights.select(F.col("source").alias("_named"), F.col("weight").cast("long").alias("weight"))
        weighted = sizes.join(named, F.col("source").eqNullSafe(F.col("_named"))).drop("_named")
    table = written(targets(weighted, max_repeats))
    rated = _joined(rows, table.select("source", "rate"), small)
    seeds = [f"{seed}{k}" for k in range(DRAWS)]
    taken = [F.sum(F.col("_mix_size") * _copies(F.col("_mix_id"), F.col("rate"), F.lit(x))).cast("long").alias(f"t{k}") for k, x in enumerate(seeds)]
    sums = rated.groupBy("_mix_source").agg(*taken)
    named = _joined(sums, table, small)
    misses = F.array(*(F.struct(F.abs(F.col(f"t{k}").cast("double") - F.col("target")).alias("miss"), F.lit(k).alias("k")) for k in range(DRAWS)))
    chosen = F.concat(F.lit(seed), F.array_min(misses)["k"].cast("string"))
    return rows, written(named.select(F.col("_mix_source").alias("source"), "source_size", "target", "rate", chosen.alias("seed"))), small


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document, repeats counted), rate, copies.

    One row for each row of ``docs``. Documents with one id draw alike within a source; a null
    source is a source and a null id an empty one. An empty table gives no rows. A very long
    text counts with all its words and is taken or left as a whole. Other columns are not read.
    """
    rows, table, small = plan_mix(docs, **options)
    copies = _copies(F.col("_mix_id"), F.col("rate"), F.col("seed"))
    return _joined(rows, table, small).select(
        F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * copies).alias("taken"), "rate", copies.alias("copies")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``; see ``mix_report``."""
    _, table, small = plan_mix(docs, **options)
    source, key, rate, seed, copy = native.fresh(docs.columns, "_mix_source", "_mix_key", "_mix_rate", "_mix_seed", "_mix_copy")
    drawn = table.select(F.col("source").alias(key), F.col("rate").alias(rate), F.col("seed").alias(seed))
    rows = docs.withColumn(source, native.quoted(options.get("source_col", "source")))
    rows = rows.join(F.broadcast(drawn) if small else drawn, F.col(source).eqNullSafe(F.col(key)))
    copies = _copies(native.quoted(options.get("id_col", "doc_id")), F.col(rate), F.col(seed)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*(native.quoted(c) for c in docs.columns))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {documents}
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM sizes
), running AS (
  SELECT *,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM weighted
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, max(CASE WHEN CAST(3 * source_size AS DOUBLE) >= weight * level THEN level END) OVER () AS chosen FROM running
), rates AS (
  SELECT source, source_size,
    CASE WHEN chosen IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), weight * chosen) END AS target
  FROM levels
), rated AS (
  SELECT d.*, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT r.*, k, CAST(floor(rate) AS BIGINT) + CAST(
    CAST('0x' || substr(md5('mix' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
  FROM rated r, range(16) g(k)
), misses AS (
  SELECT source, k, abs(CAST(sum(size * copies) AS DOUBLE) - any_value(target)) AS miss FROM drawn GROUP BY source, k
), chosen AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY miss, k) AS n FROM misses) WHERE n = 1
), copied AS (
  SELECT d.* FROM drawn d JOIN chosen c ON d.k = c.k AND d.source IS NOT DISTINCT FROM c.source
)
"""

ORACLE_SQL = MIX_SQL.format(documents="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM copied"
