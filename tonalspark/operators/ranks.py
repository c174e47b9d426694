"""Ranks and running sums over a whole table without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _parted(df: DataFrame, column: str, parts: int | None) -> DataFrame:
    """Adds _part: ranges of the column in ascending order, cut at approximate quantiles (a broadcast row of bounds)."""
    n = parts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(column).cast("double"), [i / n for i in range(1, n)]))).alias("_cuts"))
    return df.join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: F.col(column) > c))).drop("_cuts")


def places(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(value, ties, below, total) of each distinct non-null value: rows that have it, rows that are smaller, all rows.

    Values are counted first. Quantiles cut them into parts, as many as the session has shuffle partitions; windows run
    within parts, and a table of one row for each part adds what lies below a part. So no task gets more than its part of
    the distinct values. Nothing is run before the plan is.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    counts = _parted(counts, "value", parts)
    sums = counts.groupBy("_part").agg(F.sum("ties").alias("rows"))
    tiny = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("rows").over(tiny), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_part", F.coalesce(F.sum("ties").over(within), F.lit(0)))
    return counts.join(F.broadcast(before), "_part").select("value", "ties", (F.col("before") + F.col("in_part")).alias("below"), "total")


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the percentiles named in ``shares`` (name -> 0..1), interpolated linearly between the two nearest rows; null
    for an empty table. Found from the places of distinct values, not by collecting them."""
    found = places(df, column)
    at = {n: (F.col("total") - 1) * p for n, p in shares.items()}
    holds = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("ties"))
    picks = [F.max(F.when(holds(f(h)), F.col("value"))).alias(f"_{n}_{k}") for n, h in at.items() for k, f in (("low", F.floor), ("high", F.ceil))]
    row = found.agg(F.max("total").alias("total"), *picks)
    return row.select(*[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * ((F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p))).alias(n) for n, p in shares.items()])


def suffix_min(df: DataFrame, order: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the least value of a row and all that come behind it in ascending order: within parts, and over the parts behind."""
    rows = _parted(df, order, parts)
    tiny = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = rows.groupBy("_part").agg(F.min(value).alias("_least")).select("_part", F.min("_least").over(tiny).alias("_behind"))
    here = F.min(value).over(Window.partitionBy("_part").orderBy(F.col(order).desc()))
    return rows.withColumn("_here", here).join(F.broadcast(behind), "_part").withColumn(out, F.least("_here", "_behind")).drop("_part", "_here", "_behind")


def carried(df: DataFrame, order: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """Nulls of the columns filled from the row before, in ascending order, and width, the step to the next row's place."""
    rows = _parted(df, order, parts)
    within, tiny = Window.partitionBy("_part").orderBy(order), Window.orderBy("_part")
    past = tiny.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part").agg(F.min(order).alias("_first"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in columns])
    ends = ends.select("_part", F.lead("_first").over(tiny).alias("_next"), *[F.last(f"_l_{c}", ignorenulls=True).over(past).alias(f"_l_{c}") for c in columns])
    here = {c: F.last(c, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in columns}
    met = rows.withColumns(here | {"_ahead": F.lead(order).over(within)}).join(F.broadcast(ends), "_part")
    return met.withColumns({c: F.coalesce(c, f"_l_{c}") for c in columns} | {"width": F.coalesce("_ahead", "_next") - F.col(order)}).drop("_part", "_ahead", "_next", *[f"_l_{c}" for c in columns])


def with_rank(df: DataFrame, column: str, out: str, scaled: bool = True) -> DataFrame:
    """Adds the average rank of a column: from 0 to 1 (``scaled``; 0.5 for a single row) or from 1. Null stays null."""
    found = places(df, column)
    rank = F.col("below") + (F.col("ties") - 1) / 2
    rank = F.when(F.col("total") > 1, rank / (F.col("total") - 1)).otherwise(0.5) if scaled else rank + 1
    return df.join(found.select(F.col("value").alias("_value"), rank.alias(out)), df[column] == F.col("_value"), "left").drop("_value")


def target_quantiles(df: DataFrame, targets: DataFrame, query: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(query, and a share for each of ``columns``: out -> (column, target)): the share of rows of ``df`` whose column is under
    the target. targets: a stated set of a few rows, sent with the tasks; one pass, nothing is run before."""
    asked = targets.select(query, *[F.col(t).alias(f"_t_{o}") for o, (_, t) in columns.items()])
    met = df.select(*{c: None for c, _ in columns.values()}).crossJoin(F.broadcast(asked))
    return met.groupBy(query).agg(*[(F.count_if(F.col(c) < F.col(f"_t_{o}")) / F.count(c)).alias(o) for o, (c, _) in columns.items()])


def tiles(df: DataFrame, order: str, n: int, out: str) -> DataFrame:
    """Adds the tile, from 1, of n in ascending order of a column without repeated values: the first ones are a row larger."""
    place = places_of(df, order)
    size, larger = F.floor(F.col("_total") / n), F.col("_total") % n
    edge = larger * (size + 1)
    tile = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (size + 1))).otherwise(larger + F.floor((F.col("_at") - edge) / F.greatest(size, F.lit(1))))
    return place.withColumn(out, (tile + 1).cast("int")).drop("_at", "_total")


def places_of(df: DataFrame, order: str) -> DataFrame:
    """Adds _at, from 0, and _total: a row's place in ascending order of a column (a number, or a struct that begins with one and
    breaks its ties)."""
    struct = isinstance(df.schema[order].dataType, StructType)
    first = df.schema[order].dataType.fieldNames()[0] if struct else None
    rows = _parted(df.withColumn("_key", F.col(f"{order}.{first}") if struct else F.col(order)), "_key", None)
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    tiny = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_rows").over(tiny), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.withColumn("_in", here).join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_in")).drop("_key", "_part", "_before", "_in")


def top_per_query(df: DataFrame, score: Column, k: int, query: str = "query_id", item: str = "song_idx") -> DataFrame:
    """The k rows of highest score for each query, ties by item, with their rank from 1. Spark drops rows of higher rank
    before the shuffle."""
    order = Window.partitionBy(query).orderBy(score.desc(), F.col(item).asc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of df, from each stratum its share of them, rounded, one at least; what rounding takes too many goes, what it leaves
    too few comes from the rest, all in the order of a digest of the key and the seed.

    No stratum passes on more than n rows, of which each task keeps its first n; only those are ordered together.
    """
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    quota = F.least(F.col("_size"), F.greatest(F.lit(1), F.rint(n * F.col("_size") / F.col("_total"))))
    quotas = sizes.join(F.broadcast(total)).select(F.col(stratum).alias("_stratum"), quota.alias("_quota"))
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_place") <= n)
    told = first.join(quotas, first[stratum].eqNullSafe(quotas["_stratum"])).withColumn("_chosen", F.col("_place") <= F.col("_quota"))
    return told.orderBy(F.col("_chosen").desc(), "_h", key).limit(n).select(*df.columns)
