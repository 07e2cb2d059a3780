"""Ordered dedup, quotas, cursor stops, key joins and grouped reports as window and join logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key all stay."""
    null_key = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(~null_key).withColumn("_rank", rank).where("_rank = 1").drop("_rank").unionByName(df.where(null_key))


def quota(df: DataFrame, groups: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group in listing order (0: all). Filter out failures before, as only successes count."""
    if not limit:
        return df
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")


def quota_shortfall(counts: DataFrame, grid: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Cells of the grid with fewer rows than the quota, those without any included."""
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(counts, keys, "left").select(*keys, n.alias("n"), (limit - n).alias("missing")).where(F.col("missing") > 0)


def early_stop(pages: DataFrame, cursor: list[str], order: str, newest: str, oldest_wanted: Column) -> DataFrame:
    """Pages a sequential reader would harvest: those before the first one whose newest row is too old."""
    stop = (F.coalesce(F.col(newest) < oldest_wanted, F.lit(False))).cast("int")
    seen = F.max(stop).over(Window.partitionBy(*cursor).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("_stop", seen).where("_stop = 0").drop("_stop")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those seen."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def override(record: DataFrame, listing: DataFrame, key: str, fields: list[str], listing_wins: bool = True) -> DataFrame:
    """Record fields replaced by the listing's where that is not null (or the other way round)."""
    pick = lambda f: F.coalesce(*([f"l.{f}", f"r.{f}"] if listing_wins else [f"r.{f}", f"l.{f}"])).alias(f)
    return record.alias("r").join(listing.alias("l"), key, "left").select(key, *map(pick, fields))


def fallback_join(left: DataFrame, right: DataFrame, key: str, composite: list[str], values: list[str]) -> DataFrame:
    """Left rows with the values matched by key, or by the composite where the key is missing; unmatched stay."""
    named = lambda df, how: df.withColumn("matched_by", F.lit(how))  # a match without values is a match
    by_key = left.where(F.col(key).isNotNull()).join(named(right.select(key, *values), "key"), key, "left")
    loose = first_wins(right.where(F.coalesce(*(F.col(c).cast("string") for c in composite)).isNotNull()), composite, [F.col(key).asc_nulls_last()])
    by_pair = left.where(F.col(key).isNull()).join(named(loose.select(*composite, *values), "composite"), composite, "left")
    return by_key.unionByName(by_pair)


def ambiguous(df: DataFrame, reference: str, owner: str) -> DataFrame:
    """References that several owners use: never a key on their own."""
    return df.groupBy(reference).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("n")).where("owners > 1")


def source_priority(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the first source, of the second where the first has none, and where each row came from."""
    joined = first.withColumn("_first", F.lit(True)).alias("a").join(second.alias("b"), key, "full")
    origin = F.when(F.col("_first"), "first").otherwise("second")
    return joined.select(key, *(F.coalesce(f"a.{f}", f"b.{f}").alias(f) for f in fields), origin.alias("origin"))


def join_rates(df: DataFrame, source: str, category: str, hits: dict[str, Column]) -> DataFrame:
    """Rows and hits for each source and category, with a TOTAL for each source; a null category is "?"."""
    named = df.withColumn("_cat", F.coalesce(category, F.lit("?")))
    sums = [F.count_if(c).alias(k) for k, c in hits.items()]
    out = named.groupingSets([[F.col(source), F.col("_cat")], [F.col(source)]], F.col(source), F.col("_cat")).agg(F.grouping("_cat").alias("_g"), F.count("*").alias("n"), *sums)
    return out.select(source, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("_cat")).alias(category), "n", *hits)


def distribution(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count and percentage of each listed value, zero rows included; the denominator is at least 1."""
    grid = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, position int")
    total = df.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return F.broadcast(grid).join(counts, column, "left").select(column, "position", n.alias("n"), (100.0 * n / total).alias("percent"))


def top_values(df: DataFrame, column: str, position: str, limit: int) -> DataFrame:
    """The most frequent values, ties by first appearance, with their share."""
    total = df.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    top = counts.orderBy(F.desc("n"), F.asc("_first"))
    return (top.limit(limit) if limit else top).select(column, "n", (F.col("n") * 100.0 / total).alias("percent"))


def completeness(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Share of non-null values of each field by group, one row for each pair."""
    rates = df.groupBy(group).agg(*((F.count(f) / F.count("*")).alias(f) for f in fields))
    return rates.unpivot([group], fields, "field", "fill_rate")


def first_non_null(rows: DataFrame, key: str, position: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Label-value rows as one record per key; the first non-null value of a field wins."""
    picks = [F.min_by(F.when((F.col(field) == f) & F.col(value).isNotNull(), F.col(value)), F.when((F.col(field) == f) & F.col(value).isNotNull(), F.col(position))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*picks)


def in_years(df: DataFrame, date: str, years: list[int]) -> DataFrame:
    """Rows with a date in one of the years; rows without one go."""
    return df.where(F.col(date).isNotNull() & F.year(date).isin(years))


def tagged(df: DataFrame, **constants: Column | str | int) -> DataFrame:
    """Rows with constant columns: source, year and its origin, time of collection."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()})


def page_numbers(df: DataFrame, cursor: list[str], newest_first: str, tie: str, size: int) -> DataFrame:
    """Adds the page a sorted listing shows each row on. Counts by day are summed up first, so no task sorts a whole cursor."""
    days = df.groupBy(*cursor, newest_first).agg(F.count("*").alias("_n"))  # a row a day
    w = Window.partitionBy(*cursor).orderBy(F.desc_nulls_last(newest_first)).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*cursor, newest_first]]
    within = F.row_number().over(Window.partitionBy(*(F.col(f"r.{c}") for c in [*cursor, newest_first])).orderBy(F.asc(f"r.{tie}")))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.alias("r").join(starts.alias("s"), on).select("r.*", F.floor((F.col("_start") + within - 1) / size).alias("page"))


def tallies(df: DataFrame, outcome: str, kinds: list[str]) -> DataFrame:
    """One row with the number of rows of each outcome, 0 where there is none."""
    return df.agg(*(F.count_if(F.col(outcome) == k).alias(k) for k in kinds))


def by_text(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """Rows sorted by a column's text; null sorts as "None"."""
    return df.orderBy(F.coalesce(F.col(column).cast("string"), F.lit("None")), *order)
