"""Yearly indicators of companies and buyers from consultations, bids and awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def awards(bids: DataFrame) -> DataFrame:
    """The marked winner of each market: its first line, by an explicit order and never by price."""
    first = bids.groupBy("market").agg(F.min(F.struct("line", "bidder", "part", "amount")).alias("w"))
    return first.select("market", F.col("w.bidder").alias("winner"), F.col("w.amount").alias("amount"))


def bidder_counts(bids: DataFrame) -> DataFrame:
    return bids.groupBy("market").agg(F.countDistinct("bidder").alias("number_of_bidders"))


def full_years(df: DataFrame, year: str = "annee", date: str = "published") -> DataFrame:
    """Rows before the last year, if that is cut short; trends and growth must not see it."""
    return df.where(F.col(year) <= last_full_year(df, date))


def last_full_year(df: DataFrame, date: str = "published") -> Column:
    """The last year that is not cut short: that of the latest date if it is in December, else the one before."""
    return df.agg(F.max(date).alias("m")).select(F.when(F.month("m") < 12, F.year("m") - 1).otherwise(F.year("m"))).scalar()


def without_biased(df: DataFrame, source: str = "listing", year: int = 2024) -> DataFrame:
    """Drops the vintage that was collected from a narrow window, before any yearly aggregate; rows without a source stay."""
    return df.where(~F.coalesce((F.col("source") == source) & (F.col("annee") == year), F.lit(False)))


def awarded(consultations: DataFrame, bids: DataFrame) -> DataFrame:
    """One row for each award with its consultation and number of bidders."""
    counted = bids.groupBy("market").agg(F.min(F.struct("line", "bidder", "part", "amount")).alias("w"), F.countDistinct("bidder").alias("number_of_bidders"))
    won = counted.select(F.col("market").alias("ref_id"), F.col("w.bidder").alias("winner"), F.col("w.amount").alias("award_amount"), "number_of_bidders")
    return consultations.join(won, "ref_id")


def company_stats(won: DataFrame) -> DataFrame:
    per = won.groupBy("winner").agg(F.count("*").alias("number_of_awards"), F.sum("award_amount").alias("_sum"))
    total = per.agg(F.sum("_sum").cast("double")).scalar()  # of the same exchange
    amount = F.col("_sum").cast("double")
    return per.select("winner", "number_of_awards", amount.alias("total_amount"), (amount / F.col("number_of_awards")).alias("average_amount"), (amount / F.nullif(total, F.lit(0.0))).alias("market_share"))


def company_year_stats(won: DataFrame) -> DataFrame:
    per = won.groupBy("winner", "annee").agg(F.count("*").alias("number_of_awards"), F.sum("award_amount").alias("_sum"), F.count_if(F.col("number_of_bidders") == 1).alias("single_bidder"))
    amount = F.col("_sum").cast("double")
    return per.select("winner", "annee", "number_of_awards", amount.alias("total_amount"), (amount / F.col("number_of_awards")).alias("average_amount"), "single_bidder", (F.col("single_bidder") / F.col("number_of_awards")).alias("single_bidder_rate"))


def win_rates(consultations: DataFrame, bids: DataFrame) -> DataFrame:
    """Wins among participations of each bidder and year."""
    tried = bids.select("market", "bidder").distinct()
    first = awards(bids).select("market", F.col("winner").alias("bidder"), F.lit(1).alias("won"))
    rows = tried.join(first, ["market", "bidder"], "left").join(consultations.select(F.col("ref_id").alias("market"), "annee"), "market")
    return rows.groupBy("bidder", "annee").agg(F.count("*").alias("participations"), F.count("won").alias("wins"), (F.count("won") / F.count("*")).alias("win_rate"))


def buyer_concentration(won: DataFrame) -> DataFrame:
    """A winner's share of what a buyer awarded in a year and category-free total."""
    pair = won.groupBy("buyer", "annee", "winner").agg(F.sum("award_amount").alias("_sum"))
    total = F.sum("_sum").over(Window.partitionBy("buyer", "annee")).cast("double")
    return pair.select("buyer", "annee", "winner", F.col("_sum").cast("double").alias("amount"), (F.col("_sum").cast("double") / F.nullif(total, F.lit(0.0))).alias("concentration"))


def recurrent_pairs(won: DataFrame) -> DataFrame:
    """Awards of a company from a buyer, by year and cumulated."""
    per = won.groupBy("winner", "buyer", "annee").agg(F.count("*").alias("awards"))
    until = Window.partitionBy("winner", "buyer").orderBy("annee").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("cumulated", F.sum("awards").over(until))


def amount_variation(bids: DataFrame) -> DataFrame:
    """The retained amount against the mean of the other companies' bids; null without any."""
    first = awards(bids)
    per = bids.groupBy("market", "bidder").agg(F.sum("amount").alias("bid"))
    joined = per.join(first, "market")
    other = F.when(F.col("bidder") != F.col("winner"), F.col("bid"))
    sums = joined.groupBy("market", "winner", "amount").agg(F.sum(other).alias("_sum"), F.count(other).alias("others"))
    mean = F.col("_sum").cast("double") / F.nullif(F.col("others"), F.lit(0))
    return sums.select("market", "winner", "others", ((F.col("amount").cast("double") - mean) / F.nullif(mean, F.lit(0.0))).alias("amount_variation"))


def bid_ranking(bids: DataFrame) -> DataFrame:
    per = bids.groupBy("market", "bidder").agg(F.sum("amount").alias("bid"))
    rank = F.rank().over(Window.partitionBy("market").orderBy("bid"))
    return per.select("market", "bidder", F.col("bid").cast("double").alias("bid"), rank.cast("long").alias("classement"))


def yoy_growth(yearly: DataFrame, company: str, year: str, value: str) -> DataFrame:
    """value(N) / value(N - 1); null where the year before is missing."""
    w = Window.partitionBy(company).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return yearly.select(company, year, value, (F.col(value) / F.nullif(before, F.lit(0).cast("double"))).alias("growth"))


def trend_slope(yearly: DataFrame, company: str, year: str, value: str) -> DataFrame:
    """Slope of a yearly indicator; at least two years."""
    return yearly.groupBy(company).agg(F.countDistinct(year).alias("years"), F.regr_slope(value, year).alias("slope")).where("years >= 2")


def company_features(won: DataFrame, last_full: Column) -> DataFrame:
    """Totals, market share, bidders, active years, frequency and trend of each company, from one aggregate by year."""
    yearly = won.groupBy("winner", "annee").agg(F.count("*").alias("_n"), F.sum("award_amount").alias("_sum"), F.sum("number_of_bidders").alias("_bidders"))
    full = F.col("annee") <= last_full
    per = yearly.groupBy("winner").agg(
        F.sum("_n").alias("number_of_awards"),
        F.sum("_sum").alias("_sum"),
        (F.sum("_bidders") / F.sum("_n")).alias("mean_bidders"),
        F.count("*").alias("active_years"),
        F.regr_slope(F.when(full, F.col("_sum").cast("double")), F.when(full, F.col("annee"))).alias("_slope"),
        F.count_if(full).alias("_full"),
    )
    total = per.agg(F.sum("_sum").cast("double")).scalar()
    amount = F.col("_sum").cast("double")
    return per.select(
        "winner",
        "number_of_awards",
        amount.alias("total_amount"),
        (amount / F.col("number_of_awards")).alias("average_amount"),
        (amount / F.nullif(total, F.lit(0.0))).alias("market_share"),
        "mean_bidders",
        "active_years",
        F.when(F.col("_full") >= 2, F.round("_slope", 2)).alias("trend"),
        (F.col("number_of_awards") / F.col("active_years")).alias("frequency"),
    )


def within_category(won: DataFrame) -> DataFrame:
    """Each award's amount against the mean of its category and year: amounts of unlike categories are never compared."""
    mean = won.groupBy("category", "annee").agg(F.sum("award_amount").alias("_sum"), F.count("*").alias("peers"))  # a report's size
    same = F.col("a.category").eqNullSafe(F.col("m.category")) & (F.col("a.annee") == F.col("m.annee"))
    average = F.col("_sum").cast("double") / F.col("peers")
    return won.alias("a").join(mean.alias("m"), same).select("ref_id", "a.category", "a.annee", "peers", (F.col("award_amount").cast("double") / F.nullif(average, F.lit(0.0))).alias("to_category_mean"))
