"""Queries over consultations, bids and awards, each with its DuckDB SQL.

Orders stand for consultations, line items for bids, suppliers for companies
and customers for buyers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.operators import forest, indicators, relational, risk
from tendril.sources import jsonl
from tendril.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """WITH consultation AS (SELECT o_orderkey AS ref_id, o_custkey AS buyer, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS published, CAST(year(o_orderdate) AS INT) AS annee, o_orderpriority AS category, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'pv_manifest' ELSE 'listing' END AS source, 'AO ' || CAST(o_orderkey % 4000 AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) AS reference FROM orders),
bid AS (SELECT l_orderkey AS market, l_suppkey AS bidder, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount, l_linenumber AS line, l_partkey AS part, l_returnflag AS flag FROM lineitem),
award AS (SELECT market, bidder AS winner, amount FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY line, bidder, part, amount) AS rn FROM bid) WHERE rn = 1),
nb AS (SELECT market, count(DISTINCT bidder) AS number_of_bidders FROM bid GROUP BY market),
won AS (SELECT c.*, a.winner, a.amount AS award_amount, nb.number_of_bidders FROM consultation c JOIN award a ON c.ref_id = a.market JOIN nb ON nb.market = a.market),
last AS (SELECT CASE WHEN month(max(published)) < 12 THEN year(max(published)) ELSE year(max(published)) + 1 END AS y FROM consultation),
wonf AS (SELECT * FROM won WHERE annee < (SELECT y FROM last)),
cy AS (SELECT winner, annee, count(*) AS number_of_awards, CAST(sum(award_amount) AS DOUBLE) AS total_amount, CAST(sum(award_amount) AS DOUBLE) / count(*) AS average_amount, count(*) FILTER (WHERE number_of_bidders = 1) AS single_bidder FROM wonf GROUP BY 1, 2),
conc AS (SELECT buyer, annee, winner, CAST(sum(award_amount) AS DOUBLE) AS amount, CAST(sum(award_amount) AS DOUBLE) / nullif(CAST(sum(sum(award_amount)) OVER (PARTITION BY buyer, annee) AS DOUBLE), 0) AS concentration FROM won GROUP BY 1, 2, 3),
rec AS (SELECT winner, buyer, annee, count(*) AS awards, CAST(sum(count(*)) OVER (PARTITION BY winner, buyer ORDER BY annee) AS BIGINT) AS cumulated FROM won GROUP BY 1, 2, 3)
"""


def query(sql: str | None = None, base: str = BASE):
    """Registers a query under its function's name, with the oracle that follows the common views."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = base + sql
        return fn

    return add


def consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("ref_id"),
        F.col("o_custkey").alias("buyer"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.to_date("o_orderdate").alias("published"),
        year.alias("annee"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "pv_manifest").otherwise("listing").alias("source"),
        F.concat(F.lit("AO "), (F.col("o_orderkey") % 4000).cast("string"), F.lit("/"), year.cast("string")).alias("reference"),
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return l.select(F.col("l_orderkey").alias("market"), F.col("l_suppkey").alias("bidder"), amount.alias("amount"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))


def won(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.awarded(consultations(spark, sf_dir), bids(spark, sf_dir))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.company_year_stats(indicators.full_years(won(spark, sf_dir)))


@query("SELECT winner, annee, number_of_awards, total_amount, single_bidder, single_bidder / number_of_awards AS single_bidder_rate FROM cy")
def single_bidder_rate(spark, sf_dir):
    return yearly(spark, sf_dir).select("winner", "annee", "number_of_awards", "total_amount", "single_bidder", "single_bidder_rate")


@query("SELECT * FROM nb")
def number_of_bidders(spark, sf_dir):
    return indicators.bidder_counts(bids(spark, sf_dir))


@query("SELECT winner, count(*) AS number_of_awards, CAST(sum(award_amount) AS DOUBLE) AS total_amount, CAST(sum(award_amount) AS DOUBLE) / count(*) AS average_amount, CAST(sum(award_amount) AS DOUBLE) / (SELECT CAST(sum(award_amount) AS DOUBLE) FROM won) AS market_share FROM won GROUP BY winner")
def company_stats(spark, sf_dir):
    return indicators.company_stats(won(spark, sf_dir))


@query("SELECT *, single_bidder / number_of_awards AS single_bidder_rate FROM cy")
def company_year_stats(spark, sf_dir):
    return yearly(spark, sf_dir)


@query("SELECT t.bidder, c.annee, count(*) AS participations, count(a.winner) AS wins, count(a.winner) / count(*) AS win_rate FROM (SELECT DISTINCT market, bidder FROM bid) t LEFT JOIN award a ON a.market = t.market AND a.winner = t.bidder JOIN consultation c ON c.ref_id = t.market GROUP BY 1, 2")
def win_rate_by_year(spark, sf_dir):
    return indicators.win_rates(consultations(spark, sf_dir), bids(spark, sf_dir))


@query("SELECT * FROM conc")
def buyer_concentration(spark, sf_dir):
    return indicators.buyer_concentration(won(spark, sf_dir))


@query("SELECT * FROM rec")
def recurrent_pairs(spark, sf_dir):
    return indicators.recurrent_pairs(won(spark, sf_dir))


@query("SELECT p.market, a.winner, count(*) FILTER (WHERE p.bidder <> a.winner) AS others, (CAST(a.amount AS DOUBLE) - CAST(sum(p.bid) FILTER (WHERE p.bidder <> a.winner) AS DOUBLE) / nullif(count(*) FILTER (WHERE p.bidder <> a.winner), 0)) / nullif(CAST(sum(p.bid) FILTER (WHERE p.bidder <> a.winner) AS DOUBLE) / nullif(count(*) FILTER (WHERE p.bidder <> a.winner), 0), 0) AS amount_variation FROM (SELECT market, bidder, sum(amount) AS bid FROM bid GROUP BY 1, 2) p JOIN award a ON a.market = p.market GROUP BY p.market, a.winner, a.amount")
def amount_variation(spark, sf_dir):
    return indicators.amount_variation(bids(spark, sf_dir))


@query("SELECT market, bidder, CAST(sum(amount) AS DOUBLE) AS bid, rank() OVER (PARTITION BY market ORDER BY sum(amount)) AS classement FROM bid GROUP BY 1, 2")
def bid_ranking(spark, sf_dir):
    return indicators.bid_ranking(bids(spark, sf_dir))


@query("SELECT winner, annee, total_amount, total_amount / nullif(CASE WHEN lag(annee) OVER w = annee - 1 THEN lag(total_amount) OVER w END, 0) AS growth FROM cy WINDOW w AS (PARTITION BY winner ORDER BY annee)")
def yoy_growth(spark, sf_dir):
    return indicators.yoy_growth(yearly(spark, sf_dir), "winner", "annee", "total_amount")


@query("SELECT winner, count(DISTINCT annee) AS years, round(regr_slope(total_amount, annee), 2) AS slope FROM cy GROUP BY winner HAVING count(DISTINCT annee) >= 2")
def trend_slope(spark, sf_dir):
    return indicators.trend_slope(yearly(spark, sf_dir), "winner", "annee", "total_amount").withColumn("slope", F.round("slope", 2))


@query("SELECT annee, count(*) AS n FROM consultation WHERE annee < (SELECT y FROM last) GROUP BY 1")
def truncated_year_exclusion(spark, sf_dir):
    return indicators.full_years(consultations(spark, sf_dir)).groupBy("annee").agg(F.count("*").alias("n"))


@query("SELECT annee, category, count(*) AS n FROM consultation WHERE NOT coalesce(source = 'listing' AND annee = 1998, FALSE) GROUP BY 1, 2")
def biased_vintage_filter(spark, sf_dir):
    return indicators.without_biased(consultations(spark, sf_dir), year=1998).groupBy("annee", "category").agg(F.count("*").alias("n"))


FLAGGED = """, flagged AS (SELECT w.ref_id, w.winner, w.annee, coalesce(w.number_of_bidders = 1, FALSE) AS single_bidder, coalesce(w.category NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), FALSE) AS closed_procedure, EXISTS (SELECT 1 FROM bid b WHERE b.market = w.ref_id AND b.flag = 'R') AS excluded_bidders, coalesce(c.concentration, 0) >= 0.5 AS concentration, coalesce(r.cumulated, 0) >= 3 AS recurrent FROM won w LEFT JOIN conc c USING (buyer, annee, winner) LEFT JOIN rec r USING (winner, buyer, annee)),
scored AS (SELECT *, 20.0 * (single_bidder::INT + closed_procedure::INT + excluded_bidders::INT + concentration::INT + recurrent::INT) AS s FROM flagged)
"""


def flagged(spark, sf_dir):
    out = bids(spark, sf_dir).where("flag = 'R'").select(F.col("market").alias("ref_id"))
    return risk.red_flags(won(spark, sf_dir).withColumn("procedure", F.col("category")), out, ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(FLAGGED + "SELECT * FROM flagged")
def red_flags(spark, sf_dir):
    return flagged(spark, sf_dir)


@query(FLAGGED + "SELECT ref_id, winner, CAST(s AS DOUBLE) AS risk_score, CASE WHEN s >= 75 THEN 'Critique' WHEN s >= 50 THEN 'Élevé' WHEN s >= 25 THEN 'Modéré' ELSE 'Faible' END AS risk_level FROM scored")
def risk_score(spark, sf_dir):
    return risk.scored(flagged(spark, sf_dir)).select("ref_id", "winner", "risk_score", "risk_level")


@query(FLAGGED + "SELECT ref_id, array_to_string(list_filter([CASE WHEN single_bidder THEN 'un seul concurrent' END, CASE WHEN closed_procedure THEN 'procédure non ouverte' END, CASE WHEN excluded_bidders THEN 'concurrents écartés' END, CASE WHEN concentration THEN 'part élevée chez l''acheteur' END, CASE WHEN recurrent THEN 'attributions répétées' END], lambda x: x IS NOT NULL), '; ') AS explanation FROM flagged")
def risk_explanation(spark, sf_dir):
    return risk.scored(flagged(spark, sf_dir)).select("ref_id", "explanation")


@query(FLAGGED + "SELECT winner, count(*) AS markets, CAST(avg(s) AS DOUBLE) AS mean_score, count(*) FILTER (WHERE s >= 50) AS high FROM scored GROUP BY 1")
def company_risk(spark, sf_dir):
    """The company level of the analysis, beside the market level."""
    return risk.scored(flagged(spark, sf_dir)).groupBy("winner").agg(F.count("*").alias("markets"), F.avg("risk_score").alias("mean_score"), F.count_if(F.col("risk_score") >= 50).alias("high"))


def features(spark, sf_dir):
    variation = indicators.amount_variation(bids(spark, sf_dir)).groupBy("winner").agg(F.round(F.avg("amount_variation"), 6).alias("amount_variation"))
    per = indicators.company_features(won(spark, sf_dir), indicators.last_full_year(consultations(spark, sf_dir)))
    return per.join(variation, "winner", "left")


@query(", v AS (" + ORACLES["amount_variation"].removeprefix(BASE) + "), e AS (SELECT winner, avg(number_of_bidders) AS mean_bidders, count(DISTINCT annee) AS active_years, count(*) AS number_of_awards, CAST(sum(award_amount) AS DOUBLE) AS total_amount FROM won GROUP BY 1), s AS (SELECT winner, CASE WHEN count(*) >= 2 THEN round(regr_slope(total_amount, annee), 2) END AS trend FROM cy GROUP BY 1) SELECT e.winner, e.number_of_awards, e.total_amount, e.total_amount / e.number_of_awards AS average_amount, e.total_amount / (SELECT CAST(sum(award_amount) AS DOUBLE) FROM won) AS market_share, e.mean_bidders, e.active_years, (SELECT round(avg(v.amount_variation), 6) FROM v WHERE v.winner = e.winner) AS amount_variation, s.trend, e.number_of_awards / e.active_years AS frequency FROM e LEFT JOIN s USING (winner)")
def feature_matrix(spark, sf_dir):
    return features(spark, sf_dir)


@query()
def isolation_forest(spark, sf_dir):
    """Anomaly scores of companies; random trees have no SQL form."""
    names = ["number_of_awards", "average_amount", "market_share", "mean_bidders", "amount_variation", "frequency"]
    return forest.isolation_scores(features(spark, sf_dir), "winner", names)


@query("SELECT c.ref_id, c.buyer, a.winner, CAST(a.amount AS DOUBLE) AS award_amount, CASE WHEN a.market IS NULL THEN 'INFRUCTUEUX' ELSE 'ATTRIBUE' END AS statut FROM consultation c LEFT JOIN award a ON a.market = c.ref_id")
def procurement_award_left_join(spark, sf_dir):
    a = indicators.awards(bids(spark, sf_dir)).select(F.col("market").alias("ref_id"), "winner", F.col("amount").cast("double").alias("award_amount"))
    out = consultations(spark, sf_dir).join(a, "ref_id", "left")
    return out.select("ref_id", "buyer", "winner", "award_amount", F.when(F.col("winner").isNull(), "INFRUCTUEUX").otherwise("ATTRIBUE").alias("statut"))


@query(""", pv AS (SELECT CASE WHEN ref_id % 10 = 0 THEN NULL ELSE ref_id END AS ref_id, buyer, reference, ref_id AS doc FROM consultation),
lk AS (SELECT ref_id, buyer, reference, amount FROM consultation), loose AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY buyer, reference ORDER BY ref_id) AS rn FROM lk) WHERE rn = 1)
SELECT pv.doc, CAST(lk.amount AS DOUBLE) AS amount, CASE WHEN lk.amount IS NOT NULL THEN 'key' END AS matched_by FROM pv LEFT JOIN lk USING (ref_id) WHERE pv.ref_id IS NOT NULL
UNION ALL SELECT pv.doc, CAST(l.amount AS DOUBLE), CASE WHEN l.amount IS NOT NULL THEN 'composite' END FROM pv LEFT JOIN loose l ON l.buyer = pv.buyer AND l.reference = pv.reference WHERE pv.ref_id IS NULL""")
def fallback_key_join(spark, sf_dir):
    c = consultations(spark, sf_dir)
    pv = c.select(F.when(F.col("ref_id") % 10 != 0, F.col("ref_id")).alias("ref_id"), "buyer", "reference", F.col("ref_id").alias("doc"))
    out = relational.fallback_join(pv, c.select("ref_id", "buyer", "reference", "amount"), "ref_id", ["buyer", "reference"], ["amount"])
    return out.select("doc", F.col("amount").cast("double").alias("amount"), "matched_by")


@query("SELECT reference, count(DISTINCT buyer) AS owners, count(*) AS n FROM consultation GROUP BY 1 HAVING count(DISTINCT buyer) > 1")
def ambiguous_reference(spark, sf_dir):
    return relational.ambiguous(consultations(spark, sf_dir), "reference", "buyer")


@query(", a AS (SELECT ref_id, buyer, amount FROM consultation WHERE ref_id % 4 <> 0), b AS (SELECT ref_id, buyer, amount * 2 AS amount FROM consultation WHERE ref_id % 4 <> 1) SELECT coalesce(a.ref_id, b.ref_id) AS ref_id, coalesce(a.buyer, b.buyer) AS buyer, CAST(coalesce(a.amount, b.amount) AS DOUBLE) AS amount, CASE WHEN a.buyer IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b ON a.ref_id = b.ref_id")
def source_priority_merge(spark, sf_dir):
    c = consultations(spark, sf_dir).select("ref_id", "buyer", F.col("amount").cast("double").alias("amount"))
    return relational.source_priority(c.where("ref_id % 4 <> 0"), c.where("ref_id % 4 <> 1").withColumn("amount", F.col("amount") * 2), "ref_id", ["buyer", "amount"])


def manifest_rows(spark, sf_dir):
    """References of the manifest, written loosely."""
    pv = consultations(spark, sf_dir).where("ref_id % 7 = 0")
    return pv.select("ref_id", F.lower(F.concat(F.lit("  "), F.replace("reference", F.lit("/"), F.lit(" / ")), F.lit("-"))).alias("written"))


MANIFEST = ", pv AS (SELECT ref_id, lower('  ' || replace(reference, '/', ' / ') || '-') AS written FROM consultation WHERE ref_id % 7 = 0), keys AS (SELECT DISTINCT nullif(trim(upper(regexp_replace(written, '[\\s\\p{Z}]+', '', 'g')), '-/.'), '') AS k FROM pv), named AS (SELECT *, nullif(trim(upper(regexp_replace(reference, '[\\s\\p{Z}]+', '', 'g')), '-/.'), '') AS k FROM consultation) "


@query(MANIFEST + "SELECT ref_id, reference FROM named WHERE k IN (SELECT k FROM keys)")
def semi_join_normalized(spark, sf_dir):
    keys = manifest_rows(spark, sf_dir).select(T.normalize_reference(F.col("written")).alias("k")).distinct()
    return consultations(spark, sf_dir).withColumn("k", T.normalize_reference(F.col("reference"))).join(keys, "k", "left_semi").select("ref_id", "reference")


@query(MANIFEST + "SELECT source, CASE WHEN grouping(cat) = 1 THEN 'TOTAL' ELSE cat END AS category, count(*) AS n, count(*) FILTER (WHERE by_id) AS by_id, count(*) FILTER (WHERE by_ref) AS by_ref, CASE WHEN count(*) = 0 THEN NULL ELSE 100.0 * count(*) FILTER (WHERE by_id) / count(*) END AS id_percent, CASE WHEN count(*) = 0 THEN '-' ELSE format('{} ({:.0f}%)', count(*) FILTER (WHERE by_ref), count(*) FILTER (WHERE by_ref) / count(*) * 100) END AS ref_cell FROM (SELECT source, coalesce(category, '?') AS cat, ref_id IN (SELECT ref_id FROM pv) AS by_id, k IN (SELECT k FROM keys) AS by_ref FROM named) GROUP BY GROUPING SETS ((source, cat), (source))")
def join_rate_rollup(spark, sf_dir):
    pv = manifest_rows(spark, sf_dir)
    ids = pv.select("ref_id").distinct().withColumn("_id", F.lit(True))
    keys = pv.select(T.normalize_reference(F.col("written")).alias("k")).distinct().withColumn("_ref", F.lit(True))
    c = consultations(spark, sf_dir).withColumn("k", T.normalize_reference(F.col("reference"))).join(ids, "ref_id", "left").join(keys, "k", "left")
    out = relational.join_rates(c, "source", "category", {"by_id": F.col("_id"), "by_ref": F.col("_ref")})
    return out.withColumns({"id_percent": 100.0 * F.col("by_id") / F.col("n"), "ref_cell": T.share_text(F.col("by_ref"), F.col("n"))})


@query("SELECT ref_id, buyer FROM consultation WHERE ref_id NOT IN (SELECT market FROM bid WHERE flag = 'R')")
def anti_join_seen(spark, sf_dir):
    seen = bids(spark, sf_dir).where("flag = 'R'").select(F.col("market").alias("ref_id"))
    return relational.unseen(consultations(spark, sf_dir), seen, ["ref_id"]).select("ref_id", "buyer")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (3, 5)")
def anti_join_exclusion(spark, sf_dir):
    out = spark.createDataFrame([(3,), (5,)], "p_partkey long")
    return table(spark, sf_dir, "part").join(F.broadcast(out), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT buyer, category, ref_id, published FROM (SELECT *, row_number() OVER (PARTITION BY buyer, category ORDER BY published, ref_id) AS rn FROM consultation) WHERE rn = 1")
def first_wins_dedup(spark, sf_dir):
    return relational.first_wins(consultations(spark, sf_dir), ["buyer", "category"], [F.col("published"), F.col("ref_id")]).select("buyer", "category", "ref_id", "published")


@query("SELECT source, ref_id, annee FROM consultation WHERE source = 'pv_manifest' UNION ALL SELECT source, ref_id, annee FROM consultation c WHERE source = 'listing' AND ref_id NOT IN (SELECT ref_id FROM consultation WHERE source = 'pv_manifest')")
def union_passes(spark, sf_dir):
    c = consultations(spark, sf_dir).select("source", "ref_id", "annee")
    first = c.where("source = 'pv_manifest'")
    return first.unionByName(relational.unseen(c.where("source = 'listing'"), first, ["ref_id"]).select("source", "ref_id", "annee"))


@query("SELECT r.ref_id, coalesce(l.reference, r.reference) AS reference, coalesce(l.category, r.category) AS category FROM consultation r LEFT JOIN (SELECT ref_id, CASE WHEN ref_id % 2 = 0 THEN reference || ' bis' END AS reference, 'listing' AS category FROM consultation WHERE ref_id % 3 = 0) l USING (ref_id)")
def override_coalesce(spark, sf_dir):
    c = consultations(spark, sf_dir)
    listing = c.where("ref_id % 3 = 0").select("ref_id", F.when(F.col("ref_id") % 2 == 0, F.concat("reference", F.lit(" bis"))).alias("reference"), F.lit("listing").alias("category"))
    return relational.override(c, listing, "ref_id", ["reference", "category"])


@query("SELECT category, annee, ref_id, published FROM (SELECT *, row_number() OVER (PARTITION BY category, annee ORDER BY published DESC, ref_id) AS rn FROM consultation WHERE ref_id NOT IN (SELECT market FROM bid WHERE flag = 'R')) WHERE rn <= 100")
def quota_per_group(spark, sf_dir):
    seen = bids(spark, sf_dir).where("flag = 'R'").select(F.col("market").alias("ref_id"))
    fresh = relational.unseen(consultations(spark, sf_dir), seen, ["ref_id"])
    return relational.quota(fresh, ["category", "annee"], [F.desc("published"), F.asc("ref_id")], 100).select("category", "annee", "ref_id", "published")


@query(", n AS (SELECT category, annee, count(*) AS n FROM consultation WHERE status = 'P' GROUP BY 1, 2) SELECT g.category, g.annee, coalesce(n.n, 0) AS n, 240 - coalesce(n.n, 0) AS missing FROM (SELECT * FROM (SELECT DISTINCT category FROM consultation), (SELECT DISTINCT annee FROM consultation)) g LEFT JOIN n USING (category, annee) WHERE coalesce(n.n, 0) < 240")
def quota_shortfall(spark, sf_dir):
    c = consultations(spark, sf_dir)
    grid = c.select("category").distinct().join(c.select("annee").distinct(), how="cross")  # categories by years: a small report grid
    counts = c.where("status = 'P'").groupBy("category", "annee").agg(F.count("*").alias("n"))
    return relational.quota_shortfall(counts, grid, ["category", "annee"], 240)


@query(", paged AS (SELECT *, CAST((row_number() OVER (PARTITION BY category ORDER BY published DESC, ref_id) - 1) // 100 AS BIGINT) AS page FROM consultation), p AS (SELECT category, page, max(published) AS newest, count(*) AS n FROM paged GROUP BY 1, 2) SELECT category, page, newest, n FROM (SELECT *, max(CASE WHEN newest < DATE '1998-01-01' - 180 THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY page) AS stop FROM p) WHERE stop = 0")
def early_stop_pages(spark, sf_dir):
    return relational.early_stop(listing_pages(spark, sf_dir), ["category"], "page", "newest", F.date_sub(F.lit("1998-01-01").cast("date"), 180)).select("category", "page", "newest", "n")


def listing_pages(spark, sf_dir):
    """The pages of a listing by category, newest first, 100 rows each, with their span."""
    paged = relational.page_numbers(consultations(spark, sf_dir), ["category"], "published", "ref_id", 100)
    return paged.groupBy("category", "page").agg(F.max("published").alias("newest"), F.min("published").alias("oldest"), F.count("*").alias("n"))


@query(", paged AS (SELECT *, CAST((row_number() OVER (PARTITION BY category ORDER BY published DESC, ref_id) - 1) // 100 AS BIGINT) AS page FROM consultation) SELECT category, page, max(published) AS newest, min(published) AS oldest, count(*) AS n FROM paged GROUP BY 1, 2")
def page_spans(spark, sf_dir):
    return listing_pages(spark, sf_dir)


@query("SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, CASE WHEN grouping(annee) = 1 THEN 'TOTAL' ELSE CAST(annee AS VARCHAR) END AS annee, count(*) AS n FROM consultation GROUP BY CUBE (category, annee)")
def category_year_cube(spark, sf_dir):
    cube = consultations(spark, sf_dir).cube("category", "annee").agg(F.count("*").alias("n"), F.grouping("annee").alias("_g"), F.grouping("category").alias("_c"))
    return cube.select(F.when(F.col("_c") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("annee").cast("string")).alias("annee"), "n")


@query("SELECT CAST(date_trunc('month', published) AS DATE) AS month, count(*) AS n FROM consultation GROUP BY 1")
def month_histogram(spark, sf_dir):
    return consultations(spark, sf_dir).groupBy(F.trunc("published", "month").alias("month")).agg(F.count("*").alias("n"))


@query(", f AS (SELECT source, CASE WHEN ref_id % 5 <> 0 THEN amount END AS amount, CASE WHEN source = 'listing' THEN published END AS published, reference FROM consultation) SELECT source, 'amount' AS field, count(amount) / count(*) AS fill_rate FROM f GROUP BY 1 UNION ALL SELECT source, 'published', count(published) / count(*) FROM f GROUP BY 1 UNION ALL SELECT source, 'reference', count(reference) / count(*) FROM f GROUP BY 1")
def field_completeness(spark, sf_dir):
    c = consultations(spark, sf_dir).select("source", F.when(F.col("ref_id") % 5 != 0, F.col("amount")).alias("amount"), F.when(F.col("source") == "listing", F.col("published")).alias("published"), "reference")
    return relational.completeness(c, "source", ["amount", "published", "reference"])


@query("SELECT p_type AS value, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM part) AS percent FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 10", base="")
def frequency_topk(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("value"), "p_partkey")
    return relational.top_values(parts, "value", "p_partkey", 10)


@query("SELECT source, annee, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM consultation GROUP BY 1, 2")
def records_per_year(spark, sf_dir):
    """Counts of a pass by year, with total size or amount."""
    return consultations(spark, sf_dir).groupBy("source", "annee").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


FISCAL = "CASE s_suppkey % 3 WHEN 0 THEN 'Sté  ' || lower(s_name) WHEN 1 THEN 'SOCIETE ' || s_name || ' SARL' ELSE s_name || ' SA' END"
NAMED = "nullif(trim(regexp_replace(regexp_replace(' ' || replace(upper(trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))), ' ', '  ') || ' ', '" + T.LEGAL_FORMS + "', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


@query(f", fiscal AS (SELECT k, min_by(s_nationkey, s_suppkey) AS nation FROM (SELECT *, {NAMED.format(FISCAL)} AS k FROM supplier WHERE s_acctbal > 0) WHERE k IS NOT NULL GROUP BY k) SELECT c.ref_id, f.nation, CAST(c.amount AS DOUBLE) AS amount FROM consultation c JOIN award a ON a.market = c.ref_id JOIN supplier s ON s.s_suppkey = a.winner LEFT JOIN fiscal f ON f.k = {NAMED.format('s.s_name')}")
def fiscal_reference_join(spark, sf_dir):
    """Awards with a reference record of the winner where one has its normalised name; of several with one name the first."""
    suppliers = table(spark, sf_dir, "supplier")
    ref = suppliers.where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("nation"), T.normalize_company(F.expr(FISCAL)).alias("k")).where("k is not null")
    ref = ref.groupBy("k").agg(F.min_by("nation", "s_suppkey").alias("nation"))
    names = suppliers.select(F.col("s_suppkey").alias("winner"), T.normalize_company(F.col("s_name")).alias("k"))
    a = indicators.awards(bids(spark, sf_dir)).select(F.col("market").alias("ref_id"), "winner")
    out = consultations(spark, sf_dir).join(a, "ref_id").join(names, "winner").join(ref, "k", "left")
    return out.select("ref_id", "nation", F.col("amount").cast("double").alias("amount"))


@query("SELECT w.ref_id, w.category, w.annee, m.peers, CAST(w.award_amount AS DOUBLE) / nullif(m.average, 0) AS to_category_mean FROM won w JOIN (SELECT category, annee, count(*) AS peers, CAST(sum(award_amount) AS DOUBLE) / count(*) AS average FROM won GROUP BY 1, 2) m USING (category, annee)")
def amount_within_category(spark, sf_dir):
    return indicators.within_category(won(spark, sf_dir))


@query("SELECT ref_id, published FROM consultation WHERE published IS NOT NULL AND year(published) IN (1995, 1997)")
def year_filter(spark, sf_dir):
    return relational.in_years(consultations(spark, sf_dir), "published", [1995, 1997]).select("ref_id", "published")


@query("SELECT ref_id, 'listing' AS source, annee, 'date_mise_ligne' AS annee_source FROM consultation")
def tagged_records(spark, sf_dir):
    return relational.tagged(consultations(spark, sf_dir).select("ref_id", "annee"), source="listing", annee_source="date_mise_ligne").select("ref_id", "source", "annee", "annee_source")


@query("SELECT ref_id, reference FROM consultation WHERE CASE WHEN ref_id % 4 <> 0 THEN category END IS NULL")
def todo_rows(spark, sf_dir):
    """Records without a category, which are still to be enriched."""
    lacking = consultations(spark, sf_dir).withColumn("category", F.when(F.col("ref_id") % 4 != 0, F.col("category")))
    return jsonl.todo(lacking, "category").select("ref_id", "reference")


@query("SELECT count(*) FILTER (WHERE status = 'F') AS ok, count(*) FILTER (WHERE status = 'O') AS skip, count(*) FILTER (WHERE status = 'X') AS err FROM consultation")
def outcome_tallies(spark, sf_dir):
    named = F.create_map(*(F.lit(x) for x in ("F", "ok", "O", "skip", "X", "err")))
    return relational.tallies(consultations(spark, sf_dir).withColumn("outcome", named[F.col("status")]), "outcome", ["ok", "skip", "err"])


@query("SELECT year, n, CAST(row_number() OVER (ORDER BY coalesce(CAST(year AS VARCHAR), 'None')) AS INT) AS position FROM (SELECT CASE WHEN ref_id % 9 <> 0 THEN annee END AS year, count(*) AS n FROM consultation GROUP BY 1)")
def years_by_text(spark, sf_dir):
    """Records per year sorted by the year's text, those without one as "None"."""
    per = consultations(spark, sf_dir).groupBy(F.when(F.col("ref_id") % 9 != 0, F.col("annee")).alias("year")).agg(F.count("*").alias("n"))
    ordered = Window.orderBy(F.coalesce(F.col("year").cast("string"), F.lit("None")))  # a row a year
    return relational.by_text(per, "year").select("year", "n", F.row_number().over(ordered).alias("position"))


@query(", t AS (SELECT ref_id, published, category FROM consultation ORDER BY published, ref_id LIMIT 10) SELECT * FROM t")
def first_rows(spark, sf_dir):
    """The first ten rows of a sorted listing; 0 would mean all."""
    return consultations(spark, sf_dir).orderBy("published", "ref_id").limit(10).select("ref_id", "published", "category")
