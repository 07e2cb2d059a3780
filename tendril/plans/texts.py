"""Queries over extracted text, pages and events, each with its DuckDB SQL.

Documents stand for the pages of files: ten documents of a source, by id, are a
file; every third page has its own text layer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions.fixed import STATUSES
from tendril.operators import documents, relational
from tendril.sources import binary, html
from tendril.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CORRUPT = r"""((len(tokens) >= 20 AND len(list_filter(tokens, lambda x: NOT regexp_matches(x, '^[A-Za-zÀ-ÿ]+[.,;:)]?$'))) / greatest(len(tokens), 1) > 0.35) OR len(regexp_extract_all(t, '[\[\]{}\\|]')) / greatest(length(t) / 1000, 0.1) > 4.0)"""
TOKENS = r"""SELECT *, coalesce(text, '') AS t, list_filter(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x0b\x{85}\x1c-\x1f]{3,}'), lambda x: regexp_matches(x, '\p{L}')) AS tokens FROM documents"""
PAGE = """WITH page AS (SELECT source || '/' || CAST(doc_id // 10 AS VARCHAR) AS doc, CAST(doc_id AS BIGINT) AS page_number, CASE WHEN source IN ('src1', 'src2') OR doc_id % 3 = 0 THEN 'native' ELSE 'ocr' END AS source, CAST(doc_id % 101 AS DOUBLE) AS confidence, CAST(n_chars % 9 AS BIGINT) AS word_count, CASE WHEN doc_id % 17 = 0 OR source = 'src3' THEN 'error' END AS error, CAST(CASE doc_id % 29 WHEN 0 THEN 90 WHEN 1 THEN 270 ELSE 0 END AS INT) AS orientation_rotate_deg, CAST(doc_id % 23 AS DOUBLE) AS orientation_confidence, text, doc_id, n_chars FROM documents),
sums AS (SELECT doc, count(*) FILTER (WHERE source = 'ocr') AS ocr_pages, count(*) FILTER (WHERE source = 'ocr' AND error IS NULL) AS good, count(*) FILTER (WHERE source = 'ocr' AND error IS NULL AND word_count >= 3) AS rd, avg(confidence) FILTER (WHERE source = 'ocr' AND error IS NULL AND word_count >= 3) AS m FROM page GROUP BY doc),
status AS (SELECT doc, ocr_pages, CASE WHEN ocr_pages = 0 THEN 'native' WHEN good = 0 THEN 'ocr_failed' WHEN rd = 0 THEN 'ocr_low_confidence' WHEN m >= 60 THEN 'ocr_success' ELSE 'ocr_low_confidence' END AS ocr_status, CASE WHEN ocr_pages > 0 AND good > 0 THEN coalesce(m, 0.0) END AS mean_confidence FROM sums)
"""


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.concat("source", F.lit("/"), F.floor(i / 10).cast("string")).alias("doc"),
        i.alias("page_number"),
        F.when(F.col("source").isin("src1", "src2") | (i % 3 == 0), "native").otherwise("ocr").alias("source"),
        (i % 101).cast("double").alias("confidence"),
        (F.col("n_chars") % 9).alias("word_count"),
        F.when((i % 17 == 0) | (F.col("source") == "src3"), "error").alias("error"),
        F.when(i % 29 == 0, 90).when(i % 29 == 1, 270).otherwise(0).alias("orientation_rotate_deg"),
        (i % 23).cast("double").alias("orientation_confidence"),
        "text",
        "doc_id",
        "n_chars",
    )


@query(f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, {CORRUPT} AS corrupted FROM ({TOKENS})")
def text_corruption(spark, sf_dir):
    tokens = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)(\S{3,})"), F.lit(1)), lambda x: x.rlike(r"\p{L}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), T.corrupted(F.col("text")).alias("corrupted"))


@query(f"SELECT doc_id, length(t) > 20 AND NOT {CORRUPT} AS usable FROM ({TOKENS})")
def native_text_decision(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.native_usable(F.col("text")).alias("usable"))


@query(PAGE + "SELECT * FROM status")
def page_to_doc_status(spark, sf_dir):
    return documents.document_status(pages(spark, sf_dir))


@query(PAGE + ", names(ocr_status, position) AS (VALUES ('native', 0), ('ocr_success', 1), ('ocr_low_confidence', 2), ('ocr_failed', 3)) SELECT names.ocr_status, CAST(position AS INT) AS position, count(doc) AS n, 100.0 * count(doc) / (SELECT greatest(count(*), 1) FROM status) AS percent FROM names LEFT JOIN status USING (ocr_status) GROUP BY 1, 2")
def status_distribution(spark, sf_dir):
    return relational.distribution(documents.document_status(pages(spark, sf_dir)), "ocr_status", STATUSES)


@query(PAGE + "SELECT count(*) AS n, min(orientation_confidence) AS lowest, max(orientation_confidence) AS highest, avg(orientation_confidence) AS mean, count(*) FILTER (WHERE orientation_confidence < 3) AS near_threshold FROM page WHERE orientation_rotate_deg <> 0")
def rotation_stats(spark, sf_dir):
    return documents.rotation_stats(pages(spark, sf_dir))


@query(PAGE + "SELECT doc, round(coalesce(median(a) FILTER (WHERE abs(a) < 10), 0.0), 6) AS skew_angle_deg FROM (SELECT doc, degrees(atan2(CAST(doc_id % 41 AS DOUBLE) - 20, CAST(n_chars % 97 AS DOUBLE) + 1)) AS a FROM page) GROUP BY doc")
def median_filtered(spark, sf_dir):
    segments = pages(spark, sf_dir).select("doc", ((F.col("doc_id") % 41).cast("double") - 20).alias("dy"), ((F.col("n_chars") % 97).cast("double") + 1).alias("dx"))
    return documents.skew(segments, "doc").withColumn("skew_angle_deg", F.round("skew_angle_deg", 6))


@query(PAGE + "SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text FROM page WHERE trim(coalesce(text, '')) <> '' GROUP BY doc")
def page_text_concat(spark, sf_dir):
    return documents.document_text(pages(spark, sf_dir), "doc", "page_number", "text")


@query(PAGE + "SELECT doc, coalesce(avg(confidence) FILTER (WHERE confidence <> -1), 0.0) AS confidence, count(*) FILTER (WHERE confidence <> -1) AS word_count FROM (SELECT doc, CASE WHEN doc_id % 5 = 0 THEN -1.0 WHEN doc_id % 7 <> 0 THEN confidence END AS confidence FROM page) GROUP BY doc")
def word_to_page_confidence(spark, sf_dir):
    words = pages(spark, sf_dir).select("doc", F.when(F.col("doc_id") % 5 == 0, -1.0).when(F.col("doc_id") % 7 != 0, F.col("confidence")).alias("confidence"))
    return documents.page_confidence(words, ["doc"])


@query("SELECT doc_id, regexp_matches(lower(text), 'licen[sc]e|rights reserved|password') AS listed, regexp_matches(lower(text), 'classement|concurrent 1|concurrent 2|montant par|liste des concurrents') AS table_words FROM documents")
def keyword_any(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(t).rlike("licen[sc]e|rights reserved|password").alias("listed"), T.has_table_words(t).alias("table_words"))


@query("SELECT source, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents WHERE regexp_matches(lower(text), 'licen[sc]e|rights reserved') GROUP BY source")
def first_match(spark, sf_dir):
    """The first document of each source, in order, that has a keyword."""
    hit = table(spark, sf_dir, "documents").where(F.lower("text").rlike("licen[sc]e|rights reserved"))
    return hit.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


BLOBS = "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '%PDF-1.4 ' ELSE '' END || text AS body, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' ELSE 'text/html' END AS type, CASE doc_id % 6 WHEN 0 THEN 'http://x/y.PDF' ELSE 'http://x/y' END AS url, CASE doc_id % 7 WHEN 0 THEN 'attachment; filename=a.pdf' END AS disposition FROM documents) "


def blobs(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.when(i % 4 == 0, "%PDF-1.4 ").otherwise(""), "text").cast("binary").alias("content"),
        F.when(i % 5 == 0, "application/pdf").otherwise("text/html").alias("type"),
        F.when(i % 6 == 0, "http://x/y.PDF").otherwise("http://x/y").alias("url"),
        F.when(i % 7 == 0, "attachment; filename=a.pdf").alias("disposition"),
    )


@query(BLOBS + "SELECT doc_id, type LIKE '%pdf%' OR lower(url) LIKE '%.pdf' OR coalesce(lower(disposition) LIKE '%.pdf%', FALSE) OR body LIKE '[%]PDF%' OR left(body, 4) = '%PDF' AS is_pdf FROM f")
def content_sniff(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", binary.is_pdf(F.col("content"), F.col("type"), F.col("url"), F.col("disposition")).alias("is_pdf"))


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies, CAST(max(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return binary.by_hash(d, "content", "doc_id")


READING = "SELECT doc_id, coalesce(text, '') AS a, replace(replace(coalesce(text, ''), 'e', 'c'), ' th', ' tli') AS b FROM documents"
READ_WORDS = "list_filter(regexp_split_to_array({}, '[\\s\\p{{Z}}\\x0b\\x{{85}}\\x1c-\\x1f]+'), lambda x: x <> '')"
# The edit distance of word lists of one length is at most the number of places that differ, and at least the number of
# words of one list that the other lacks; where both are equal, that is the distance.
WORD_EDITS = f"""WITH w AS (SELECT doc_id, {READ_WORDS.format('a')} AS a, {READ_WORDS.format('b')} AS b FROM ({READING})),
upper_bound AS (SELECT doc_id, len(a) AS n, len(list_filter(list_zip(a, b), lambda z: z[1] IS DISTINCT FROM z[2])) AS most FROM w),
tally AS (SELECT doc_id, x, sum(d) AS d FROM (SELECT doc_id, unnest(a) AS x, 1 AS d FROM w UNION ALL SELECT doc_id, unnest(b), -1 FROM w) GROUP BY ALL),
lower_bound AS (SELECT doc_id, greatest(sum(greatest(d, 0)), sum(greatest(-d, 0))) AS least FROM tally GROUP BY doc_id)
SELECT doc_id, CASE WHEN most = coalesce(least, 0) THEN most END / nullif(CAST(n AS DOUBLE), 0) AS wer FROM upper_bound LEFT JOIN lower_bound USING (doc_id)"""


def readings(spark, sf_dir):
    """Each whole text, and a reading of it with usual errors."""
    truth = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", truth.alias("a"), F.replace(F.replace(truth, F.lit("e"), F.lit("c")), F.lit(" th"), F.lit(" tli")).alias("b"))


@query(f"SELECT doc_id, CAST(levenshtein(regexp_replace(a, '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(b, '[^\\x00-\\x7F]', '?', 'g')) AS DOUBLE) / nullif(length(a), 0) AS cer FROM ({READING})")
def cer(spark, sf_dir):
    """Character error rate of a reading of each whole text; marks stand for characters beyond ASCII, whose edits engines count unlike."""
    # dealt anew, for the work of a text grows faster than its bytes
    dealt = readings(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = dealt.select("doc_id", *(F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(c) for c in ("a", "b")))
    return plain.select("doc_id", (T.character_errors(F.col("a"), F.col("b")).cast("double") / F.nullif(F.length("a"), F.lit(0))).alias("cer"))


@query(WORD_EDITS)
def wer(spark, sf_dir):
    """Word error rate of the same readings."""
    return readings(spark, sf_dir).select("doc_id", (T.word_errors(F.col("a"), F.col("b")).cast("double") / F.nullif(T.word_count(F.col("a")), F.lit(0))).alias("wer"))


@query(PAGE + "SELECT doc, page_number, orientation_rotate_deg, orientation_confidence, orientation_confidence < 3 AS near_threshold FROM page WHERE orientation_rotate_deg <> 0")
def rotations_by_confidence(spark, sf_dir):
    return documents.rotations(pages(spark, sf_dir))


@query(PAGE + ", runs AS (SELECT doc, sum(n_chars) / 1000 AS seconds FROM page GROUP BY 1) SELECT round(sum(seconds), 3) AS total_seconds, count(*) AS documents, round(sum(seconds) / greatest(count(*), 1), 9) AS mean_seconds FROM runs")
def run_time_summary(spark, sf_dir):
    """Time of a run: each document takes a second for 1,000 characters."""
    runs = pages(spark, sf_dir).groupBy("doc").agg((F.sum("n_chars") / 1000).alias("seconds"))
    return documents.run_time(runs, "seconds").select(F.round("total_seconds", 3).alias("total_seconds"), "documents", F.round("mean_seconds", 9).alias("mean_seconds"))


@query(PAGE + "SELECT doc, ocr_status, CAST(pages AS BIGINT) AS pages, coalesce(CAST(length(text) AS BIGINT), 0) AS characters FROM status LEFT JOIN (SELECT doc, count(*) AS pages FROM page GROUP BY 1) USING (doc) LEFT JOIN (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text FROM page WHERE trim(coalesce(text, '')) <> '' GROUP BY doc) USING (doc)")
def ocr_results(spark, sf_dir):
    """The result of each document as a sink writes it: status, pages, text."""
    p = pages(spark, sf_dir).withColumnsRenamed({"doc": "path"}).withColumns({"skew_angle_deg": F.lit(0.0), "deskewed": F.lit(False)})
    out = documents.results(p)
    return out.select(F.col("path").alias("doc"), "ocr_status", F.size("pages").cast("long").alias("pages"), F.length("text").cast("long").alias("characters"))


@query("SELECT source, n, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE lang = 'en' AND regexp_matches(text, ' the ')) AS DOUBLE) AS tp, count(*) FILTER (WHERE lang <> 'en' AND regexp_matches(text, ' the ')) AS fp, count(*) FILTER (WHERE lang = 'en' AND NOT regexp_matches(text, ' the ')) AS fn FROM documents GROUP BY 1)")
def extraction_f1(spark, sf_dir):
    """Precision, recall and F1 of an extraction rule by group."""
    truth, said = F.col("lang") == "en", F.col("text").contains(" the ")
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(truth & said).cast("double").alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    rate = lambda a, b: a / F.nullif(b, F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("source", "n", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("SELECT page_id, count(*) AS links, min(href) AS first_href, max(href) AS last_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def html_links(spark, sf_dir):
    links = html.links(table(spark, sf_dir, "pages"), "page_id", "html")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"), F.max("href").alias("last_href"))


@query("SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '?') THEN 'https://www.marchespublics.gov.ma/index.php' || href ELSE 'https://www.marchespublics.gov.ma/' || ltrim(href, '/') END AS absolute FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS href FROM pages)")
def absolute_url(spark, sf_dir):
    links = html.links(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "href").distinct()
    return links.withColumn("absolute", T.absolute_url(F.col("href")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(spark, sf_dir):
    props = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), props["missing"].alias("missing"))


@query("SELECT user_id, max(n) AS longest, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def event_sessions(spark, sf_dir):
    """Beyond the reference: sessions with gaps under 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = table(spark, sf_dir, "events").withColumn("new", F.when(gap < F.expr("interval 30 minutes"), 0).otherwise(1))
    e = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("sessions"))


@query("SELECT * FROM events")
def stream_ingest(spark, sf_dir):
    """Events read as a stream, in batches, new keys only; the end state is a table."""
    from tendril.streaming.ingest import ingest_once

    return ingest_once(spark, f"{sf_dir}/events.parquet", ["event_id"])
