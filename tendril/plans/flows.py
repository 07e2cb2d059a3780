"""Queries over streams, sinks, catalog tables, variants and table functions, each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions import extras
from tendril.functions import text as T
from tendril.operators import documents, mentions, minutes, relational
from tendril.session import scratch_path, stored
from tendril.sources import html, jsonl, portal, sinks, store, udtf
from tendril.streaming import harvest, ingest
from tendril.tables import table

from . import tenders, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, through a Parquet sink with a checkpoint."""
    spark, root = stream.sparkSession, scratch_path(stream.sparkSession, name)
    run = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def view(df: DataFrame, name: str) -> str:
    name = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@query("SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def stored_pages(spark, sf_dir):
    """Pages that a crawl has stored, read as a stream with offsets."""
    spark.dataSource.register(portal.StoredPages)
    stream = spark.readStream.format("stored_pages").option("path", f"{sf_dir}/pages.parquet").load()
    return drained(stream, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"))


@query(texts.PAGE + "SELECT replace(doc, '/', '-') AS stem, CAST(pages AS BIGINT) AS pages, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM status LEFT JOIN (SELECT doc, count(*) AS pages FROM page GROUP BY 1) USING (doc) LEFT JOIN (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text FROM page WHERE trim(coalesce(text, '')) <> '' GROUP BY doc) USING (doc)")
def ocr_files(spark, sf_dir):
    """Results of documents written as files by the transactional sink, and read back."""
    p = texts.pages(spark, sf_dir).withColumn("path", F.concat(F.replace("doc", F.lit("/"), F.lit("-")), F.lit(".pdf"))).drop("doc").withColumns({"skew_angle_deg": F.lit(0.0), "deskewed": F.lit(False)})
    folder = scratch_path(spark, "ocr")
    names = jsonl.write_ocr(documents.results(p), folder)
    texts_, metas = (sinks.read_files(names.where(F.col("name").endswith(kind)), folder) for kind in (".txt", ".json"))
    bytes_ = texts_.select(F.regexp_extract("name", r"(.+)\.txt$", 1).alias("stem"), F.octet_length("content").cast("long").alias("bytes"))
    meta = metas.select(F.from_json(F.col("content").cast("string"), jsonl.OCR).alias("m")).select("m.pdf_path", "m.pages")
    return bytes_.join(meta.select(F.regexp_extract("pdf_path", r"(.+)\.pdf$", 1).alias("stem"), F.size("pages").cast("long").alias("pages")), "stem").select("stem", "pages", "bytes")


@query("WITH d AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS file_hash FROM documents) SELECT doc_id, file_hash, file_hash NOT IN (SELECT file_hash FROM d WHERE lang = 'en') AS is_new FROM d")
def document_store(spark, sf_dir):
    """Contents stored under their hashes: first those of one language, then all, of which only new ones are written."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    folder = scratch_path(spark, "documents")
    sinks.store_documents(files.where("lang = 'en'").select("path", "content"), folder)
    return sinks.store_documents(files.select("path", "content"), folder).select(F.col("path").alias("doc_id"), "file_hash", "is_new")


OLDEST = dt.date(1997, 7, 5)
LISTED = ", paged AS (SELECT *, CAST((row_number() OVER (PARTITION BY category ORDER BY published DESC, ref_id) - 1) // 100 AS BIGINT) AS page FROM consultation), spans AS (SELECT category, page, max(published) AS newest FROM paged GROUP BY 1, 2), stops AS (SELECT category, min(page) AS stop FROM spans WHERE newest < DATE '1997-07-05' GROUP BY 1)"


def listing(spark, sf_dir):
    paged = relational.page_numbers(tenders.consultations(spark, sf_dir), ["category"], "published", "ref_id", 100)
    return paged.select("category", F.col("ref_id").cast("long").alias("ref_id"), F.col("page").cast("long").alias("page"), "published", (-F.unix_date("published")).alias("age"))


@query(tenders.BASE + LISTED + " SELECT category, CAST(ref_id AS BIGINT) AS ref_id, page, published FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page, published DESC, ref_id) AS rn FROM paged LEFT JOIN stops USING (category) WHERE stop IS NULL OR page < stop) WHERE rn <= 1000")
def stream_harvest(spark, sf_dir):
    """What a reader takes of a listing that comes as a stream: 1,000 rows by category, until a page is too old."""
    path = scratch_path(spark, "listing")
    rows = listing(spark, sf_dir)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return drained(harvest.harvest(stream, "category", "ref_id", "page", ["page", "age", "ref_id"], 1000, "published", OLDEST), "harvest").drop("age")


@query(tenders.BASE + LISTED + " SELECT category, page, newest FROM spans LEFT JOIN stops USING (category) WHERE stop IS NULL OR page < stop")
def harvested_pages(spark, sf_dir):
    """The same stop as a table function over partitioned, ordered pages."""
    udtf.register(spark)
    pages = view(listing(spark, sf_dir).groupBy("category", "page").agg(F.max("published").alias("newest")), "listing")
    return spark.sql(f"SELECT * FROM harvested(TABLE({pages}) PARTITION BY category ORDER BY (page), 'newest', DATE '{OLDEST}')")


AWARDED = "SELECT l_orderkey AS ref_id, min(CAST(l_shipdate AS TIMESTAMP)) AS awarded FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


@query(f"WITH a AS ({AWARDED}), c AS (SELECT o_orderkey AS ref_id, CAST(o_orderdate AS TIMESTAMP) AS published FROM orders), mark AS (SELECT least((SELECT max(published) FROM c), (SELECT max(awarded) FROM a)) - INTERVAL 10 DAY AS reached), j AS (SELECT c.ref_id, published, awarded FROM c LEFT JOIN a ON a.ref_id = c.ref_id AND awarded BETWEEN published AND published + INTERVAL 60 DAY) SELECT ref_id, CAST(published AS DATE) AS published, CAST(awarded AS DATE) AS awarded FROM j, mark WHERE awarded IS NOT NULL OR published + INTERVAL 60 DAY < reached")
def award_outcomes(spark, sf_dir):
    """Two streams joined: awards within 60 days, and consultations that can get none any more."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.to_timestamp("o_orderdate").alias("published"))
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("ref_id")).agg(F.min(F.to_timestamp("l_shipdate")).alias("awarded"))
    streams = []
    for name, df in (("consultations", c), ("awards", a)):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        streams.append(spark.readStream.schema(df.schema).parquet(path))
    out = drained(harvest.award_outcomes(*streams, "ref_id", "published", "awarded", "60 DAYS", "10 days"), "outcomes")
    return out.select("ref_id", F.to_date("published").alias("published"), F.to_date("awarded").alias("awarded"))


@query("WITH e AS (SELECT time_bucket(INTERVAL 60 MINUTE, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events) SELECT start, event_type, count(*) AS n FROM e GROUP BY 1, 2 HAVING start + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM e)")
def windowed_counts(spark, sf_dir):
    """Events of a stream by hour and type, of the hours that can get none any more."""
    stream = ingest.stream_of(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return drained(ingest.windowed_counts(stream), "windows").select(F.col("window.start").alias("start"), "event_type", "n")


MANIFEST = "SELECT CAST(o_orderkey AS STRING) || '/' || o_orderstatus AS reference, CASE WHEN o_orderpriority LIKE '5%' THEN 'x' ELSE 'y?refConsultation=' || CAST(o_orderkey AS STRING) || '&orgAcronyme=o' || CAST(o_custkey % 9 AS STRING) END AS pdf_url, CAST(o_orderdate AS STRING) AS scraped_at FROM orders"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"refConsultation\", 'o' || CAST(o_custkey % 9 AS VARCHAR) AS \"orgAcronyme\", CAST(o_orderkey AS VARCHAR) || '/' || o_orderstatus AS reference, o_orderpriority AS categorie_principale, CAST(o_totalprice AS DOUBLE) AS estimation_dhs_ttc FROM orders WHERE o_orderpriority NOT LIKE '5%' AND o_orderstatus <> 'O'")
def manifest_details_join(spark, sf_dir):
    """The manifest's index joined with details, both bucketed in the catalog, so the join needs no shuffle."""
    manifest, _ = jsonl.manifest_index(table(spark, sf_dir, "orders").selectExpr(*MANIFEST.removeprefix("SELECT ").removesuffix(" FROM orders").split(", ")))
    details = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("refConsultation"), F.lit(None).cast("string").alias("orgAcronyme"), F.col("o_orderpriority").alias("categorie_principale"), F.col("o_totalprice").cast("double").alias("estimation_dhs_ttc"))
    name, parts = uuid.uuid4().hex, int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = [store.bucketed(df, f"{kind}_{name}", scratch_path(spark, kind), "refConsultation", parts) for kind, df in (("manifest", manifest), ("details", details))]
    return store.manifest_details(*both, ["categorie_principale", "estimation_dhs_ttc"])


@query("SELECT count(*) FILTER (WHERE o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '4%') AS usable, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS without_keys, count(*) FILTER (WHERE o_orderpriority LIKE '4%') AS malformed, count(DISTINCT CASE WHEN o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '4%' THEN o_orderkey END) AS written FROM orders")
def manifest_counts(spark, sf_dir):
    """Usable, key-less and malformed lines of a JSON-lines manifest, counted while its index is written."""
    lines, index = scratch_path(spark, "manifest"), scratch_path(spark, "index")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", *MANIFEST.removeprefix("SELECT ").removesuffix(" FROM orders").split(", "))
    whole = F.to_json(F.struct("reference", "pdf_url", "scraped_at"))
    rows.select(F.when(F.col("o_orderpriority").startswith("4"), F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(lines)
    counts = jsonl.write_index(jsonl.scan(spark, lines), index)
    return spark.read.parquet(index).agg(*(F.lit(counts[k]).alias(k) for k in ("usable", "without_keys", "malformed")), F.count("*").alias("written"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 1 THEN CAST(o_totalprice AS DOUBLE) END AS caution, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_custkey % 2 = 0 THEN 'null' ELSE 'value' END AS caution_state, CAST(o_custkey % 5 AS INT) AS lots, o_orderpriority AS visite, CAST(NULL AS DATE) AS as_date FROM orders")
def extras_variant(spark, sf_dir):
    """Labels of any shape as a variant: typed reads, null apart from missing, a value of another type as null."""
    o = table(spark, sf_dir, "orders")
    caution = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_custkey") % 2 == 0, '"Caution provisoire": null, ').otherwise(F.concat(F.lit('"Caution provisoire": '), F.col("o_totalprice").cast("string"), F.lit(", ")))
    json = F.concat(F.lit("{"), caution, F.lit('"Lots": {"nombre": '), (F.col("o_custkey") % 5).cast("string"), F.lit('}, "Visite d\'été": '), F.to_json(F.struct(F.col("o_orderpriority").alias("x"))).substr(F.lit(6), F.length("o_orderpriority") + 2), F.lit("}"))
    v = o.select("o_orderkey", extras.as_variant(json).alias("v"))
    read = lambda label, kind: extras.typed(F.col("v"), label, kind)
    return v.select("o_orderkey", read("Caution provisoire", "double").alias("caution"), extras.state(F.col("v"), "Caution provisoire").alias("caution_state"), F.try_variant_get(read("Lots", "variant"), "$.nombre", "int").alias("lots"), read("Visite d'été", "string").alias("visite"), read("Visite d'été", "date").alias("as_date"))


@query("SELECT page_id, CAST(count(*) AS BIGINT) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def page_links(spark, sf_dir):
    """Links of pages by a table function in SQL."""
    udtf.register(spark)
    pages = view(table(spark, sf_dir, "pages").select("page_id", "html"), "pages")
    return spark.sql(f"SELECT page_id, count(*) AS links FROM page_links(TABLE({pages}), 'html') GROUP BY page_id")


NAMED = r"""WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(upper(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
names AS (SELECT w[1] || ' ' || w[2] || ' ' || w[3] AS name, 3 AS n, min(doc_id) AS company FROM tok WHERE len(w) >= 3 GROUP BY 1 UNION ALL SELECT w[1] || ' ' || w[2], 2, min(doc_id) FROM tok JOIN documents USING (doc_id) WHERE len(w) >= 2 AND lang = 'en' GROUP BY 1),
place AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tok),
hits AS (SELECT doc_id, i, max({'n': n, 'company': company}) AS m FROM (SELECT doc_id, i, n, company FROM place JOIN names ON names.n = 3 AND w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] = name WHERE i + 2 <= len(w) UNION ALL SELECT doc_id, i, n, company FROM place JOIN names ON names.n = 2 AND w[i] || ' ' || w[i + 1] = name) GROUP BY 1, 2),
pick AS (SELECT doc_id, min({'i': i, 'm': m}) AS p FROM hits GROUP BY 1 UNION ALL SELECT pick.doc_id, min({'i': h.i, 'm': h.m}) FROM pick JOIN hits h ON h.doc_id = pick.doc_id AND h.i >= pick.p.i + pick.p.m.n GROUP BY pick.doc_id, pick.p)
SELECT doc_id, CAST(p.i - 1 AS BIGINT) AS first_word, CAST(p.m.n AS BIGINT) AS n_words, p.m.company AS company FROM pick"""


@query(NAMED)
def company_mentions(spark, sf_dir):
    """Names in all texts, leftmost and longest. The first words of the documents stand for the names of companies."""
    docs = table(spark, sf_dir, "documents")
    begun = lambda n, df: df.select("doc_id", mentions.first_words(F.coalesce("text", F.lit("")), n).alias("w"))
    first = lambda n, df: begun(n, df).where(F.size("w") >= n).select("doc_id", F.array_join("w", " ").alias("name"))
    names = first(3, docs).unionByName(first(2, docs.where("lang = 'en'"))).groupBy("name").agg(F.min("doc_id").alias("company"))
    return mentions.mentions(docs, "doc_id", "text", names, "company", "name")


LOT_TEXT = """concat('Lot n° ', i + 1, ' : Pièce ', x.l_partkey, '\\nListe des concurrents ayant déposé leurs plis :\\n- STE C', x.l_suppkey, '\\n- D', x.l_partkey, ' SARL\\n\\nConcurrents écartés : ', CASE WHEN x.l_returnflag = 'R' THEN concat('D', x.l_partkey, ' SARL') ELSE 'Néant' END,
'\\nMontants des offres avant vérification :\\n- STE C', x.l_suppkey, ' : ', x.n, ' 250,50 DH TTC\\nMontants après vérification :\\n1) STE C', x.l_suppkey, ' : ', x.n, ' 249,25 DHS\\n', CASE WHEN x.l_returnflag = 'A' THEN 'Le lot est déclaré infructueux.' ELSE concat('Concurrent retenu : STE C', x.l_suppkey) END)"""


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), l_returnflag) AS INT) AS lot, 'Pièce ' || l_partkey AS title, CAST(l_orderkey AS VARCHAR) || '/2024' AS reference, CASE WHEN l_returnflag = 'A' THEN 'INFRUCTUEUX' ELSE 'ATTRIBUE' END AS statut, CASE WHEN l_returnflag <> 'A' THEN 'STE C' || l_suppkey END AS concurrent_retenu, 'STE C' || l_suppkey || '|D' || l_partkey || ' SARL' AS bidders, CAST(CAST(l_quantity AS INT) AS DOUBLE) * 1000 + 250.5 AS amount_before, CAST(CAST(l_quantity AS INT) AS DOUBLE) * 1000 + 249.25 AS amount_after, CASE WHEN l_returnflag = 'R' THEN 'D' || l_partkey || ' SARL' ELSE '' END AS excluded FROM lineitem")
def minutes_lots(spark, sf_dir):
    """One row a lot of minutes that are built of line items: offers before and after they were verified."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("n"), "l_returnflag")
    # dealt to a fixed number of tasks, for texts are many times what the lines weigh that tasks are merged by
    dealt = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    whole = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    parts = F.expr(f"array_join(transform(lines, (x, i) -> {LOT_TEXT}), '\\n')")
    text = F.concat(F.lit("Extrait du PV\nAppel d'offres ouvert n° "), F.col("l_orderkey").cast("string"), F.lit("/2024\n\n"), parts)
    out = minutes.lots(whole.select("l_orderkey", text.alias("x")), "l_orderkey", "x")
    first = F.get("offers", F.lit(0))
    bidders = F.array_join(F.transform("offers", lambda x: x["bidder"]), "|")
    excluded = F.array_join(F.transform(F.filter("offers", lambda x: x["excluded"]), lambda x: x["bidder"]), "|")
    return out.select("l_orderkey", "lot", "title", "reference", "statut", "concurrent_retenu", bidders.alias("bidders"), first["amount_before"].alias("amount_before"), first["amount_after"].alias("amount_after"), excluded.alias("excluded"))
