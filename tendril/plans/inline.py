"""Queries over values shaped like the portal's, inline ones and many built from the tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions.fixed import FIELD_ALIASES
from tendril.operators import documents, minutes, relational
from tendril.sources import html
from tendril.tables import table

from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def rows_sql(name: str, kind: str = "VARCHAR") -> str:
    """A common table v(i, x) of a list of fixtures and of its values from the tables."""
    source, key, value = X.FROM_TABLES[name]
    fixed = ", ".join(f"(CAST({i - 1000} AS BIGINT), CAST({literal(x)} AS {kind}))" for i, x in enumerate(getattr(X, name)))
    return f"WITH v AS (SELECT * FROM (VALUES {fixed}) AS t(i, x) UNION ALL SELECT CAST({key} AS BIGINT), {value} FROM {source}) "


def rows(spark: SparkSession, sf_dir: str, name: str, kind: str = "string") -> DataFrame:
    source, key, value = X.FROM_TABLES[name]
    fixed = spark.createDataFrame([(i - 1000, x) for i, x in enumerate(getattr(X, name))], f"i long, x {kind}")
    return fixed.unionByName(table(spark, sf_dir, source).selectExpr(f"CAST({key} AS BIGINT) AS i", f"{value} AS x"))


W = r"[\s\p{Z}\x0b\x{85}\x1c-\x1f]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}', ' ', 'g'))"


def stripped(x: str, pattern: str) -> str:
    """x with a space for each match, squeezed."""
    return squeeze(f"regexp_replace({x}, '{pattern}', ' ', 'g')")


BARE = f"trim(trim(trim(replace({squeeze('x')}, '@@@@', '')), '*'))"
CLEAN = f"CASE WHEN lower({BARE}) NOT IN ('', '-', '--', 'n/a', 'néant', 'neant') THEN {BARE} END"
LABEL = "trim(rtrim(" + squeeze("coalesce(x, '')") + ", '*'))"
ALIASES = " ".join(f"WHEN starts_with(lower(l), {literal(a.lower())}) THEN '{f}'" for f, names in FIELD_ALIASES.items() for a in names)


@query(rows_sql("VALUES") + f"SELECT i, {CLEAN} AS cleaned FROM v")
def clean_value(spark, sf_dir):
    return rows(spark, sf_dir, "VALUES").select("i", T.clean_value(F.col("x")).alias("cleaned"))


@query(
    rows_sql("VALUES")
    + f""", d AS (SELECT i, regexp_replace({CLEAN}, '[^0-9,.\\-]', '', 'g') AS d FROM v),
e AS (SELECT i, CASE WHEN contains(d, ',') AND contains(d, '.') AND instr(reverse(d), ',') < instr(reverse(d), '.') THEN replace(replace(d, '.', ''), ',', '.') WHEN contains(d, ',') AND contains(d, '.') THEN replace(d, ',', '') ELSE replace(d, ',', '.') END AS d FROM d),
f AS (SELECT i, CASE WHEN length(d) - length(replace(d, '.', '')) > 1 THEN replace(d, '.', '') ELSE d END AS d FROM e)
SELECT i, CASE WHEN regexp_matches(d, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN try_cast(d AS DOUBLE) END AS amount FROM f"""
)
def parse_amount(spark, sf_dir):
    return rows(spark, sf_dir, "VALUES").select("i", T.parse_amount(F.col("x")).alias("amount"))


@query(rows_sql("DATES") + r"SELECT i, CAST(try_strptime(nullif(regexp_extract(x, '\b\d{2}/\d{2}/\d{4}\b'), ''), '%d/%m/%Y') AS DATE) AS day FROM v")
def parse_date(spark, sf_dir):
    return rows(spark, sf_dir, "DATES").select("i", T.parse_date(F.col("x")).alias("day"))


@query(rows_sql("BOOLS") + f"SELECT i, CASE WHEN starts_with(lower({CLEAN}), 'oui') OR starts_with(lower({CLEAN}), 'yes') THEN TRUE WHEN starts_with(lower({CLEAN}), 'no') THEN FALSE END AS value FROM v")
def tri_state_bool(spark, sf_dir):
    return rows(spark, sf_dir, "BOOLS").select("i", T.tri_state(F.col("x")).alias("value"))


@query(rows_sql("LABELS") + f"SELECT i, l AS label, CASE {ALIASES} END AS field FROM (SELECT i, {LABEL} AS l FROM v)")
def label_dispatch(spark, sf_dir):
    return rows(spark, sf_dir, "LABELS").select("i", T.normalize_label(F.col("x")).alias("label"), T.label_field(F.col("x")).alias("field"))


SPLIT = "CASE WHEN strpos(x, ':') > 0 THEN left(x, strpos(x, ':') - 1) ELSE nullif(regexp_extract(trim(x), '^(Référence|Reference)\\s+(.+)$', 1), '') END AS label, CASE WHEN strpos(x, ':') > 0 THEN substr(x, strpos(x, ':') + 1) ELSE nullif(regexp_extract(trim(x), '^(Référence|Reference)\\s+(.+)$', 2), '') END AS value"


@query(rows_sql("LINES") + f"SELECT i, {SPLIT} FROM v")
def split_label_value(spark, sf_dir):
    label, value = T.split_label(F.col("x"))
    return rows(spark, sf_dir, "LINES").select("i", label.alias("label"), value.alias("value"))


@query(rows_sql("REFERENCES") + f"SELECT i, nullif(trim(upper(regexp_replace(x, '{W}', '', 'g')), '-/.'), '') AS reference FROM v")
def normalize_reference(spark, sf_dir):
    return rows(spark, sf_dir, "REFERENCES").select("i", T.normalize_reference(F.col("x")).alias("reference"))


PIVOT = ["objet", "reference", "domaines_activite", "allotissement", "lieu_execution"]


@query(
    rows_sql("LINES")
    + f", s AS (SELECT i, {SPLIT} FROM v), n AS (SELECT CASE WHEN i < 0 THEN 0 ELSE 1 + i % 100 END AS doc, i, CASE {ALIASES.replace('lower(l)', 'lower(trim(label))')} END AS field, {CLEAN.replace('(x,', '(value,')} AS value FROM s WHERE label IS NOT NULL) SELECT CAST(doc AS BIGINT) AS doc, "
    + ", ".join(f"min_by(value, i) FILTER (WHERE field = '{f}' AND value IS NOT NULL) AS {f}" for f in PIVOT)
    + " FROM n GROUP BY doc"
)
def first_non_null_pivot(spark, sf_dir):
    label, value = T.split_label(F.col("x"))
    named = rows(spark, sf_dir, "LINES").where(label.isNotNull()).select(F.when(F.col("i") < 0, 0).otherwise(1 + F.col("i") % 100).cast("long").alias("doc"), "i", T.label_field(label).alias("field"), T.clean_value(value).alias("value"))
    return relational.first_non_null(named, "doc", "i", "field", "value", PIVOT)


def grab(label: str) -> str:
    return f"nullif(trim(regexp_replace(trim(regexp_extract(x, '{label}\\s*:\\s*([^|]{{1,180}})', 1), ' :'), '( {{2,}}|Procédure|Acheteur public).*$', '', 'g')), '')"


@query(rows_sql("BLOBS") + f"SELECT i, coalesce({grab('Catégorie principale')}, {grab('Catégorie')}) AS category, {grab('Acheteur public')} AS buyer, {grab('Objet')} AS objet FROM v")
def blob_extract(spark, sf_dir):
    x = F.col("x")
    return rows(spark, sf_dir, "BLOBS").select("i", T.labelled(x, ["Catégorie principale", "Catégorie"]).alias("category"), T.labelled(x, ["Acheteur public"]).alias("buyer"), T.labelled(x, ["Objet"]).alias("objet"))


KEYS = "nullif(regexp_extract(x, 'refConsultation=(\\d+)', 1), '') AS ref, nullif(regexp_extract(x, 'orgAcronyme=([^&\"'']+)', 1), '') AS org"


@query(rows_sql("URLS") + f"SELECT i, ref, org, CASE WHEN ref IS NOT NULL AND org IS NOT NULL THEN 'https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation=' || ref || '&orgAcronyme=' || org END AS detail_url FROM (SELECT i, {KEYS} FROM v)")
def url_keys(spark, sf_dir):
    ref, org = T.url_keys(F.col("x"))
    return rows(spark, sf_dir, "URLS").select("i", ref.alias("ref"), org.alias("org"), T.detail_url(ref, org).alias("detail_url"))


LINKED = "WITH l(page, pos, href) AS (VALUES " + ", ".join(f"(CAST({p} AS BIGINT), {k}, {literal(h)})" for p, k, h in X.LINKS) + f" UNION ALL SELECT {X.LINKS_FROM[1]}, {X.LINKS_FROM[2]}, {X.LINKS_FROM[3]} FROM {X.LINKS_FROM[0]}) "


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, page, pos, href = X.LINKS_FROM
    return spark.createDataFrame(X.LINKS, "page long, pos int, href string").unionByName(table(spark, sf_dir, source).selectExpr(f"{page} AS page", f"{pos} AS pos", f"{href} AS href"))


@query(LINKED + ", d AS (SELECT *, contains(lower(href), 'demandetelechargementdce') AS gated FROM l WHERE contains(lower(href), 'dce')), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gated, pos) AS rn FROM d) WHERE rn = 1) SELECT page, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '?') THEN 'https://www.marchespublics.gov.ma/index.php' || href ELSE 'https://www.marchespublics.gov.ma/' || ltrim(href, '/') END AS dossier_consultation_url, NOT gated AS is_publicly_downloadable FROM f")
def downloadability(spark, sf_dir):
    return html.downloadability(linked(spark, sf_dir), "page")


@query(rows_sql("SIDES", "DOUBLE") + "SELECT i, CAST(CASE WHEN x > 0 AND x / 72 * 300 > 4000 THEN floor(4000 / (x / 72)) ELSE 300 END AS INT) AS dpi FROM v")
def effective_dpi(spark, sf_dir):
    return rows(spark, sf_dir, "SIDES", "double").select("i", T.effective_dpi(F.col("x")).alias("dpi"))


@query(rows_sql("COMPANIES") + f", s AS (SELECT i, x, regexp_matches(x, '(?i)^\\s*groupement\\b') AS g, regexp_replace({squeeze('x')}, '(?i)^groupement\\s*:?\\s*', '') AS bare FROM v) SELECT i, g AS is_groupement, unnest(CASE WHEN g THEN list_filter(list_transform(regexp_split_to_array(bare, '(?i)\\s+et\\s+|\\s*/\\s*|\\s*;\\s*|\\s+&\\s+'), lambda y: trim(y)), lambda y: y <> '') ELSE [{squeeze('x')}] END) AS company FROM s WHERE x IS NOT NULL")
def split_consortium(spark, sf_dir):
    named = rows(spark, sf_dir, "COMPANIES").where("x is not null")
    return named.select("i", F.col("x").rlike(r"(?i)^\s*groupement\b").alias("is_groupement"), F.explode(T.consortium(F.col("x"))).alias("company"))


SPACED = f"' ' || replace(upper({squeeze('x')}), ' ', '  ') || ' '"


@query(rows_sql("COMPANIES") + f"SELECT i, nullif({stripped(SPACED, T.LEGAL_FORMS)}, '') AS company FROM v")
def normalize_company(spark, sf_dir):
    return rows(spark, sf_dir, "COMPANIES").select("i", T.normalize_company(F.col("x")).alias("company"))


@query(rows_sql("MINUTES") + "SELECT i, CASE WHEN regexp_matches(lower(x), 'infructueu') THEN 'INFRUCTUEUX' WHEN regexp_matches(lower(x), 'offre[s]?\\s+(est\\s+|sont\\s+)?excessi') THEN 'OFFRE_EXCESSIVE' WHEN regexp_matches(lower(x), '(concurrent|prestataire|soumissionnaire)\\w*\\s+(retenu|attributaire)|attribué') THEN 'ATTRIBUE' END AS statut FROM v")
def award_status(spark, sf_dir):
    return rows(spark, sf_dir, "MINUTES").select("i", T.award_status(F.col("x")).alias("statut"))


ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


@query(rows_sql("MIXED") + f"SELECT i, {stripped('x', ARABIC)} AS text FROM v")
def strip_arabic(spark, sf_dir):
    return rows(spark, sf_dir, "MIXED").select("i", T.strip_arabic(F.col("x")).alias("text"))


@query(rows_sql("COUNTS") + r"SELECT i, try_cast(regexp_replace(nullif(regexp_extract(x, '[Nn]ombre de r.sultats\s*:?\s*([\d\s\x{A0}\x{202F}]{1,12})', 1), ''), '[^0-9]', '', 'g') AS INT) AS n FROM v")
def result_count(spark, sf_dir):
    return rows(spark, sf_dir, "COUNTS").select("i", T.result_count(F.col("x")).alias("n"))


@query(rows_sql("ANGLES", "DOUBLE") + "SELECT i, abs(x) > 0.5 AS deskew, i * 90 <> 0 AND x >= 0.5 AS rotate FROM v")
def page_decisions(spark, sf_dir):
    return rows(spark, sf_dir, "ANGLES", "double").select("i", documents.deskews(F.col("x")).alias("deskew"), ((F.col("i") * 90 != 0) & (F.col("x") >= 0.5)).alias("rotate"))


NAMES = r"list_filter(list_transform(regexp_split_to_array(regexp_extract(x, '(?is){}[^:\n]*:\s*(.*?)(\n\s*\n|\n[^\n:]{{3,80}}:|\z)', 1), '\n|;'), lambda y: trim(regexp_replace(regexp_replace(y, '^\s*([-•*]|\d+[.)])\s*', ''), '\s+', ' ', 'g'))), lambda y: lower(y) NOT IN ('', 'néant', 'neant', '-'))"


@query(
    rows_sql("PV")
    + ", w AS (SELECT i, x, nullif(trim(regexp_extract(x, '(?i)(concurrent|prestataire|soumissionnaire)s?\\s+(retenu|attributaire)s?\\s*:\\s*([^\\n]{2,120})', 3)), '') AS w, "
    + NAMES.format("liste des concurrents ayant")
    + " AS b, "
    + NAMES.format("(?:liste des )?concurrents (?:écartés|évincés)")
    + r""" AS e FROM v) SELECT i, CASE WHEN regexp_matches(lower(x), 'infructueu') THEN 'INFRUCTUEUX' WHEN regexp_matches(lower(x), '(concurrent|prestataire|soumissionnaire)\w*\s+(retenu|attributaire)') THEN 'ATTRIBUE' END AS statut, CASE WHEN w NOT IN ('-') THEN w END AS concurrent_retenu, array_to_string(b, '|') AS bidders, CAST(len(b) AS BIGINT) AS number_of_bidders, array_to_string(e, '|') AS excluded, CAST(try_strptime(nullif(regexp_extract(x, '\b\d{2}/\d{2}/\d{4}\b'), ''), '%d/%m/%Y') AS DATE) AS date_seance, len(regexp_extract_all(x, '\d{1,3}(?:[ .]\d{3})*[,.]\d{2}')) AS n_amounts FROM w"""
)
def minutes_fields(spark, sf_dir):
    out = minutes.fields(rows(spark, sf_dir, "PV"), "i", "x")
    return out.select("i", "statut", "concurrent_retenu", F.array_join("liste_concurrents", "|").alias("bidders"), F.when(F.col("liste_concurrents").isNotNull(), F.col("number_of_bidders")).alias("number_of_bidders"), F.array_join("concurrents_ecartes", "|").alias("excluded"), "date_seance", F.size("amounts").cast("long").alias("n_amounts"))


@query(LINKED + "SELECT page, 'https://www.marchespublics.gov.ma/' || 'x?EntrepriseDownloadAvisJAL&idAvis=' || CAST(min(pos) AS VARCHAR) AS pdf_url FROM l GROUP BY page")
def minutes_link(spark, sf_dir):
    shown = linked(spark, sf_dir).select("page", "pos", F.concat(F.lit("x?EntrepriseDownloadAvisJAL&idAvis="), F.col("pos").cast("string")).alias("href"))
    other = spark.createDataFrame([(9, 1, "x?EntrepriseDownloadAvisJAL&idAvis=z")], "page long, pos int, href string")
    return minutes.minutes_link(shown.unionByName(other), "page")


@query(rows_sql("MINUTES") + "SELECT i, contains(lower(x), 'extrait de pv') OR contains(lower(x), 'extrait du pv') AS minutes FROM (SELECT i, CASE WHEN i % 2 = 0 THEN 'Avis : EXTRAIT DU PV. ' || x ELSE x END AS x FROM v)")
def minutes_notice(spark, sf_dir):
    shown = rows(spark, sf_dir, "MINUTES").withColumn("x", F.when(F.col("i") % 2 == 0, F.concat(F.lit("Avis : EXTRAIT DU PV. "), "x")).otherwise(F.col("x")))
    return shown.select("i", minutes.is_minutes_notice(F.col("x")).alias("minutes"))


def listing_sql(source: str = "orders") -> str:
    """The rows of the listing pages, straight from the values the pages are built of."""
    row = "o_orderkey AS page_id, CAST(0 AS INT) AS pos, CAST(o_orderkey AS VARCHAR) AS \"refConsultation\", 'o' || CAST(o_custkey % 9 AS VARCHAR) AS \"orgAcronyme\""
    url = "'https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation=' || CAST(o_orderkey AS VARCHAR) || '&orgAcronyme=o' || CAST(o_custkey % 9 AS VARCHAR) AS detail_url"
    return f"""SELECT {row}, {url}, CAST(o_orderkey AS VARCHAR) || '/' || o_orderstatus AS reference, CAST(o_orderdate AS DATE) AS date_mise_ligne, DATE '2031-02-01' AS date_limite_remise_plis FROM {source}
UNION ALL SELECT o_orderkey, 2, '7', 'z', 'https://www.marchespublics.gov.ma/index.php?x=EntrepriseDetailConsultation&refConsultation=7&orgAcronyme=z', 'R' || CAST(o_orderkey AS VARCHAR) || '/' || o_orderstatus, NULL, NULL FROM {source} WHERE o_orderkey % 4 = 1"""


def pages_of(spark, sf_dir, page: str):
    """A page of each order; orders are dealt anew to tasks that are not merged, for a page's work weighs many times what its order does."""
    dealt = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.selectExpr("o_orderkey AS page_id", f"{page} AS html")


@query(listing_sql())
def listing_rows(spark, sf_dir):
    """Result rows of listing pages that are built from orders."""
    return html.listing_rows(pages_of(spark, sf_dir, X.LISTING_PAGE), "page_id", "html")


DETAIL_SQL = f"""SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS date_limite_remise_plis, CAST(o_orderkey AS VARCHAR) || '/' || o_orderstatus AS reference, 'Travaux été ' || CAST(o_orderkey AS VARCHAR) AS objet,
o_orderpriority AS mode_passation, {X.PRICE} + 0.5::DOUBLE AS estimation_dhs_ttc, CASE WHEN o_orderkey % 3 = 0 THEN TRUE END AS allotissement,
CASE o_orderkey % 3 WHEN 0 THEN 'https://www.marchespublics.gov.ma/x/EntrepriseDemandeTelechargementDce?' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'https://www.marchespublics.gov.ma/index.php?dce=' || CAST(o_orderkey AS VARCHAR) END AS dossier_consultation_url,
CASE o_orderkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS is_publicly_downloadable, CASE WHEN o_orderkey % 3 = 1 THEN 'Visite=' || {X.DAY} ELSE '' END AS extras FROM orders"""


@query(DETAIL_SQL)
def detail_records(spark, sf_dir):
    """Records of detail pages that are built from orders; the fields that those pages name."""
    extras = F.array_join(F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    fields = ["date_limite_remise_plis", "reference", "objet", "mode_passation", "estimation_dhs_ttc", "allotissement", "dossier_consultation_url", "is_publicly_downloadable"]
    return html.detail_records(pages_of(spark, sf_dir, X.DETAIL_PAGE), "page_id", "html").select("page_id", *fields, extras.alias("extras"))


@query("SELECT p_partkey, 'https://www.marchespublics.gov.ma/index.php?page=entreprise.Avis&type=' || replace(url_encode(p_type), '%20', '+') || '&n=' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '&AllAnn&x' ELSE '' END AS url FROM part")
def page_url(spark, sf_dir):
    """Addresses of portal pages: encoded parameters and bare flags."""
    flags = F.when(F.col("p_partkey") % 2 == 0, "AllAnn&x")
    return table(spark, sf_dir, "part").select("p_partkey", T.page_url(F.lit("entreprise.Avis"), flags, {"type": F.col("p_type"), "n": F.col("p_size").cast("string")}).alias("url"))
