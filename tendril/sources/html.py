"""HTML pages as rows: links, listing rows and detail records.

One pass of the standard library's parser over a page, in Arrow batches, gives
its links, blocks and table rows as arrays of one row; everything after that is
DataFrame logic on these arrays, so a page is parsed once for all uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_type

from tendril.functions import text as T
from tendril.functions.fixed import FIELD_ALIASES

#: A tag of plain markup: attributes in double quotes, none in end tags; and its attributes.
TAG = re.compile(r"""<(/)?([A-Za-z][A-Za-z0-9]*)((?(1)|(?:[ \t\r\n]+[A-Za-z][A-Za-z0-9-]*="[^"<>]*")*))[ \t\r\n]*>""")
ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z0-9-]*)="([^"]*)"')
#: Elements whose contents every version of the parser reads as markup.
PLAIN = frozenset("a b body br center dd div dl dt em font form h1 h2 h3 h4 h5 h6 head hr html i img input label li ol p small span strong sub sup table tbody td tfoot th thead tr u ul".split())
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


def record(**fields: t.DataType) -> t.ArrayType:
    return t.ArrayType(t.StructType([t.StructField(k, v) for k, v in fields.items()]))


#: Links with their text and the cells of the table row they stand in (null: in none); blocks of class line; rows of tables.
PIECES = {
    "links": record(pos=t.IntegerType(), href=t.StringType(), text=t.StringType(), cells=t.ArrayType(t.StringType())),
    "lines": record(pos=t.IntegerType(), text=t.StringType()),
    "rows": t.ArrayType(t.ArrayType(t.StringType())),
}


class Pieces(HTMLParser):
    """The pieces of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.lines: list[dict] = []
        self.rows: list[list[str]] = []
        self.open: list[tuple[str, object, list[str]]] = []  # tag, what its text belongs to, text
        self.inside: list[list[str]] = []  # cells of the open rows

    def read(self, page: str) -> None:
        """A whole page. Plain markup is cut at its tags by one expression; any other page goes through the parser, with the same result."""
        parts = TAG.split(page)
        names, attributes = [x.lower() for x in parts[2::4]], "".join(filter(None, parts[3::4]))
        if "<" in "".join(parts[::4]) or not PLAIN.issuperset(names) or attributes.count("&") != attributes.count("&amp;"):
            self.feed(page)
            self.close()
            return
        if parts[0]:
            self.handle_data(unescape(parts[0]))
        for end, tag, attrs, data in zip(parts[1::4], names, parts[3::4], parts[4::4], strict=True):
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(k.lower(), v.replace("&amp;", "&")) for k, v in ATTRIBUTE.findall(attrs)] if attrs else ())
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
        self.end()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        target = None
        if tag == "a" and found.get("href") is not None:
            target = {"pos": len(self.links), "href": found["href"], "text": "", "cells": self.inside[-1] if self.inside else None}
            self.links.append(target)
        if tag in VOID:
            return
        if tag == "tr":
            self.rows.append([])
            self.inside.append(self.rows[-1])
        elif tag == "td":
            target = "cell"
        elif tag == "div" and "line" in (found.get("class") or "").split():
            target = "line"
        self.open.append((tag, target, []))

    def handle_endtag(self, tag):
        if not (self.open and self.open[-1][0] == tag) and not any(x[0] == tag for x in self.open):
            return
        while True:
            name, target, texts = self.open.pop()
            text = " ".join(" ".join(texts).split()) if texts else ""
            if target == "cell" and self.inside:
                self.inside[-1].append(text)
            elif target == "line":
                self.lines.append({"pos": len(self.lines), "text": text})
            elif isinstance(target, dict):
                target["text"] = text
            if name == "tr" and self.inside:
                self.inside.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if bare := data.strip():
            for _, target, texts in self.open:
                if target is not None:
                    texts.append(bare)

    def close(self):
        super().close()
        self.end()

    def end(self):
        while self.open:
            self.handle_endtag(self.open[-1][0])


def parsed(html: str | None) -> Pieces:
    parser = Pieces()
    if html:
        parser.read(html)
    return parser


def pieces(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, links, lines, rows): one row for each page, parsed once."""
    kinds = {k: to_arrow_type(v) for k, v in PIECES.items()}
    schema = t.StructType([pages.schema[key], *(t.StructField(k, v) for k, v in PIECES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(p, k) for p in found], v) for k, v in kinds.items())], [key, *kinds])

    return pages.select(key, html).mapInArrow(run, schema)


class Addresses(HTMLParser):
    """The links' addresses alone: nothing is kept of a page's texts and tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.found.append(href)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href) of all links."""
    schema = t.StructType([pages.schema[key], t.StructField("hrefs", t.ArrayType(t.StringType()))])

    def addresses(page: str | None) -> list[str]:
        parser = Addresses()
        if page and "<a" in page.lower():
            parser.feed(page)
            parser.close()
        return parser.found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([addresses(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, "hrefs"])

    return pages.select(key, html).mapInArrow(run, schema).select(key, F.posexplode("hrefs").alias("pos", "href"))


def inventory(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, pos, value) of what a page holds: links, dates of its text, rows of its tables; to look into an unknown page."""
    found = pieces(pages, key, html)
    dates = pages.select(key, F.lit("date").alias("kind"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1))).alias("pos", "value"))
    rows = found.select(key, F.lit("row").alias("kind"), F.posexplode(F.transform("rows", lambda r: F.array_join(r, " | "))).alias("pos", "value"))
    hrefs = found.select(key, F.lit("link").alias("kind"), F.posexplode(F.transform("links", lambda x: F.concat(F.lit("["), x["text"], F.lit("] "), x["href"]))).alias("pos", "value"))
    return hrefs.unionByName(dates).unionByName(rows)


def listing_rows(pages: DataFrame, key: str, html: str, minutes: bool = False) -> DataFrame:
    """Result rows of listings, the first link of each consultation of a page; minutes: the variant of award-minutes listings.

    The variant needs one date in any cell, marks an absent reference as empty
    and takes a dash without a space after it.
    """
    usable = lambda x: x["href"].contains("EntrepriseDetailConsultation") & F.forall(F.array(*T.url_keys(x["href"])), lambda k: k.isNotNull())
    hits = F.filter("links", usable if minutes else lambda x: usable(x) & x["cells"].isNotNull())
    names = F.transform(hits, lambda x: F.concat_ws("&", *T.url_keys(x["href"])))
    first = F.filter(F.arrays_zip(hits.alias("link"), names.alias("name")), lambda x, i: F.array_position(names, x["name"]) == i + 1)
    rows = pieces(pages, key, html).select(key, F.explode(F.transform(first, lambda x: x["link"])).alias("link")).select(key, "link.*").where("cells is not null")
    pattern = r"^(?U:\s*)(\S+)(?U:\s+)-" + ("" if minutes else r"(?U:\s)")
    named = F.filter(F.transform("cells", lambda c: F.regexp_extract(c, pattern, 1)), lambda x: (x != "") & ~x.rlike(r"^\d{2}/\d{2}/\d{4}\b"))
    reference = F.get(named, F.lit(0))
    dates = F.regexp_extract_all(F.array_join("cells", " | "), F.lit("(" + T.DATE + ")"), F.lit(1))
    as_date = lambda c: F.try_to_date(c, "dd/MM/yyyy")
    if minutes:
        valid = F.filter(F.transform("cells", lambda c: T.parse_date(c)), lambda x: x.isNotNull())
        extra = [F.coalesce(reference, F.lit("")).alias("reference"), F.get(valid, F.lit(0)).alias("date_publication")]
    else:
        two = F.size(dates) >= 2
        extra = [reference.alias("reference"), F.when(two, as_date(F.get(dates, F.lit(0)))).alias("date_mise_ligne"), F.when(two, as_date(F.element_at(dates, -1))).alias("date_limite_remise_plis")]
    ref, org = T.url_keys(F.col("href"))
    return rows.select(key, "pos", ref.alias("refConsultation"), org.alias("orgAcronyme"), T.absolute_url(F.col("href")).alias("detail_url"), *extra)


def dossier(found: Column) -> tuple[Column, Column]:
    """(address, public) of the dossier among links (pos, href): a direct one is public, else the first gated one is not; null without one."""
    gated = lambda x: F.lower(x["href"]).contains("demandetelechargementdce")
    named = F.transform(F.filter(found, lambda x: F.lower(x["href"]).contains("dce")), lambda x: F.named_struct(F.lit("gated"), gated(x), F.lit("pos"), x["pos"], F.lit("href"), x["href"]))
    best = F.array_min(named)
    return T.absolute_url(best["href"]), ~best["gated"]


def downloadability(found: DataFrame, key: str) -> DataFrame:
    """The dossier's link by page, from links (key, pos, href)."""
    address, public = dossier(F.col("links"))
    by_page = found.groupBy(key).agg(F.collect_list(F.struct("pos", "href")).alias("links"))
    return by_page.select(key, address.alias("dossier_consultation_url"), public.alias("is_publicly_downloadable")).where("is_publicly_downloadable is not null")


def detail_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One record for each page: every field typed or null, unknown labels in extras."""
    label, value = T.split_label(F.col("text"))
    address, public = dossier(F.col("links"))
    blocks = pieces(pages, key, html).select(key, address.alias("url"), public.alias("public"), F.inline_outer("lines"))
    blocks = blocks.select(key, "url", "public", "pos", F.when(F.col("text") != "", label).alias("label"), value.alias("value"))
    blocks = blocks.select(key, "url", "public", "pos", F.when(F.col("label").isNotNull(), T.normalize_label(F.col("label"))).alias("label"), F.col("value").alias("raw"), T.squeeze(F.col("value")).alias("value"))
    # a column for each step, for an expression that names a step twice computes it twice
    blocks = blocks.withColumn("value", T.undecorated(F.col("value"))).withColumn("value", T.present(F.col("value")))
    blocks = blocks.withColumn("low", F.lower(F.coalesce("label", F.lit("")))).withColumn("field", T.field_of(F.col("low"))).drop("low")
    blocks = blocks.withColumn("amount", T.amount_digits(F.when(F.col("field").isin(*T.AMOUNTS), F.col("value")))).withColumn("amount", T.amount_bare(F.col("amount"))).withColumn("amount", T.amount_of(F.col("amount")))
    blocks = blocks.withColumn("day", T.parse_date(F.when(F.col("field") == "date_limite_remise_plis", F.col("raw")))).withColumn("flag", F.lower(F.when(F.col("field").isin(*T.FLAGS), F.col("value"))))
    blocks = blocks.withColumn("typed", T.typed_text(*map(F.col, ("field", "value", "amount", "day")), T.flag_of(F.col("flag"))))
    held = lambda f: (F.col("field") == f) & F.col("typed").isNotNull()
    pick = lambda f: F.min_by("typed", F.when(held(f), F.col("pos"))).alias(f)
    unknown = F.col("field").isNull() & F.col("value").isNotNull() & (F.col("label") != "")
    extras = F.array_sort(F.collect_list(F.when(unknown, F.struct("pos", "label", "value")))).alias("extras")
    out = blocks.groupBy(key).agg(*map(pick, FIELD_ALIASES), F.first("url").alias("dossier_consultation_url"), F.first("public").alias("is_publicly_downloadable"), extras)
    kinds = {"estimation_dhs_ttc": "double", "caution_provisoire": "double", "allotissement": "boolean", "reserve_tpe_pme": "boolean", "date_limite_remise_plis": "date"}
    fields = [F.col(f).cast(kinds.get(f, "string")).alias(f) for f in FIELD_ALIASES]
    labels = F.transform("extras", lambda x: x["label"])
    once = F.filter("extras", lambda x, i: F.array_position(labels, x["label"]) == i + 1)  # the first value of a label
    named = F.map_from_entries(F.array_sort(F.transform(once, lambda x: F.struct(x["label"], x["value"]))))
    return out.select(key, *fields, F.lit(None).cast("date").alias("date_mise_ligne"), "dossier_consultation_url", "is_publicly_downloadable", named.alias("extras"))


def form_state(page: str, current: str) -> tuple[dict[str, str], str]:
    """Fields a form would send, and its absolute address; raises if there is no form. For the portal connector."""
    from urllib.parse import urljoin

    class Form(HTMLParser):
        def __init__(self):
            super().__init__()
            self.data, self.action, self.select, self.picked, self.inside = {}, None, None, False, False

        def handle_starttag(self, tag, attrs):
            got = dict(attrs)
            if tag == "form" and self.action is None:
                self.action, self.inside = got.get("action") or current, True
            if not self.inside:
                return
            if tag == "input" and got.get("name"):
                kind = (got.get("type") or "text").lower()
                if kind in ("checkbox", "radio"):
                    if "checked" in got:
                        self.data[got["name"]] = got.get("value", "on")
                elif kind != "submit":
                    self.data[got["name"]] = got.get("value") or ""
            elif tag == "select" and got.get("name"):
                self.select, self.picked = got["name"], False
                self.data[self.select] = ""
                self.first = True
            elif tag == "option" and self.select and (self.first or ("selected" in got and not self.picked)):
                self.data[self.select] = got.get("value") or ""
                self.first, self.picked = False, self.picked or "selected" in got

        def handle_endtag(self, tag):
            if tag == "select":
                self.select = None
            elif tag == "form":
                self.inside = False

    form = Form()
    form.feed(page)
    if form.action is None:
        raise ValueError("the page has no form")
    return form.data, urljoin(current, form.action)


