"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A template is the distinct words of a notice; a block is any run of words of a
document, lines or not, that is as long as the notice and a quarter more, so a
wrapped notice or one with marks between its words is found and words that
stand far apart are not one. A pair is found if the block holds at least
THRESHOLD of the template's words.

The words of a document are cut into tiles, each as long as two of the longest
blocks and overlapping by one, so every block lies in a tile. Words are ordered
by how many documents hold them, rarest first (a count over all documents). A
tile that holds a block which shares alpha words with a template of m words
shares one of its m - alpha + 1 rarest (prefix filter), has alpha words of
templates itself (length filter), and from the first common word on both still
have enough words left (positional filter). Survivors are checked exactly,
block by block. Only tiles with a prefix word leave their row.

Templates are a table (label, notice), NOTICES by default; several notices may
have one label. The driver reads up to TEMPLATE_BYTES of them at once; a larger
table is dealt to groups of about that size, each joined with the same stored
words in a pass of its own, so every notice is looked for. Beside the join stand the places of fixed phrases, counted in words
of a whole text.

Edge cases: a null text is empty, has no words and no labels; one block may
match several templates, and of several blocks the best gives the score;
notices without words match nothing; repeated rows give equal rows; a doc_id
may be null or repeated; very long texts are cut into tiles like others; an
empty table gives no rows; columns of the input with other names are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.session import stored

from .notices import NOTICES

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.85
#: A block's length over that of the notice.
SLACK = 1.25
#: Bytes of notices that the driver holds and tasks are sent at once; a notice that is longer is a group by itself.
TEMPLATE_BYTES = 1 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a lower-case text, in order."""
    return F.array_remove(F.split(text, BREAK), "")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def needed(size: int, threshold: float) -> int:
    """The least overlap that meets the threshold for a template of `size` words."""
    return math.ceil(threshold * size - 1e-9)


class Template:
    """A notice's label, distinct words, the length of its blocks and the overlap it needs."""

    def __init__(self, number: int, label: str, notice: str, threshold: float):
        found = [w for w in re.split(BREAK, notice.translate(str.maketrans(UPPER, LOWER))) if w]
        self.number, self.label, self.words = number, label, sorted(set(found))
        self.wide, self.alpha = math.ceil(SLACK * len(found)), needed(len(set(found)), threshold)

    def order(self, counts: dict[str, int]) -> None:
        """Puts the words in the global order, rarest first."""
        self.words.sort(key=lambda w: (counts[w], w))

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.alpha + 1]


def templates_of(notices: list[tuple[str, str]], threshold: float) -> list[Template]:
    """The templates of notices (label, notice) that have words."""
    made = [Template(i, label, notice, threshold) for i, (label, notice) in enumerate(notices)]
    return [t for t in made if t.words]


def groups_of(notices: list[tuple[str, str]] | DataFrame, threshold: float, limit: int) -> Iterator[list[Template]]:
    """The templates of a list, or of a table in groups of about `limit` bytes, one group after the other."""
    if not isinstance(notices, DataFrame):
        yield templates_of(notices, threshold)
        return
    rows = notices.select("label", "notice").dropna()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("notice")), F.lit(0))).first()[0]
    parts = 1 if size <= limit else math.ceil(2 * size / limit)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("label", "notice"), F.lit(parts)))
    for part in range(parts):
        yield templates_of(sorted((r.label, r.notice) for r in dealt.where(F.col("part") == part).collect()), threshold)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the templates."""
    found = docs.select(F.explode(F.array_intersect(words(lowered(F.col("text"))), F.array(*map(F.lit, vocabulary)))).alias("word"))
    # one row for each word of the templates at most
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def phrase_places(text_words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first, last) of a phrase: how often its words stand in a row, and the word numbers."""
    parts = phrase.split(" ")
    joined = F.concat(F.lit(" "), F.array_join(text_words, "  "), F.lit(" "))
    cut = F.split(joined, " " + "  ".join(parts) + " ")
    here = F.array_contains(text_words, parts[0]) & F.array_contains(text_words, parts[-1])
    count = lambda piece: F.size(F.array_remove(F.split(piece, " "), ""))
    places = F.when(here, F.size(cut) - 1).otherwise(0)
    first = F.when(here & (F.size(cut) > 1), count(cut[0]))
    last = F.when(here & (F.size(cut) > 1), n_words - count(F.element_at(cut, -1)) - len(parts))
    return places.cast("long"), first.cast("long"), last.cast("long")


def tiles(text_words: Column, step: int) -> Column:
    """Runs of 2 * step words, one from every step-th word on: every run of step + 1 words lies in one."""
    last = F.greatest(F.ceil(F.size(text_words) / step).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(text_words, k * step + 1, 2 * step))


def containments(blocks: DataFrame, templates: list[Template], counts: dict[str, int]) -> DataFrame:
    """blocks: (row, tile), tiles of lower-case words. (row, label, containment) of all pairs with a block that meets the threshold."""
    spark = blocks.sparkSession
    order = sorted(counts, key=lambda w: (counts[w], w))
    least = min(t.alpha for t in templates)
    prefixes = [(w, i, t.number) for t in templates for i, w in enumerate(t.prefix)]
    # a row for each prefix word of the templates, and one for each template
    side = F.broadcast(spark.createDataFrame(prefixes, "word string, i int, number int"))
    known = F.broadcast(spark.createDataFrame([(t.number, t.label, len(t.words), t.alpha, t.wide, t.words) for t in templates], "number int, label string, m int, alpha int, wide int, template array<string>"))
    held = F.array_intersect(F.array(*map(F.lit, order)), F.col("tile"))  # in the global order
    sets = blocks.select("row", "tile", held.alias("held")).where(F.size("held") >= least)
    probes = sets.select("row", "tile", "held", F.posexplode(F.slice("held", 1, F.size("held") - least + 1)).alias("j", "word"))
    size = F.size("held")
    room = F.least(F.col("m") - F.col("i"), size - F.col("j"))
    pairs = probes.join(side, "word").join(known, "number").where((size >= F.col("alpha")) & (room >= F.col("alpha")))
    pairs = pairs.where(F.size(F.array_intersect("held", "template")) >= F.col("alpha"))
    # of one tile and template, the pair of their first common prefix word
    first = pairs.where(F.col("word") == F.get(F.array_intersect("held", "template"), F.lit(0)))
    # a block that starts with a word of the template holds all that one before it holds
    starts = F.filter(F.transform("tile", lambda w, i: F.when(F.array_contains("template", w), i)), lambda i: i.isNotNull())
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("tile", i + 1, F.col("wide")), F.col("template")))))
    found = first.select("row", "label", "m", "alpha", overlap.alias("overlap")).where("overlap >= alpha")
    return found.select("row", "label", (F.col("overlap") / F.col("m")).alias("containment"))


def candidate_tiles(text_words: Column, templates: list[Template], vocabulary: list[str]) -> Column:
    """The tiles of a text that may hold a block of some template; null for a text without a prefix word."""
    if not templates:
        return F.lit(None).cast("array<array<string>>")
    rare = F.array(*map(F.lit, sorted({w for t in templates for w in t.prefix})))
    step, least = max(t.wide for t in templates), min(t.alpha for t in templates)
    known = F.array(*map(F.lit, vocabulary))
    kept = F.filter(tiles(text_words, step), lambda x: F.arrays_overlap(x, rare) & (F.size(F.array_intersect(x, known)) >= least))
    # only documents with a prefix word of some template can hold a block that matches
    return F.when(F.arrays_overlap(text_words, rare), kept)


def ordered(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """The words' counts over all documents, by which the templates' words are put in order."""
    counts = frequencies(docs, sorted({w for t in templates for w in t.words})) if templates else {}
    for t in templates:
        t.order(counts)
    return counts


def scan(docs: DataFrame, notices: list[tuple[str, str]] | DataFrame = NOTICES, threshold: float = THRESHOLD, limit: int = TEMPLATE_BYTES) -> DataFrame:
    """doc_id, word and phrase counts, first and last place, base labels, all labels and a score."""
    groups = groups_of(notices, threshold, limit)
    templates = next(groups)
    more = next(groups, None)
    counts = ordered(docs, templates)
    base = docs.select("doc_id", lowered(F.col("text")).alias("_text")).select("doc_id", words(F.col("_text")).alias("_words"))
    base = base.withColumn("n_words", F.size("_words").cast("long"))
    found = {label: phrase_places(F.col("_words"), F.col("n_words"), phrase) for phrase, label in PHRASES.items()}
    named = base.select(
        "doc_id",
        "n_words",
        sum((p[0] for p in found.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(p[1] for p in found.values())).alias("first_word"),
        F.greatest(*(p[2] for p in found.values())).alias("last_word"),
        F.array_compact(F.array(*(F.when(found[label][0] > 0, F.lit(label)) for label in sorted(found)))).alias("_base"),
        candidate_tiles(F.col("_words"), templates, sorted(counts)).alias("_tiles"),
        *([F.col("_words")] if more is not None else []),  # for the passes of further groups
    )
    rows = stored(named.withColumn("row", F.monotonically_increasing_id()), "scan")

    def joined(tiled: Column, templates: list[Template], counts: dict[str, int]) -> DataFrame:
        blocks = rows.select("row", tiled.alias("_tiles")).where(F.size("_tiles") > 0).select("row", F.explode("_tiles").alias("tile"))
        return containments(blocks, templates, counts) if templates else docs.sparkSession.createDataFrame([], "row long, label string, containment double")

    pairs = joined(F.col("_tiles"), templates, counts)
    while more is not None:
        counts = ordered(docs, more)
        pairs = pairs.unionByName(stored(joined(candidate_tiles(F.col("_words"), more, sorted(counts)), more, counts), "matches"))
        more = next(groups, None)
    hits = pairs.groupBy("row").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    out = rows.drop("_tiles", "_words").join(hits, "row", "left")
    labels = F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))), ",")
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def oracle(notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan(documents): every block that starts with a word of a template, without filters."""
    cut = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = ", ".join("({}, '{}', [{}], {}, {})".format(t.number, t.label, ", ".join(f"'{w}'" for w in t.words), t.alpha, t.wide) for t in templates_of(notices, threshold))
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(len(w) - {len(parts) - 1}), lambda i: {test}), lambda i: {{'i': i, 'label': '{label}'}})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
worded AS (SELECT r, doc_id, {cut.format('t')} AS w FROM docs),
placed AS (SELECT r, doc_id, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS p FROM worded),
templates(number, label, words, alpha, wide) AS (VALUES {values}),
near AS (SELECT r, w, templates.* FROM worded, templates WHERE len(list_intersect(w, words)) >= alpha),
blocks AS (SELECT r, label, words, alpha, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i])), lambda i: w[i:i + wide - 1])) AS block FROM near),
pairs AS (SELECT r, label, len(list_intersect(block, words)) / len(words) AS c FROM blocks WHERE len(list_intersect(block, words)) >= alpha),
best AS (SELECT r, list(DISTINCT label) AS more, max(c) AS c FROM pairs GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(p, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.i)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM placed LEFT JOIN best USING (r)"""
