"""Divergence audit of sources: how the term distribution of each source differs from the others of its language.

A byte-level tokenizer finds the terms of a slice's concatenated UTF-8 buffer
by a table of bytes, groups them by xxhash and verifies each by its bytes, so
each distinct term of a slice leaves the worker once, with its occurrences and
documents. Spark sums these by (lang, source, term) and keeps the terms of
enough documents of their language.

Kept counts are dealt to blocks of a language's terms; a block is a CSR matrix
of sources by terms. The L1 divergence of a source from all others takes one
gather over the matrix and one reduceat: |p - q| where the other source has the
term, and what is left, against that source's share of an absent term, by
sorted prefix sums. So a block costs sources times its counts, not sources
squared times terms. Shares are whole numbers of billionths; every sum is exact.

A language with very many terms has many blocks, a term with very many sources
fills one by itself; each block holds all sources of its language once, for a
source differs from others also where it lacks a term.

Edge cases: null texts, languages and sources are ''; a group without terms has
N = 0 and shares of 1 / V each; a language without kept terms has pairs of
divergence 0 and no term rows; a language of one source has no pairs; ties go
by the item's UTF-8 bytes; repeated rows are documents of their own; an empty
table gives an empty result; columns of other names are ignored. A text is one
row's work, its memory grows with its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import stored

from .common import arrow, grouped, map_arrow
from .textvec import LOWER, Words, byte_table, slices, text_bytes

MIN_DOCS, SMOOTHING, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Counts a block should hold, bytes of text a slice, and terms that are hashed or compared at once.
BLOCK, SLICE, HASHED = 1 << 18, 1 << 22, 1 << 16
#: Terms: runs of ASCII letters and all bytes of other characters.
LETTERS = byte_table(lambda b: b >= 0x80 or chr(b).isalpha())


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all given spans, one after the other."""
    firsts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - firsts, lengths)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b, of equal positive lengths, have equal bytes; HASHED spans at a time."""
    out = np.zeros(len(lengths), bool)
    for k in range(0, len(lengths), HASHED):
        own, each = slice(k, k + HASHED), lengths[k : k + HASHED]
        same = data[spans(a[own], each)] == data[spans(b[own], each)]
        out[own] = np.logical_and.reduceat(same, np.cumsum(each) - each)
    return out


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), HASHED):
        each = zip(starts[a : a + HASHED].tolist(), ends[a : a + HASHED].tolist(), strict=True)
        out[a : a + HASHED] = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in each]
    return out


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each span, first span of each class): spans of one hash, verified by bytes; those of other bytes are grouped again.

    A hash that stands for several different spans gives them all, in as many rounds.
    """
    kind = np.full(len(starts), -1, np.int64)
    firsts: list[np.ndarray] = []
    left, n = np.arange(len(starts)), 0
    while len(left):
        _, first, of = np.unique(keys[left], return_index=True, return_inverse=True)
        lead = left[first][of]
        length = ends[left] - starts[left]
        same = length == ends[lead] - starts[lead]
        same[same] = equal_spans(data, starts[left[same]], starts[lead[same]], length[same])
        kind[left[same]] = n + of[same]
        firsts.append(left[first])
        n += len(first)
        left = left[~same]
    return kind, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and number of documents, summed over all documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SLICE):
            data, offsets = text_bytes(part.column("text"))
            words = Words(data, offsets, LETTERS)
            if not len(words.starts):
                continue
            data = LOWER[data]
            kind, first = classes(data, words.starts, words.ends, hashes(data.tobytes(), words.starts, words.ends))
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = pair[words.rows] * len(first) + kind
            # by group and term: occurrences, and rows, which come in order
            order = np.argsort(key, kind="stable")
            key, row = key[order], words.rows[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.flatnonzero(new)
            counts = np.diff(np.append(begin, len(key)))
            n_docs = np.add.reduceat((new | np.concatenate(([True], row[1:] != row[:-1]))).astype(np.int64), begin)
            group, term = key[begin] // len(first), first[key[begin] % len(first)]
            lengths = words.ends[term] - words.starts[term]
            text = data[spans(words.starts[term], lengths)]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(term), [None, pa.py_buffer(ends), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), terms.cast(pa.string()), pa.array(counts), pa.array(n_docs)], schema=schema)

    found = map_arrow(docs.select("lang", "source", "text"), work, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), three digits at a time, so nothing overflows below 2**53 occurrences."""
    below = np.asarray(total, np.int64) + SMOOTHING * terms
    whole, rest = np.divmod(counts + SMOOTHING, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return 1 + whole


def divergences(indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, absent: np.ndarray, width: int, source: int) -> np.ndarray:
    """The sums over a block's `width` terms of |p - q| between one source and all: CSR shares, and each source's share of absent terms."""
    own = slice(indptr[source], indptr[source + 1])
    dense = np.full(width, absent[source])
    dense[indices[own]] = values[own]
    # as if the other sources had no term here
    mine = np.sort(values[own])
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(mine)))
    below = np.searchsorted(mine, absent)
    out = absent * below - sums[below] + (sums[-1] - sums[below]) - absent * (len(mine) - below) + (width - len(mine)) * np.abs(absent[source] - absent)
    # and what they have
    if len(values):
        at = dense[indices]
        change = np.abs(at - values) - np.abs(at - np.repeat(absent, np.diff(indptr)))
        some = np.flatnonzero(np.diff(indptr))
        out[some] += np.add.reduceat(change, indptr[some])
    return out


def _top(terms: pa.Array, indices: np.ndarray, value: np.ndarray, ranks: int) -> np.ndarray:
    """The places of the largest values, ties by the term's bytes."""
    if len(value) > ranks:
        least = np.partition(value, len(value) - ranks)[len(value) - ranks]
        place = np.flatnonzero(value >= least)
    else:
        place = np.arange(len(value))
    names = terms.take(pa.array(indices[place])).cast(pa.binary()).to_pylist()
    return place[sorted(range(len(place)), key=lambda i: (-value[place[i]], names[i]))[:ranks]]


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank of every group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(texts).withColumn("docs", F.sum("docs").over(of_term)).withColumn("lead", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = stored(counted.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    # a row a language and a row a group
    langs = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("terms"), F.sum("count").alias("n_lang"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna({"n": 0, "terms": 0, "n_lang": 0, "blocks": 1})
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("long").alias("count"), "n", "n_lang", "terms")
    dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "source", "count", *(F.lit(None).cast("long").alias(c) for c in ("n", "n_lang", "terms")))
    together = marks.unionByName(dealt).withColumn("key", F.concat_ws(":", "block", "lang")).repartition("lang", "block").sortWithinPartitions("key", "term", "source")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def rows(lang: str, source: str, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        repeated = lambda x: pa.array([x]).take(pa.array(np.zeros(len(items), np.int64)))
        return pa.RecordBatch.from_arrays([repeated(lang), repeated(source), repeated(part), items, pa.array(values, pa.int64())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "key"):
            table = table.combine_chunks()
            mark = pc.is_null(table["term"])
            heads, cells = table.filter(mark), table.filter(pc.invert(mark))
            lang, width_all = heads["lang"][0].as_py(), heads["terms"][0].as_py()
            sources = heads["source"].combine_chunks()
            totals = heads["n"].to_numpy()
            if not width_all:
                absent = np.zeros(len(sources), np.int64)
            else:
                absent = shares(np.zeros(len(sources), np.int64), totals, width_all)
            coded = cells["term"].combine_chunks().dictionary_encode()
            terms, column = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            row = pc.index_in(cells["source"].combine_chunks(), value_set=sources).to_numpy().astype(np.int64)
            count = cells["count"].to_numpy()
            order = np.argsort(row, kind="stable")
            row, column, count = row[order], column[order], count[order]
            indptr = np.searchsorted(row, np.arange(len(sources) + 1))
            value = shares(count, totals[row], width_all) if len(count) else np.zeros(0, np.int64)
            in_lang = np.zeros(len(terms), np.int64)
            np.add.at(in_lang, column, count)
            expected = shares(in_lang, heads["n_lang"][0].as_py(), width_all) if len(terms) else in_lang
            names = sources.to_pylist()
            for s, source in enumerate(names):
                others = np.delete(np.arange(len(names)), s)
                if len(others):
                    yield rows(lang, source, "pair", sources.take(pa.array(others)), divergences(indptr, column, value, absent, len(terms), s)[others])
                own = slice(indptr[s], indptr[s + 1])
                above = value[own] - expected[column[own]]
                more = np.flatnonzero(above > 0)
                if len(more):
                    best = more[_top(terms, column[own][more], above[more], term_ranks)]
                    yield rows(lang, source, "term", terms.take(pa.array(column[own][best])), above[best])

    found = arrow(together, work, "lang string, source string, part string, item string, value long")
    total = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return total.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= term_ranks))


def oracle() -> str:
    """DuckDB SQL of the audit."""
    share = f"1 + ({SCALE} * (CAST({{0}} AS HUGEINT) + {SMOOTHING})) // ({{1}} + {SMOOTHING} * {{2}})"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
langs AS (SELECT lang, sum(n) AS n_lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n_group FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share.format("coalesce(c.n, 0)", "coalesce(t.n_group, 0)", "l.v")} AS p, {share.format("k.n", "l.n_lang", "l.v")} AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
QUALIFY part = 'pair' OR rank <= {TERM_RANKS}"""
