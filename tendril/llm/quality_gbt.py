"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a text come from vectorised kernels; the trees are grown
with histograms under monotonic constraints, then flattened into numpy node
arrays, so a batch of rows is scored level by level without a Python loop
over rows. They are fitted on a bounded sample: at most `max_rows` labelled
ids by hash order, one row for each id, whatever order rows arrive in. Fewer
than `least_rows` labelled rows, or labels of one class only, are no basis for
trees; the base rule then decides alone and quality_score is 1.

Edge cases: a null or empty text has zero words and fails the base rule;
texts under five words have no window; very long texts are one slice of their
own, with work space in proportion to their length; a row without an id is
scored and teaches nothing; repeated rows get equal verdicts, and a score equal
to the threshold is kept; an empty table gives no rows; other columns of the
input pass through untouched under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, map_arrow
from .textvec import NONSPACE, Words, byte_table, row_sums, slices, text_bytes, window_hashes

#: Rows of labels that a fit may read; bounds the driver's share of the work.
MAX_LABEL_ROWS = 20_000
#: Labelled rows below which no trees are grown.
LEAST_ROWS = 50
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SYMBOLS = byte_table(lambda b: chr(b) in "#*$%&|<>")
UPPER = byte_table(lambda b: 65 <= b <= 90)
DIGIT = byte_table(lambda b: 48 <= b <= 57)
PUNCT = byte_table(lambda b: 33 <= b < 127 and not chr(b).isalnum())
STOP = byte_table(lambda b: chr(b) in ".,;:")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "stop_rate", "line_words", "symbol_end_rate")
#: -1: the verdict never improves as the feature grows.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "symbol_end_rate": -1}


def statistics(array: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of the texts, and the feature matrix."""
    data, offsets = text_bytes(array)
    words = Words(data, offsets, NONSPACE)
    inside = words.flag
    chars = inside & ((data & 0xC0) != 0x80)
    count = lambda table: row_sums(table[data], offsets)
    n, word_chars, symbols = words.counts, row_sums(chars, offsets), count(SYMBOLS)

    repeat = np.zeros(len(n), np.int64)
    hashes = words.hashes()
    wins, at, rows = window_hashes(hashes, words.bounds, WINDOW)
    if len(wins):
        order = np.lexsort((wins, rows))
        w, r = wins[order], rows[order]
        same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(w), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(hashes) + 1, np.int64)
        first = at[order[twice]]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + WINDOW, -1)
        repeat = row_sums(np.cumsum(edge[:-1]) > 0, words.bounds)

    dup, lines = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(row_sums(data == 10, offsets) > 0):
        parts = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i], dup[i] = max(len(parts), 1), len(parts) - len(set(parts))

    last = np.zeros(len(data), bool)
    last[words.ends - 1] = True
    ends = row_sums(last & PUNCT[data] & ~STOP[data], offsets)
    size = np.maximum(word_chars, 1)
    per = np.maximum(n, 1)
    features = np.column_stack([np.log1p(n), word_chars / per, symbols / size, dup / lines, repeat / per, count(UPPER) / size, count(DIGIT) / size, count(PUNCT) / size, count(STOP) / size, np.log1p(n / lines), ends / per])
    return dict(zip(BASE, (n.astype(np.int64), word_chars, symbols, dup, repeat), strict=True)), features


class Trees:
    """Boosted trees with logistic loss, grown by histogram splits on the driver's bounded sample.

    Nodes of all trees share flat arrays (feature, threshold, left child,
    value); the right child follows the left one, and a leaf is its own child.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, min_rows: int = 20):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.min_rows = trees, depth, rate, bins, ridge, min_rows
        self.feature, self.threshold, self.left, self.value, self.roots = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            self.roots.append(len(self.feature))
            self._grow(codes, cuts, p - y, p * (1 - p), monotone)
            self.freeze()
            margin = self.margin(x)
        return self

    def _leaf(self) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(at)
        self.value.append(0.0)
        return at

    def _grow(self, codes, cuts, grad, hess, monotone) -> None:
        todo = [(self._leaf(), np.arange(len(grad)), 0, -np.inf, np.inf)]
        best_value = lambda g, h, lo, hi: np.clip(-g / (h + self.ridge), lo, hi)
        gain = lambda g, h, v: -(g * v + 0.5 * (h + self.ridge) * v * v)
        while todo:
            at, rows, depth, lo, hi = todo.pop()
            g, h = grad[rows], hess[rows]
            total_g, total_h = g.sum(), h.sum()
            value = best_value(total_g, total_h, lo, hi)
            self.value[at] = float(value * self.rate)
            if depth == self.depth or len(rows) < 2 * self.min_rows:
                continue
            best = (1e-6, None)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                code = codes[rows, f]
                gl = np.cumsum(np.bincount(code, g, len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(code, h, len(cut) + 1))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=len(cut) + 1))[:-1]
                vl, vr = best_value(gl, hl, lo, hi), best_value(total_g - gl, total_h - hl, lo, hi)
                won = gain(gl, hl, vl) + gain(total_g - gl, total_h - hl, vr) - gain(total_g, total_h, value)
                bad = (nl < self.min_rows) | (len(rows) - nl < self.min_rows) | ((vr - vl) * monotone[f] < 0)
                won[bad] = -np.inf
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                continue
            f, k, vl, vr = best[1]
            left, right = self._leaf(), self._leaf()
            self.feature[at], self.threshold[at], self.left[at] = f, float(cuts[f][k]), left
            middle = (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[int(monotone[f])]
            goes_left = codes[rows, f] <= k
            todo += [(left, rows[goes_left], depth + 1, *bounds[0]), (right, rows[~goes_left], depth + 1, *bounds[1])]

    def freeze(self) -> Trees:
        self.nodes = tuple(np.asarray(a, t) for a, t in ((self.feature, np.int32), (self.threshold, float), (self.left, np.int32), (self.value, float)))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return flat_margin(self.nodes, np.asarray(self.roots, np.int32), self.start, self.depth, x)


def flat_margin(nodes, roots, start, depth, x: np.ndarray) -> np.ndarray:
    """Sum of leaf values over the flattened trees, one step per level for all rows and trees."""
    feature, threshold, left, value = nodes
    out = np.empty(len(x))
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        at = np.broadcast_to(roots, (len(part), len(roots))).copy()
        row = np.arange(len(part))[:, None]
        for _ in range(depth):
            low = left[at]
            at = np.where(low == at, at, low + (part[row, feature[at]] > threshold[at]))
        out[a : a + 4096] = start + value[at].sum(1)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABEL_ROWS, least_rows: int = LEAST_ROWS) -> Trees | None:
    """Trees for P(quality = 1), learnt from at most `max_rows` labelled documents; None below `least_rows` or if one class is missing."""
    sample = bounded_labels(labels, "quality", max_rows)
    # max_rows ids and labels: a size that is bounded by the parameter
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            _, x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # of texts that share an id the one with the least statistics, so max_rows rows come whatever their order
    found = map_arrow(labelled.withColumn("doc_id", F.col("doc_id").cast("long")), rows, "doc_id long, quality int, x array<double>")
    got = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if len(y) < least_rows or not 0 < y.mean() < 1:
        return None
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(len(y), -1)
    order = np.lexsort((*x.T, y))
    return Trees().fit(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"


def score(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The base counts, base verdict, quality score and final verdict of each document."""
    flat = None if model is None else (model.nodes, np.asarray(model.roots, np.int32), model.start, model.depth)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            base, x = statistics(part.column("text"))
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            quality = np.ones(len(failed)) if flat is None else 1 / (1 + np.exp(-flat_margin(*flat, x)))
            columns = [*(pa.array(base[k]) for k in BASE), pa.array(failed), pa.array(~failed & (quality >= threshold)), pa.array(quality)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *BASE, "base_failed", "kept", "quality_score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, OUT)


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    columns = docs.columns
    flat = None if model is None else (model.nodes, np.asarray(model.roots, np.int32), model.start, model.depth)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            base, x = statistics(part.column("text"))
            kept = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * base["n_words"])
            if flat is not None:
                kept &= flat_margin(*flat, x) >= np.log(threshold / (1 - threshold))
            yield part.filter(pa.array(kept)).select(columns)

    return map_arrow(docs, rows, docs.schema)
