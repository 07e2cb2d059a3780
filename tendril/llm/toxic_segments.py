"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Words and word beginnings of labelled documents are counted as tokens, by
class. A feature's log-odds between the classes come from a Dirichlet prior
that follows the background corpus: pseudo-tokens (PRIOR times those of the
rarer class), shared out by the feature's rate in all documents. The
log-odds shrink towards 0 by their uncertainty, and both signs count:
a word of clean texts speaks against a passage. A word seen fewer than
MIN_COUNT times in the sample scores like its longest known beginning, and one
without any like a neutral word. Every token also costs COST, so a passage
ends when toxic words stay away. A linear-time scan finds all maximal-scoring
segments. Under the scores' law in clean documents the best segment of n tokens
follows an extreme-value law with parameters lambda (the positive root of
E[exp(lambda * s)] = 1) and K; segments whose expected number in a clean text
of that length is below EVALUE are significant. A document's evidence is minus
the log10 p-value of its best segment and of the sum of its significant ones,
and a logistic curve over the logarithms of both turns it into the probability
of label 1.

The fit reads labels of at most `max_rows` ids by hash order, one text for
each, and keeps the `max_features` most frequent features of these: both are
parameters, and they bound what the driver and a task hold. Background counts
cover all documents.

Edge cases: null, empty and word-less texts have no segment and get the score
of no evidence; a row without an id is scored, is not held out and teaches
nothing; repeated rows score alike; equal segments stay apart; very long texts
are one slice of their own; if one class has no labelled rows the score is the
other's rate; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import stored

from .common import arrow, bounded_labels, fold_of, is_held_out, map_arrow
from .textvec import LOWER, U64, Words, byte_table, mix64, slices, text_bytes

#: Labelled rows that a fit may read, and features that it may keep.
MAX_LABEL_ROWS, MAX_FEATURES = 40_000, 200_000
#: Code points of a word's beginnings that are features, the longest first.
STEMS = (6, 4)
#: Tokens of the sample below which a word is judged by its beginning.
MIN_COUNT = 5
#: Deviations within which log-odds shrink to 0 (one of 370 chance features lies beyond 3), and what a token costs.
SHRINK, COST = 3.0, 1.0
#: Strength of the prior, as a share of the rarer class's tokens.
PRIOR = 0.002
EVALUE = 0.01
LETTERS = byte_table(lambda b: b >= 0x80 or chr(b).isalpha())


def features(array: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """The words of the texts, and the hashes of each word and of its beginnings (0: not longer than that)."""
    data, offsets = text_bytes(array)
    words = Words(data, offsets, LETTERS)
    out = [np.maximum(words.hashes(LOWER), U64(1))]
    for n in STEMS:
        head = words.heads(n)
        out.append(np.where(head < words.ends, np.maximum(mix64(words.hashes(LOWER, head) ^ U64(n)), U64(1)), U64(0)))
    return words, out


class Lexicon:
    """Scores of features, sorted by hash; hashes of words and of beginnings differ."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def score(self, array: pa.Array) -> tuple[Words, np.ndarray]:
        """The score of each token: that of its word, else of its longest known beginning, else 0; less COST."""
        words, found = features(array)
        distinct, back = np.unique(found[0], return_inverse=True)
        at = self.places(distinct)[back]
        out = np.zeros(len(at))
        out[at >= 0] = self.scores[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for h in found[1:]:
            at = self.places(h[left])
            out[left[at >= 0]] = self.scores[at[at >= 0]]
            left = left[at < 0]
        return words, out - COST


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal-scoring segments, in one pass with amortised constant work per token:
    a held segment keeps the place of the nearest earlier one with a smaller sum before it.

    Only tokens with positive scores are visited; the drift between them comes from prefix sums.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the nearest earlier one with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(held) - 1
        while j >= 0 and held[j][2] >= before:
            j = held[j][4]
        while j >= 0 and held[j][3] < after:
            start, before, earlier = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = earlier
        held.append((start, end, before, after, j))
    return [(a, b, after - before) for a, b, before, after, _ in held]


class Model:
    """Lexicon, extreme-value parameters and logistic weights."""

    def __init__(self, lexicon: Lexicon, decay: float, scale: float, weights: tuple[float, float, float]):
        self.lexicon, self.decay, self.scale, self.weights = lexicon, decay, scale, weights

    def evidence(self, array: pa.Array, segments: list | None = None) -> np.ndarray:
        """Per text: minus log10 p-value of the best segment, and significant sums (in the same unit); adds (row, start, end, E) to segments."""
        words, scores = self.lexicon.score(array)
        out = np.zeros((len(words.counts), 2))
        sums = np.concatenate(([0], np.cumsum(scores > 0)))
        for row in np.flatnonzero(sums[words.bounds[1:]] > sums[words.bounds[:-1]]).tolist():
            a, b = words.bounds[row], words.bounds[row + 1]
            found = maximal_segments(scores[a:b])
            logs = math.log(self.scale * (b - a)) - self.decay * np.array([s for _, _, s in found])  # natural log of E
            p = log_p(logs)
            good = logs < math.log(EVALUE)
            out[row] = -p.min() / math.log(10), -np.where(good, logs, 0.0).sum() / math.log(10)
            if segments is not None:
                segments += [(row, *found[k][:2], float(np.exp(logs[k]))) for k in np.flatnonzero(good)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return np.exp(-np.logaddexp(0.0, -(a + b * np.log1p(x[:, 0]) + c * np.log1p(x[:, 1]))))


def log_p(logs: np.ndarray) -> np.ndarray:
    """log(1 - exp(-E)) from log E; E itself where that is tiny, 0 where no text would lack such a segment."""
    expected = np.exp(np.clip(logs, -20.0, 5.0))  # beyond these the two branches agree to the last digit
    return np.where(logs < -20, logs, np.log(-np.expm1(-expected)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, rate: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of token counts under a Dirichlet prior of `prior` tokens a class, shared out by `rate`."""
    a = prior * rate
    return np.log((toxic + a) / (n_toxic + prior - toxic - a)) - np.log((clean + a) / (n_clean + prior - clean - a))


def deviation(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """The root of the likelihood ratio against equal rates: about a standard normal for features without a lean."""
    both, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1e-300) / expected), 0.0)
    return np.sqrt(np.maximum(2 * (part(toxic, both * share) + part(clean, both * (1 - share))), 0.0))


def shrunk(value: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Log-odds less their uncertainty: 0 within SHRINK deviations, near their value far beyond."""
    return value * np.maximum(0.0, 1 - (SHRINK / np.maximum(z, 1e-12)) ** 2)


def decay_of(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(x * s)] = 1; a small one if the mean score is not negative."""
    p = counts / counts.sum()
    if (p * values).sum() >= 0 or not (values > 0).any():
        return 0.1
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of a ridge-penalised logistic regression by Newton steps."""
    z = np.column_stack((np.ones(len(x)), np.log1p(x)))
    ridge, w = np.array([1e-6, 1e-2, 1e-2]), np.zeros(3)
    for _ in range(50):
        p = np.exp(-np.logaddexp(0.0, -(z @ w)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def sampled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(text, y): at most `max_rows` labelled texts outside the held-out fold; copies of a text count once."""
    sample = bounded_labels(labels.where(fold_of(F.col("doc_id"), folds) != held_out), "toxic", max_rows)
    # max_rows ids and labels: a size that is bounded by the parameter
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("y")).groupBy("text").agg(F.min("y").alias("y"))


def counted(rows: DataFrame) -> DataFrame:
    """(kind, name, toxic, clean): tokens of each feature by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, found = features(part.column("text"))
                toxic = (part.column("y").to_numpy(zero_copy_only=False) == 1)[words.rows]
                for kind, h in enumerate(found):
                    names, back = np.unique(h, return_inverse=True)
                    both, bad = np.bincount(back, minlength=len(names)), np.bincount(back, toxic, len(names)).astype(np.int64)
                    keep = names > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int32)), *(pa.array(v[keep].astype(np.int64)) for v in (names.view(np.int64), bad, both - bad))], ["kind", "name", "toxic", "clean"])

    return arrow(rows, run, "kind int, name long, toxic long, clean long").groupBy("kind", "name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def background(docs: DataFrame, names: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens of each feature (sorted hashes) in all documents, and all tokens; a task sends at most one row a feature."""
    known = Lexicon(names, np.zeros(len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, found = features(part.column("text"))
                total[-1] += len(words.starts)
                for h in found:
                    distinct, n = np.unique(h, return_counts=True)
                    at = known.places(distinct)
                    total[at[at >= 0]] += n[at >= 0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    got = arrow(docs.select("text"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a feature
    out = np.zeros(len(names) + 1, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = MAX_LABEL_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learns from at most `max_rows` labelled documents outside the held-out fold."""
    rows = stored(sampled(docs, labels, folds, held_out, max_rows), "labelled")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    if not n_toxic or not n_clean:
        rate = n_toxic / max(1, n_toxic + n_clean)
        return Model(Lexicon(np.empty(0, np.uint64), np.empty(0)), 1.0, 1.0, (math.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0))
    counts = stored(counted(rows), "counts")
    tokens = counts.where("kind = 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    often = counts.where((F.col("kind") > 0) | (F.col("toxic") + F.col("clean") >= MIN_COUNT))
    got = often.orderBy(F.desc(F.col("toxic") + F.col("clean")), "name").limit(max_features).toArrow()
    name, toxic, clean = (got.column(c).to_numpy().astype(np.int64) for c in ("name", "toxic", "clean"))
    order = np.argsort(name.view(np.uint64))
    name, toxic, clean = name.view(np.uint64)[order], toxic[order].astype(float), clean[order].astype(float)
    in_all, all_tokens = background(docs, name)
    rate = (in_all + 0.5) / (all_tokens + 1.0)
    sizes = float(tokens[0]) + 1, float(tokens[1]) + 1
    lexicon = Lexicon(name, shrunk(log_odds(toxic, clean, *sizes, rate, PRIOR * min(sizes)), deviation(toxic, clean, *sizes)))

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words, scores = lexicon.score(part.column("text"))
            bounds = list(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True))
            best = [max((s for _, _, s in maximal_segments(scores[a:b])), default=0.0) for a, b in bounds]
            grid = [np.unique(np.round(scores[a:b], 2), return_counts=True) for a, b in bounds]
            lists = [pa.array([g[k].tolist() for g in grid], pa.list_(t)) for k, t in ((0, pa.float64()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(words.counts.astype(np.int64)), pa.array(best, pa.float64()), *lists], ["y", "n", "best", "value", "times"])

    measured = map_arrow(rows, measure, "y int, n long, best double, value array<double>, times array<long>").where("y <> 1")
    clean_rows = stored(measured, "measured")
    hist = clean_rows.select(F.explode(F.arrays_zip("value", "times")).alias("s")).groupBy("s.value").agg(F.sum("s.times").alias("n")).orderBy("value").collect()  # a row for each hundredth
    decay = decay_of(np.array([r["value"] for r in hist]), np.array([float(r["n"]) for r in hist])) if hist else 1.0
    law = clean_rows.agg(F.count("*"), F.sum(F.col("n") * F.exp(-F.lit(decay) * F.col("best")))).first()
    scale = max(1e-12, law[0] / max(law[1] or 1.0, 1e-9))  # the likelihood's maximum for K, given lambda
    model = Model(lexicon, decay, scale, (0.0, 0.0, 0.0))

    def weigh(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            x = model.evidence(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "a", "b"])

    table = map_arrow(rows, weigh, "y int, a double, b double").toArrow()  # max_rows rows at most
    x, y = np.column_stack((table.column("a").to_numpy(), table.column("b").to_numpy())), (table.column("y").to_numpy() == 1).astype(float)
    order = np.lexsort((*x.T, y))
    model.weights = logistic(x[order], y[order])
    return model


OUT = "doc_id long, held_out boolean, score double, predicted int, n_segments int, evidence double"


def score(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Probability of label 1, verdict and number of significant passages of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out(F.col("doc_id"), folds, held_out).alias("held_out"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            found: list = []
            x = model.evidence(part.column("text"), found)
            p = model.probability(x)
            n = np.bincount([f[0] for f in found], minlength=len(p)) if found else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(x[:, 0])], ["doc_id", "held_out", "score", "predicted", "n_segments", "evidence"])

    return map_arrow(rows, run, OUT)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first and end word, expected number in a clean text, and the passage."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            found: list = []
            model.evidence(part.column("text"), found)
            if found:
                words = features(part.column("text"))[0]
                data = words.data.tobytes()
                row, a, b, e = zip(*found, strict=True)
                texts = [data[words.starts[words.bounds[r] + i] : words.ends[words.bounds[r] + j - 1]].decode("utf-8", "replace") for r, i, j in zip(row, a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64()), pa.array(texts)], ["doc_id", "first_word", "end_word", "expected", "passage"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, first_word long, end_word long, expected double, passage string")
