"""Segments against brute force, calibration, held-out accuracy and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tendril.llm import toxic_segments as t


def plain_segments(x):
    """All maximal segments by recursion: the best contiguous run, then what is left and right of it."""
    best, at = 0.0, None
    for i in range(len(x)):
        total = 0.0
        for j in range(i, len(x)):
            total += x[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return plain_segments(x[:a]) + [(a, b, best)] + [(b + i, b + j, s) for i, j, s in plain_segments(x[b:])]


def test_segments_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.normal(-0.3, 1, rng.integers(0, 30))
        got = [(a, b) for a, b, _ in t.maximal_segments(x)]
        assert got == [(a, b) for a, b, _ in plain_segments(x.tolist())]
        assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in t.maximal_segments(x))


def test_decay_solves_its_equation():
    values, counts = np.array([-0.5, 1.0, 3.0]), np.array([90.0, 8.0, 2.0])
    root = t.decay_of(values, counts)
    assert root > 0 and abs((counts / counts.sum() * np.exp(root * values)).sum() - 1) < 1e-6


def test_held_out_accuracy_and_passages(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = t.fit(docs, labels)
    out = t.score(docs, model).join(labels, "doc_id").where("held_out")
    got = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert got[0] > 0.95 and got[1] > 0.8
    assert t.passages(docs, model).where("end_word <= first_word or expected >= 0.01").count() == 0


def test_odd_rows(spark):
    texts = [None, "", "123", "fine words here", "bad nastyword here", "bad nastyword there"] + ["fine words here", "bad nastyword"] * 20 + ["long " * 100_000]
    docs = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(texts)], "doc_id long, text string, score double")
    labels = docs.where("text is not null and text <> ''").select("doc_id", F.col("text").contains("nasty").cast("int").alias("toxic"))
    for model in (t.fit(docs, labels), t.fit(docs, labels.where("toxic = 0")), t.fit(docs, labels.limit(0))):
        out = t.score(docs, model).collect()
        assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert out[0].score == out[1].score == out[2].score
    assert t.score(docs.limit(0), model).count() == 0


def test_falling_sums_are_scanned_in_linear_time():
    import time

    n = 30_000
    scores = np.tile([1.0, -2.0], n)
    began = time.process_time()
    found = t.maximal_segments(scores)
    assert time.process_time() - began < 2
    assert found == [(2 * i, 2 * i + 1, 1.0) for i in range(n)]


WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def forms(word):
    """The hashed features of a word, as the operator names them."""
    return [int(h[0]) for h in t.features(pa.array([word]))[1] if h[0]]


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_score(model, text, table):
    """The probability of one document by loops over its words and all their runs."""
    w = plain_words(text)
    x = []
    for word in w:
        names = [word, *(f"{word[:n]}/{n}" for n in t.STEMS if len(word) > n)]
        x.append(next((table[k] for k in names if k in table), 0.0) - t.COST)
    logs = [math.log(model.scale * len(w)) - model.decay * s for _, _, s in plain_segments(x)]
    best = max((-(v if v < -20 else math.log(-math.expm1(-math.exp(min(v, 5))))) / math.log(10) for v in logs), default=0.0)
    total = sum(-v / math.log(10) for v in logs if v < math.log(t.EVALUE))
    a, b, c = model.weights
    return 1 / (1 + math.exp(-(a + b * math.log1p(best) + c * math.log1p(total))))


def test_scores_against_plain_loops(spark):
    import random

    rng = random.Random(2)
    clean, bad = [f"wört{i}" for i in range(40)], ["idiotisch", "idiot", "scum"]
    rows = []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 40))]
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "scum idiots scum"), (9_001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    # the lexicon by plain counts
    seen, counts = set(), {0: Counter(), 1: Counter()}
    for i, text, y in sorted(rows, key=lambda r: (r[1], r[2])):
        if zlib.crc32(str(i).encode()) % 5 and text not in seen:
            seen.add(text)
            for word in plain_words(text):
                counts[y].update([word, *(f"{word[:n]}/{n}" for n in t.STEMS if len(word) > n)])
    whole = Counter()
    for r in docs.collect():
        for word in plain_words(r.text):
            whole.update([word, *(f"{word[:n]}/{n}" for n in t.STEMS if len(word) > n)])
    size = [sum(n for k, n in counts[y].items() if "/" not in k) + 1 for y in (0, 1)]
    all_tokens = sum(n for k, n in whole.items() if "/" not in k)
    table = {}
    for k in counts[0] | counts[1]:
        bad_n, good_n = counts[1][k], counts[0][k]
        if "/" not in k and bad_n + good_n < t.MIN_COUNT:
            continue
        prior = t.PRIOR * min(size)
        a = prior * (whole[k] + 0.5) / (all_tokens + 1)
        value = math.log((bad_n + a) / (size[1] + prior - bad_n - a)) - math.log((good_n + a) / (size[0] + prior - good_n - a))
        share = size[1] / sum(size)
        part = lambda n, e: n * math.log(n / e) if n else 0.0
        z = math.sqrt(max(0.0, 2 * (part(bad_n, (bad_n + good_n) * share) + part(good_n, (bad_n + good_n) * (1 - share)))))
        table[k] = value * max(0.0, 1 - (t.SHRINK / max(z, 1e-12)) ** 2)
    named = {}
    for k in table:
        if "/" in k:
            n = int(k[-1])
            named[k] = forms(k[:-2] + "x")[1 + [m for m in t.STEMS if len(k) - 1 > m].index(n)]
        else:
            named[k] = forms(k)[0]
    got = dict(zip(model.lexicon.hashes.tolist(), model.lexicon.scores.tolist(), strict=True))
    assert set(got) == set(named.values()) and all(abs(got[named[k]] - v) < 1e-9 for k, v in table.items())
    assert any(v < 0 for v in table.values()) and any(v > 0 for v in table.values())
    out = t.score(docs, model).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == 302 and all(abs(r.score - plain_score(model, text[r.doc_id], table)) < 1e-9 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_beginnings_are_code_points():
    words, found = t.features(pa.array(["日本語日本語日", "abcdefg", "abcd", None]))
    assert [(h > 0).tolist() for h in found] == [[True] * 3, [True, True, False], [True, True, False]]
    assert words.heads(4).tolist() == [12, 25, 32] and words.heads(6).tolist() == [18, 27, 32]


def test_fit_does_not_depend_on_arrival(spark):
    docs = spark.createDataFrame([(i % 60, f"text {i} {'nasty' if i % 60 % 2 else 'fine'} " * 6) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    a, b = t.fit(docs, labels, max_rows=40), t.fit(docs.orderBy("text").repartition(5), labels.repartition(3), max_rows=40)
    assert (a.lexicon.hashes == b.lexicon.hashes).all() and a.weights == b.weights and a.decay == b.decay
