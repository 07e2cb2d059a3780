"""Runs against brute force on every small word, linear work on hard words, whole rows of the query."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tendril.llm import lyndon_runs as L
from tendril.llm import queries


def brute(t, repeats=4, least=6):
    """Every maximal stretch of equal words a period apart, by scanning for each period; its period must be the smallest."""
    out = []
    for p in range(1, len(t) // repeats + 1):
        i = 0
        while i + p < len(t):
            start = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            w = t[start : i + p]
            if len(w) >= max(least, repeats * p) and all(w[q:] != w[:-q] for q in range(1, p)):
                out.append((start, len(w), p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def through_pieces(t):
    out = []
    for a, b in zip(*L.pieces(np.array(t, np.int64), np.zeros(len(t), np.int64)), strict=True):
        out += [(int(a) + s, n, p) for s, n, p in L.runs(t[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_short_words():
    for n in range(13):
        for t in itertools.product((1, 2), repeat=n):
            assert L.runs(list(t)) == brute(t)
            assert L.runs(list(t), 2, 2) == brute(t, 2, 2)


def test_random_words():
    draw = random.Random(2)
    for _ in range(3000):
        t = []
        while len(t) < draw.randint(0, 60):
            t += [draw.randint(1, 3) for _ in range(draw.randint(1, 6))] * draw.randint(1, 6)
        assert L.runs(t) == brute(t) == through_pieces(t)


def test_pieces_of_long_words():
    draw = random.Random(3)
    for n in (400, 2000):
        for letters in (3, 40, 1000):
            t = [draw.randint(1, letters) for _ in range(n)] + ([draw.randint(1, letters) for _ in range(n // 8)] * 5)[: n // 2] + [draw.randint(1, letters) for _ in range(n)]
            assert through_pieces(t) == brute(t)


def test_pieces_do_not_span_rows():
    a, b = L.pieces(np.ones(10, np.int64), np.array([0] * 5 + [1] * 5))
    assert len(a) == 0
    a, b = L.pieces(np.ones(14, np.int64), np.array([0] * 7 + [1] * 7))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 7), (7, 14)]


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("name", ["one letter", "fibonacci", "thue-morse", "periodic", "ruler", "blocks"])
def test_words_are_read_a_few_times(name):
    n, draw = 20_000, random.Random(4)
    fib, more = [0], [0, 1]
    while len(more) < n:
        fib, more = more, more + fib
    root = [draw.randrange(50) for _ in range(n // 9)]
    word = {"one letter": [0] * n, "fibonacci": more[:n], "thue-morse": [i.bit_count() % 2 for i in range(n)], "periodic": (root * 10)[:n], "ruler": [(i & -i).bit_length() for i in range(1, n + 1)], "blocks": sum(([0] * k + [1] for k in range(200)), [])[:n]}[name]
    for t in (word, [-x for x in word]):
        Counted.reads = 0
        L.lyndon_edges(Counted(t))
        assert Counted.reads <= 12 * len(t)


def plain_row(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if rewrite and n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute(w)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_the_smallest_tables(spark, sf):
    got = queries.QUERIES["op12_lyndon_runs"](spark, sf)
    assert got.columns == COLUMNS
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 40_000]
    assert len(want) >= 0.9 * len(docs)
    assert any(r[1] for r in want)
    rows = {tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    assert set(want) <= rows


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y " * 4), (6, "é e\x1fz " * 9 + "end"), (7, ("p q r s " * 6 + "t ") * 5), (8, "w " * 5000), (9, "abababababab")]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in texts], "doc_id long, text string, runs string, start int")
    got = L.find(docs).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(i, t, False)) for i, t in texts)
    text = {r["doc_id"]: r["collapsed"] for r in L.find(docs).collect()}
    assert text[5] == "a" and text[None] == "x y" and text[1] == "" and text[7].split() == ["p", "q", "r", "s", "t"]
    assert L.find(docs.limit(0)).collect() == []
