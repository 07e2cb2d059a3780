"""Best-two-fit: ids against the tokenizer, packings against a bin-by-bin run, whole sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tendril.llm import queries
from tendril.llm import two_fit_packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    one = Tokenizer.from_file(PATH)
    one.encode_special_tokens = True
    return lambda text: [*one.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_of_odd_texts(plain):
    draw = random.Random(5)
    signs = [*"ab ZÉñß×÷.  \n\t'sé 　漢1,-", " t", "'ll", " the", "<|endoftext|>", "\r\n", "🙂"]
    encoder = P.Encoder(PATH)
    for _ in range(800):
        texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3)] + [None]
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain(t) for t in texts]


def test_what_is_remembered_does_not_matter(plain, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    encoder = P.Encoder(PATH)
    for text in ("one two three four", "two five six", "", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == plain(text)


def bin_by_bin(counts, context):
    counts, out = counts.copy(), []
    while counts.any():
        left, gap, found = counts.copy(), context, []
        while any(left[1 : gap + 1]):
            size = max(s for s in range(1, gap + 1) if left[s])
            found.append(size)
            left[size] -= 1
            gap -= size
        best = None
        if gap and len(found) > 1:
            room = gap + found[-1]
            for a in range(1, room):
                for b in range(1, min(a, room - a) + 1):
                    if left[a] and left[b] and (a != b or left[a] > 1) and a + b > found[-1] and (best is None or a + b > sum(best)):
                        best = (a, b)
        if best:
            found[-1:] = best
        for size in found:
            counts[size] -= 1
        out.append(sorted(found, reverse=True))
    return out


def test_patterns_are_a_bin_by_bin_run():
    draw = random.Random(6)
    for _ in range(150):
        counts = np.zeros(25, np.int64)
        for _ in range(draw.randint(1, 9)):
            counts[draw.randint(1, 24)] += draw.randint(1, 9)
        got = [b for b, times in P.patterns(counts, 24) for _ in range(times)]
        want = bin_by_bin(counts, 24)
        assert Counter(x for b in got for x in b) == Counter(x for b in want for x in b)
        assert all(sum(b) <= 24 for b in got)
        assert len(got) == len(want)


def test_two_fit_better_than_one():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 4]] = 1, 1, 0
    assert P.patterns(counts, 10) == [([7, 2], 1)]
    counts[1], counts[2] = 2, 1  # 7 + 2 leaves 1, which the greedy fill takes
    assert P.patterns(counts, 10) == [([7, 2, 1], 1), ([1], 1)]
    counts[:] = 0
    counts[[10, 6, 5, 4]] = 0, 1, 0, 1
    counts[3] = 1
    assert P.best_two([6, 3], np.bincount([6, 3, 2, 2], minlength=11), 10) == [6, 2, 2]
    assert P.best_two([6, 3], np.bincount([6, 3, 2], minlength=11), 10) == [6, 3]


def test_number_of_patterns_does_not_grow():
    draw = np.random.default_rng(1)
    few = np.bincount(draw.integers(1, 1025, 20_000), minlength=1025)
    assert len(P.patterns(few * 1_000_000)) < 8000


def test_cut_gives_the_first_piece_the_rest():
    row, piece, start, length = P.cut(np.array([1, 1024, 1025, 3000]))
    assert list(zip(row.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == [(0, 0, 0, 1), (1, 0, 0, 1024), (2, 0, 0, 1), (2, 1, 1, 1024), (3, 0, 0, 952), (3, 1, 952, 1024), (3, 2, 1976, 1024)]


def check(rows, texts, plain):
    """All rows of a digest table against the plain tokenizer; the bins are full and gapless."""
    encoded = Counter()
    for doc_id, text in texts:
        ids = np.array(plain(text), "<u4")
        row, piece, start, length = P.cut(np.array([len(ids)]))
        encoded.update((doc_id, int(p), int(s), int(n), zlib.crc32(ids[s : s + n].tobytes())) for p, s, n in zip(piece, start, length, strict=True))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == encoded
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= P.CONTEXT
    return len(bins)


def test_query_on_the_smallest_tables(spark, sf, plain):
    rows = queries.QUERIES["op13_two_fit_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bins = check(rows, docs, plain)
    assert bins <= 1.02 * sum(r["length"] for r in rows) / P.CONTEXT + 1


def test_edge_cases(spark, plain):
    texts = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 5000), (4, "x" * 9000), (5, "a b"), (5, "a b")]
    docs = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in texts], "doc_id long, text string, length int, task int, offset int").repartition(3)
    check(P.digests(docs).collect(), texts, plain)
    assert P.digests(docs.limit(0)).collect() == []


def test_sequences_hold_their_ids(spark, plain):
    texts = [(i, "some words here " * (i * 7 % 90)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    packed = P.pack(P.stored(P.pieces(docs), "pieces")).cache()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in P.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == r["ids"]
    packed.unpersist()
