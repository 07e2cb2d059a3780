"""Elias-Fano against sorted arrays, counts and scores against a plain model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tendril.llm import elias_fano_lm as lm


def test_sequences():
    rng = np.random.default_rng(5)
    for bits in (1, 7, 20, 40, 64):
        for n in (0, 1, 2, 63, 64, 65, 3000, 70_000):
            top = (1 << bits) - 1
            x = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            e = lm.EliasFano(lm.EliasFano.pack(x, bits))
            if n:
                assert (e.at(np.arange(n)) == x).all()
            if n > 1:
                assert all((a == b).all() for a, b in zip(e.two(np.arange(n - 1)), (x[:-1], x[1:]), strict=True))
            q = np.concatenate((x, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)))
            assert (e.successor(q) == np.searchsorted(x, q)).all()
            assert (e.find(q) >= 0).tolist() == np.isin(q, x).tolist()
            lo = rng.integers(0, n + 1, len(q))
            hi = np.minimum(lo + rng.integers(0, 50, len(q)), n)
            got = e.within(q, lo, hi)
            inside = np.array([bool((x[a:b] == y).any()) for a, b, y in zip(lo[:300], hi[:300], q[:300], strict=True)], bool)
            assert (got[:300] >= 0).tolist() == inside.tolist()
            assert all(x[g] == y and a <= g < b for g, y, a, b in zip(got, q, lo, hi, strict=True) if g >= 0)


def plain(rows, mu2=lm.MU2, mu3=lm.MU3):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            texts += 1
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            three.update(zip(["<s>", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    total = lambda u: texts if u == "<s>" else one[u]
    p2 = lambda u, w: (two[u, w] + mu2 * p1(w)) / (total(u) + mu2)
    p3 = lambda t, u, w: (three[t, u, w] + mu3 * p2(u, w)) / (two[t, u] + mu3)
    out = []
    for i, t in rows:
        w = tokens(t)
        framed = ["<s>", *w]
        score = math.log10(p2("<s>", w[0])) + sum(math.log10(p3(*framed[k : k + 3])) for k in range(len(w) - 1))
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return out


def agree(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert abs(g.base_score - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g.score - w[6]) <= 0.03 * w[2] + 1e-6  # quantisation per token


def test_all_documents(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = plain(rows)
    whole = lm.score(docs, lm.build(docs)).orderBy("doc_id").collect()
    agree(whole, want)
    held = [g for g in whole if g.held_out]
    assert held and sum(g.score for g in held) > sum(g.base_score for g in held)
    for name in ("SLICE", "WORD_SHARD", "TRIE_SHARD"):
        monkeypatch.setattr(lm, name, 20_000)  # many slices and shards
    monkeypatch.setattr(lm, "HEAVY", 40)  # many contexts in parts
    monkeypatch.setattr(lm, "GATHER", 500)
    agree(lm.score(docs, lm.build(docs)).orderBy("doc_id").collect(), want)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a A a a", "a b" * 100_000, "same text", "same text", "é É \xa0 x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, "again"), (9, "again")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    agree(lm.score(docs, lm.build(docs)).orderBy("doc_id").collect(), plain(rows))
    assert lm.score(docs.limit(0), lm.build(docs.limit(0))).count() == 0
    assert all(r.train_tokens == 0 for r in lm.score(docs, lm.build(docs.limit(0))).collect())


def test_larger_tables_agree_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    agree(lm.score(docs, lm.build(docs)).orderBy("doc_id").collect(), plain(sorted((r.doc_id, r.text) for r in docs.collect())))


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b d", "a b c", "b c a", "c"] * 20
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    model = lm.build(docs)
    # p(x | a, b) for all words x, and for an unknown one: a text's score less that of its beginning
    def log(*ends):
        rows = spark.createDataFrame([(i, f"a b {e}".strip()) for i, e in enumerate(ends)], "doc_id long, text string")
        return [r.score for r in lm.score(rows, model).orderBy("doc_id").collect()]

    def end(*ends):  # p(END | b, x)
        block = [lm.Block(lm.pa.array([f"a b {e}"])) for e in ends]
        out = []
        for b in block:
            reader = model.reader()
            share2, left, share3 = reader.shares(b)
            count = reader.counts(b.words)
            last = b.at[-1] - 1
            p = share2[b.pair_of[last]] + lm.MU2 / (count[b.before[last]] + lm.MU2) * model.law.unigram(count[b.token[last]])
            out.append(math.log10(share3[b.triple_of[last - 1]] + left[b.pair_of[last - 1]] * p))
        return out

    words = ["a", "b", "c", "d", "unknown"]
    head = log(*words)
    first_two = log("")[0] - end_of_two(model)
    total = sum(10 ** (h - e - first_two) for h, e in zip(head, end(*words), strict=True)) + 10 ** end_of_two(model)
    assert abs(total - 1) < 0.05


def end_of_two(model):
    """log p(END | a, b)."""
    b, reader = lm.Block(lm.pa.array(["a b"])), model.reader()
    share2, left, share3 = reader.shares(b)
    count = reader.counts(b.words)
    p = share2[b.pair_of[2]] + lm.MU2 / (count[b.before[2]] + lm.MU2) * model.law.unigram(count[b.token[2]])
    return math.log10(share3[b.triple_of[1]] + left[b.pair_of[1]] * p)


def test_heavy_contexts_are_split_by_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 500)
    monkeypatch.setattr(lm, "TRIE_SHARD", 5_000)
    monkeypatch.setattr(lm, "SLICE", 4_000)
    rows = [(i, " ".join(f"the w{(i * 50 + k) % 6000}" for k in range(50))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = lm.build(docs)
    heavy = model.reader().heavy
    assert len(heavy.words) == 1 and 2 ** heavy.bits[0] >= heavy.counts[0] / 500
    sizes = [len(lm.load(model.folder, f"trie-{s}")["code2"]) for s in range(1 << model.bits2) if lm.load(model.folder, f"trie-{s}") is not None]
    assert len(sizes) == 32 and max(sizes) < 0.15 * sum(sizes)  # the word "the" has half of all bigrams
    agree(lm.score(docs, model).orderBy("doc_id").collect(), plain(rows))


def test_many_shards_a_task_and_little_kept(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scores = lambda: [(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, lm.build(docs)).orderBy("doc_id").collect()]
    want = scores()
    for name, value in (("WORD_SHARD", 1 << 14), ("TRIE_SHARD", 1 << 13), ("MOST_TASKS", 4)):
        monkeypatch.setattr(lm, name, value)
    assert lm.dealt(spark.range(3).withColumnRenamed("id", "shard"), 6).rdd.getNumPartitions() == 4
    assert scores() == want
    model = lm.build(docs)
    assert model.bits2 > 4
    # a store without paths: levels are read and few are kept
    reader = lm.Reader(model)
    reader.keeps = False
    monkeypatch.setattr(lm, "KEPT_BYTES", 1 << 16)
    block = lm.Block(pa.array([r.text for r in docs.limit(40).collect()], pa.string()))
    whole = lm.Reader(model)
    for a, b in zip([reader.counts(block.words), *reader.shares(block)], [whole.counts(block.words), *whole.shares(block)], strict=True):
        assert (a == b).all()
    assert len(whole.held) > len(reader.held) and sum(reader.sizes.values()) < 1 << 17


def test_select():
    rng = np.random.default_rng(3)
    words = np.concatenate([rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)])
    each = np.bitwise_count(words).astype(np.int64)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    want = [i for w in words.tolist() for i in range(64) if w >> i & 1]
    assert lm.select(np.repeat(words, each), k).tolist() == want


def test_successors_are_guessed_from_their_values(monkeypatch):
    rng = np.random.default_rng(9)
    n, nodes = 100_000, 5
    node = np.sort(rng.integers(0, nodes, n)).astype(np.uint64)
    node[:3] = 0
    keys = np.unique((node << lm.TAIL) | rng.integers(0, 1 << 32, n, dtype=np.uint64))
    e = lm.EliasFano(lm.EliasFano.pack(keys, 32 + nodes.bit_length(), 32))
    assert e.low == 32 and (e.at(np.arange(len(keys))) == keys).all()
    bounds = np.searchsorted(keys >> lm.TAIL, np.arange(nodes + 1))
    want = np.concatenate((rng.integers(0, len(keys), 20_000), np.arange(3)))
    own, tails = (keys[want] >> lm.TAIL).astype(int), keys[want] & lm.U64(0xFFFFFFFF)
    probes, plain_tails = [0], lm.EliasFano.tails
    monkeypatch.setattr(lm.EliasFano, "tails", lambda self, at: probes.append(len(at)) or plain_tails(self, at))
    assert (e.among(tails, bounds[own], bounds[own + 1]) == want).all()
    assert sum(probes) < 6 * len(want)  # by halves there are 14
    # values that are not there, other nodes' values, empty ranges
    other = (own + 1) % nodes
    missing = np.isin((other.astype(np.uint64) << lm.TAIL) | tails, keys, invert=True)
    assert ((e.among(tails, bounds[other], bounds[other + 1]) < 0) == missing).all()
    assert (e.among(tails, bounds[own], bounds[own]) < 0).all()
    # values spread unevenly, which no guess finds
    odd = np.unique(np.concatenate((1 << np.arange(32, dtype=np.uint64), np.arange(2000, dtype=np.uint64), np.array([(1 << 32) - 1], np.uint64))))
    e = lm.EliasFano(lm.EliasFano.pack(odd, 33, 32))
    probes.clear()
    assert (e.among(odd, np.zeros(len(odd), np.int64), np.full(len(odd), len(odd))) == np.arange(len(odd))).all()
    assert len(probes) <= lm.GUESSES + 12


def test_distinct_codes():
    rng = np.random.default_rng(4)
    for n, top in ((0, 5), (1, 5), (5000, 300), (5000, 1 << 40), (5000, 1 << 60)):
        codes = rng.integers(0, top, n)
        codes[n // 2 :] = codes[: n - n // 2]
        want = np.unique(codes, return_inverse=True, return_counts=True)
        assert all((a == b).all() for a, b in zip(lm.distinct(codes, top), want, strict=True))
        hashes = codes.astype(np.uint64) * lm.GOLD
        assert all((a == b).all() for a, b in zip(lm.distinct_hashes(hashes), np.unique(hashes, return_inverse=True), strict=True))
    block = lm.Block(pa.array(["a b a", None]), grams=False)
    assert block.token.tolist() == lm.Block(pa.array(["a b a", None])).token.tolist() and not hasattr(block, "u")


def test_slices_are_scored_together_where_shards_are_many(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").coalesce(1)
    monkeypatch.setattr(lm, "TRIE_SHARD", 20_000)
    model = lm.build(docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    monkeypatch.setattr(lm, "SLICE", 30_000)
    alone, four = list(lm.gathered([batch], 1)), list(lm.gathered([batch], 4))
    assert len(alone) > 4 and len(four) == -(-len(alone) // 4)
    for k, held in enumerate(four):
        whole = model.reader().shares(*(b for _, b in held))
        apart = [model.reader().shares(b) for own in alone[4 * k : 4 * k + 4] for _, b in own]
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*apart, strict=True), whole, strict=True))
    tokens = [sum(len(b.token) for _, b in held) for held in alone]
    monkeypatch.setattr(lm, "MOST_TOKENS", max(tokens))
    assert all(len(h) == 1 or sum(len(b.token) for _, b in h) <= max(tokens) for h in lm.gathered([batch], 4))
    scores = lambda: [tuple(r) for r in lm.score(docs, model).orderBy("doc_id").collect()]
    want = scores()
    monkeypatch.setattr(lm, "SHARDS_A_SLICE", 1)
    monkeypatch.setattr(lm, "MOST_TOKENS", 1 << 22)
    assert 1 << model.bits2 >= 4 and scores() == want
