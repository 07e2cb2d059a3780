"""Round trips, distinctness and the law of the draws against full enumeration."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tendril.llm import sentencepiece_sample as g
from tendril.llm.textvec import U64, mix64

TEXTS = [None, "", " ", "a", "the of and", "Hello  world\n é😀 x▁y\t", "\u0000\x1c ü" * 50, "ab " * 40_000, "zzzzzzzzzzzzzzzzzzzzzz", "the of and"]


def enumerate_all(text, vocab):
    """All segmentations with their log weights, by recursion over the pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=g.MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if np.isfinite(vocab.log[i])}
    s = "▁" + text.replace(" ", "▁")

    def go(i):
        if i == len(s):
            return [((), 0.0)]
        return [((ids[s[i:j]], *rest), vocab.log[ids[s[i:j]]] + w) for j in range(i + 1, len(s) + 1) if s[i:j] in ids for rest, w in go(j)]

    return dict(go(0))


def test_draws_follow_sampling_without_replacement():
    vocab = g.Vocabulary()
    text, n = "ab", 30_000
    weights = enumerate_all(text, vocab)
    total = math.log(sum(map(math.exp, weights.values())))
    p = {k: math.exp(v - total) for k, v in weights.items()}
    ranks, threshold = g.sample_slice([text] * n, mix64(np.arange(n, dtype=np.uint64) + U64(9)), g.Chunks(vocab), 3)
    drawn = [[tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] for _, ids, at, _, _ in ranks]
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*drawn, strict=True))
    for s, log in zip(drawn[0][:200], ranks[0][3][:200], strict=True):
        assert abs(math.log(p[s]) - log) < 1e-4
    first, second = Counter(drawn[0]), Counter(drawn[1])
    for s, q in p.items():
        again = sum(p[t] * q / (1 - p[t]) for t in p if t != s)
        for got, want in ((first[s] / n, q), (second[s] / n, again)):
            assert abs(got - want) < 4.5 * math.sqrt(max(want * (1 - want), 1e-5) / n) + 1e-3
    tops = np.array([r[4] for r in ranks] + [threshold])
    assert (np.diff(tops, axis=0) < 0).all()


def test_round_trips_and_odd_rows(spark):
    docs = spark.createDataFrame([(i if i < 9 else 4, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = g.decode(g.encode(docs, 3)).collect()
    assert all(r.decoded_equal and r.decoded == (TEXTS[r.doc_id] or "") for r in out)
    n = {i: len(enumerate_all(TEXTS[i], g.Vocabulary())) for i in (2, 3)}
    assert Counter(r.doc_id for r in out) == {0: 1, 1: 1, 2: n[2], 3: n[3], 4: 6} | {i: 3 for i in range(5, 9)}
    assert all(0 < r.inclusion <= 1 for r in out) and all(r.inclusion == 1 for r in out if r.doc_id < 2)
    twice = [r for r in out if r.doc_id == 4]
    assert len({tuple(r.ids) for r in twice}) == 3
    assert g.encode(docs.limit(0)).count() == 0


def test_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(g.encode(docs.repartition(n), 2).collect(), key=lambda r: (r.doc_id, r.sample_rank)) for n in (1, 5))
    assert [(r.doc_id, r.sample_rank, r.ids) for r in a] == [(r.doc_id, r.sample_rank, r.ids) for r in b]
    assert all(r.decoded_equal for r in a)


def test_ids_and_clashing_columns(spark):
    rows = [(None, "no id here"), (None, "no id here"), (1, ""), (2, "a b▁c"), (2, "a b▁c")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, decoded string, ids int")
    out = g.encode(docs).collect()
    assert all(r.decoded_equal for r in out) and sum(r.doc_id is None for r in out) == 4
    assert len({tuple(r.ids) for r in out if r.doc_id is None}) == 2 == len({tuple(r.ids) for r in out if r.doc_id == 2})
    encoded = g.encode(docs).withColumn("decoded", F.lit("clash"))
    back = g.decode(encoded)
    assert back.columns.count("decoded") == 1 and {r.decoded for r in back.collect()} == {"no id here", "", "a b▁c"}
    assert g.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>"))).where("decoded is not null").count() == 0


def test_draws_reach_rare_pieces():
    vocab = g.Vocabulary()
    chunks = g.Chunks(vocab)
    assert chunks.cumulative.dtype == np.float64
    u = g.uniform(np.arange(1000, dtype=np.uint64), 0, np.zeros(1000, np.int64), 0)
    assert 0 < u.min() and u.max() < 1 and len(np.unique(u * 2.0**53)) == 1000
