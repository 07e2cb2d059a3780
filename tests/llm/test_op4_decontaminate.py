"""Leaks against a plain comparison of all windows, and the Hamming index against all pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

from tendril.llm import decontaminate as d


def plain(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    size = lambda g: sum(len(w.encode()) for w in g)
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        item = words(t)
        k = min(5, len(item))
        if not item:
            continue
        want = cut(item, k)
        for doc, text in docs:
            w = words(text)
            n = min(len(item), len(w))
            for s in range(len(w) - n + 1):
                own = cut(w[s : s + n], k)
                if own & want and sum(map(size, own & want)) >= 0.8 * sum(map(size, own | want)):
                    out.add((doc, i))
                    break
    return out


def pairs(frame):
    return {(r.doc_id, r.item_id) for r in frame.collect()}


def test_all_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and pairs(d.leaks(docs, items)) == want == pairs(d.leaks(docs, items, items=7))
    kept = d.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({a for a, _ in want})


def test_odd_rows(spark):
    item = " ".join(f"word{i}" for i in range(40))
    near = item.replace("word39", "changed")
    items = [(1, item), (2, None), (3, ""), (4, "short item"), (5, item), (6, "one two three four five six")]
    docs = [(0, None), (1, ""), (2, item), (3, "x " * 100_000 + near.upper() + " y" * 5), (4, "a Short, item b"), (5, "one two three four five"), (6, "clean words " * 30), (2, item)]
    frames = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = d.leaks(*frames)
    assert pairs(got) == plain(docs, items) == {(2, 1), (2, 5), (3, 1), (3, 5), (4, 4)}
    assert got.count() == 7 and got.where("doc_id = 3").first().first_word in (99_999, 100_000)
    assert d.leaks(frames[0].limit(0), frames[1]).count() == 0 and d.leaks(frames[0], frames[1].limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    queries = np.vstack([items[:200], rng.integers(0, 256, (50, 16), dtype=np.uint8)])
    bits = np.unpackbits(queries, axis=1)
    for row in range(200):
        bits[row, rng.choice(128, rng.integers(0, 40), replace=False)] ^= 1
    queries = np.packbits(bits, axis=1)
    distance = np.unpackbits(queries[:, None] ^ items[None], axis=2).sum(2)
    query, item, got = d.Index(items).within(queries)
    assert set(zip(query.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(distance <= d.RADIUS)), strict=True))
    assert (distance[query, item] == got).all()


def test_equals_its_sql(spark):
    import duckdb

    for sf in ("sf0.01",):
        frames = [spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "benchmark")]
        con = duckdb.connect()
        for n in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {n} AS SELECT * FROM '/root/testdata/{sf}/{n}.parquet'")
        want = con.sql(d.oracle())
        got = d.leaks(*frames).drop("distance")
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_large_benchmarks_give_the_same_rows(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    more = items.unionByName(spark.createDataFrame([(900, None), (901, "short item"), (902, "it")], "item_id long, text string"))
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a short item here"), (7_000, None), (7_001, "it")], "doc_id long, text string"))
    want = sorted(map(repr, d.leaks(odd, more).collect()))
    assert want and sorted(map(repr, d.leaks(odd, more, items=3).collect())) == want
    assert d.leaks(odd.limit(0), more, items=3).count() == 0


def test_fingerprints_of_runs_equal_those_of_single_windows(monkeypatch):
    rng = np.random.default_rng(3)
    h, w = rng.integers(0, 1 << 63, 600).astype(np.uint64), rng.integers(1, 40, 600)
    monkeypatch.setattr(d, "RUN", 37)
    for length in (1, 5, 100):
        starts = np.unique(rng.integers(0, 600 - length, 200))
        got = d.fingerprints(h, w, starts, length)
        for k, s in enumerate(starts.tolist()):
            assert (got[k] == np.packbits(d.votes(h[s : s + length], w[s : s + length]).sum(0) > 0)).all()


def test_recall_of_the_radius_at_the_threshold():
    """Single windows whose weighted similarity to the item is just over 0.8: an end is replaced until no more may go."""
    rng = np.random.default_rng(8)
    for n, least in ((14, 0.98), (16, 0.98), (24, 0.99), (80, 0.999)):
        found = tried = 0
        for _ in range(600):
            words = [f"w{x}" + "x" * int(y) for x, y in zip(rng.integers(0, 10**6, n), rng.integers(0, 8, n), strict=True)]
            _, by = d.shingled(d.pa.array([" ".join(words)]), [5])
            h, w, _ = by[5]
            k, total, lost = 0, int(w.sum()), 0
            while (total - lost - int(w[k])) / (total + lost + int(w[k])) >= 0.8:
                lost += int(w[k])
                k += 1
            if not k:
                continue
            other = h.copy()
            other[:k] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            a, b = (d.fingerprints(x, w, np.zeros(1, np.int64), len(x)) for x in (h, other))
            tried += 1
            found += int(np.bitwise_count(a ^ b).sum()) <= d.RADIUS
        print("words", n, "windows", tried, "recall", found / tried)
        assert tried > 300 and found / tried >= least


def test_very_long_text(spark):
    item = " ".join(f"item{i}" for i in range(60))
    docs = spark.createDataFrame([(1, item + " filler" * 2_000_000 + " " + item)], "doc_id long, text string")
    got = d.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in got] == [(1, 5, 0)]


def test_a_leak_without_an_id_goes(spark):
    item = " ".join(f"word{i}" for i in range(40))
    rows = [(None, "before " + item + " after", 1), (None, "clean words of a text without an id", 2), (5, item, 3), (5, "clean beside a leak of one id", 4), (6, "clean", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    kept = d.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.number for r in kept.collect()) == [2, 5, 6]


def test_a_shingle_of_every_item_is_looked_for_by_none(spark):
    common = "as an answer to the question asked above"
    items = [(i, f"{common} " + " ".join(f"i{i}w{k}" for k in range(20))) for i in range(40)]
    docs = [(i, f"start {t} end") for i, t in items] + [(100 + i, f"{common} and nothing else {i}") for i in range(50)] + [(200, items[3][1].replace("i3w19", "changed"))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    asked = frames[1].withColumn("bucket", F.col("item_id").cast("int") % 4)
    names = d.item_shingles(asked, 0.8)
    assert names.groupBy("name").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count() == 0
    got = d.leaks(*frames, items=10)
    assert pairs(got) == plain(docs, items) == {(i, i) for i in range(40)} | {(200, 3)}
