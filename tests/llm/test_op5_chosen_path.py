"""Links and classes against all pairs compared by plain sets."""

import math
import random
import re

from tendril.llm import chosen_path as c


def plain(rows, threshold=0.8):
    def shingles(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    links, root = {i: 0 for i, _ in sets}, {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and len(s & t) >= threshold * len(s | t):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i, _ in sets}


def result(docs, **options):
    return {r.doc_id: (r.class_id, r.n_links) for r in c.near_duplicates(docs, **options).collect()}


def near_copies(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        text = list(base) if i % 3 else [rng.choice(words) for _ in range(120)]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "..."), (3, "one two"), (4, "One, two!"), (5, "one two three"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "word " * 50_000), (9, "word word word word word")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, n int")
    assert result(docs) == plain(rows)
    assert result(docs.limit(0)) == {}
    kept = c.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 5, 6, 8}


def test_large_and_split_leaves(spark):
    rows = near_copies(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, split = plain(rows), result(docs, leaf=20, block=15, stall=2.0)
    assert result(docs, leaf=20, block=15) == want  # the group is dense, so it stays whole
    assert result(docs) == want
    assert {i: v[0] for i, v in split.items()} == {i: v[0] for i, v in want.items()}
    assert sum(v[1] for v in split.values()) >= 0.999 * sum(v[1] for v in want.values())
    assert result(docs, shingles=3000) == want  # long leaves are cut by their shingles


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_recall_at_the_threshold_after_all_splits(spark):
    # 80 of 100 shingles are common; leaves of one set make every path take all DEPTH splits
    pairs = 4000
    words = lambda i, n: " ".join(f"p{i}w{k}" for k in range(n))
    docs = spark.createDataFrame([(2 * i + j, words(i, n)) for i in range(pairs) for j, n in enumerate((104, 84))], "doc_id long, text string").repartition(8)
    linked = c.near_duplicates(docs, leaf=1, depth=4, stall=2.0).where("n_links = 1").count() / 2
    print("recall", linked / pairs)
    assert linked >= 0.998 * pairs


def test_sketches_lose_nothing_at_other_thresholds():
    for threshold in (0.3, 0.5, 0.8, 0.95):
        for orders in (32, 56, 400):
            k = c.agree_for(threshold, orders)
            below = sum(math.comb(orders, i) * threshold**i * (1 - threshold) ** (orders - i) for i in range(k))
            assert 0 <= k <= orders and below <= 1e-7


def test_survival_of_a_pair():
    rng = random.Random(1)
    whole, more = c.children(0.8)
    assert (whole, more) == (1, 0.25) and c.children(0.5) == (2, 0.0) and c.children(1.0) == (1, 0.0)

    def together(s, depth):
        return depth == 0 or any(rng.random() < s and together(s, depth - 1) for _ in range(whole + (rng.random() < more)))

    for s, depth in ((0.8, 4), (0.8, 8), (0.9, 4)):
        met = sum(together(s, depth) for _ in range(20_000)) / 20_000
        assert abs(met - c.meeting(s, 0.8, depth)) < 0.015
    assert c.meeting(0.8, 0.8, 12) > 4 * 0.8**12  # where a tree with one child a set has all but lost the pair
    assert c.runs_for(0.8, 0.999, 4) == 9 and c.runs_for(1.0, 0.9, 3) == 1


def test_nodes_split_to_several_children(spark):
    nodes = spark.range(4000).selectExpr("cast(id % 40 as int) as run", "xxhash64(id % 40) as path", "id as sid", "sequence(id * 1000, id * 1000 + 400) as least", "1L as above")
    got = c.split(nodes, 0, 4, 0.8, range(2)).groupBy("sid").count().collect()
    assert {r["count"] for r in got} == {1, 2} and len(got) == 4000
    assert 4000 < sum(r["count"] for r in got) < 6000


def test_recall_by_band(spark):
    """Against all pairs that share a shingle, by similarity."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    base = [[f"g{g}w{k}" for k in range(200)] for g in range(60)]
    rows = []
    for g, words in enumerate(base):
        for _ in range(40):
            text = list(words)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want, near = [0] * len(rows), {0.8: 0, 0.85: 0, 0.9: 0}
    for g in range(60):
        for a in range(40 * g, 40 * g + 40):
            for b in range(a):
                if b >= 40 * g:
                    s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                    if s >= 0.8:
                        near[max(k for k in near if k <= s)] += 1
                        want[a] += 1
                        want[b] += 1
    got = {r.doc_id: r.n_links for r in c.near_duplicates(docs, leaf=5).select("doc_id", F.col("n_links")).collect()}
    found = sum(min(got[i], w) for i, w in enumerate(want)) / sum(want)
    print("pairs by band", near, "recall", found)
    assert min(near.values()) > 1000 and found >= 0.99 and all(got[i] <= w for i, w in enumerate(want))


def test_large_leaves_move_few_rows(spark):
    members = spark.range(20_000).selectExpr("1L as path", "id as sid", "20000L as size")
    groups = c.spread(members, c.BLOCK)
    assert groups.count() == 20_000 * 10 and groups.groupBy("group").count().agg({"count": "max"}).first()[0] <= 2.2 * c.BLOCK


def test_equals_its_sql(spark):
    import duckdb

    for sf in ("sf0.01",):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        want = con.sql(c.oracle())
        frame = c.near_duplicates(docs)
        assert frame.columns == want.columns
        assert sorted(map(tuple, frame.collect())) == sorted(want.fetchall())


def test_overlaps_equal_plain_counts():
    import numpy as np

    rng = random.Random(6)
    for n, words in ((0, 1), (1, 5), (60, 30), (60, 4000), (90, 400)):
        sets = [sorted(rng.sample(range(words), rng.randrange(min(words, 30) + 1))) for _ in range(n)]
        got = c.overlaps(np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets], np.int64))
        assert got.shape == (n, n) and all(got[a, b] == len(set(sets[a]) & set(sets[b])) for a in range(n) for b in range(n) if a != b)


def test_recall_at_the_threshold_beside_dense_groups(spark):
    # with the default rule on dense nodes: a group of near copies of one text, and pairs at exactly the threshold
    pairs = 1500
    words = lambda i, n: " ".join(f"p{i}w{k}" for k in range(n))
    rows = [(2 * i + j, words(i, n)) for i in range(pairs) for j, n in enumerate((104, 84))] + [(10_000 + i, t) for i, t in near_copies(300) if i % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    linked = c.near_duplicates(docs, leaf=1).where("doc_id < 10000 and n_links = 1").count() / 2
    print("recall", linked / pairs)
    assert linked >= 0.997 * pairs


def test_rows_without_ids_are_linked(spark):
    text = [f"w{i}" for i in range(61)]
    near = " ".join(text[:-1])
    other = [f"v{i}" for i in range(80)]
    rows = [(1, " ".join(text), "a"), (None, near, "b"), (None, "a text of its own that is long enough", "c"), (None, " ".join(other), "d"), (None, " ".join(other), "d"), (None, " ".join(other[1:]), "e"), (None, "", "f"), (None, None, "g"), (7, "some other words that nobody else has", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid string")
    got = sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in c.near_duplicates(docs).collect())
    assert got == sorted([("1", "1", 1), ("None", "1", 1), ("None", "None", 0), *[("None", "None", 2)] * 3, ("None", "None", 0), ("None", "None", 0), ("7", "7", 0)])
    kept = c.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.sid for r in kept.collect()) in (["a", "c", "d", "f", "g", "h"], ["a", "c", "e", "f", "g", "h"])


def test_many_rows_of_one_text_without_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text)] * 300 + [(None, text + " end")] * 2 + [(4, "x y z")], "doc_id long, text string").repartition(5)
    assert {(r.class_id, r.n_links) for r in c.near_duplicates(docs).collect()} == {(None, 301), (4, 0)}
    assert c.keep_one(docs).count() == 2
