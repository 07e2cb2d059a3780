"""The statistics against a plain rule, and the trees against their constraints."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tendril.llm import quality_gbt as q

TEXTS = [None, "", " \n\t ", "a b c d e a b c d e", "one two\none two\n\none two", "x" * 300_000, "a " * 9, "é#ß $| <b>\x0b\x0cz\xa0z", "a b c d e f " * 4000, "q w e r t q w e r t q w e r t", "w\r\nw\r\nv"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, w in enumerate(wins):
        seen.setdefault(w, []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    before, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_match_the_plain_rule(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base, x = q.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(base[k].tolist() for k in q.BASE), strict=True)) == [plain(t) for t in texts]
    assert np.isfinite(x).all() and x.shape == (len(texts), len(q.FEATURES))


def test_trees_learn_and_keep_their_direction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    y = ((x[:, 0] + 0.3 * rng.standard_normal(3000)) < 0.5).astype(float)
    model = q.Trees(trees=20).fit(x, y, np.array([-1, 0]))
    assert ((model.margin(x) > 0) == y).mean() > 0.75
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.4)])
    assert (np.diff(model.margin(grid)) <= 1e-12).all()


def test_scores_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "lang") for i, t in enumerate(TEXTS)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert q.fit(docs, labels) is None
    out = q.score(docs, None).orderBy("doc_id").collect()
    assert len(out) == len(TEXTS) and not out[0].kept and out[0].base_failed
    assert q.score(docs.limit(0), None).count() == 0
    kept = q.keep_good(docs, None)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = q.score(docs, q.fit(docs, labels)).join(labels, "doc_id").where("not base_failed")
    assert out.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95


def walk(model, row):
    """The margin of a row by a plain walk from each root."""
    total = model.start
    for at in model.roots:
        while model.left[at] != at:
            at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
        total += model.value[at]
    return total


def test_flat_arrays_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((2000, 4)), 2)  # many ties with the cuts
    y = (x[:, 0] + x[:, 1] * x[:, 2] < 0.8).astype(float)
    model = q.Trees(trees=15).fit(x, y, np.array([-1, 0, 0, 0]))
    assert np.allclose(model.margin(x), [walk(model, r) for r in x], atol=1e-12)


def test_fit_does_not_depend_on_arrival(spark):
    texts = [f"good words number {i} in a row of more than ten plain words {i}" if i % 2 else "### $$$ " * (12 + i % 5) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, "another text with this id " * 3) for i in range(120)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    a, b = q.fit(docs, labels, max_rows=90), q.fit(docs.orderBy("text").repartition(3), labels.repartition(5), max_rows=90)
    assert all((u == v).all() for u, v in zip(a.nodes, b.nodes, strict=True)) and a.start == b.start
    assert q.fit(docs, labels, max_rows=49) is None and q.fit(docs, labels, max_rows=49, least_rows=40) is not None


def test_edge_rows(spark):
    model = q.Trees(trees=1)
    rows = [(None, "no id " * 20), (1, "word " * 400_000), (2, " ".join(f"w{i}" for i in range(30)))] * 2
    out = q.score(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    assert len(out) == 6 and {(r.doc_id, r.kept) for r in out} == {(None, False), (1, False), (2, True)}
    assert model.roots == []
