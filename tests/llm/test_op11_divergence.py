"""The audit against its SQL on tables and on odd rows, the kernels against loops."""

import random

import duckdb
import numpy as np
import pytest

from tendril.llm import queries
from tendril.llm import source_divergence as S

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return sorted(con.sql(S.oracle()).select(*COLUMNS).fetchall())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = queries.QUERIES["op11_source_divergence"](spark, folder)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(con.sql(S.oracle()).select(*COLUMNS).fetchall())


def odd_rows():
    draw = random.Random(7)
    words = [*"abcdefgh", "É", "é", "漢字", "a_b", "x1y", "Z", "z", "long" * 900, "İ", "@[`{"]
    rows = [(draw.choice([1, 2, None]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), draw.choice(["en", "fr", None, ""]), draw.choice(["s1", "s2", "é", None]), 1) for _ in range(900)]
    return [*rows, (5, None, "en", "only here", 2), (6, "rare word", "xx", "lone", 3), (7, None, "yy", "p", 4), (8, "", "yy", "q", 4)]


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_odd_rows_equal_sql(spark, block):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, term int").repartition(5)
    got = sorted(map(tuple, S.audit(docs, block=block).select(*COLUMNS).collect()))
    assert got == by_sql(docs.toPandas())
    assert ("yy", "p", "pair", "q", 0, 1) in got and not [r for r in got if r[0] == "xx"]


def test_empty_table(spark):
    assert S.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_spans_of_one_hash_are_told_apart():
    text = np.frombuffer(b"abcabdabcxyab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([3, 6, 9, 11, 13])
    kind, first = S.classes(text, starts, ends, np.zeros(5, np.uint64))
    assert kind[0] == kind[2] and len(set(kind.tolist())) == 4
    assert all(kind[f] == i for i, f in enumerate(first.tolist()))


def test_shares_are_exact():
    draw = random.Random(8)
    for _ in range(500):
        total, terms = draw.randrange(10**draw.randint(1, 14)), draw.randint(1, 10**6)
        count = draw.randint(0, total)
        assert int(S.shares(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_divergences_equal_loops():
    draw = np.random.default_rng(9)
    for _ in range(60):
        n, width = int(draw.integers(1, 7)), int(draw.integers(1, 12))
        absent = draw.integers(1, 30, n)
        dense = np.where(draw.random((n, width)) < 0.4, draw.integers(1, 99, (n, width)), absent[:, None])
        rows = [np.flatnonzero(draw.random(width) < 0.5) for _ in range(n)]
        for i, r in enumerate(rows):
            dense[i] = absent[i]
            dense[i, r] = draw.integers(1, 99, len(r))
        indptr = np.cumsum([0, *map(len, rows)])
        indices = np.concatenate(rows).astype(np.int64)
        values = np.concatenate([dense[i, r] for i, r in enumerate(rows)])
        for s in range(n):
            assert S.divergences(indptr, indices, values, absent, width, s).tolist() == np.abs(dense - dense[s]).sum(axis=1).tolist()
