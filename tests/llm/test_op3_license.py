"""The join and the places against plain loops."""

import math
import random
import re


from tendril.llm import license_join as lj


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, notices=lj.NOTICES):
    w = cut(text)
    places = [(i, label) for p, label in lj.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for label, notice in notices:
        wide, t = math.ceil(lj.SLACK * len(cut(notice))), set(cut(notice))
        for i in range(max(len(w) - wide + 1, 1)) if len(set(w) & t) >= lj.THRESHOLD * len(t) else ():
            held = len(set(w[i : i + wide]) & t) / len(t)
            if held >= lj.THRESHOLD:
                more.add(label)
                best = max(best, held)
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best


def run(docs):
    return sorted((tuple(r)[0] if r[0] is not None else -1, tuple(r)[1:]) for r in lj.scan(docs).collect())


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs) == sorted((r.doc_id, plain(r.text)) for r in docs.collect())


def test_odd_rows(spark):
    texts = [None, "", "...", "cc by cc by. CC-BY", "CC\nBY all rights reserved", "x" * 200_000 + " all rights reserved " * 3, "Released, under the MIT license!", "released under the license", "Released under the MIT License.", "Released under the MIT License.", "é all rights reservedé Licensed under Apache License, Version 2.0", "LICENSED UNDER THE GNU General public license"]
    docs = spark.createDataFrame([(i if i else None, t, "z", 1) for i, t in enumerate(texts)] + [(3, "again", "z", 1)], "doc_id long, text string, row string, n_words int")
    want = sorted([(i if i else -1, plain(t)) for i, t in enumerate(texts)] + [(3, plain("again"))])
    assert run(docs) == want
    assert run(docs.limit(0)) == []


def labels(got):
    return [x[-2] for _, x in got]


def test_wrapped_notices(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    mpl = " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not"
    unlicense, mit_text = (next(n for k, n in lj.NOTICES if k == label) for label in ("unlicense", "mit-text"))
    texts = [bsd, mpl, "Prose of the\nsame kind.\n\n" + bsd + "\n" + mpl, "\n".join(unlicense.split()), "released under\nthe mit", "released\n" + "far " * 9 + "\nunder the mit license", mit_text.replace(" ", "\r\n\r\n")]
    texts += ["Released under\n// the MIT license.", " ".join(w + " far" * 3000 for w in "released under the license mit".split())]
    rng = random.Random(1)
    words = sorted({w for _, n in lj.NOTICES for w in cut(n)})
    for _ in range(150):  # notices with words lost or strange ones between, wrapped anywhere, in any prose
        notice = [w for w in cut(rng.choice(lj.NOTICES)[1]) for w in ([w, "x"] if rng.random() < 0.04 else [w]) if rng.random() > 0.06]
        prose = lambda: [rng.choice(words) for _ in range(rng.randrange(30))]
        texts.append("".join(w + rng.choice(["  ", " ", " ", "\n", "\n// "]) for w in prose() + notice + prose()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = run(docs)
    assert labels(got[:9]) == ["bsd", "mpl-2.0", "bsd,mpl-2.0", "unlicense", "", "", "mit-text", "mit", ""]
    assert got == [(i, plain(t)) for i, t in enumerate(texts)]
    assert sum(bool(x) for x in labels(got[9:])) > 100


def test_whole_notices_and_tables(spark):
    whole = [(label, n) for label, n in lj.NOTICES if len(n.split()) > 30]
    assert len(whole) >= 8
    docs = spark.createDataFrame([(i, "Some prose first. " * 40 + n.replace(". ", ".\n * ") + " and prose after" * 40) for i, (_, n) in enumerate(whole)], "doc_id long, text string")
    for (label, _), found in zip(whole, labels(run(docs)), strict=True):
        assert label in found.split(",")
    table = spark.createDataFrame([("own", "this is our very own notice of seven terms"), ("own", None), ("none", "...")], "label string, notice string")
    texts = spark.createDataFrame([(1, "THIS is our\nvery own notice, of seven terms"), (2, "nothing"), (3, "this is our very own")], "doc_id long, text string")
    got = sorted((r.doc_id, r.labels) for r in lj.scan(texts, table).collect())
    assert got == [(1, "own"), (2, ""), (3, "")]
    assert {r.labels for r in lj.scan(texts, table.limit(0)).collect()} == {""}


def test_notices_in_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = spark.createDataFrame(lj.NOTICES + [("long", " ".join(f"clause{i}" for i in range(400))), ("none", None), (None, "x"), ("empty", "...")], "label string, notice string")
    text = "before " + " ".join(f"clause{i}" for i in range(400) if i % 20) + " after released under the MIT license"
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, text), (None, None)], "doc_id long, text string"))
    whole = sorted(map(repr, lj.scan(more, table).collect()))
    assert sorted(map(repr, lj.scan(more, table, limit=700).collect())) == whole  # a dozen groups, one of a longer notice
    assert len(whole) == docs.count() + 2 and sum("'long,mit'" in r or "labels='long,mit'" in r for r in whole) == 1


def test_long_text_of_prefix_words(spark):
    got = run(spark.createDataFrame([(1, "mit apache mozilla " * 60_000)], "doc_id long, text string"))
    assert got[0][1][0] == 180_000 and got[0][1][-2] == ""


def test_equals_its_sql(spark):
    import duckdb

    for sf in ("sf0.01",):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        want = con.sql(lj.oracle())
        got = lj.scan(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
