"""Streams that stop, replay and go on; joins without a shuffle; table functions; variants; counts on the way."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tendril.functions import extras
from tendril.operators import minutes
from tendril.sources import html, jsonl, portal, store, udtf
from tendril.streaming import harvest


def drain(stream, root):
    run = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append")
    query = run.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def result(spark, stream, root):
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{root}/rows").collect()), key=repr)


def pages(spark, ids):
    return spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string")


def test_stored_pages_stop_and_go_on(spark, tmp_path):
    spark.dataSource.register(portal.StoredPages)
    crawl = str(tmp_path / "crawl")
    stream = lambda: spark.readStream.format("stored_pages").option("path", crawl).load()
    pages(spark, range(1, 40)).repartition(3).write.parquet(crawl)
    drain(stream(), tmp_path / "a")
    assert [r[0] for r in result(spark, stream(), tmp_path / "a")] == sorted(range(1, 40), key=lambda i: repr((i, f"http://x/{i}")))
    pages(spark, range(40, 61)).repartition(2).write.mode("append").parquet(crawl)
    second = drain(stream(), tmp_path / "a")
    assert second.lastProgress is None or sum(p["numInputRows"] for p in second.recentProgress) == 21  # nothing is read twice
    drain(stream(), tmp_path / "b")  # one run over all
    assert result(spark, stream(), tmp_path / "a") == result(spark, stream(), tmp_path / "b")
    assert len(result(spark, stream(), tmp_path / "a")) == 60
    after = spark.readStream.format("stored_pages").option("path", crawl).option("after", "50").load()
    drain(after, tmp_path / "c")
    assert [r[0] for r in result(spark, after, tmp_path / "c")] == list(range(51, 61))


def test_a_failed_batch_is_read_again(spark, tmp_path):
    spark.dataSource.register(portal.StoredPages)
    crawl, seen, fail = str(tmp_path / "crawl"), {}, [True]
    pages(spark, range(1, 20)).repartition(2).write.parquet(crawl)

    def take(batch, number):
        seen[number] = sorted(r.page_id for r in batch.collect())
        if fail[0]:
            raise RuntimeError("stopped in the middle")

    def run():
        stream = spark.readStream.format("stored_pages").option("path", crawl).load()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):
        run()
    first = dict(seen)
    pages(spark, range(20, 25)).write.mode("append").parquet(crawl)
    fail[0] = False
    run()
    assert seen == first  # the same bounds again, though there is more now
    run()
    assert first == {0: list(range(1, 20))} and seen == {0: list(range(1, 20)), 1: list(range(20, 25))}


def test_offsets_and_parts_of_stored_pages(spark, tmp_path):
    crawl = str(tmp_path / "crawl")
    pages(spark, range(10, 30)).repartitionByRange(2, "page_id").write.parquet(crawl)
    stream = portal.StoredPagesStream({"path": crawl}, ["page_id", "url"])
    assert stream.initialOffset() == {"page": -1} and stream.latestOffset() == {"page": 29}
    assert len(stream.partitions({"page": -1}, {"page": 29})) == 2 and len(stream.partitions({"page": 25}, {"page": 29})) == 1 and stream.partitions({"page": 29}, {"page": 29}) == []
    read = [i for p in stream.partitions({"page": 12}, {"page": 27}) for b in stream.read(p) for i in b.column("page_id").to_pylist()]
    assert sorted(read) == list(range(13, 28))


LISTED = "category string, ref_id long, page long, pos int, published date"


def listed(spark, rows):
    return spark.createDataFrame(rows, LISTED)


def sequential(rows, quota, oldest):
    """What one reader of one category after the other takes."""
    out = []
    for category in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == category), key=lambda r: (r[2], r[3]))
        seen, stop = set(), None
        for page in sorted({r[2] for r in own}):
            days = [r[4] for r in own if r[2] == page and r[4]]
            if stop is None and oldest and days and max(days) < oldest:
                stop = page
        for r in own:
            if (stop is None or r[2] < stop) and r[1] not in seen and len(seen) < quota:
                seen.add(r[1])
                out.append(r)
    return sorted(out, key=repr)


@pytest.mark.parametrize("quota,oldest", [(7, None), (1000, dt.date(2024, 1, 10)), (9, dt.date(2024, 1, 5)), (1, dt.date(2030, 1, 1))])
def test_harvest_over_restarts(spark, tmp_path, quota, oldest):
    day = lambda page, pos: dt.date(2024, 1, 28) - dt.timedelta(days=3 * page + pos) if (page + pos) % 4 else None
    rows = [(c, (page * 5 + pos) % 13 + (100 if c == "b" else 0), page, pos, day(page, pos)) for c in "ab" for page in range(7) for pos in range(4)]
    folder = str(tmp_path / "in")
    for low, high in ((0, 2), (2, 3), (3, 7)):  # three runs of the query, a batch of later pages each
        listed(spark, [r for r in rows if low <= r[2] < high]).repartition(2).write.mode("append").parquet(folder)
        stream = harvest.harvest(spark.readStream.schema(LISTED).parquet(folder), "category", "ref_id", "page", ["page", "pos"], quota, "published", oldest)
        drain(stream, tmp_path / "out")
    assert result(spark, stream, tmp_path / "out") == sequential(rows, quota, oldest)


def test_first_rows_in_any_order():
    import random

    from pyspark.sql import Row

    draw = random.Random(3)
    for _ in range(400):
        rows = [Row(page=draw.randint(0, 5), pos=draw.randint(0, 3), key=draw.randint(0, 8)) for _ in range(draw.randint(0, 25))]
        room, out = draw.randint(0, 6), {2, 5}
        want, seen = [], set(out)
        for r in sorted(rows, key=lambda r: (r.page, r.pos)):
            if r.key not in seen and len(want) < room:
                seen.add(r.key)
                want.append((r.page, r.pos))
        got = harvest.first_rows(iter(rows), ["page", "pos"], "key", room, lambda k: k in out)
        assert [(r.page, r.pos) for r in got] == want and len({r.key for r in got}) == len(got)


@pytest.mark.parametrize("quota,oldest", [(4, None), (4, dt.date(2024, 1, 20)), (30, dt.date(2024, 1, 12)), (1, dt.date(2030, 1, 1))])
def test_needed_rows_are_enough(spark, monkeypatch, quota, oldest):
    import random

    monkeypatch.setattr(harvest, "LOOKED", 60)
    monkeypatch.setattr(harvest, "HELD", 200)
    draw = random.Random(5)
    rows = []
    for category in (*map(str, range(40)), None):
        for pos in range(draw.randint(1, 60)):
            page = pos // draw.choice([3, 4])
            day = dt.date(2024, 1, 28) - dt.timedelta(days=2 * page + draw.randint(0, 6)) if draw.random() < 0.7 else None
            rows.append((category, draw.randint(0, 25), page, pos, day))
    draw.shuffle(rows)
    few = harvest.needed(listed(spark, rows).repartition(3), "category", "ref_id", "page", ["page", "pos"], quota, oldest and "published")
    got = list(map(tuple, few.collect()))
    assert set(got) <= set(rows) and len(got) < len(rows)
    assert sequential(got, quota, oldest) == sequential(rows, quota, oldest)


def test_one_category_gets_few_rows_of_a_large_batch(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=4).selectExpr("'a' AS category", "(id * 7919) % 200000 AS ref_id", "id")
    rows = rows.selectExpr("category", "ref_id", "ref_id div 10 AS page", "CAST(ref_id % 10 AS INT) AS pos", "date_sub(DATE '2024-01-31', CAST(ref_id div 10000 AS INT)) AS published")
    rows.write.parquet(str(tmp_path / "in"))
    cursor = ("category", "ref_id", "page", ["page", "pos"], 25)
    assert harvest.needed(rows, *cursor, "published").count() <= 4 * (25 + 26)  # by task a quota, and a row for each page up to its end
    stream = harvest.harvest(spark.readStream.schema(LISTED).parquet(str(tmp_path / "in")), *cursor, "published", dt.date(2024, 1, 10))
    assert "MapInArrow" in stream._jdf.queryExecution().logical().toString()  # and the stream goes through it
    drain(stream, tmp_path / "out")
    assert sorted(r[1] for r in result(spark, stream, tmp_path / "out")) == list(range(25))


def test_rows_without_a_place_come_last():
    from pyspark.sql import Row

    rows = [Row(page=0, pos=pos, key=key) for key, pos in enumerate([None, 2, None, 1])]
    assert [r.key for r in harvest.first_rows(iter(rows), ["page", "pos"], "key", 3, lambda k: False)] == [3, 1, 0]


def test_late_and_missing_awards(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    c, a = "ref_id long, published timestamp", "ref_id long, awarded timestamp"
    asked, given = str(tmp_path / "c"), str(tmp_path / "a")
    batches = [
        ([(1, day(0)), (2, day(1)), (3, day(2))], [(9, day(0))]),
        ([(4, day(40))], [(1, day(25)), (3, day(39))]),  # 1 in time and late; 3 beyond its 30 days
        ([(5, day(120))], [(6, day(119))]),
        ([(6, day(200))], [(7, day(200))]),
    ]
    sizes = []
    for asked_rows, given_rows in batches:
        spark.createDataFrame(asked_rows, c).write.mode("append").parquet(asked)
        spark.createDataFrame(given_rows, a).write.mode("append").parquet(given)
        stream = harvest.award_outcomes(spark.readStream.schema(c).parquet(asked), spark.readStream.schema(a).parquet(given), "ref_id", "published", "awarded", "30 DAYS", "15 days")
        query = drain(stream, tmp_path / "out")
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert result(spark, stream, tmp_path / "out") == sorted([(1, day(0), day(25)), (2, day(1), None), (3, day(2), None), (4, day(40), None), (5, day(120), None)], key=repr)
    assert max(sizes) <= 8 and sizes[-1] <= 4  # what is past the horizon goes


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.createDataFrame([(str(i), "o", f"r{i}") for i in range(50)], "refConsultation string, orgAcronyme string, reference string")
        d = spark.createDataFrame([(str(i), "o" if i % 2 else None, f"objet {i}") for i in range(0, 60, 3)] + [("3", "other", "x")], "refConsultation string, orgAcronyme string, objet string")
        both = [store.bucketed(df, f"t_{name}", str(tmp_path / name), "refConsultation", 4) for name, df in (("m", m), ("d", d))]
        out = store.manifest_details(*both, ["objet"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert {(r.refConsultation, r.objet) for r in out.collect()} == {(str(i), f"objet {i}") for i in range(0, 50, 3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("t_m", "t_d"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_variants(spark):
    rows = spark.createDataFrame([(1, '{"Visite": "le 3", "Lots": 4, "l\'été": {"a": [1, 2]}}'), (2, '{"Visite": null, "Lots": "quatre"}'), (3, "no json"), (4, None), (5, "{}")], "i int, x string").withColumn("v", extras.as_variant(F.col("x")))
    read = rows.select("i", extras.typed(F.col("v"), "Visite", "string"), extras.typed(F.col("v"), "Lots", "int"), extras.state(F.col("v"), "Visite"), extras.state(F.col("v"), "Lots")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in read] == [("le 3", 4, "value", "value"), (None, None, "null", "value"), (None, None, None, None), (None, None, None, None), (None, None, "missing", "missing")]
    shape = extras.shape(rows, "v")
    assert "Visite: STRING" in shape and "Lots" in shape
    record = html.detail_records(spark.createDataFrame([(1, '<div class="line">Visite : le 3</div>')], "id int, html string"), "id", "html")
    assert record.select(extras.typed(extras.of_map(F.col("extras")), "Visite", "string")).first()[0] == "le 3"
    with pytest.raises(ValueError):
        extras.typed(F.col("v"), "both ' and \"", "int")


def test_index_counts_on_the_way(spark, tmp_path):
    key = lambda i: f"x?refConsultation={i}&orgAcronyme=o"
    lines = [json.dumps({"reference": f"r{i}", "pdf_url": key(i % 3), "scraped_at": f"2024-01-0{i + 1}"}) for i in range(6)] + ['{"reference": "half', json.dumps({"pdf_url": "none"}), json.dumps({"reference": "z"})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = jsonl.scan(spark, str(tmp_path / "m.jsonl"))
    assert jsonl.write_index(rows, str(tmp_path / "index")) == {"usable": 6, "without_keys": 2, "malformed": 1}
    assert {(r.refConsultation, r.reference) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {("0", "r0"), ("1", "r1"), ("2", "r2")}


def test_table_functions(spark):
    udtf.register(spark)
    shown = spark.createDataFrame([(1, "u", '<a href="x">X</a><a href="y">Y <b>z</b></a>'), (2, None, None), (3, "v", "<p>none")], "page_id long, url string, html string")
    shown.createOrReplaceTempView("flow_pages")
    got = spark.sql("SELECT * FROM page_links(TABLE(flow_pages), 'html')")
    assert got.columns == ["page_id", "url", "pos", "href", "text"]
    assert sorted((r.page_id, r.pos, r.href) for r in got.collect()) == sorted((r.page_id, r.pos, r.href) for r in html.links(shown, "page_id", "html").collect())
    rows = [(c, p, dt.date(2024, 1, 20 - p) if p != 3 else None) for c in "abc" for p in range(9)]
    spark.createDataFrame(rows, "category string, page int, newest date").repartition(5).createOrReplaceTempView("flow_listing")
    kept = spark.sql("SELECT * FROM harvested(TABLE(flow_listing) PARTITION BY category ORDER BY (page), 'newest', DATE '2024-01-15')").collect()
    assert sorted((r.category, r.page) for r in kept) == [(c, p) for c in "abc" for p in range(6)]
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM page_links(TABLE(flow_pages), 'nothing')").collect()


MINUTES = """Extrait du PV
Appel d'offres ouvert n° 12/2024/DR
Lot n° 1 : Travaux de voirie
Liste des concurrents ayant déposé leurs plis :
- STE ALPHA
- BETA SARL
- GAMMA

ligne sans section
Concurrents écartés : GAMMA
Montants avant vérification :
- STE ALPHA : 716 971,20 DH TTC
- BETA SARL : 559 980.00
Montants des offres après vérification :
- STE ALPHA : 716.971,25
- BETA SARL : 559 980.00 DHS
Concurrent retenu : BETA SARL

Lot 2 - Éclairage
Liste des concurrents : X ; Y
Le lot est déclaré infructueux
Lot 3
Concurrents écartés : Néant
"""


def test_lots_of_minutes(spark):
    whole = "Liste des concurrents ayant déposé un pli :\r\n1) X\r\n2) Y\r\n\r\nConcurrent retenu : Groupement X et Z"
    texts = [(1, MINUTES), (2, whole), (3, ""), (4, None), (5, "Liste des concurrents : A\nLot 7\nConcurrents retenus : néant")]
    got = {(r.id, r.lot): r for r in minutes.lots(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 0), (3, 0), (4, 0), (5, 0), (5, 7)}
    one = got[1, 1]
    assert (one.title, one.reference, one.statut, one.concurrent_retenu) == ("Travaux de voirie", "12/2024/DR", "ATTRIBUE", "BETA SARL")
    assert [tuple(o) for o in one.offers] == [("STE ALPHA", 716971.2, 716971.25, False), ("BETA SARL", 559980.0, 559980.0, False), ("GAMMA", None, None, True)]
    assert (got[1, 2].title, got[1, 2].statut, got[1, 2].concurrent_retenu, [o.bidder for o in got[1, 2].offers]) == ("Éclairage", "INFRUCTUEUX", None, ["X", "Y"])
    assert got[1, 3].statut is None and got[1, 3].offers == [] and got[1, 3].reference == "12/2024/DR"
    assert got[2, 0].concurrent_retenu == "Groupement X et Z" and [o.bidder for o in got[2, 0].offers] == ["X", "Y"]
    assert [o.bidder for o in got[5, 0].offers] == ["A"] and got[5, 7].statut is None


def test_lots_of_minutes_are_dealt_to_a_fixed_number_of_tasks(spark, sf):
    from tendril.plans import flows

    # tasks that are merged by the size of lines would hold texts many times that size
    plan = flows.minutes_lots(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
