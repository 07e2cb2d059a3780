"""Each stage against its operator's rows and plain rules, on all documents and on odd rows."""

import corpus_pipeline as cp
from tendril.llm import chosen_path, decontaminate, language_zstd, quality_gbt
from tests.llm.test_op4_decontaminate import plain as plain_leaks
from tests.llm.test_op5_chosen_path import plain as plain_classes

SF = "/root/testdata/sf0.001"


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    good = cp.quality_rules(spark, docs, SF).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_gbt.score(docs, quality_gbt.fit(docs, labels)).where("kept"))
    known = cp.language_id(spark, good, SF).cache()
    verdicts = language_zstd.predict(good, language_zstd.fit(good))
    assert known.columns == docs.columns and ids(known) == ids(verdicts.where("not rejected"))
    assert {(r.doc_id, r.lang) for r in known.collect()} == {(r.doc_id, r.lang_pred) for r in verdicts.where("not rejected").collect()}
    rows = [(r.doc_id, r.text) for r in known.collect()]
    single = cp.near_duplicates(spark, known, SF).cache()
    classes = plain_classes(rows)
    assert single.columns == docs.columns and ids(single) == {i for i, (c, _) in classes.items() if c == i}
    clean = cp.decontamination(spark, single, SF).cache()
    leaks = plain_leaks([(r.doc_id, r.text) for r in single.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert clean.columns == docs.columns and ids(clean) == ids(single) - {d for d, _ in leaks}
    out = cp.encodings(spark, clean, SF).collect()
    assert {r.doc_id for r in out} == ids(clean) and all(r.decoded_equal for r in out)
    assert len(out) == 2 * clean.count()
    whole = {(r.doc_id, r.sample_rank, r.ids_hash) for r in cp.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.sample_rank, r.ids_hash) for r in out}


def test_stages_take_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, None, None, None, "x"), (None, "some words of a text that has no id but is long enough to stay", "en", "s", 1, None), (3, "", "en", "s", 0, "y"), (4, long, "en", "s", 9, "z"), (4, long, "en", "s", 9, "z"), (5, long, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sid string")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert ids(chosen_path.keep_one(docs)) == {1, None, 3, 4}  # the row without an id has a class of its own
    assert decontaminate.keep_clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == len(rows)
    assert cp.STAGES[-1][1](spark, docs, SF).where("decoded_equal").count() >= len(rows)
