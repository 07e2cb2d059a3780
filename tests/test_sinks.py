"""The sink of files: all or none, retried and killed attempts, names; the store of documents."""

import hashlib
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tendril.sources import sinks


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_files_are_written_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"n{i}.txt", f"text {i}".encode()) for i in range(20)] + [("sub/a.bin", None)], "name string, content binary").repartition(5)
    sinks.write_files(rows, folder)
    assert files_of(folder) == {f"n{i}.txt": f"text {i}".encode() for i in range(20)} | {"sub/a.bin": b""}
    sinks.write_files(spark.createDataFrame([("n3.txt", b"new")], "name string, content binary"), folder)
    assert len(files_of(folder)) == 21 and files_of(folder)["n3.txt"] == b"new"
    sinks.write_files(spark.createDataFrame([("only.txt", b"x")], "name string, content binary"), folder, "overwrite")
    assert files_of(folder) == {"only.txt": b"x"}


@pytest.mark.parametrize("names", [["a", "a"], ["../out"], ["_x"], [None], ["/abs"]])
def test_bad_names_leave_nothing(spark, tmp_path, names):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "old.txt").write_bytes(b"old")
    rows = spark.createDataFrame([("good", b"1")] + [(n, b"2") for n in names], "name string, content binary").repartition(3)
    with pytest.raises(Exception):
        sinks.write_files(rows, str(folder))
    settled(folder, {"old.txt": b"old"})


def settled(folder, want):
    """Waits until tasks that were still at work have tidied up."""
    for _ in range(100):
        if files_of(folder) == want:
            return
        time.sleep(0.1)
    assert files_of(folder) == want


def test_a_task_of_a_job_that_was_given_up_tidies_up(tmp_path, monkeypatch):
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: 7)

    monkeypatch.setattr(sinks.TaskContext, "get", staticmethod(lambda: Task))
    writer = sinks.FileWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [b"1", None]})

    def rows():
        yield batch
        writer.abort([])  # the driver gives up while the task goes on
        yield batch

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert files_of(tmp_path) == {}
    other = sinks.FileWriter(str(tmp_path), False)
    other.commit([other.write(iter([batch]))])
    assert files_of(tmp_path) == {"a": b"1", "b": b""}


class Retried(sinks.FileWriter):
    """Writes all of an attempt, then fails the first attempt of each task that has rows, as a lost executor would, without a chance to tidy up."""

    def write(self, iterator):
        from pyspark import TaskContext

        out = super().write(iterator)
        if out.names and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        return out


class RetriedFiles(DataSource):
    @classmethod
    def name(cls):
        return "retried_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return Retried(self.options["path"], overwrite)


def test_attempts_that_were_not_accepted_leave_nothing(spark, tmp_path):
    # a local session gives each task one attempt, so the job fails after its tasks have written
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"n{i}", b"x") for i in range(9)], "name string, content binary").repartition(3)
    spark.dataSource.register(RetriedFiles)
    with pytest.raises(Exception):
        rows.write.format("retried_files").mode("append").save(str(folder))
    settled(folder, {})


def test_only_accepted_attempts_are_committed(tmp_path):
    writer = sinks.FileWriter(str(tmp_path), False)
    work = tmp_path / "_work" / writer.job
    for attempt, names in (("0-1", ["a", "b"]), ("0-2", ["a", "b"]), ("1-3", ["c"])):
        (work / attempt).mkdir(parents=True)
        for n in names:
            (work / attempt / n).write_text(f"{attempt} {n}")
    # attempt 0-1 was killed after it had written, 0-2 took its place; a task without rows sends nothing
    writer.commit([sinks.Written(str(work / "0-2"), ["a", "b"]), sinks.Written(str(work / "1-3"), ["c"]), None])
    assert files_of(tmp_path) == {"a": b"0-2 a", "b": b"0-2 b", "c": b"1-3 c"}


def test_documents_are_stored_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    files = spark.createDataFrame([("u1", b"%PDF one"), ("u2", b"%PDF two"), ("u3", b"%PDF one")], "path string, content binary").repartition(3)
    name = lambda b: f"{hashlib.sha256(b).hexdigest()}.pdf"
    first = {r.path: (r.local_path, r.is_new) for r in sinks.store_documents(files, folder).collect()}
    assert first == {u: (f"{folder}/{name(b)}", True) for u, b in (("u1", b"%PDF one"), ("u2", b"%PDF two"), ("u3", b"%PDF one"))}
    assert files_of(folder) == {name(b): b for b in (b"%PDF one", b"%PDF two")}
    stamps = {p: p.stat().st_mtime_ns for p in Path(folder).glob("*.pdf")}
    more = files.unionByName(spark.createDataFrame([("u4", b"%PDF four")], "path string, content binary"))
    assert {r.path for r in sinks.store_documents(more, folder).where("is_new").collect()} == {"u4"}
    assert len(files_of(folder)) == 3 and all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    assert sinks.stored_hashes(spark, folder).where(F.length("file_hash") == 64).count() == 3


def test_the_driver_learns_attempts_only(spark, tmp_path, monkeypatch):
    # a staged job sends no names, lists no folder and moves nothing on the driver
    writer = sinks.FileWriter(str(tmp_path / "out"), False, "job")
    monkeypatch.setattr(sinks.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda: 0, "taskAttemptId": lambda: 1})))
    import pyarrow as pa

    sent = writer.write(iter([pa.RecordBatch.from_pydict({"name": [f"n{i}" for i in range(50)], "content": [b"x"] * 50})]))
    assert sent.names == [] and sent.attempt.endswith("/0-1")
    writer.commit([sent, None])
    assert (tmp_path / "out/_work/job/accepted").read_text() == sent.attempt
    monkeypatch.undo()
    folder = str(tmp_path / "many")
    names = sinks.write_files(spark.range(500).selectExpr("concat('s', id % 3, '/f', id) AS name", "CAST(CAST(id AS string) AS binary) AS content").repartition(6), folder)
    assert len(files_of(folder)) == 500 and names.count() == 500
    back = {r.name: bytes(r.content) for r in sinks.read_files(names, folder).collect()}
    assert back == files_of(folder)


def test_a_store_is_not_listed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    sinks.store_documents(spark.createDataFrame([("u1", b"one")], "path string, content binary"), folder)
    monkeypatch.setattr(sinks, "stored_hashes", lambda *_: pytest.fail("listed"))
    out = sinks.store_documents(spark.createDataFrame([("u1", b"one"), ("u2", b"two")], "path string, content binary"), folder)
    assert {(r.path, r.is_new) for r in out.collect()} == {("u1", False), ("u2", True)}
