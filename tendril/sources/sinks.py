"""A transactional sink of files, and a store of documents under their hashes.

`tendril_files` writes a file for each row (name, content) of a DataFrame. A
task writes into a folder of its attempt, out of sight below `_work`; the
driver moves the files of the attempts that Spark accepted to their places when
all tasks are done. So a task that was killed, retried or run twice leaves
nothing of its own, and a job that fails leaves nothing at all: a task that is
still at work when its job is given up finds the job's mark gone, and tidies up.

Moves are a call a file on the driver, a few at a time side by side. `write_files`
is for many files: there the driver only learns which attempts were accepted,
and tasks list, compare and move the names. A folder of many files is never
listed either: `read_files` and the store open or look up files by their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tendril.session import stored

MOVERS = 16
#: Files that are moved or looked up at a time, and bytes of contents in a batch.
AT_A_TIME, BATCH_BYTES = 1_000, 4 << 20


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt and the names in it."""

    attempt: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, staged: str | None = None):
        """staged: the name of a job whose files stay where its attempts wrote them; commit then only notes which were accepted."""
        self.folder, self.overwrite, self.staged, self.job = folder.rstrip("/"), overwrite, staged, staged or uuid.uuid4().hex
        fs, root = opened(self.folder)
        fs.create_dir(self._work(root), recursive=True)
        fs.open_output_stream(self._mark(root)).close()

    def _mark(self, root: str) -> str:
        """A file that is there as long as the job may succeed."""
        return f"{self._work(root)}/open"

    def _work(self, root: str) -> str:
        return f"{root}/_work/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.folder)
        task = TaskContext.get()
        attempt = f"{self._work(root)}/{task.partitionId()}-{task.taskAttemptId()}"
        names, some = [], False
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                        raise ValueError(f"not a file's name: {name!r}")
                    place = f"{attempt}/{name}"
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    if self.staged and fs.get_file_info(place).type != pafs.FileType.NotFound:
                        raise ValueError("two rows have one name")
                    with fs.open_output_stream(place, compression=None) as out:
                        out.write(content or b"")
                    some = True
                    if not self.staged:
                        names.append(name)
            if fs.get_file_info(self._mark(root)).type != pafs.FileType.File:
                raise RuntimeError("the job was given up")
        except BaseException:
            self._drop(fs, attempt)
            raise
        return Written(attempt if some else "", names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        if self.staged:
            with fs.open_output_stream(f"{self._work(root)}/accepted", compression=None) as out:
                out.write("\n".join(m.attempt for m in messages if m and m.attempt).encode())
            return
        moves = [(f"{m.attempt}/{name}", f"{root}/{name}") for m in messages if m for name in m.names]
        if len({place for _, place in moves}) < len(moves):
            self._drop(fs, self._work(root))
            raise ValueError("two rows have one name")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            self.empty(fs, root)
        for folder in {place.rpartition("/")[0] for _, place in moves}:
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            for some in batched(moves, AT_A_TIME):
                list(pool.map(lambda move: fs.move(*move), some))
        self._drop(fs, self._work(root))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        self._drop(fs, self._work(root))

    @classmethod
    def empty(cls, fs: pafs.FileSystem, root: str) -> None:
        """Deletes what a folder has, without the work of jobs."""
        for old in fs.get_file_info(pafs.FileSelector(root)):
            if old.base_name != "_work":
                cls._drop(fs, old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)

    @staticmethod
    def _drop(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class Files(DataSource):
    """df.write.format("tendril_files").mode("append").save(folder): rows of name and content; mode overwrite empties the folder first."""

    @classmethod
    def name(cls):
        return "tendril_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"], overwrite, self.options.get("staged"))


def write_files(files: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Writes a file for each row (name, content), all or none; files of equal names are replaced. Gives the names.

    The files are moved to their places in tasks once all are written and no name is there twice; a move that was done
    is skipped when its task runs again. Only if Spark gives up on the moves, some files are in place and others not.
    """
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Files)
    files.select("name", "content").write.format("tendril_files").option("staged", job).mode(mode).save(folder)
    fs, root = opened(folder.rstrip("/"))
    work = f"{root}/_work/{job}"
    try:
        with fs.open_input_stream(f"{work}/accepted", compression=None) as got:
            attempts = got.read().decode().split()  # one a task
        wide = max(spark.sparkContext.defaultParallelism * 4, 1)
        tasks = spark.createDataFrame([(x,) for x in attempts], "attempt string").repartition(min(wide, max(len(attempts), 1)))
        names = stored(tasks.mapInArrow(_names(folder), "attempt string, name string"), "file-names")
        if names.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("two rows have one name")
        if mode == "overwrite":
            FileWriter.empty(fs, root)
        names.repartition(wide).mapInArrow(_moved(folder), "name string").write.format("noop").mode("overwrite").save()
    finally:
        FileWriter._drop(fs, work)
    return names.select("name")


def _names(folder: str):
    """Of attempts' folders, the names of the files in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                found = [x.path.removeprefix(f"{attempt}/") for x in fs.get_file_info(pafs.FileSelector(attempt, recursive=True)) if x.type == pafs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([attempt] * len(found), pa.string()), pa.array(found, pa.string())], ["attempt", "name"])

    return run


def _moved(folder: str):
    """Moves files of attempts to their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder.rstrip("/"))
        folders = set()

        def move(attempt: str, name: str) -> None:
            place = f"{root}/{name}"
            try:
                fs.move(f"{attempt}/{name}", place)
            except FileNotFoundError:
                # moved by this task's attempt before, or it is lost
                if fs.get_file_info(f"{attempt}/{name}").type != pafs.FileType.NotFound or fs.get_file_info(place).type != pafs.FileType.File:
                    raise

        with ThreadPoolExecutor(MOVERS) as pool:
            for batch in batches:
                pairs = list(zip(batch.column("attempt").to_pylist(), batch.column("name").to_pylist(), strict=True))
                for own in {f"{root}/{name}".rpartition("/")[0] for _, name in pairs} - folders:
                    fs.create_dir(own, recursive=True)
                    folders.add(own)
                for some in batched(pairs, AT_A_TIME):
                    list(pool.map(lambda pair: move(*pair), some))
                yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return run


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """(name, content) of files by their names; the folder is not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder.rstrip("/"))
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["name", "content"])
        for batch in batches:
            rows, held = [], 0
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as got:
                    rows.append((name, got.read()))
                held += len(rows[-1][1])
                if held >= BATCH_BYTES:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    return names.select("name").mapInArrow(run, "name string, content binary")


def stored_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """file_hash of each document of a store; only names are read. The driver lists the store, so this is for a look into it."""
    fs, root = opened(folder)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return spark.createDataFrame([], "file_hash string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return listed.select(F.regexp_extract("path", r"([0-9a-f]{64})\.pdf$", 1).alias("file_hash")).where("file_hash <> ''")


def _there(folder: str):
    """Of hashes, those whose document a store has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder.rstrip("/"))
        for batch in batches:
            for some in batched(batch.column("file_hash").to_pylist(), AT_A_TIME):
                infos = fs.get_file_info([f"{root}/{x}.pdf" for x in some])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, info in zip(some, infos, strict=True) if info.type == pafs.FileType.File], pa.string())], ["file_hash"])

    return run


def store_documents(files: DataFrame, folder: str) -> DataFrame:
    """Stores each content (path, content) once as HASH.pdf, skips those that are there; returns path, file_hash, local_path and whether it was new."""
    spark = files.sparkSession
    hashed = files.withColumn("file_hash", F.sha2("content", 256))
    # each hash is looked up by its name, for a listing of a large store fits no driver
    before = stored(hashed.select("file_hash").distinct().mapInArrow(_there(folder), "file_hash string"), "document-hashes")
    fresh = hashed.groupBy("file_hash").agg(F.first("content").alias("content")).join(before, "file_hash", "left_anti")
    known = hashed.select("path", "file_hash").join(before.withColumn("is_new", F.lit(False)), "file_hash", "left")
    # names are written before the store changes, for they say what was new
    out = stored(known.select("path", "file_hash", F.concat(F.lit(folder.rstrip("/") + "/"), "file_hash", F.lit(".pdf")).alias("local_path"), F.coalesce("is_new", F.lit(True)).alias("is_new")), "document-names")
    write_files(fresh.select(F.concat("file_hash", F.lit(".pdf")).alias("name"), "content"), folder)
    return out
