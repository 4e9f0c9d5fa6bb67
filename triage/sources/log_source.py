"""A1 — a data source that lists log files in tasks, and readers of their tails.

``job_logs`` is a Python data source (batch and stream).  Its partitions are the
folders ``depth`` levels below the root and the files above them; only folder names
pass the driver, and a task lists what lies in its folder.  It gives
``file_path, log_path, length, modified``, no content; :func:`read_tails` reads the
files in tasks of their own, dealt by a hash of the path, so that a folder with a
third of all logs is not read by one task.  (Listing one folder is one task: stores
list a folder in sequence.)  Names that begin with a dot are left out.

A file is read from its end until its last lines are complete, whatever its size.
A file that can't be opened or vanishes meanwhile has an empty text and an ``error``.

As a stream the source gives files by their modification time: a batch has those
modified since the one before, up to ``settle`` seconds before now, so the offset is
one time, whatever the number of files.  A file changed later comes again.  A file
that is moved in with an older time is found within ``overlap`` seconds only, in
which files come again as well; what is behind the source has to expect that.

Stores: whatever pyarrow opens (local, hdfs, s3, gs).  The functions travel to the
executors by value, so a cluster needs no copy of this module.
"""

from __future__ import annotations

import datetime
import fnmatch
import itertools
import sys
import time
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "file_path string, log_path string, length bigint, modified timestamp"
TAILS = LISTING + ", raw binary, error string"
BLOCK_BYTES, BATCH_BYTES, BATCH_ROWS = 1 << 18, 1 << 24, 1_000
HELD_BYTES = 1 << 26  # of unfilled rolls in a task
LINES = pa.schema([("app_id", pa.string()), ("line", pa.string())])
MAX_TAIL_BYTES = 1 << 29  # a longer tail can't be one value; its end is kept
STORES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def opens(scheme: str | None) -> bool:
    """Whether the source can read a store of this scheme."""
    return (scheme or "") in STORES


def open_store(scheme: str, authority: str, path: str) -> tuple[fs.FileSystem, str]:
    """The store, and the path as it names it."""
    kind = STORES[scheme or ""]
    if kind == "file":
        return fs.LocalFileSystem(), path
    store, top = fs.FileSystem.from_uri(f"{kind}://{authority}/")
    return store, path if kind == "hdfs" else top.rstrip("/") + path


@dataclass
class Folder(InputPartition):
    """Files to list: those in a folder, with or without its sub-folders, modified in ``(after, upto]`` (milliseconds)."""

    path: str
    deep: bool
    after: int | None = None
    upto: int | None = None


def _listed(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path)


class _Listing:
    def __init__(self, options: dict):
        self.scheme, self.authority, self.path = options["scheme"], options["authority"], options["root"].rstrip("/") or "/"
        self.pattern, self.depth = options.get("pattern", "*.log"), int(options.get("depth", 1))

    def store(self) -> tuple[fs.FileSystem, str]:
        return open_store(self.scheme, self.authority, self.path)

    def folders(self, after: int | None = None, upto: int | None = None) -> list[Folder]:
        store, top = self.store()
        if store.get_file_info(top).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no folder {self.path}")
        level, out = [top], []
        for _ in range(self.depth):
            out += [Folder(path, False, after, upto) for path in level]
            level = [i.path for path in level for i in _listed(store, path) if i.type == fs.FileType.Directory]
        return out + [Folder(path, True, after, upto) for path in level]

    def files(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        store, top = self.store()
        name = top.rstrip("/").rsplit("/", 1)[-1]
        todo, rows = [folder.path], []
        while todo:
            for info in _listed(store, todo.pop()):
                if info.type == fs.FileType.Directory:
                    if folder.deep:
                        todo.append(info.path)
                    continue
                ns = info.mtime_ns if info.mtime_ns is not None else 0
                if info.base_name.startswith(".") or not fnmatch.fnmatchcase(info.base_name, self.pattern) or (folder.upto is not None and not folder.after < ns // 1_000_000 <= folder.upto):
                    continue
                inside = info.path[len(top.rstrip("/")) + 1 :]
                rows.append((info.path, f"{name}/{inside}", info.size or 0, datetime.datetime.fromtimestamp(ns // 1000 / 1e6, datetime.timezone.utc)))
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("file_path", pa.string()), ("log_path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class LogReader(_Listing, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.files(partition)


class LogStreamReader(_Listing, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle, self.overlap = (int(float(options.get(k, v)) * 1000) for k, v in (("settle", 5), ("overlap", 0)))

    def initialOffset(self) -> dict:
        return {"ms": -1}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000) - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.folders(start["ms"] - self.overlap, end["ms"]) if start["ms"] < end["ms"] else []

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.files(partition)

    def commit(self, end: dict) -> None:
        """Offsets are times: nothing to forget."""


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_logs"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def _options(spark: SparkSession, root: str, **more) -> dict[str, str]:
    spark.dataSource.register(LogSource)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    named = {"scheme": uri.getScheme() or "file", "authority": uri.getAuthority() or "", "root": uri.getPath()}
    return {**named, **{k: str(v) for k, v in more.items() if v is not None}}


def scheme_of(spark: SparkSession, root: str) -> str:
    return _options(spark, root)["scheme"]


def list_logs(spark: SparkSession, root: str, pattern: str = "*.log", depth: int = 1) -> DataFrame:
    """``file_path, log_path, length, modified`` of the files below ``root``."""
    return spark.read.format("job_logs").options(**_options(spark, root, pattern=pattern, depth=depth)).load()


def log_arrivals(spark: SparkSession, root: str, pattern: str = "*.log", depth: int = 1, settle: float = 5, overlap: float = 0) -> DataFrame:
    """The same as a stream of new and changed files."""
    options = _options(spark, root, pattern=pattern, depth=depth, settle=settle, overlap=overlap)
    return spark.readStream.format("job_logs").options(**options).load()


def tail_bytes(file, size: int, lines: int, most: int = MAX_TAIL_BYTES) -> bytes:
    """The end of a file that holds its last ``lines`` lines whole (ended by LF, CR or both)."""
    parts, held, breaks, low = [], 0, 0, size
    while low > 0 and breaks < lines + 2 and held < most:  # one ending may end the file, one must begin the first line
        high, low = low, max(0, low - BLOCK_BYTES)
        file.seek(low)
        part = file.read(high - low)
        breaks += part.count(b"\n") + part.count(b"\r") - part.count(b"\r\n")
        if parts and part.endswith(b"\r") and parts[-1].startswith(b"\n"):
            breaks -= 1
        parts.append(part)
        held += len(part)
    return b"".join(reversed(parts))


def _reads(scheme: str, authority: str, lines: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(scheme, authority, "/")

        def cut(batch: pa.RecordBatch, low: int, raw: list[bytes], errors: list[str | None]) -> pa.RecordBatch:
            some = batch.slice(low, len(raw))
            return pa.RecordBatch.from_arrays([*some.columns, pa.array(raw, pa.binary()), pa.array(errors, pa.string())], names=[*some.schema.names, "raw", "error"])

        for batch in batches:
            low, raw, errors, held = 0, [], [], 0
            for k, path in enumerate(batch["file_path"].to_pylist()):
                data, error = b"", None
                try:
                    with store.open_input_file(path) as file:
                        data = tail_bytes(file, file.size(), lines)
                except OSError as e:  # missing, forbidden, broken
                    error = str(e)[:500]
                raw.append(data)
                errors.append(error)
                held += len(data)
                if held >= BATCH_BYTES or len(raw) >= BATCH_ROWS:
                    yield cut(batch, low, raw, errors)
                    low, raw, errors, held = k + 1, [], [], 0
            if raw:
                yield cut(batch, low, raw, errors)

    return read


def read_tails(listing: DataFrame, root: str, lines: int, parts: int | None = None) -> DataFrame:
    """The listing with ``raw`` (the bytes of at least the last ``lines`` lines) and ``error``.

    ``parts``: tasks that read, as many as shuffle partitions unless given.
    """
    spark = listing.sparkSession
    named = _options(spark, root)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listing.select("file_path", "log_path", "length", "modified").repartition(n, "file_path")
    return dealt.mapInArrow(_reads(named["scheme"], named["authority"], lines), TAILS)


def write_logs(logs: DataFrame, root: str) -> int:
    """Write ``log_path, log_text`` rows to files ``<root>/<log_path>``, in the tasks that hold them; their number.

    A task writes a file under another name and moves it, so a repeated task leaves the same files.
    """
    spark = logs.sparkSession
    named = _options(spark, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(named["scheme"], named["authority"], named["root"])
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch["log_path"].to_pylist(), batch["log_text"].to_pylist()):
                full = f"{top.rstrip('/')}/{path}"
                folder = full.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                hidden = f"{folder}/.{zlib.crc32(full.encode()):08x}.{time.time_ns()}"
                with store.open_output_stream(hidden) as file:
                    file.write((text or "").encode("utf-8"))
                store.move(hidden, full)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return logs.select("log_path", "log_text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _rolls(named: dict[str, str], size: int, parts: int | None):
    """Task code that writes ``app_id, line`` rows as rolls; with ``parts``, only full ones: rows
    ``bucket, frame`` are what is left, a frame for each bucket of applications."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(named["scheme"], named["authority"], named["root"])
        # a repeated task gives its rolls the same numbers, others give others
        first = (2 * TaskContext.get().partitionId() + (parts is None)) << 32
        numbers, zstd = itertools.count(first), pa.Codec("zstd", 3)
        held: dict[str, list[pa.Array]] = {}
        n: Counter[str] = Counter()
        made: set[str] = set()

        def roll(app: str) -> int:
            pieces = held.pop(app)
            lines = pa.concat_arrays(pieces)
            text = pc.binary_join(pa.ListArray.from_arrays([0, n.pop(app)], lines), "\n")[0].as_py() + "\n"
            folder = f"{top.rstrip('/')}/eventlog_v2_{app}"
            if folder not in made:
                store.create_dir(folder)
                made.add(folder)
            full = f"{folder}/events_{next(numbers)}_{app}.zstd"
            hidden = f"{folder}/.{zlib.crc32(full.encode()):08x}.{time.time_ns()}"
            with store.open_output_stream(hidden, compression=None) as file:
                file.write(zstd.compress(text.encode("utf-8")))
            store.move(hidden, full)
            return sum(x.nbytes for x in pieces)

        def rest() -> Iterator[pa.RecordBatch]:
            if parts is None:
                for app in sorted(held):
                    roll(app)
                return
            for bucket, apps in itertools.groupby(sorted((zlib.crc32(app.encode()) % parts, app) for app in held), itemgetter(0)):
                apps = [app for _, app in apps]
                columns = [pa.concat_arrays([pa.repeat(app, n[app]) for app in apps]), pa.concat_arrays([x for app in apps for x in held[app]])]
                frame = pa.BufferOutputStream()
                with pa.ipc.new_stream(frame, LINES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays(columns, schema=LINES))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([frame.getvalue().to_pybytes()], pa.binary())], names=["bucket", "frame"])
            held.clear()
            n.clear()

        space = 0
        for batch in batches:
            apps = batch["app_id"].cast(pa.string()).fill_null("None").dictionary_encode()
            lines = batch["line"].cast(pa.string()).fill_null("")
            codes = apps.indices.to_numpy()
            order, high = np.argsort(codes, kind="stable"), 0
            for app, many in zip(apps.dictionary.to_pylist(), np.bincount(codes, minlength=len(apps.dictionary)).tolist()):
                low, high = high, high + many
                while low < high:
                    some = lines.take(pa.array(order[low : min(high, low + size - n[app])]))  # a copy: no batch is held
                    held.setdefault(app, []).append(some)
                    n[app] += len(some)
                    low += len(some)
                    space += some.nbytes
                    if n[app] == size:
                        space -= roll(app)
            if space >= HELD_BYTES:
                yield from rest()
                space = 0
        yield from rest()

    return write


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for frame in batch["frame"]:
            yield from pa.ipc.open_stream(frame.as_buffer())


def write_rolls(lines: DataFrame, root: str, size: int) -> None:
    """Write ``app_id, line`` rows as rolling event logs ``<root>/eventlog_v2_<app>/events_<number>_<app>.zstd``,
    about ``size`` lines a file.

    A task writes the rolls it can fill by itself.  Only what is left of an application in each task
    is shuffled, packed and compressed, to fill rolls together; a short one is the last of its
    application, or a task held HELD_BYTES of unfilled ones.  A repeated task writes the same files, if
    its rows come in the same order.
    """
    spark = lines.sparkSession
    named = _options(spark, root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = lines.select("app_id", "line").mapInArrow(_rolls(named, size, parts), "bucket int, frame binary")
    dealt = left.repartition("bucket").mapInArrow(_unpacked, "app_id string, line string")
    in_order = dealt.sortWithinPartitions("app_id", "line")
    in_order.mapInArrow(_rolls(named, size, None), "bucket int, frame binary").count()
