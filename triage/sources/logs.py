"""A1/A2 — log files as a DataFrame of ``(log_path, task_id, log_text)``.

:func:`read_logs` lists files in tasks and reads each from its end.  Where the
store opens for Spark's readers alone, :func:`scan_logs` reads normal files whole
(``wholetext``), one row per file, and cuts them to their tail right away so only the
tail travels further.  Files above ``big_file_bytes`` cannot be one string safely;
they are read line by line and only the blocks that hold the last ``max_lines`` lines are kept (SURVEY §4.3):

1. per (file, block) line counts — a map-side-combined aggregate;
2. running count from the last block backwards per file — a window over a
   handful of block rows per file;
3. the lines of those blocks are ranked from the end per file and the last
   ``max_lines`` are gathered in order.  The gathered array is bounded by
   ``max_lines``, never by file size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import decode_text, normalize_newlines, tail_lines
from .log_source import list_logs, opens, read_tails, scheme_of

BIG_FILE_BYTES = 64 * 1024 * 1024
TASK_FOLDER = r"([^/]+)/[^/]+$"


def _reader(spark: SparkSession, pattern: str):
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
    )


def _qualified(spark: SparkSession, root: str):
    """The root's Hadoop file system and its full path (any scheme)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def _relative(spark: SparkSession, file_path, root: str):
    """``<basename(root)>/<rest>`` for a file under ``root``, percent-decoded; the URI otherwise."""
    _, path = _qualified(spark, root)
    top = path.toUri().getPath().rstrip("/") + "/"
    decoded = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    pos = F.instr(decoded, top)
    return F.when(pos > 0, F.concat(F.lit(f"{path.getName()}/"), F.substring(decoded, pos + len(top), F.length(decoded)))).otherwise(file_path)


def _empty_logs(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of no bytes, which Spark's scans leave out: what the scan lists but does not
    read.  The listing is the one that Spark makes of any folder, and stays in the JVM;
    the scan reads names alone."""
    scan = _reader(spark, pattern).format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("file_path"))
    names = Column(spark._jvm.org.apache.spark.sql.functions.lit(scan._jdf.inputFiles()))
    listed = spark.range(1).select(F.explode(names).alias("file_path"))
    listed = listed.select(F.regexp_replace("file_path", "^file:/+", "file:/").alias("file_path"))
    return listed.join(scan, "file_path", "left_anti").withColumn("log_text", F.lit(""))


def _with_names(df: DataFrame, root: str) -> DataFrame:
    df = df.withColumn("log_path", _relative(df.sparkSession, F.col("file_path"), root))
    return df.withColumn("task_id", F.regexp_extract("log_path", TASK_FOLDER, 1))


def read_logs(
    spark: SparkSession,
    root: str,
    pattern: str = "*.log",
    max_lines: int = C.MAX_LINES,
    big_file_bytes: int = BIG_FILE_BYTES,
    depth: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """All ``pattern`` files under ``root`` → ``file_path, log_path, task_id, log_text``.

    ``log_text`` is the decoded, newline-normalised tail of at most ``max_lines``; empty
    for an empty file and for one that can't be read.  Files are listed in tasks, by
    folder (``depth`` levels below the root), and read from their ends in ``parts``
    tasks (``triage.sources.log_source``).  Stores that pyarrow doesn't open go
    through :func:`scan_logs`, the only user of ``big_file_bytes``.
    """
    if not opens(scheme_of(spark, root)):
        return scan_logs(spark, root, pattern, max_lines, big_file_bytes)
    return decoded_logs(read_tails(list_logs(spark, root, pattern, depth), root, max_lines, parts), max_lines).select(
        "file_path", "log_path", "task_id", "log_text"
    )


def decoded_logs(tails: DataFrame, max_lines: int = C.MAX_LINES) -> DataFrame:
    """The tails as text, with the task whose folder they lie in."""
    text = tail_lines(normalize_newlines(decode_text(F.col("raw"))), max_lines)
    return tails.withColumns({"log_text": text, "task_id": F.regexp_extract("log_path", TASK_FOLDER, 1)}).drop("raw")


def scan_logs(
    spark: SparkSession,
    root: str,
    pattern: str = "*.log",
    max_lines: int = C.MAX_LINES,
    big_file_bytes: int = BIG_FILE_BYTES,
) -> DataFrame:
    """The same by Spark's own scans, for stores that only they open.  Spark lists all
    files on the driver then, and an unreadable file fails the job."""
    whole = (
        _reader(spark, pattern)
        .text(root, wholetext=True)
        .where(F.col("_metadata.file_size") <= big_file_bytes)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            tail_lines(normalize_newlines(decode_text(F.col("value"))), max_lines).alias("log_text"),
        )
    )
    big = _big_file_tails(spark, root, pattern, max_lines, big_file_bytes)
    out = whole.unionByName(big).unionByName(_empty_logs(spark, root, pattern))
    return _with_names(out, root).select("file_path", "log_path", "task_id", "log_text")


def _big_file_tails(spark, root, pattern, max_lines, big_file_bytes) -> DataFrame:
    lines = (
        _reader(spark, pattern)
        .option("lineSep", "\n")
        .text(root)
        .where(F.col("_metadata.file_size") > big_file_bytes)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("blk"),
            F.monotonically_increasing_id().alias("mid"),
            F.col("value").alias("line"),
        )
    )
    spans = F.sum(F.octet_length("line") + 1)
    per_block = lines.groupBy("file_path", "size", "blk").agg(F.count(F.lit(1)).alias("n"), spans.alias("spans"))
    whole = Window.partitionBy("file_path")
    w = whole.orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # lines with an ending each make up the file, unless the last one has none; a mark of
    # three bytes at the start of the file is not part of a line
    over = F.sum("spans").over(whole) - F.col("size")
    needed = (
        per_block.withColumns({"after": F.sum("n").over(w) - F.col("n"), "ended": over.isin(0, -3)})
        .where(F.col("after") < max_lines)
        .select("file_path", "blk", "ended")
    )
    kept = lines.join(needed, ["file_path", "blk"])
    rank = Window.partitionBy("file_path").orderBy(F.col("blk").desc(), F.col("mid").desc())
    last = kept.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= max_lines)
    rows = F.array_sort(F.collect_list(F.struct("blk", "mid", "line")))
    text = F.concat(F.array_join(F.transform(rows, lambda s: s["line"]), "\n"), F.when(F.bool_or("ended"), "\n").otherwise(""))
    tails = last.groupBy("file_path").agg(text.alias("log_text"))
    return tails.select("file_path", tail_lines(normalize_newlines(decode_text(F.col("log_text"))), max_lines).alias("log_text"))


def log_files(spark: SparkSession, root: str, pattern: str = "*.log") -> DataFrame:
    """File listing with sizes; ``binaryFile`` skips the content column when unused."""
    df = (
        _reader(spark, pattern)
        .format("binaryFile")
        .load(root)
        .select(F.col("path").alias("file_path"), F.col("length"), F.col("modificationTime"))
    )
    return _with_names(df, root)
