"""File sources: Markdown folders, JSON logs and labelled case files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.functions import jsonval as js
from supportlake.functions import text as tx
from supportlake.session import materialize

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("conversation_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("intent", T.StringType()), T.StructField("route", T.StringType()), T.StructField("gate_passed", T.BooleanType()),
    T.StructField("gate_score", T.DoubleType()), T.StructField("decisions", T.LongType()), T.StructField("tool_calls", T.LongType()),
    T.StructField("tool_trace", T.ArrayType(T.StringType())), T.StructField("tokens", T.LongType()),
    T.StructField("usage", T.ArrayType(T.StructType([
        T.StructField("stage", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("estimated", T.BooleanType()),
    ]))),
    T.StructField("stop_reason", T.StringType()), T.StructField("message_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("error_type", T.StringType()), T.StructField("occurred_at", T.StringType()),
    T.StructField("evidence_ids", T.ArrayType(T.LongType())), T.StructField("retrieval_trace", T.StringType()),
])


#: Files that a task reads at least, and the most tasks a core has of a folder.
FILES_PER_TASK, TASKS_PER_CORE = 32, 16
#: Names listed, and bytes of texts read, that a task hands over at once.
LISTED, READ_BYTES = 10_000, 1 << 22


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) for every ``*.md`` file of a folder; none at all is an error.

    The source is the file name. Row order is the file name, so sort by it
    where order matters; nothing is gathered to sort it here. One task lists
    the folder into a table of names and tasks read what they are dealt of
    it, so the driver holds no list of files. Names and texts are those of
    Spark's own scan: no hidden files and no empty ones.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = store.makeQualified(path).toUri()
    place = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    if not _is_folder(place):
        return scan_markdown(spark, folder)
    listed = materialize(spark.range(0, 1, 1, 1).mapInArrow(_lister(place), "source string, nested boolean"), "markdown-names")
    n, nested = listed.agg(F.count("source"), F.max("nested")).first()
    if nested:
        return scan_markdown(spark, folder)
    if not n:
        raise FileNotFoundError(f"no Markdown file in {folder}")
    parts = min(-(-n // FILES_PER_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return listed.where("source is not null").select("source").repartition(parts, "source").mapInArrow(_reader(place), "source string, text string")


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``read_markdown``, by Spark's own scan: for patterns, partitioned folders and stores that only Spark reads. The driver lists all files."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    parts = files._jdf.queryExecution().toRdd().getNumPartitions()  # each of a few small files only
    if not parts:
        raise FileNotFoundError(f"no Markdown file in {folder}")
    named = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))
    named = named.withColumn("source", F.url_decode(F.regexp_replace("source", r"\+", "%2B")))
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return named.coalesce(most) if parts > most else named


def _is_folder(place: str) -> bool:
    """Whether Python can open a place, a local path or the URI of a store, and it is a folder."""
    if place.startswith("/"):
        return os.path.isdir(place)
    try:
        store, path = fs.FileSystem.from_uri(place)
        return store.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _entries(place: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what lies in a folder."""
    if place.startswith("/"):
        with os.scandir(place) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.name, True, 0
                elif entry.is_file():
                    yield entry.name, False, entry.stat().st_size
        return
    store, path = fs.FileSystem.from_uri(place)
    for info in store.get_file_info(fs.FileSelector(path)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _is_hidden(name: str) -> bool:
    """Names that Spark's scans leave out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(place: str) -> Callable:
    """A function for tasks: names of the Markdown files of a folder, and whether folders of a partition lie beside them."""
    def batch(names: list[str], nested: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([False] * len(names) + [nested])], ["source", "nested"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names, nested = [], False
            for name, folder, size in _entries(place):
                if _is_hidden(name):
                    continue
                if folder:
                    nested |= "=" in name
                elif size and name.endswith(".md"):
                    names.append(name)
                if len(names) >= LISTED:
                    yield batch(names, nested)
                    names = []
            yield batch(names, nested)

    return run


def _reader(place: str) -> Callable:
    """A function for tasks: the files of a folder by their names."""
    def batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
        # Bytes as they are, like those of Spark's own scan.
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).view(pa.string())], ["source", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if place.startswith("/"):
            opened = lambda name: open(f"{place}/{name}", "rb")
        else:
            store, path = fs.FileSystem.from_uri(place)
            opened = lambda name: store.open_input_stream(f"{path}/{name}", compression=None)
        names, texts, size = [], [], 0
        for given in batches:
            for name in given.column("source").to_pylist():
                with opened(name) as file:
                    text = file.read()
                names.append(name)
                texts.append(text)
                size += len(text)
                if size >= READ_BYTES:
                    yield batch(names, texts)
                    names, texts, size = [], [], 0
        yield batch(names, texts)

    return run


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines file or folder; blank lines are skipped.

    Rejects name the file, its line (from 1, blank lines counted) and the
    problem: malformed JSON, a missing field, or a value of the wrong type.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    text = F.col("value")
    parsed = lines.filter(~tx.is_blank("value")).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), keys)
    # A present, non-null value that the declared type could not take became NULL.
    wrong = F.array_compact(F.array(*[
        F.when(F.get_json_object(text, f"$.{f.name}").isNotNull() & F.col(f"row.{f.name}").isNull(), F.lit(f.name)) for f in schema
    ]))
    problem = (
        F.when(~js.is_object(js.parsed(text)), "malformed_json")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing:"), F.array_join(lacking, ",")))
        .when(F.size(wrong) > 0, F.concat(F.lit("type:"), F.array_join(wrong, ",")))
    )
    checked = parsed.withColumn("problem", problem)
    good = checked.filter(F.col("problem").isNull()).select("row.*")
    bad = checked.filter(F.col("problem").isNotNull()).select("file", "__block", "__id", "value", "problem")
    # Ids are consecutive inside a file block, so a line number is its distance
    # from the block's first id plus the lines of the file's earlier blocks.
    blocks = lines.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    numbered = bad.join(offsets, ["file", "__block"]).withColumn("line", F.col("__id") - F.col("__first") + F.col("__before") + 1)
    return good, numbered.select("file", "line", "value", "problem")


CASE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("area", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("message", T.StringType()), T.StructField("approve", T.BooleanType()),
        T.StructField("expect", T.StringType()),
    ]))),
]))
STEP_KINDS = ("message", "confirmation")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled workflow cases from JSON arrays with the problem of each (NULL if valid)."""
    raw = spark.read.option("multiLine", True).schema(CASE_SCHEMA.elementType).json(path)
    return check_cases(raw)


def check_cases(cases: DataFrame) -> DataFrame:
    """Unique string ids, steps present, and each step complete for its kind."""
    def broken(step: Column) -> Column:
        return (
            ~F.coalesce(step["kind"].isin(*STEP_KINDS), F.lit(False))
            | ((step["kind"] == "message") & step["message"].isNull())
            | ((step["kind"] == "confirmation") & step["approve"].isNull())
        )

    repeated = cases.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("__n")).filter("__n > 1").select("id", F.lit(True).alias("__dup"))
    joined = cases.join(repeated, "id", "left")
    problem = (
        F.when(F.col("id").isNull(), "id_missing").when(F.col("__dup"), "duplicate_id")
        .when(F.coalesce(F.size("steps"), F.lit(0)) < 1, "steps_missing").when(F.exists("steps", broken), "invalid_step")
    )
    return joined.withColumn("problem", problem).drop("__dup")
