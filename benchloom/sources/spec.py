"""Dataset specs: kind:name[:flag[=value]]*, and readers and writers for each kind."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchloom.operators.curate import shared_table

#: Byte ranges whose line numbers may be broadcast.
RANGES_SENT = 100_000
KINDS = ("csv", "jsonl", "disk", "hub", "parquet")


@dataclass(frozen=True)
class Spec:
    kind: str
    name: str
    flags: dict = field(default_factory=dict)


def parse_spec(text: str) -> Spec:
    """A bare flag is True, limit is a number, every other value a string (so private=false is truthy)."""
    kind, _, rest = text.partition(":")
    if kind not in KINDS:
        raise ValueError(f"unknown dataset kind {kind!r}")
    name, *flags = re.split(r":(?!//)", rest)
    if not name:
        raise ValueError(f"no dataset name in {text!r}")
    found: dict = {}
    for flag in flags:
        key, eq, value = flag.partition("=")
        if not re.fullmatch(r"[A-Za-z_]\w*", key) or key in found:
            raise ValueError(f"bad flag {flag!r}")
        found[key] = (int(value) if key == "limit" else value) if eq else True
    if kind == "hub" and "split" not in found:
        raise ValueError("hub datasets need split=")
    return Spec(kind, name, found)


def read_spec(spark: SparkSession, text: str, schema: str | None = None) -> DataFrame:
    spec = parse_spec(text)
    r = spark.read.schema(schema) if schema else spark.read
    if spec.kind == "csv":
        df = r.option("header", True).csv(spec.name)
    elif spec.kind == "jsonl":
        df = r.json(spec.name)
    else:
        df = r.parquet(spec.name)
        if spec.kind == "hub":
            df = df.where(F.col("split") == spec.flags["split"]).drop("split")
    return df.limit(spec.flags["limit"]) if "limit" in spec.flags else df


def load(spark: SparkSession, text: str, schema: str | None = None, **options) -> DataFrame:
    """A dataset by the data source of this package: rows in the order of the files, a limit reads only what it needs.

    Its tasks open files by themselves; read_spec goes through Spark's readers and any file system that Spark knows.
    """
    from benchloom.sources.reader import SpecSource

    spark.dataSource.register(SpecSource)
    r = spark.read.format(SpecSource.name()).option("spec", text)
    return (r.schema(schema) if schema else r).options(**options).load()


def write_spec(df: DataFrame, text: str, force: bool = False) -> None:
    """limit is for reading only. disk and hub refuse an empty table."""
    spec = parse_spec(text)
    w = df.write.mode("overwrite" if force else "errorifexists")
    if spec.kind == "csv":
        w.option("header", True).csv(spec.name)
    elif spec.kind == "jsonl":
        w.option("ignoreNullFields", False).json(spec.name)
    else:
        if df.isEmpty():
            raise ValueError("an empty dataset can't be saved")
        if spec.kind == "hub":
            df.withColumn("split", F.lit(spec.flags["split"])).write.mode("overwrite" if force else "append").partitionBy("split").parquet(spec.name)
        else:
            w.parquet(spec.name)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, file): every line of the files below path, numbered through in the order of their names.

    Tasks read byte ranges. How many lines a range has is counted first, and the sums of those before it
    carry over; nothing is sorted and no line moves.
    """
    scan = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("id"))
    ranges = scan.groupBy("file", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    files = ranges.groupBy("file").agg(F.sum("n").alias("in_file"))
    files = files.select("file", (F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).alias("files_before"))
    within = F.sum("n").over(Window.partitionBy("file").orderBy("range")) - F.col("n")
    # a row for each byte range, some 100 MB of text: checked all the same before it is sent to every task
    starts = ranges.withColumn("before", within).join(files, "file").select("file", "range", (F.col("before") + F.col("files_before") - F.col("first")).alias("shift"))
    starts = shared_table(starts, "line-starts")
    few = F.broadcast if starts.count() <= RANGES_SENT else (lambda x: x)
    return scan.join(few(starts), ["file", "range"]).select((F.col("id") + F.col("shift")).alias("line"), "value", "file")


def read_lines(spark: SparkSession, path: str, schema: str, start: int = 0, end: int = -1, allow_malformed: bool = False) -> DataFrame:
    """Rows [start, end) of JSONL files by line number, malformed lines counted; then parsed, in order.

    Without a range the file is read in parallel and in any order.
    """
    if (start, end) == (0, -1):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if allow_malformed else "FAILFAST").json(path)
    placed = numbered_lines(spark, path).where(F.col("line") >= start)
    placed = placed if end < 0 else placed.where(F.col("line") < end)
    rows = placed.select("line", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    if allow_malformed:
        rows = rows.where(~F.col("bad"))
    else:
        rows = rows.where(F.when(F.col("bad"), F.raise_error(F.concat(F.lit("malformed line "), F.col("line").cast("string")))).otherwise(F.lit(True)))
    return rows.orderBy("line").select("r.*")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Typed rows: a null in a required column raises."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return df.where(F.when(bad, F.raise_error(F.lit("a required field is null"))).otherwise(F.lit(True)))


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, code) of all files below path; the id is the relative path without its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace(F.regexp_replace("path", "^.*" + re.escape(path.rstrip("/").split("://")[-1]) + "/", ""), r"\.[^./]*$", "")
    return files.select(rel.alias("item_id"), F.col("content").cast("string").alias("code"))


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(split).parquet(path)


def finished_ids(spark: SparkSession, path: str) -> DataFrame:
    """The resume set: item ids in an output of JSONL results."""
    return spark.read.schema("item_id string").json(path).where(F.col("item_id").isNotNull()).distinct()


def read_split(spark: SparkSession, path: str, split: str, columns: list[str]) -> DataFrame:
    """A named split of a published dataset, projected to its schema."""
    return spark.read.parquet(path).where(F.col("split") == split).select(*columns)


def read_step(spark: SparkSession, path: str, schema: str, start: int = 0, end: int = -1) -> DataFrame:
    """The rows of an earlier step's output; that it has not run yet is an error that names it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the step that writes it first")
    return read_lines(spark, path, schema, start, end)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def start_step(spark: SparkSession, path: str, readonly: bool = False, force: bool = False) -> str:
    """A step's output folder. One that has something in it is refused unless force is given; readonly: it must be there."""
    fs, p = _file(spark, path)
    if readonly:
        if not fs.exists(p):
            raise FileNotFoundError(path)
        return path
    if fs.exists(p) and len(fs.listStatus(p)):
        if not force:
            raise FileExistsError(f"{path} is not empty")
        fs.delete(p, True)
    fs.mkdirs(p)
    return path


def write_document(spark: SparkSession, path: str, body) -> None:
    """A text, or anything else as JSON, as one file on whatever file system the path names."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray((body if isinstance(body, str) else json.dumps(body, indent=2)).encode()))
    out.close()


def append_rows(df: DataFrame, path: str, **columns) -> None:
    """Appends rows to a log (metrics, prompts and outputs), with more columns of fixed values such as the step."""
    df.withColumns({k: F.lit(v) for k, v in columns.items()}).write.mode("append").parquet(path)


def log_scalars(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    append_rows(spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double"), path, step=step)


def log_table(spark: SparkSession, path: str, step: int, name: str, rows: list[list]) -> None:
    """The first row is the header; rows of another width are an error."""
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("a table's rows must be as wide as its header")
    cells = [(name, i, str(h), str(v)) for i, r in enumerate(rows[1:]) for h, v in zip(rows[0], r)]
    append_rows(spark.createDataFrame(cells, "name string, row int, header string, value string"), path, step=step)


def success_report(results: DataFrame, file: str = "file") -> DataFrame:
    """(file, success-rate) as a report has it, two digits of percent for each file."""
    rate = F.avg((F.col("status") == "success").cast("double"))
    return results.groupBy(file).agg(F.format_string("%.2f%%", 100 * rate).alias("success-rate"))
