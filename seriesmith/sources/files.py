"""Series files: discovery by path, by-name union of differing layouts, delimited sinks, Parquet tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.functions.expressions import round_to_second
from seriesmith.operators.cleaning import keep_first
from seriesmith.session import pin, ship_package

# Names the path of a series file is made of.
PHASES = ["Startup", "Operation", "Shutdown"]
BATCHES = [
    "batch_dist_binary_ethanol+propan-2-ol",
    "batch_dist_ternary_acetone+butan-1-ol+methanol",
    "batch_dist_ternary_butan-1-ol+propan-2-ol+water",
]
EXPERIMENT_TYPES = ["train_normal", "test_anormal"]

# Folders of the three kinds of series.
MODALITIES = {
    "labels": "00_Timeseries_Label_Anomaly_Metadata",
    "sensors": "01_Timeseries_Sensors",
    "actuators": "02_Timeseries_Actuators",
}
PATH_COLUMNS = ["phase", "batch", "operating_point", "experiment_type", "experiment"]

MAX_SHARED_HEADS = 32_000_000  # bytes of paths, identifiers and column places sent to every executor at once


def _any_of(names: Sequence[str]) -> str:
    return "(" + "|".join(n.replace("+", r"\+") for n in names) + ")"


def path_metadata(path: Column) -> dict[str, Column]:
    """Phase, batch, operating point, type and experiment from a file path; NULL where a part is missing.

    The experiment is named by the file, or by its folder when Spark wrote the file as ``part-...``.
    """
    name = _any_of(EXPERIMENT_TYPES) + r"_experiment_(\d+)[^/]*(?:/part-[^/]*)?$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, group), F.lit(""))

    return {
        "phase": part("(?i)" + _any_of(PHASES), 1),
        "batch": part(_any_of(BATCHES), 1),
        "operating_point": part(r"(operating_point_\d+)", 1),
        "experiment_type": part(name, 1),
        "experiment": F.concat(F.lit("experiment_"), part(name, 2)),
    }


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Matching series files with their path parts; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv") \
        .load(folder).select("path")
    parts = path_metadata(F.col("path"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    return files.select("path", *[e.alias(n) for n, e in parts.items()]).filter(known)


def _known(path: Column) -> Column:
    return reduce(lambda a, b: a & b, [e.isNotNull() for e in path_metadata(path).values()])


def first_record(uri: str, step: int = 1 << 16) -> str:
    """The first line of a file, line breaks inside quotes included; read in steps until it is complete."""
    system, path = FileSystem.from_uri(uri)
    held, seen, quotes = bytearray(), 0, 0
    with system.open_input_stream(path, buffer_size=0) as stream:
        while part := stream.read(step):
            held += part
            for at in (m.start() for m in re.finditer(rb'["\r\n]', part)):
                if part[at:at + 1] == b'"':
                    quotes += 1
                elif quotes % 2 == 0 and held[:seen + at].strip(b" \t\r\n\xef\xbb\xbf"):
                    return held[:seen + at].decode("utf-8-sig", "replace").strip("\r\n")
            seen += len(part)
    return held.decode("utf-8-sig", "replace").strip("\r\n")


def layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Header line and identifier per matching file: (path, header, identifier).

    Paths come from the file listing. A task opens its files one after another and reads each up to the end of its header
    only; the files must lie where ``pyarrow.fs`` can open them. Empty files have no header and are left out.
    """
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [first_record(p) or None for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(lines, pa.string())], ["path", "header"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv") \
        .load(folder).select(F.col("_metadata.file_path").alias("path"))
    ship_package(spark)
    found = files.filter(_known(F.col("path"))).mapInArrow(heads, "path string, header string").filter("header IS NOT NULL")
    parts = path_metadata(F.col("path"))
    return found.withColumn("identifier", F.concat_ws("/", *[parts[p] for p in PATH_COLUMNS]))


def _csv_options(width: int, sep: str) -> tuple[str, dict[str, str]]:
    """Schema and options of lines with up to ``width`` cells, all text; empty and missing cells are NULL."""
    return ", ".join(f"__c{i} string" for i in range(width)), {
        "sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "maxColumns": str(max(20480, width + 1)), "maxCharsPerColumn": "-1"}


def _cells(line: Column, width: int, sep: str) -> Column:
    """The cells of a line as an array of ``width`` strings."""
    parsed = F.from_csv(line, *_csv_options(width, sep))
    return F.array(*[parsed[f"__c{i}"] for i in range(width)])


def _rows(spark: SparkSession, folder: str, width: int, sep: str, line_breaks: bool) -> DataFrame:
    """Cells of all lines behind the headers with their path and reading order, by one read of every file.

    The path is only handed on: looking into it costs more than parsing the line, so that is done once a file.
    """
    schema, options = _csv_options(width, sep)
    read = spark.read.schema(schema).options(**options, header="true", enforceSchema="true", multiLine=str(line_breaks))
    lines = read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    cells = [F.col(f"__c{i}") for i in range(width)]
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("file_row"), F.array(*cells).alias("__cells"),
    ).filter(F.exists("__cells", lambda c: c.isNotNull()))


def read_series(spark: SparkSession, folder: str, text: Sequence[str] = ("Time",), sep: str = ",",
                bad_cells: str = "fail", line_breaks: bool = True) -> DataFrame:
    """All matching series files below a folder, united by column name and tagged with ``identifier``.

    Columns are numbers except those named in ``text``. A cell that is no number ends the read with its file, or, with
    ``bad_cells="report"``, becomes NULL and its column is named in the array ``bad_cells``. Every file may have a header
    of its own: rows meet their header in a join by path, which also leaves out files that do not match. Up to
    ``MAX_SHARED_HEADS`` bytes the heads are sent to the rows, beyond that the rows are shuffled to them. The driver collects
    the distinct column names. ``file_block`` and ``file_row`` give the order of rows inside a file.

    Headers are read in bounded bytes, then every file once. Line breaks inside quotes belong to their cell, so a file is
    read by one task as a stream; ``line_breaks=False`` promises that there are none and lets Spark split long files.
    Missing cells at the end of a line are NULL, cells beyond the header and lines without any cell are left out.
    """
    if bad_cells not in ("fail", "report"):
        raise ValueError(f"unknown choice {bad_cells!r}")
    heads = pin(layouts(spark, folder))
    bare = F.regexp_replace("header", '"[^"]*"', "")  # separators inside quotes do not count
    count = F.size(F.split(bare, F.lit("\\Q" + sep + "\\E")))
    size = F.length("path") + F.length("identifier")
    width, files, long = heads.agg(F.max(count), F.count("*"), F.sum(size)).first()
    if not width:
        raise ValueError(f"no matching series files in {folder}")
    named = F.transform(F.slice(_cells(F.col("header"), width, sep), 1, count),
                        lambda c, i: F.coalesce(c, F.concat(F.lit("_c"), i.cast("string"))))
    heads = pin(heads.select("path", "identifier", named.alias("names")))
    order = heads.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i"))
    columns = [r["name"] for r in order.orderBy("i", "name").collect()]
    places = F.array(*[F.array_position("names", F.lit(c)).cast("int") - 1 for c in columns])
    heads = heads.select(F.col("path").alias("__path"), "identifier", places.alias("__places"))
    few = long + files * (4 * len(columns) + 64) <= MAX_SHARED_HEADS
    rows = _rows(spark, folder, width, sep, line_breaks).join(
        F.broadcast(heads) if few else heads, F.col("path") == F.col("__path"))
    cell = {c: F.when(F.get("__places", F.lit(i)) >= 0, F.get("__cells", F.get("__places", F.lit(i))))
            for i, c in enumerate(columns)}
    values, wrong = {}, []
    for c in columns:
        number = cell[c].try_cast("double")
        bad = cell[c].isNotNull() & number.isNull()
        message = F.concat(F.lit(f"no number in column {c}: "), cell[c], F.lit(" in "), F.col("path"))
        values[c] = cell[c] if c in text else F.when(bad, F.raise_error(message).cast("double")).otherwise(number) \
            if bad_cells == "fail" else number
        wrong += [] if c in text else [F.when(bad, F.lit(c))]
    report = [F.array_compact(F.array(*wrong)).alias("bad_cells")] if bad_cells == "report" else []
    return rows.select(
        *[v.alias(c) for c, v in values.items()], *report, "file_block", "file_row", "identifier")


def read_modalities(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_series(spark, f"{root.rstrip('/')}/{folder}") for name, folder in MODALITIES.items()}


def write_series(df: DataFrame, path: str, parts: Sequence[str], mode: str = "overwrite",
                 formats: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> None:
    """One CSV folder per combination of ``parts``.

    The rebalance hint gathers small combinations and lets adaptive execution split a large one over several files.
    ``formats`` writes numbers with a fixed pattern such as ``%.6f``. With ``order`` a combination is one file whose rows
    are in that order; the task that writes it sorts it, on disk if need be.
    """
    shown = df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))) for c, f in (formats or {}).items()
    })
    dealt = shown.repartition(*parts).sortWithinPartitions(*parts, *order) if order else shown.hint("rebalance", *parts)
    dealt.write.mode(mode).option("header", True).partitionBy(*parts).csv(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", infer: bool = False) -> DataFrame:
    """Delimited UTF-8 table with a header whose names are trimmed (incident lists, plant settings)."""
    df = (
        spark.read.option("header", True).option("sep", sep).option("inferSchema", infer).option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    return df.toDF(*[c.strip() for c in df.columns])


def combine_uploads(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Concatenate the uploaded parts of an experiment; a ``Timestamp`` column becomes whole-second ``Time``.

    The first row of a repeated second is kept (earliest part, earliest time).
    """
    numbered = [f.withColumn("__part", F.lit(i)) for i, f in enumerate(frames)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    if "Timestamp" not in df.columns:
        return df.drop("__part")
    ts = F.try_to_timestamp(F.col("Timestamp"), F.lit("HH:mm:ss[.SSSSSS][.SSS]"))
    clock = F.date_format(round_to_second(ts), "HH:mm:ss")
    timed = df.withColumn("Time", F.coalesce(clock, F.col("Time")) if "Time" in df.columns else clock)
    return keep_first(timed, [*keys, "Time"], ["__part", "Timestamp"]).drop("__part", "Timestamp")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, pruned to ``columns``; a missing path raises Spark's own error."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_results(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Result tables kept in memory for repeated lookups (they hold one row per model, run or threshold)."""
    return {n: read_table(spark, f"{folder.rstrip('/')}/{n}").persist() for n in names}
