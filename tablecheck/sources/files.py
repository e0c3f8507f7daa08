"""Source files: resolving paths, reading, sampling and counting rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.sqltext import quote_part
from . import csvrecords

FORMATS = ("csv", "json", "parquet", "avro")  # avro needs the spark-avro package

_CORRUPT = "__corrupt_record"


class SourceError(ValueError):
    """A source that is missing, empty or malformed."""


@dataclass(frozen=True)
class SourceFiles:
    """Where a load comes from.

    `path` may hold `*`. With pattern_mode="glob" a star stays inside one path
    segment; with "regex" it is `.*` and may cross `/`, and a dot is any character.
    files="first" keeps only the smallest matching path.
    multiline lets a quoted CSV field span lines. Reading such a file takes one task;
    counting its rows takes as many as there are byte ranges.
    """

    root: str
    path: str
    format: str = "csv"
    files: str = "all"
    pattern_mode: str = "glob"
    multiline: bool = False
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("root", "path", "format"):
            if not isinstance(getattr(self, name), str):
                raise SourceError(f"a source needs a {name}, not {getattr(self, name)!r}")
        if self.format not in FORMATS:
            raise SourceError(f"format {self.format!r} is not one of {', '.join(FORMATS)}")
        if self.files not in ("all", "first"):
            raise SourceError(f"files must be 'all' or 'first', not {self.files!r}")
        if self.pattern_mode not in ("glob", "regex"):
            raise SourceError(f"pattern_mode must be 'glob' or 'regex', not {self.pattern_mode!r}")

    @property
    def location(self) -> str:
        return f"{self.root.rstrip('/')}/{self.path.lstrip('/')}"


_FILE_SCHEME = "^file:/+"


def _plain(path: Column) -> Column:
    """`file:/x` and `file:///x` are one path."""
    return F.regexp_replace(path, _FILE_SCHEME, "/")


def list_files(spark: SparkSession, source: SourceFiles) -> DataFrame:
    """(path, length, modified) of the matching files; their content is not read."""
    reader = spark.read.format("binaryFile")
    if source.pattern_mode == "regex" and "*" in source.path:
        root, path = source.root.rstrip("/"), source.path.lstrip("/")
        folder = path.split("*")[0].rpartition("/")[0]
        files = reader.option("recursiveFileLookup", "true").load(f"{root}/{folder}".rstrip("/"))
        root = re.sub(_FILE_SCHEME, "/", root)
        full = _plain(F.col("path"))
        name = F.substr(full, F.locate(root, full) + F.lit(len(root) + 1))
        files = files.where(name.rlike("^" + path.replace("*", ".*") + r"\z"))
    else:
        files = reader.load(source.location)
    listed = files.select(
        _plain(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified")
    )
    return listed.orderBy("path").limit(1) if source.files == "first" else listed


def resolve(spark: SparkSession, source: SourceFiles) -> list[str]:
    """Paths to hand to a reader. Only a regex or "first" needs the listing itself."""
    if "*" not in source.path or (source.pattern_mode == "glob" and source.files == "all"):
        return [source.location]
    paths = [row.path for row in list_files(spark, source).select("path").toLocalIterator()]
    if not paths:
        raise SourceError(f"no files match {source.location}")
    return paths


def _csv_options(source: SourceFiles) -> dict:
    return {
        "header": "true",
        "escape": '"',
        "multiLine": str(source.multiline).lower(),
        **source.options,
    }


def read(
    spark: SparkSession, source: SourceFiles, schema: T.StructType | str | None = None
) -> DataFrame:
    """The rows of the source; CSV columns are strings unless a schema is given."""
    reader = spark.read.format(source.format)
    if source.format == "csv":
        # without a schema, every file's header is compared with the first's
        strict = {} if schema is not None else {"enforceSchema": "false"}
        reader = reader.options(**_csv_options(source), **strict)
    else:
        reader = reader.options(**source.options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(resolve(spark, source))


def read_as(spark: SparkSession, source: SourceFiles, schema: T.StructType) -> DataFrame:
    """The source's columns that a table has too, by name, converted to its types.

    A value that does not convert is NULL.
    """
    rows = read(spark, source)
    found = {c.lower(): c for c in rows.columns}
    return rows.select(
        *(
            F.col(quote_part(found[f.name.lower()])).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name.lower() in found
        )
    )


def columns(spark: SparkSession, source: SourceFiles) -> list[str]:
    return read(spark, source).columns


def head(spark: SparkSession, source: SourceFiles, n: int = 100) -> DataFrame:
    return read(spark, source).limit(n)


def _csv_with_extras(spark: SparkSession, source: SourceFiles) -> DataFrame:
    """CSV rows as (is_extra), TRUE where a row has more fields than the header.

    A row as wide as the header is done with. Of others the text is kept, and its
    separators outside quotes are counted: a short row is padded, as loaders do; a longer
    one is not.
    """
    paths = resolve(spark, source)
    options = _csv_options(source)
    header = spark.read.format("csv").options(**options).load(paths).schema
    schema = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in header]
        + [T.StructField(_CORRUPT, T.StringType())]
    )
    rows = (
        spark.read.format("csv")
        .options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("columnPruning", "false")
        .schema(schema)
        .load(paths)
    )
    separator = options.get("sep", options.get("delimiter", ","))
    quote = re.escape(options.get("quote", '"'))
    plain = F.regexp_replace(_CORRUPT, f"(?s){quote}(?:[^{quote}]|{quote}{quote})*{quote}", "")
    fields = F.size(F.split(plain, re.escape(separator), -1))
    if not len(header):  # an empty file, which the caller reports
        return rows.withColumn("is_extra", F.lit(False))
    # Spark wants another column to be read along with the rows' text; this is always true.
    first = F.col(quote_part(header[0].name))
    read_too = first.isNull() | (F.length(first) >= 0)
    is_extra = F.col(_CORRUPT).isNotNull() & (fields > len(header)) & read_too
    return rows.withColumn("is_extra", is_extra)


def one_header(spark: SparkSession, source: SourceFiles) -> None:
    """Raises SourceError if files of a CSV source begin with different headers.

    Lines are read as text, which costs little next to decoding them; a file begins in one
    task, so its first line is the one with the smallest id there.
    """
    lines = spark.read.text(resolve(spark, source)).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    found = first.groupBy(F.rtrim("header")).agg(F.min("path").alias("path")).limit(2).collect()
    if len(found) > 1:
        raise SourceError(f"the headers of {found[0].path} and {found[1].path} differ")


def _rows_to_count(spark: SparkSession, source: SourceFiles) -> tuple[DataFrame, Column]:
    """The source's rows, decoded no further than counting needs, and which are malformed."""
    if source.format == "csv":
        return _csv_with_extras(spark, source), F.col("is_extra")
    if source.format == "json":
        options = {"multiLine": str(source.multiline).lower(), **source.options}
        reader = spark.read.format("json").options(**options)
        reader = reader.option("columnNameOfCorruptRecord", _CORRUPT)
        rows = reader.schema(f"unread string, {_CORRUPT} string").load(resolve(spark, source))
        return rows, F.col("unread").isNull() & F.col(_CORRUPT).isNotNull()
    return read(spark, source), F.lit(False)


def _multiline_counts(spark: SparkSession, source: SourceFiles, path: Column) -> DataFrame:
    """Rows and malformed rows of each file, read as lines in byte ranges."""
    paths, options = resolve(spark, source), _csv_options(source)
    header = spark.read.format("csv").options(**options).load(paths).schema
    lines = spark.read.text(paths).select(
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    separator = options.get("sep", options.get("delimiter", ","))
    return csvrecords.record_counts(lines, separator, max(len(header), 1))


def count_by_file(spark: SparkSession, source: SourceFiles) -> DataFrame:
    """(path, length, rows, malformed_rows) of every matching file.

    A file without rows is listed with 0. The join is on file names, one row each.
    """
    # the metadata path is percent-encoded, but a plus sign in it is a plus sign
    path = _plain(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))
    if source.format == "csv" and source.multiline and csvrecords.can_split(source.options):
        counts = _multiline_counts(spark, source, path)
    else:
        rows, malformed = _rows_to_count(spark, source)
        counts = rows.groupBy(path.alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(malformed).alias("malformed_rows")
        )
    return (
        list_files(spark, source)
        .select("path", "length")
        .join(counts, "path", "left")
        .na.fill(0, ["rows", "malformed_rows"])
    )


def row_count(spark: SparkSession, source: SourceFiles) -> int:
    """Rows of the source without its headers.

    Raises SourceError for a missing file, an empty CSV file, CSV rows with more fields
    than the header, or JSON that does not parse. Columnar formats are counted from their
    footers; only text needs to be read, and listed to notice files without a header.
    """
    if source.format not in ("csv", "json"):
        return read(spark, source).count()
    if source.format == "csv" and "*" in source.path:
        one_header(spark, source)
    row = (
        count_by_file(spark, source)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("rows").alias("rows"),
            F.sum("malformed_rows").alias("malformed_rows"),
            F.min(F.when(F.col("length") == 0, F.col("path"))).alias("empty_file"),
            F.min(F.when(F.col("malformed_rows") > 0, F.col("path"))).alias("malformed_file"),
        )
        .first()
    )
    if not row.files:
        raise SourceError(f"no files match {source.location}")
    if source.format == "csv" and row.empty_file:
        raise SourceError(f"no header in empty file {row.empty_file}")
    if row.malformed_file:
        what = "have more fields than the header" if source.format == "csv" else "do not parse"
        raise SourceError(f"{row.malformed_rows} rows {what}, first in {row.malformed_file}")
    return row.rows
