"""Dataset files: Parquet, JSON lines, CSV and ARFF, by suffix, with explicit schemas.

File order is part of the data, but no stored layout has a column for it. Rows that carry ``file_ordinal`` are
written into one folder per capture file (``file_ordinal=3/``), which every reader of partitioned data gives back as a
column, and packet order does the rest; ``_files`` beside them names the files with their counts and first positions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.operators.position import prefix_buckets
from ethersense.schemas import assert_same_columns, conform
from ethersense.session import local_frame, materialise

ORDINAL = "file_ordinal"
FILES = "file_ordinal int, source_file string, n_rows long, first_pos long"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.BooleanType)


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else ""


def csv_value(cell: Column, kind: T.DataType) -> Column:
    """One CSV cell in its declared type: empty is null, true/false in any case, else a try-cast."""
    text = F.when(cell != "", cell)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return text.try_cast(kind)


def csv_kind(cell: Column) -> Column:
    """Kind an untyped cell reads as, one cell at a time."""
    return (
        F.when(cell.isNull() | (cell == ""), "null")
        .when(F.lower(cell).isin("true", "false"), "bool")
        .when(cell.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), "int")
        .when(cell.rlike(r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"
                         r"|inf|infinity|nan)\s*$"), "float")
        .otherwise("string")
    )


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by suffix. A schema keeps the read to one pass and makes drift visible; without one
    CSV and JSON infer per column (not per cell)."""
    kind = suffix_of(path)
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if kind in ("jsonl", "json"):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    cells = spark.read.schema(text).csv(path, header=True, enforceSchema=False)
    ordinal = [c for c in cells.columns if c == ORDINAL and c not in schema.names]
    return cells.select(*[csv_value(F.col(f.name), f.dataType).alias(f.name)
                          for f in schema.fields], *ordinal)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The capture files of a dataset that was written with its file order."""
    return spark.read.schema(FILES).parquet(f"{path}/_files")


def file_table(df: DataFrame) -> DataFrame:
    """``FILES`` of rows with ``file_ordinal``: one row per file."""
    name = F.any_value("source_file", True) if "source_file" in df.columns else F.lit(None).cast("string")
    counted = df.groupBy(ORDINAL).agg(name.alias("source_file"), F.count(F.lit(1)).alias("n_rows"))
    counts = materialise(counted.withColumn("bucket", F.col(ORDINAL).cast("long")), "file-counts")
    return prefix_buckets(counts, ["n_rows"]).select(
        ORDINAL, "source_file", "n_rows", F.col("n_rows_before").alias("first_pos"))


def write_dataset(
    df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "errorifexists"
) -> int:
    """Write by suffix and return the row count, observed during the write itself.

    ``file_ordinal`` is kept as folders, whether the schema has it or not; an ARFF file has no place for it.
    """
    kind = suffix_of(path)
    ordered = ORDINAL in df.columns and kind != "arff"
    files = file_table(df) if ordered else None
    if schema is not None:
        rest = df.drop(ORDINAL) if ORDINAL not in schema.names else df
        assert_same_columns(rest, schema)
        beside = [] if rest is df or not ordered else [T.StructField(ORDINAL, T.IntegerType())]
        df = conform(df, T.StructType([*schema.fields, *beside]))
    counted = Observation()
    out = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    if kind == "arff":
        write_arff(out, path, mode)
        return counted.get["rows"]
    if kind in ("jsonl", "json"):
        out = out.select(*sorted(df.columns))
    writer = out.write.mode(mode)
    if ordered:
        writer = writer.partitionBy(ORDINAL)
    if kind == "parquet":
        writer.parquet(path)
    elif kind in ("jsonl", "json"):
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.csv(path, header=True)
    if files is not None:
        files.coalesce(1).write.mode("overwrite").parquet(f"{path}/_files")
    return counted.get["rows"]


def float_text(value: Column) -> Column:
    """A double as plain shortest text (``1704067207.179575``), without the JVM's exponents."""
    size = F.abs(value)

    def plain(digits: int) -> Column:
        text = value.cast(f"decimal(38,{digits})").cast("string")
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")

    text = value.cast("string")
    exponent = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when((size >= 1e7) & (size < 1e16), plain(18))
        .when((size >= 1e-4) & (size < 1e-3), plain(22))
        .when(exponent.isNotNull(), scientific)
        .when(F.isnan(value), "nan")
        .otherwise(F.lower(F.regexp_replace(text, "Infinity", "inf")))
    )


def arff_value(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.BooleanType):
        text = value.cast("int").cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = float_text(value.cast("double"))
    elif isinstance(kind, NUMERIC):
        text = value.cast("string")
    else:
        escaped = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(escaped, F.lit("'"), F.lit("\\'"))
        text = F.concat(F.lit("'"), escaped, F.lit("'"))
    return F.coalesce(text, F.lit("?"))


def arff_rows(df: DataFrame) -> DataFrame:
    """Data lines of an ARFF file."""
    cells = [arff_value(f.name, f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def arff_header(df: DataFrame, relation: str = "frames") -> DataFrame:
    """Header lines; a column without any value is declared STRING."""
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    lines = [f"@RELATION {relation}", ""]
    for f in df.schema.fields:
        kind = "NUMERIC" if isinstance(f.dataType, NUMERIC) and filled[f.name] else "STRING"
        lines.append(f"@ATTRIBUTE {f.name} {kind}")
    lines += ["", "@DATA"]
    return local_frame(df.sparkSession, [("\n".join(lines),)], "value string")


def write_arff(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``path/header`` and ``path/data``: the file is their concatenation."""
    header = arff_header(df)
    arff_rows(df).write.mode(mode).text(f"{path}/data")
    header.coalesce(1).write.mode(mode).text(f"{path}/header")


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row frame (metrics, manifest) as a JSON document."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry document (JSON, or YAML where a YAML parser is installed)."""
    from ethersense.operators.labels import registry_frame

    text = spark.read.text(path, wholetext=True).first()[0]
    if suffix_of(path) == "json":
        document = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML registries needs a YAML parser") from exc
        document = yaml.safe_load(text) or {}
    return registry_frame(spark, document.get("targets", []))
