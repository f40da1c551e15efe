"""Sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opswatch import schemas
from opswatch.operators.normalize import tag_source

_CORRUPT = "_corrupt_record"


def read_events_stream(
    spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options: str
) -> DataFrame:
    """A stream of JSON events as ``json_str``.

    ``kafka`` takes the connector's options (servers, topic) and starts at the latest offsets
    unless told otherwise; ``text`` and ``parquet`` follow a directory with a ``value`` column.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", **options}
    elif fmt == "parquet":
        reader = reader.schema("value string")
    stream = reader.options(**options).load(path) if path else reader.options(**options).load()
    return stream.select(F.col("value").cast("string").alias("json_str"))


def _good_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows that are JSON objects. Spark reads no file for the corrupt column alone (as a count would), so a ``column`` is read too."""
    read = ~F.isnan(F.hash(column).cast("double"))  # true of every row
    return df.where(F.col(_CORRUPT).isNull() & read).drop(_CORRUPT)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines files without the lines that are not JSON objects of the schema."""
    reader = spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
    return _good_rows(reader.option("columnNameOfCorruptRecord", _CORRUPT).json(path), schema[0].name)


def read_jsonl_stream(
    spark: SparkSession, path: str, schema: T.StructType, **options: str
) -> DataFrame:
    """A directory of JSON-lines files as a stream; each file is read once per checkpoint."""
    reader = spark.readStream.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", _CORRUPT).options(**options)
    return _good_rows(reader.json(path), schema[0].name)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The service catalogue with ``ord``, the order of its lines in the files."""
    reader = spark.read.schema(_with_corrupt(schemas.CATALOG)).option("mode", "PERMISSIVE")
    lines = reader.option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return _good_rows(
        lines.select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("ord"),
        ),
        schemas.CATALOG[0].name,
    )


def read_log_dir_stream(
    spark: SparkSession, path: str, source_type: str, **options: str
) -> DataFrame:
    """Lines of the files that appear in a directory, as events tagged with their source."""
    lines = spark.readStream.options(**options).text(path)
    tagged = tag_source(lines.withColumnRenamed("value", "message"), source_type)
    event = F.to_json(
        F.struct(
            "source_type",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(
                "timestamp"
            ),
            "message",
        )
    )
    return tagged.select(event.alias("json_str"))


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """The structured table; a filter on ``source_type`` prunes its partitions."""
    return spark.read.schema(schemas.STRUCTURED).parquet(path)


def read_semantic(spark: SparkSession, path: str) -> DataFrame:
    """Semantic rows that have a vector."""
    rows = spark.read.schema(schemas.SEMANTIC).parquet(path)
    return rows.where(F.size("embedding") > 0)


def read_experiment_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of experiment logs with ``experiment`` (the file) and ``ord`` (the line number).

    Files are split as any text is. A line's number is its place in its split and the lines of the file's
    earlier splits, which are counted first: one small row per split is joined, and nothing is sorted.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    lines = spark.read.text(path).select(
        name.alias("experiment"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # lines of a split are read one after the other, by one task
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("experiment", (F.col("line") + F.col("shift")).alias("ord"), "value")
