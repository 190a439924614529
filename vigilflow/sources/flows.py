"""Flow files and JSON batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vigilflow.operators.cleaning import normalize_name


def read_flow_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
    max_rows: int | None = None, encoding: str = "UTF-8",
) -> DataFrame:
    """Flow CSV: ``#`` comment lines and leading blanks skipped, names trimmed.

    Give a schema for large inputs; without one the types cost an extra scan.
    """
    reader = (
        spark.read.option("header", True)
        .option("comment", "#")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("positiveInf", "Infinity")
        .option("negativeInf", "-Infinity")
        .option("encoding", encoding)
    )
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.limit(max_rows) if max_rows is not None else df


def discover(spark: SparkSession, folder: str, fallback: str) -> tuple[list[str], bool]:
    """(sorted CSV files of the folder, False) or ([fallback], True).

    Goes through the Hadoop file system, so any shared storage works.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.csv")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    files = sorted(str(s.getPath().toString()) for s in found) if found else []
    return (files, False) if files else ([fallback], True)


def load_metadata(df: DataFrame, is_sample: bool) -> DataFrame:
    """One row per source file: path, size, rows, columns, sample flag."""
    columns = len(df.columns)
    return (
        df.groupBy(
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_size_bytes"),
        )
        .agg(F.count(F.lit(1)).alias("raw_row_count"))
        .withColumn("raw_column_count", F.lit(columns))
        .withColumn("is_sample_dataset", F.lit(is_sample))
    )


FLAGS = T.StructType([T.StructField(f, T.IntegerType()) for f in ("syn", "ack", "rst", "fin")])
RECORD = T.StructType(
    [
        T.StructField("captured_at", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("total_packets", T.LongType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("syn_flag_count", T.IntegerType()),
        T.StructField("ack_flag_count", T.IntegerType()),
        T.StructField("rst_flag_count", T.IntegerType()),
        T.StructField("fin_flag_count", T.IntegerType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("flags", FLAGS),
    ]
)
BATCH = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("records", T.ArrayType(RECORD))])


def read_json_batches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``{batch_id, records[]}`` documents, one flow record per row.

    Flags may be nested or flat; missing numbers count as zero.
    """
    rows = (
        spark.read.schema(BATCH).option("multiLine", multi_line).json(path)
        .select("batch_id", F.explode("records").alias("r"))
    )
    flags = [
        F.coalesce(F.col(f"r.{f}_flag_count"), F.col(f"r.flags.{f}"), F.lit(0)).alias(f"{f}_flag_count") for f in FLAGS.names
    ]
    return rows.select(
        "batch_id",
        F.col("r.captured_at").cast("timestamp").alias("captured_at"),
        *[F.col(f"r.{c}") for c in ("source_ip", "destination_ip", "source_port", "destination_port", "protocol")],
        F.coalesce("r.duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("r.total_packets", F.lit(0)).alias("total_packets"),
        F.coalesce("r.total_bytes", F.lit(0)).alias("total_bytes"),
        *flags,
        F.coalesce("r.is_suspicious", F.lit(False)).alias("is_suspicious"),
    )


def flow_schema(header: list[str], text: tuple[str, ...] = ("label",)) -> T.StructType:
    """All columns double except the text ones (by normalised name)."""
    return T.StructType(
        [T.StructField(c, T.StringType() if normalize_name(c) in text else T.DoubleType()) for c in header]
    )
