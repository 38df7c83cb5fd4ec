"""Readers with fixed schemas and writers: hive-partitioned Parquet, text-keyed CSV, JSON lines, nested annotations, fold files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one under the warehouse on one machine,
    and ValueError on a cluster, where executors would each write to their own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_panelworks"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df with its lineage cut by a table in the shared folder: worked out once, where checkpoint() does it twice."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: str, where: str, columns: list[str]) -> DataFrame:
    """Partition and column pruned scan; the schema holds the partition column."""
    return spark.read.schema(schema).parquet(path).filter(where).select(*columns)


def write_partitions(df: DataFrame, path: str, by: str, files: int = 8) -> None:
    """A folder for each value; rows of one value are dealt to several files, so that a large value is not one task."""
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    df.withColumn("_deal", deal).repartition(by, "_deal").drop("_deal").write.partitionBy(by).parquet(path)


def read_text_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV, ids as text, blanks kept as they are; path may be a glob. Adds the file's name."""
    out = spark.read.schema(schema).option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return out.withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))


def write_fixed_csv(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """Numbers by format string; Spark's committer makes the folder appear at once."""
    df.select(*[F.format_string(formats[c], c).alias(c) if c in formats else F.col(c) for c in df.columns]).write.option("header", True).csv(path)


def read_last_json(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines of which the last row of a key by `order` wins."""
    rows = spark.read.schema(schema).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotation that is not a crowd, with its image's file name."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,row:long,x0:long,x1:long,iscrowd:int>>"
    doc = spark.read.schema(schema).option("multiLine", False).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    return doc.select(F.explode("annotations").alias("a")).select("a.*").filter("iscrowd = 0").drop("iscrowd").join(images, "image_id")


def read_binary_pairs(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """Pairs of files, one of each folder, whose paths hold the same key (group 1 of the pattern); of pairs that are equal
    byte by byte (by the MD5 of both) the first by key stays, with the number of pairs that it stands for.

    Files without a partner are left out, empty ones too: Spark's file sources pass over files of no bytes. A file's content is hashed in the scan and goes no further. Columns: key,
    left_path, right_path, left_hash, right_hash, n_bytes, n.
    """

    def hashed(path: str, side: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return found.select(F.regexp_extract("path", key, 1).alias("key"), F.col("path").alias(f"{side}_path"), F.md5("content").alias(f"{side}_hash"), F.col("length").alias(f"{side}_bytes"))

    pairs = hashed(left, "left").join(hashed(right, "right"), "key")
    first = F.min(F.struct("key", "left_path", "right_path", (F.col("left_bytes") + F.col("right_bytes")).alias("n_bytes"))).alias("f")
    return pairs.groupBy("left_hash", "right_hash").agg(first, F.count(F.lit(1)).alias("n")).select("f.*", "left_hash", "right_hash", "n")


def write_checks(checks: DataFrame, path: str) -> None:
    """Check rows (name, ok, info) as JSON."""
    checks.write.json(path)
