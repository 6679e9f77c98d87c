"""Reading extracts, writing results, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session may do without the setting; it gets a new folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a new table in the shared folder and reads them back.

    Cuts the lineage: a lost executor costs its running tasks only.  The table
    is compressed, and later reads take the columns they need; it stays until
    the folder is cleaned, as later reads of the result need it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_slow_queries(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, **options: str
) -> DataFrame:
    """Extracts with a declared schema; text that does not fit goes to a side column.

    ``fmt`` is parquet, json (lines), csv, orc or jdbc.  A jdbc table brings
    its own schema and needs no path.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.load()
    if fmt in ("json", "csv"):
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "csv":
            reader = reader.option("header", options.get("header", "true")).option(
                "escape", options.get("escape", '"')
            ).option("multiLine", options.get("multiLine", "true"))
    return reader.schema(schema).load(path)


def write_results(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Stores result rows by batch; a re-run replaces only its own batch."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch)
        .parquet(path)
    )


def latest_db_metadata(meta: DataFrame) -> DataFrame:
    """Newest snapshot per database: one row per table with its sorted index names."""
    source = ["source_db_type", "source_db_host", "source_db_name"]
    window = Window.partitionBy(*source).orderBy(F.col("captured_at").desc())
    newest = meta.withColumn("_nth", F.row_number().over(window)).where("_nth = 1")
    return newest.select(
        *source, "captured_at", "indexes", F.explode("tables").alias("t")
    ).select(
        *source,
        "captured_at",
        F.col("t.name").alias("table_name"),
        F.col("t.row_count").alias("row_count"),
        F.sort_array(
            F.transform(
                F.filter(
                    F.coalesce("indexes", F.array().cast("array<struct<table:string,name:string>>")),
                    lambda i: i["table"] == F.col("t.name"),
                ),
                lambda i: i["name"],
            )
        ).alias("indexes"),
    )
