"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats whose readers come as separate jars: asking for them without the jar is a clear error.
NEEDS_JAR = {"avro": "spark-avro", "delta": "delta-spark", "iceberg": "iceberg-spark-runtime", "hudi": "hudi-spark-bundle", "kafka": "spark-sql-kafka"}
CONNECTORS_ABSENT = ("kinesis", "pulsar", "vortex", "elasticsearch", "cassandra", "hbase")


class MissingConnector(RuntimeError):
    """A connector whose jar or service library isn't on this cluster."""


def reader_for(spark: SparkSession, fmt: str):
    """A reader of ``fmt``; formats without their jar raise MissingConnector when they load."""
    if fmt in CONNECTORS_ABSENT:
        raise MissingConnector(f"{fmt} needs a third-party connector")
    return spark.read.format(fmt)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, recursive: bool = False, merge_schema: bool = False) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", recursive).option("mergeSchema", merge_schema).parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, delimiter: str = ",", malformed: str = "fail", sample: float = 1.0) -> DataFrame:
    """``malformed`` is fail or drop.  Give a schema where you can: without one the files are read twice."""
    modes = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}
    r = spark.read.option("header", header).option("sep", delimiter).option("mode", modes[malformed])
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True).option("samplingRatio", sample)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sample: float = 1.0) -> DataFrame:
    """Newline-delimited JSON."""
    r = spark.read.schema(schema) if schema is not None else spark.read.option("samplingRatio", sample)
    return r.json(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """With a key and its bounds the table is read in ``partitions`` slices."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return r.load()


SAVE_MODES = {"error": "errorifexists", "append": "append", "overwrite": "overwrite", "ignore": "ignore"}


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), evolution: str = "merge", **options) -> None:
    """``mode`` is error, append, overwrite, ignore or dynamic (replaces only the partitions that ``df`` has).

    ``evolution`` guards appends: strict wants the same columns, additive allows
    new ones, merge allows anything that a merged read can take.
    """
    spark = df.sparkSession
    if mode == "append" and evolution != "merge":
        from tessera.storage import path_exists

        if path_exists(spark, path):
            check_evolution(spark.read.format(fmt).load(path).schema, df.schema, evolution)
    w = df.write.format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if mode == "dynamic":
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        w.mode(SAVE_MODES[mode]).save(path)


def check_evolution(old: T.StructType, new: T.StructType, evolution: str) -> None:
    have, got = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    changed = [n for n in have if n in got and have[n] != got[n]]
    missing, added = [n for n in have if n not in got], [n for n in got if n not in have]
    if evolution == "strict" and (changed or missing or added):
        raise ValueError(f"schema differs: changed {changed}, missing {missing}, added {added}")
    if evolution == "additive" and (changed or missing):
        raise ValueError(f"schema may only gain columns: changed {changed}, missing {missing}")
