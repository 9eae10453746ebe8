"""Tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table up to which it may be dealt out anew.
SMALL = 256 << 20


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of at most SMALL bytes that is split into fewer parts than there are cores (one small file) is dealt out to
    all of them; any other one is left as it is, unshuffled, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() < cores else df
