"""The corpus as two tables laid out for what is asked of it: chunks by id, and the chunks of an article.

Both are cut into buckets, by id and by (doc, dieu), and sorted inside, so that a join by these keys moves the asking side
only: the corpus is read where it lies, without a shuffle, and merged in the order it is stored in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64
PLACE = ("doc", "dieu")


@dataclass(frozen=True)
class Located:
    """A corpus by id and by place; operators that read a corpus take it in place of a plain table."""

    ids: DataFrame
    places: DataFrame


def write_located(corpus: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """corpus (id, doc, dieu and whatever else) as tables name_ids and name_places under path."""
    for table, keys in ((f"{name}_ids", ("id",)), (f"{name}_places", PLACE)):
        parts = corpus.repartition(buckets, *keys)
        parts.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{table}").saveAsTable(table)


def open_located(spark: SparkSession, name: str) -> Located:
    return Located(spark.table(f"{name}_ids"), spark.table(f"{name}_places"))


def drop_located(spark: SparkSession, name: str) -> None:
    """Takes the tables' names out of the catalog; their files go with the folder that they are in."""
    for table in (f"{name}_ids", f"{name}_places"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def by_id(corpus: DataFrame | Located) -> DataFrame:
    return corpus.ids if isinstance(corpus, Located) else corpus


def by_place(corpus: DataFrame | Located) -> DataFrame:
    return corpus.places if isinstance(corpus, Located) else corpus
