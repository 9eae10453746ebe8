"""What the operators of this subpackage share: table access, the shared folder, hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import clean_up, fresh_path, map_arrow, ranked, written
from lodestone.sources.tables import read_table

__all__ = ["WORD", "clean_up", "column", "crc32_sql", "fold", "fresh_path", "hash_sample", "held_out", "map_arrow", "plain_names", "ranked", "spread", "table", "taken", "trainable", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Fold 2 is held out of every training set. A null id is not held out, and never trained on."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def trainable(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) != 2


def spread(text: Column, most: int) -> Column:
    """A training text; of a longer one 32 pieces spread evenly over it, so that one document can't fill a sample, nor the driver."""
    piece = lambda i: F.substring(text, (F.floor(i * F.length(text) / 32) + 1).cast("int"), F.lit(most // 32))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), piece), " "))


def hash_sample(keys: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows, the same on every run: those of the smallest hash. Runs as a top-k, never a full sort."""
    return keys.orderBy(F.xxhash64(by), by).limit(n)


def column(name: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def taken(df: DataFrame, name: str) -> bool:
    """Whether df has a column that the session can't tell from name."""
    same = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return name in df.columns if same else name.lower() in {c.lower() for c in df.columns}


def plain_names(df: DataFrame, *needed: str):
    """df with all columns renamed but those that are needed, so that no name clashes with another, whatever signs are in
    it; and a function that gives a table with those columns their names back, with more columns behind them."""
    same = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda x: x) if same else str.lower
    known = {fold(n): n for n in needed}
    names = [known.get(fold(c), f"c{k}") for k, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out, *more: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], *more)


def crc32_sql(text: str) -> str:
    """DuckDB's way to say the unsigned crc32 of a text's UTF-8 bytes."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    steps = f"list_transform(range(-1, strlen({text})), lambda k: CASE WHEN k < 0 THEN 4294967295 ELSE ('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT END)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1), c >> 8)), 4294967295)"
