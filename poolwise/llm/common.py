"""What several operators share: reading, written tables, stable row numbers, joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.session import work_path

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of the rows counts as hot; so there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its rows no longer depend on executors or on recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have a place in a file, else a written copy, so that each reading numbers rows alike."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "rows")


def with_row_numbers(docs: DataFrame) -> DataFrame:
    """(doc: all columns as a struct, file, row) of ``scanned`` rows: a stable identity, also of repeated rows."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def attach(rows: DataFrame, groups: DataFrame, key: list[str], finger: str, count: str, spread: list[str]) -> DataFrame:
    """Each row with the columns of its group; ``groups`` has one row per ``key`` and the number of rows as ``count``.

    ``finger`` (one of ``key``, a long) stands for the key in the list of hot keys: fewer than 1 / HOT_SHARE longs,
    whatever the input. A hot key's rows are dealt to many salts by ``spread``, and its group is copied to each of them.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(1, int(total * HOT_SHARE))
    sizes = groups.groupBy(finger).agg(F.sum(count).alias("__n")).where(F.col("__n") > limit)
    hot = F.broadcast(sizes.select(F.col(finger), F.ceil(F.col("__n") / limit).cast("int").alias("__fan")))
    fan = F.coalesce("__fan", F.lit(1))
    left = rows.join(hot, finger, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), fan).cast("int")).drop("__fan")
    right = (groups.join(hot, finger, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), fan - 1)))
             .drop("__fan"))
    return left.join(right, [*key, "__salt"]).drop("__salt")
