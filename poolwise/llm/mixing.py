"""Mixing sources to target weights: repetition rates, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwise.llm import common
from poolwise.operators.ordering import number_rows

#: Words are counted as matches of common.WORD, by the places where one begins.
WORD_START = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_START)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights``, repeating. They share ``share`` of all sizes by weight; a
    target stops at ``most`` times its source's size, and what it leaves goes to the others by weight until none is
    above: with sources in order of size per weight, the capped ones are the first ones. The windows run over one row
    per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (place + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight"))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - capped) / (F.sum("weight").over(everything) - used)
    rows = rows.withColumn("level", level)
    # The first source that its level does not fill fixes the level of all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("final", F.first(fits, ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    rows = rows.select("source", "source_size", target.alias("target"))
    return rows.withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))


def copies(doc_id: Column, size: Column, rate: Column, seed: str, occurrence: Column) -> Column:
    """floor(rate) copies, and one more where a uniform number from the md5 of seed, doc_id, size and, behind the first
    row with these, its number among them is below the rest."""
    number = F.when(occurrence > 1, occurrence.cast("string"))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), number)
    uniform = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.floor(rate).cast("int") + (uniform < rate - F.floor(rate)).cast("int")


def occurrences(rows: DataFrame) -> DataFrame:
    """(file, row, occurrence) of rows (file, row, source, doc_id, size) that share source, doc_id and size with others.

    Without such rows this is an empty table. They are numbered by place, in even ranges, so a row that fills a third of
    the table fills no task.
    """
    named = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("doc_id", "size", "source")])
    rows = rows.select("file", "row", F.md5(named).alias("named"))
    repeated = rows.groupBy("named").agg(F.count("*").alias("n")).where("n > 1").select("named")
    numbered = number_rows(rows.join(repeated, "named"), "named", ["file", "row"])
    return common.written(numbered.select("file", "row", F.col("rn").alias("occurrence")), "mix-repeated")


def rated(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """(doc: all columns, size, source_size, target, copies) for each document.

    Only sums per source are shuffled before the rates join back to the documents; a hot source is one row of them, and
    Spark splits its side of the join. Repeated rows draw apart, by their number, so that a row that fills a third of a
    source doesn't move the source from its target as a whole; which of them are taken follows their places in the
    files. Null texts have size 0, a null source is a source of its own, an empty table gives no rows. Sources are taken
    to be few: the targets are windows over one row per source.
    """
    docs = common.scanned(docs)
    rows = common.with_row_numbers(docs).withColumn("size", words(F.col("doc.text")))
    sizes = (docs.select("source", words(F.col("text")).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    rates = common.written(targets(sizes, **how), "mix-rates").withColumnRenamed("source", "of")
    again = occurrences(rows.select("file", "row", "doc.source", "doc.doc_id", "size"))
    joined = rows.join(rates, F.col("doc.source").eqNullSafe(F.col("of"))).join(again, ["file", "row"], "left")
    occurrence = F.coalesce("occurrence", F.lit(1))
    return joined.select("doc", "size", "source_size", "target",
                         copies(F.col("doc.doc_id"), F.col("size"), F.col("rate"), seed, occurrence).alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    taken = rated(docs, seed, **how).where(F.col("copies") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
