"""Exact duplicates by content-defined chunk recipes, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.llm import common

#: A chunk ends at the first end of a sentence, line or cell after MIN_CHUNK characters, at the latest after MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 256, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case; null as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The chunks of a text in order; put together they are the text. Where they end depends on nearby text only, so
    texts that differ in one place share all chunks before it and soon again those behind it."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?\n|])|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def verified(docs: DataFrame) -> int:
    """Checks that no two different chunks of ``docs`` share an identifier; returns the number of different chunks.

    Each different chunk moves once per task that holds it, however often and in however long documents it stands.
    """
    pieces = docs.select(F.explode(chunks(normal(F.col("text")))).alias("chunk"))
    different = pieces.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    texts = different.groupBy("id").agg(F.count("*").alias("texts"))
    total, most = texts.agg(F.count("*"), F.max("texts")).first()
    if (most or 1) > 1:
        raise ValueError("two different chunks share an identifier; the recipes can't be compared")
    return total


def recipes(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, recipe, finger, text_sha256): a document as the ordered list of its chunks' identifiers."""
    rows = common.with_row_numbers(docs.select("doc_id", "text"))
    rows = rows.select("file", "row", "doc.doc_id", normal(F.col("doc.text")).alias("text"))
    recipe = F.array_join(F.transform(chunks(F.col("text")), lambda c: F.sha2(c, 256)), "")
    rows = rows.select("file", "row", "doc_id", F.unhex(recipe).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    return rows.withColumn("finger", F.xxhash64("recipe"))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: file, row, doc_id, keep_id, group_size, kept, text_sha256.

    Two documents are equal when their lists of verified chunk identifiers are; null counts as the empty text, whose
    list is empty. Of equal texts the largest doc_id stays (null is below all others), of repeated rows with that
    doc_id the last one in its file. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    docs = common.scanned(docs)
    verified(docs)
    table = common.written(recipes(docs), "recipes")
    groups = table.groupBy("finger", "recipe").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count("*").alias("group_size"))
    rows = common.attach(table, groups, ["finger", "recipe"], "finger", "group_size", ["file", "row"])
    kept = common.same([F.col(c) for c in ("file", "row")], [F.col("stays.file"), F.col("stays.row")])
    return rows.select("file", "row", "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size",
                       kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``duplicates`` drops."""
    docs = common.scanned(docs)
    dropped = duplicates(docs).where(~F.col("kept")).select("file", "row")
    return common.with_row_numbers(docs).join(dropped, ["file", "row"], "left_anti").select("doc.*")
