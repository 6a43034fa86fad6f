"""Views over the parquet tables: tasks, candidates, repairs, examples, responses, artifacts, stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from poolwise.functions.scalars import style_label
from poolwise.operators.ordering import number_rows_by_key, top_per_group, wide_keys
from poolwise.session import fit_shuffles


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation task per order.

    Joins with tasks are merge joins by hint: the files of the table are several times smaller than its rows, so the
    optimizer's size check would send all tasks through the driver.
    """
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").hint("merge").select(
        key.alias("task_id"),
        F.col("o_custkey").cast("bigint").alias("template_id"),
        F.when(F.col("o_orderstatus") == "F", "alpha")
        .when(F.col("o_orderstatus") == "O", "beta")
        .otherwise("gamma").alias("domain"),
        (key % 2).cast("int").alias("init_is_abstract"),
        ((key % 3) % 2).cast("int").alias("goal_is_abstract"),
        (48 + key % 5).cast("int").alias("seed"),
        F.concat(F.lit("order "), _text("o_orderkey"), F.lit(" priority "),
                 F.col("o_orderpriority")).alias("nl"),
    )


def styled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).withColumn(
        "style", style_label(F.col("init_is_abstract"), F.col("goal_is_abstract")))


def wide_tasks(spark: SparkSession, sf_dir: str) -> list[int]:
    """Tasks of so many candidates that they are spread over partitions."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey")
    fit_shuffles(spark, rows.count())
    return wide_keys(rows, "l_orderkey")


def candidates(spark: SparkSession, sf_dir: str, max_k: int | None = None, numbered: bool = True,
               per_model: bool = False, wide: Sequence[int] | None = None) -> DataFrame:
    """Candidates of every task, numbered from 0.

    With ``max_k`` only the first ``max_k`` of each task are numbered at all. The
    filter sits on the bare row number, so Spark trims each task before the
    shuffle (WindowGroupLimit) and a task with very many rows stays small.
    Without it every row gets its number, unless ``numbered`` is off: then there
    is no ``cand_idx`` and nothing is shuffled. With ``per_model`` a task's
    candidates are numbered (and limited) for each generator model apart.
    ``wide`` are the ``wide_tasks`` where the caller has them.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", *order, "l_returnflag", "l_linestatus", "l_quantity")
    # Parquet counts its rows without reading them.
    fit_shuffles(spark, rows.count())
    if max_k is not None:
        keys = ["l_orderkey", "_model"] if per_model else ["l_orderkey"]
        rows = top_per_group(rows.withColumn("_model", F.col("l_suppkey") % 3), keys, order, max_k)
    elif numbered:
        rows = number_rows_by_key(rows, "l_orderkey", order, wide_tasks(spark, sf_dir) if wide is None else wide)
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("bigint")
    parseable = F.col("l_returnflag") != "R"

    def score(a: int, b: int, c: int) -> Column:
        return F.when(parseable, ((pk * a + sk * b + ln * c) % 101).cast("double") / 100)

    return rows.select(
        F.col("l_orderkey").alias("task_id"),
        *([(F.col("rn") - 1).cast("int").alias("cand_idx")] if numbered else []),
        parseable.alias("parseable"),
        (parseable & (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 25)).alias("correct"),
        (parseable & (F.col("l_linestatus") == "F")).alias("solvable"),
        score(37, 11, 7).alias("score"),
        score(13, 29, 3).alias("score_b"),
        F.when(~parseable & (sk % 2 == 0), "provider_error").alias("error"),
        (F.col("l_quantity") / 10).alias("latency_sec"),
        F.concat(F.lit("model_"), (sk % 3).cast("string")).alias("model"),
        F.concat(F.lit("(supplies p"), pk.cast("string"), F.lit(" s"), sk.cast("string"),
                 F.lit(")")).alias("payload"),
    )


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repair of the top-scored parseable candidate among the first eight of each task."""
    best = W.partitionBy("task_id").orderBy(F.col("score").desc_nulls_last(), "cand_idx")
    t = F.col("task_id")
    ok = t % 25 != 0
    return (
        candidates(spark, sf_dir, max_k=8).where("parseable")
        .withColumn("rn", F.row_number().over(best)).where("rn = 1")
        .select(
            t,
            F.col("cand_idx").alias("original_index"),
            F.col("correct").alias("original_correct"),
            F.col("solvable").alias("original_solvable"),
            F.col("score").alias("original_score"),
            F.col("payload").alias("original_payload"),
            ok.alias("repair_parseable"),
            (ok & (t % 4 != 0)).alias("repair_correct"),
            (ok & (t % 3 != 0)).alias("repair_solvable"),
            F.when(ok, ((t * 17) % 101).cast("double") / 100).alias("repair_score"),
        )
    )


def repair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs with the attributes of their task."""
    return repairs(spark, sf_dir).join(
        styled_tasks(spark, sf_dir).select("task_id", "template_id", "domain", "style", "seed", "nl"),
        "task_id")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, scored rows for split and calibration."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return docs.join(labels.select("doc_id", "quality"), "doc_id").select(
        d,
        F.col("source").alias("template_id"),
        F.col("lang").alias("domain"),
        F.when(d % 10 < 2, "gold").when(d % 10 < 6, "perturbation").otherwise("llm").alias("source"),
        (F.col("n_chars") >= 20).alias("parseable"),
        F.col("quality").cast("int").alias("label"),
        ((F.col("quality") * 350 + (d * 7919) % 650).cast("double") / 1000).alias("score"),
        "text",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model output: plain, with a fenced block, nested up to 40 deep, or with a group that never closes."""
    turn, nested = (F.col("conv_id") + F.col("turn")) % 5, (F.col("conv_id") % 40).cast("int")
    return load(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("body"),
        F.when(turn == 0, F.col("text"))
        .when(turn == 1, F.concat(F.lit("Sure.\n```pddl\n"), "text", F.lit("\n```\nDone.")))
        .when(turn == 2, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(turn == 3, F.concat(F.lit("Answer: (define (p) "), F.repeat(F.lit("(a "), nested), "text",
                                  F.repeat(F.lit(")"), nested + 1), F.lit(" (more)")))
        .otherwise(F.concat(F.lit("(define (p "), "text", F.lit(" (define (q))"))).alias("raw_response"),
    )


def artifacts(numbered: DataFrame) -> DataFrame:
    """S-expression documents of numbered candidates, for the section, fact and corruption operators."""
    slot = F.struct("cand_idx", "payload", "model")
    slots = numbered.groupBy("task_id").agg(
        F.array_sort(F.collect_list(slot)).alias("slots"))

    def joined(build) -> Column:
        return F.array_join(F.transform("slots", build), " ")

    def object_name(x: Column) -> Column:
        return F.concat(F.lit("c"), x["cand_idx"].cast("string"))

    return slots.select(
        "task_id",
        F.concat(
            F.lit("(define (problem t"), _text("task_id"), F.lit(") (:domain supply) (:objects "),
            joined(object_name),
            F.lit(") (:init "), joined(lambda x: x["payload"]),
            F.lit(") (:goal (and "),
            joined(lambda x: F.concat(F.lit("(rank "), object_name(x), F.lit(" "), x["model"], F.lit(")"))),
            F.lit(")))"),
        ).alias("artifact"),
    )


def facts(numbered: DataFrame) -> DataFrame:
    """The facts of the same documents, a row each: task_id, section, pos, w (words; of an object its name)."""
    name = F.concat(F.lit("c"), F.col("cand_idx").cast("string"))
    rows = F.array(*[F.struct(F.lit(section).alias("section"), w.alias("w")) for section, w in (
        ("objects", F.array(name)), ("init", F.split(F.translate("payload", "()", ""), " ")),
        ("goal", F.array(F.lit("rank"), name, F.col("model"))))])
    return numbered.select("task_id", F.col("cand_idx").alias("pos"), F.inline(rows)).select("task_id", "section", "pos", "w")


def stream(events: DataFrame) -> DataFrame:
    """Append-only arrivals; works on a batch or a streaming read of the events table."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("task_id"),
        F.col("event_type").alias("status"), F.col("value").alias("latency_sec"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
