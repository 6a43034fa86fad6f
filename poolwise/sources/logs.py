"""Readers and writers of pool logs, replay logs, examples, pairs, repairs and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise import schemas
from poolwise.functions.scalars import style_label


def _records(spark: SparkSession, schema: str, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))


def write_pool_log(candidates: DataFrame, selections: DataFrame, path: str,
                   partition_by: Sequence[str] = ()) -> None:
    """Candidates and selections in one JSON log; a selection has no ``candidate_index``.

    The lines repeat their field names and reasons, so they are written with gzip: a file per task, read as a whole.
    """
    log = candidates.unionByName(selections, allowMissingColumns=True)
    log.write.partitionBy(*partition_by).json(path, compression="gzip")


def read_candidates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return (_records(spark, schemas.POOL_LOG, paths).where("candidate_index IS NOT NULL")
            .withColumn("style", style_label(F.col("init_is_abstract"), F.col("goal_is_abstract")))
            .drop("K", "policy", "selected_index", "selection_reason"))


def read_selections(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return (_records(spark, schemas.POOL_LOG, paths)
            .where("candidate_index IS NULL AND policy IS NOT NULL AND K IS NOT NULL")
            .select("task_id", "template_id", "domain", "init_is_abstract", "goal_is_abstract", "seed",
                    "K", "policy", "selected_index", "selection_reason"))


def read_replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and ranked selections of a replay log partitioned by verifier."""
    log = _records(spark, f"{schemas.REPLAY_LOG}, verifier STRING", path)
    candidates = log.where("candidate_index IS NOT NULL").drop("K", "policy", "selected_index", "selection_reason")
    selections = log.where("candidate_index IS NULL AND policy = 'verifier_ranked'").select(
        "verifier", "task_id", "K", "policy", "selected_index", "selection_reason")
    return candidates, selections


def read_examples(spark: SparkSession, path: str, filter_unparseable: bool = True) -> DataFrame:
    """Examples with defaults: missing texts are empty, a missing ``parseable`` means true."""
    rows = _records(spark, schemas.EXAMPLE, path)
    texts = ("source", "source_model", "perturbation_type", "domain", "template_id")
    filled = rows.select(
        "doc_id", "text", "label", "score", *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
        F.coalesce("parseable", F.lit(True)).alias("parseable"))
    return filled.where("parseable") if filter_unparseable else filled


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs; K may be written ``K`` or ``k`` and defaults to 8, a missing index is -1.

    The two spellings differ only in case, so the lines are parsed once for the
    record and looked up by exact name for K.
    """
    lines = spark.read.text(path)
    rec = F.from_json("value", schemas.PAIR)
    k = F.coalesce(*[F.get_json_object("value", f"$.{n}").cast("int") for n in ("K", "k")], F.lit(8))
    r = lines.select(rec.alias("r"), k.alias("k"))

    def text(name: str, default: str = ""):
        return F.coalesce(F.col(f"r.{name}"), F.lit(default)).alias(name)

    return r.select(
        "r.nl", "r.positive_payload", "r.negative_payload", text("source", "bestofk_pairwise"), text("domain"),
        "r.task_id", "r.template_id", text("style"), "k", text("pair_type"),
        F.coalesce("r.positive_index", F.lit(-1)).alias("positive_index"),
        F.coalesce("r.negative_index", F.lit(-1)).alias("negative_index"), "r.score_margin")


def read_repairs(spark: SparkSession, glob: str, policy: str | None = None) -> DataFrame:
    """Repairs of several runs; the seed is the ``seed_N`` part of the file path."""
    rows = _records(spark, schemas.REPAIR, glob).withColumn(
        "seed", F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)", 1).cast("int"))
    return rows.where(F.col("policy") == policy) if policy else rows


def read_run_summaries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Nested run summaries as rows (run, K, policy, stratum); the totals have stratum '*'."""
    runs = _records(spark, schemas.RUN_SUMMARY, paths)
    by_k = runs.select("run", F.explode("comparisons").alias("k", "block"))
    by_policy = by_k.select("run", F.col("k").cast("int").alias("k"), F.explode("block.policies").alias("policy", "p"))
    strata = F.map_concat(F.create_map(F.lit("*"), F.col("p.metrics")), F.col("p.stratified"))
    return (by_policy.select("run", "k", "policy", F.explode(strata).alias("stratum", "m"))
            .select("run", "k", "policy", "stratum", "m.*"))


def write_run_summaries(per_run: DataFrame, strata: DataFrame, path: str) -> None:
    """Nested summaries from flat metrics by (seed, K, policy) and (seed, K, policy, stratum).

    Every level is a handful of entries: strata of a policy, policies of a K, Ks of a run.
    """
    metrics = F.struct("total", "parse_count", "solve_count", F.col("equiv_count").alias("correct_count"), "error_count")

    def nest(rows: DataFrame, by: Sequence[str], key, value, name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    run = ["seed", "k", "policy"]
    inner = nest(strata, run, F.col("stratum"), metrics, "stratified")
    policies = per_run.select(*run, metrics.alias("metrics")).join(inner, run)
    blocks = nest(policies, ["seed", "k"], F.col("policy"), F.struct("metrics", "stratified"), "policies")
    runs = nest(blocks, ["seed"], F.col("k").cast("string"), F.struct("policies"), "comparisons")
    runs.select(F.col("seed").alias("run"), "comparisons").write.json(path)


def write_bucketed_pools(tasks: DataFrame, candidates: DataFrame, path: str, name: str,
                         buckets: int) -> tuple[DataFrame, DataFrame]:
    """Tasks and candidates as tables bucketed and sorted by task.

    Selection and mining over such tables need no shuffle by task at all. Choose
    the number of buckets so that one bucket of candidates fits a task's memory.
    """
    out = []
    for kind, rows in (("tasks", tasks), ("candidates", candidates)):
        table = f"{name}_{kind}"
        rows.write.bucketBy(buckets, "task_id").sortBy("task_id").option("path", f"{path}/{kind}").saveAsTable(table)
        out.append(rows.sparkSession.table(table))
    return out[0], out[1]


def write_examples(examples: DataFrame, path: str, fmt: str = "parquet", parseable_only: bool = False) -> None:
    rows = examples.where("parseable") if parseable_only else examples
    rows.write.format(fmt).save(path)


def resume_pending(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that are not in the checkpoint table yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")
