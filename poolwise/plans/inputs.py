"""Inputs that several queries share, built from the tables of one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise.operators import mining, selection as sel
from poolwise.operators.edits import Layout
from poolwise.operators.metrics import batch_metrics
from poolwise.operators.ordering import is_wide
from poolwise.session import bucket_count, work_path, write_bucketed
from poolwise.sources import tables as t


class Inputs:
    """Views of one (session, folder) for one query. All build plans only, but numbering all candidates counts them by
    task and writes those of wide tasks, and ``fact_parts`` writes all, each once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._wide, self._numbered, self._parts = spark, sf_dir, None, None, None

    def wide(self) -> list[int]:
        if self._wide is None:
            self._wide = t.wide_tasks(self.spark, self.dir)
        return self._wide

    def tasks(self) -> DataFrame:
        return t.styled_tasks(self.spark, self.dir)

    def candidates(self, max_k: int | None = None) -> DataFrame:
        if max_k is not None:
            return t.candidates(self.spark, self.dir, max_k)
        if self._numbered is None:
            self._numbered = t.candidates(self.spark, self.dir, wide=self.wide())
        return self._numbered

    def loose_candidates(self) -> DataFrame:
        """All candidates without their index."""
        return t.candidates(self.spark, self.dir, numbered=False)

    def repairs(self) -> DataFrame:
        return t.repair_rows(self.spark, self.dir)

    def examples(self) -> DataFrame:
        return t.examples(self.spark, self.dir)

    def artifacts(self) -> DataFrame:
        """Texts of all tasks; joined by merge for the same reason as tasks."""
        return t.artifacts(self.candidates()).hint("merge")

    def facts(self) -> DataFrame:
        """The facts of all artifacts, for queries that read them once."""
        return t.facts(self.candidates())

    def fact_parts(self) -> list[tuple[DataFrame, Layout]]:
        """The facts of all artifacts for queries that read them more than once, so candidates are numbered once.

        All tasks but wide ones are bucketed by task: what follows by task needs no exchange. Facts of wide tasks are
        a plain table whose rows are spread; these tasks are so few that what has a row per task is broadcast.
        """
        if self._parts is None:
            rows = self.candidates().select("task_id", "cand_idx", "payload", "model")
            wide = is_wide("task_id", self.wide())
            buckets = bucket_count(self.spark, t.load(self.spark, self.dir, "lineitem").count())
            narrow = write_bucketed(rows.where(~wide) if self.wide() else rows, "slots", "task_id", buckets)
            self._parts = [(t.facts(narrow), Layout(buckets=buckets))]
            if self.wide():
                path = work_path(self.spark, "wide-slots")
                rows.where(wide).write.parquet(path)
                self._parts.append((t.facts(self.spark.read.schema(rows.schema).parquet(path)), Layout(few=True)))
        return self._parts

    def aggregates(self, *attrs: str, ks: Sequence[int] = sel.K_VALUES, alphas: Sequence[float] = ()) -> DataFrame:
        tasks = self.tasks().select("task_id", *attrs)
        return sel.pool_aggregates(tasks, self.candidates(max(ks)), ks, alphas=alphas)

    def picks(self, policies: dict[str, sel.Policy], *attrs: str, ks: Sequence[int] = sel.K_VALUES,
              alphas: Sequence[float] = (), **options) -> DataFrame:
        return sel.select(self.aggregates(*attrs, ks=ks, alphas=alphas), policies, ["task_id", *attrs], **options)

    def basic(self, *attrs: str, **options) -> DataFrame:
        return self.picks(sel.basic_policies(), *attrs, **options)

    def search(self, *attrs: str, **options) -> DataFrame:
        return self.picks(sel.search_policies(), *attrs, **options)

    def replay(self, *attrs: str, **options) -> DataFrame:
        return self.picks(sel.replay_policies(), *attrs, alphas=sel.ALPHAS, **options)

    def members(self, ks: Sequence[int] = (4, 8), score: str = "score") -> DataFrame:
        return mining.members(self.tasks(), self.candidates(max(ks)), ks, score)

    def scorer_rates(self) -> DataFrame:
        """Rates per seed, K and scorer for the ranked policy of both scorers."""
        both = {"scorer_a": sel.verifier_ranked(), "scorer_b": sel.second_scorer_ranked()}
        picks = self.picks(both, "seed", reasons=False).withColumnRenamed("policy", "verifier")
        return batch_metrics(picks, ["seed", "k", "verifier"])

    def seed_rates(self) -> DataFrame:
        """Ranked K=8 rate per seed."""
        picks = self.picks({"verifier_ranked": sel.verifier_ranked()}, "seed", ks=(8,), reasons=False)
        return batch_metrics(picks, ["seed"])

    def model_pools(self) -> tuple[DataFrame, DataFrame]:
        """Each task once per generator model, and the first eight candidates of each model, numbered within it.

        The numbers come from the raw order with a limit per (task, model), so they are trimmed before the shuffle.
        """
        models = F.array(*[F.lit(f"model_{i}") for i in range(3)])
        tasks = self.tasks().select("task_id", "seed", "domain", F.explode(models).alias("model"))
        return tasks, t.candidates(self.spark, self.dir, 8, per_model=True)
