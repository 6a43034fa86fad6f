"""Corruptions and comparison of artifacts as jobs on their fact table, without an artifact in one row.

A fact is (task_id, section, pos, w): section objects, init or goal, its place there, its words (predicate first; of an
object only its name). An edit is (task_id, attempt, kind, section, pos, op, fact): op delete, replace or insert, the
latter behind the last place. A task of any number of facts is drawn from by a trimmed window, and edits are few, but for
exchanges of two names, which touch every fact with one of them. Texts are built by ``render`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.operators import facts as text_form
from poolwise.operators.facts import ALL_TYPES, Corruption
from poolwise.operators.ordering import top_per_group
from poolwise.session import work_path, write_bucketed

SECTIONS = ("objects", "init", "goal")
EDIT = ("task_id", "attempt", "kind", "section", "pos", "op", "fact")


def fact_text(w: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(w, " "), F.lit(")"))


def shown(section: Column, w: Column) -> Column:
    """A fact in parentheses, an object by its name."""
    return F.when(section == "objects", F.get(w, F.lit(0))).otherwise(fact_text(w))


def section_sizes(facts: DataFrame) -> DataFrame:
    """(task_id, n_objects, n_init, n_goal)."""
    return facts.groupBy("task_id").agg(*[F.count_if(F.col("section") == s).cast("int").alias(f"n_{s}") for s in SECTIONS])


@dataclass(frozen=True)
class Layout:
    """How a fact table lies: bucketed by task into ``buckets``, or of so ``few`` tasks that one row per task is broadcast."""
    buckets: int | None = None
    few: bool = False

    def per_task(self, rows: DataFrame) -> DataFrame:
        """``rows``, a few for each task, for a join with the facts."""
        return rows.hint("broadcast" if self.few else "merge")

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a written table: a few rows per task that are used more than once. Like tasks it is joined by merge."""
        if self.buckets:
            return write_bucketed(rows, name, "task_id", self.buckets).hint("merge")
        path = work_path(rows.sparkSession, name)
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path).hint("merge")


class Editor:
    """Seeded edits of a fact table. ``settings`` are those of the text form; draws are the same."""

    def __init__(self, settings: Corruption, layout: Layout = Layout()):
        self.settings, self.layout = settings, layout

    def over(self, layout: Layout) -> "Editor":
        """The same editor for facts that lie in another way."""
        return Editor(self.settings, layout)

    def _hash(self, kind: Column, *parts: Column) -> Column:
        """md5 of seed, kind, task, attempt (left out where there is none) and more."""
        return F.md5(F.concat_ws("|", F.lit(str(self.settings.seed)), kind, F.col("task_id").cast("string"),
                                 F.col("attempt").cast("string"), *[p.cast("string") for p in parts]))

    @staticmethod
    def _below(digest: Column, n: Column | int) -> Column:
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")

    def _eligible(self) -> Column:
        """Whether a fact may be drawn by the kind of its row."""
        kind, section, several = F.col("kind"), F.col("section"), F.size("w") >= 3
        by_draw = F.when(self._below(self._hash(kind, F.lit("section")), 2) == 0, "init").otherwise("goal")
        rules = {
            "swap_goal_args": (section == "goal") & several, "drop_init": section == "init", "drop_goal": section == "goal",
            "dup_init_wrong_args": (section == "init") & several, "negate_goal": section == "goal",
            "swap_args": several & (section == by_draw),
            "swap_objects": (section == "objects") & F.get("w", F.lit(0)).startswith(self.settings.object_prefix),
            "contradict_init": (section == "init") & F.get("w", F.lit(0)).isin(*self.settings.contradictions)}
        return reduce(lambda no, rule: F.when(kind == rule[0], rule[1]).otherwise(no), rules.items(), F.lit(False))

    def _negated(self, w: Column) -> Column:
        name, args = F.get(w, F.lit(0)), F.slice(w, 2, F.size(w))
        one, some = F.slice(args, 1, 1), F.size(args) > 0
        new = F.concat(F.lit("(not "), fact_text(w), F.lit(")"))
        for old, flipped in self.settings.flips.items():
            if flipped in text_form.UNARY:
                fact = F.when(some, text_form.render_fact(F.lit(flipped), one))
            elif flipped == "on":
                fact = F.when(some, text_form.render_fact(F.lit(flipped), F.concat(one, one)))
            else:
                fact = text_form.render_fact(F.lit(flipped), args)
            new = F.when(name == old, fact).otherwise(new)
        return new

    def _contradicted(self, w: Column) -> Column:
        name, args = F.get(w, F.lit(0)), F.slice(w, 2, F.size(w))
        one, new = F.slice(args, 1, 1), F.lit(None).cast("string")
        for old, contra in self.settings.contradictions.items():
            short = F.concat(one, F.array(F.lit("left"))) if contra == "carry" else one
            fact = text_form.render_fact(F.lit(contra), F.when(F.size(args) > 0, short).otherwise(args))
            new = F.when(name == old, fact).otherwise(new)
        return new

    def _one_place(self, picks: DataFrame, sizes: DataFrame) -> DataFrame:
        """The edits of kinds that change the drawn fact or add one."""
        w, kind = F.col("w"), F.col("kind")
        tail = F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0)))
        rotated = fact_text(F.concat(F.slice(w, 1, 1), tail, F.slice(w, 2, 1)))
        turned = fact_text(F.concat(F.slice(w, 1, 1), F.reverse(F.slice(w, 2, F.size(w)))))
        at = lambda place, op, fact: F.struct(place.alias("pos"), F.lit(op).alias("op"), fact.cast("string").alias("fact"))
        here, end = F.col("pos"), F.col("n_init")
        rules = {
            "swap_goal_args": at(here, "replace", rotated), "swap_args": at(here, "replace", turned),
            "drop_init": F.when(F.col("n_init") > 2, at(here, "delete", F.lit(None))),
            "drop_goal": F.when(F.col("n_goal") > 1, at(here, "delete", F.lit(None))),
            "dup_init_wrong_args": F.when(rotated != fact_text(w), at(end, "insert", rotated)),
            "negate_goal": at(here, "replace", self._negated(w)),
            "contradict_init": at(end, "insert", self._contradicted(w))}
        edit = reduce(lambda no, rule: F.when(kind == rule[0], rule[1]).otherwise(no), rules.items(), F.lit(None))
        # Staged, so that the edit is not copied into each part of the filter.
        made = text_form.staged(picks.where(kind.isin(*rules)).join(sizes, "task_id"), "e", edit).withColumnRenamed("w", "old")
        changed = F.col("e.op").isNotNull() & ((F.col("e.op") == "delete") | (
            F.col("e.fact").isNotNull() & ((F.col("e.op") == "insert") | (F.col("e.fact") != fact_text(F.col("old"))))))
        return made.where(changed).select("task_id", "attempt", "kind", "section", "e.*")

    def _added(self, slots: DataFrame, sizes: DataFrame) -> DataFrame:
        name = F.concat(F.lit("extra_"), (self._below(self._hash(F.lit("add_object")), 99) + 1).cast("string"))
        return slots.where("kind = 'add_object'").join(sizes, "task_id").select(
            "task_id", "attempt", "kind", F.lit("objects").alias("section"), F.col("n_objects").alias("pos"),
            F.lit("insert").alias("op"), name.alias("fact"))

    def _exchanged(self, facts: DataFrame, slots: DataFrame, picks: DataFrame) -> DataFrame:
        """Two names change places in every fact. The other side of the join has one row per task and attempt."""
        name = F.get("w", F.lit(0))
        drawn = picks.where("kind = 'swap_objects'").groupBy("task_id", "attempt", "kind").agg(
            F.max(F.when(F.col("rn") == 1, name)).alias("a"), F.max(F.when(F.col("rn") == 2, name)).alias("b")).where("b IS NOT NULL")
        one, two = self.settings.named
        both = facts.groupBy("task_id").agg(*[F.max(F.array_contains("w", x)).alias(c) for c, x in (("x", one), ("y", two))]).where("x AND y")
        named = slots.where("kind = 'swap_named'").join(self.layout.per_task(both), "task_id").select(
            "task_id", "attempt", "kind", F.lit(one).alias("a"), F.lit(two).alias("b"))
        new = F.transform("w", lambda x, i: F.when((i > 0) | (F.col("section") == "objects"), F.when(
            x == F.col("a"), F.col("b")).when(x == F.col("b"), F.col("a")).otherwise(x)).otherwise(x))
        rows = facts.join(self.layout.per_task(drawn.unionByName(named)), "task_id").withColumn("new", new).where("new <> w")
        return rows.select("task_id", "attempt", "kind", "section", "pos", F.lit("replace").alias("op"),
                           shown(F.col("section"), F.col("new")).alias("fact"))

    def _edits(self, facts: DataFrame, slots: DataFrame, sizes: DataFrame, kinds: Sequence[str]) -> DataFrame:
        """Edits of ``slots`` (task_id, attempt, kind), all kinds in one join and one window over the facts."""
        rows = facts.join(self.layout.per_task(slots), "task_id").where(self._eligible())
        picks = top_per_group(rows.withColumn("_h", self._hash(F.col("kind"), F.col("pos"))), ["task_id", "attempt", "kind"],
                              ["_h", "pos"], 2 if "swap_objects" in kinds else 1)
        if len(kinds) > 1:
            picks = self.layout.stored(picks.drop("_h"), "picks")
        parts = []
        if set(kinds) - {"add_object", "swap_objects", "swap_named"}:
            parts.append(self._one_place(picks.where("rn = 1"), sizes))
        if "add_object" in kinds:
            parts.append(self._added(slots, sizes))
        if {"swap_objects", "swap_named"} & set(kinds):
            parts.append(self._exchanged(facts, slots, picks))
        return reduce(DataFrame.unionByName, parts).select(*EDIT)

    def edit(self, facts: DataFrame, kind: str) -> DataFrame:
        """One corruption of every task, by edits; tasks that it does not change have none."""
        sizes = section_sizes(facts)
        slots = sizes.select("task_id", F.lit(None).cast("int").alias("attempt"), F.lit(kind).alias("kind"))
        return self._edits(facts, slots, sizes, [kind])

    def edit_many(self, facts: DataFrame, tasks: DataFrame, n: int = 2, pools: dict[str, Sequence[str]] | None = None,
                  allowed: Sequence[str] | None = None) -> DataFrame:
        """Up to ``n`` corruptions of every task out of 3n attempts: EDIT with ``rn``, the number of the corruption.

        An attempt draws its kind from ``allowed``, else from the pool of the task's domain, else from all kinds;
        ``tasks`` is (task_id, domain). An attempt that changes nothing doesn't count, so there may be fewer than n.
        """
        every = F.array(*[F.lit(k) for k in (allowed or ALL_TYPES)])
        pool = every
        for domain, kinds in ({} if allowed else pools or {}).items():
            pool = F.when(F.col("domain") == domain, F.array(*[F.lit(k) for k in kinds])).otherwise(pool)
        sizes = self.layout.stored(section_sizes(facts), "sizes")
        tries = (sizes.select("task_id").join(tasks.select("task_id", "domain"), "task_id", "left")
                 .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3 * n)))))
        number = self._below(self._hash(F.lit("type")), F.size(pool))
        slots = tries.select("task_id", "attempt", F.get(pool, number).alias("kind"))
        kinds = {*(allowed or ALL_TYPES), *(k for p in ({} if allowed else pools or {}).values() for k in p)}
        found = self._edits(facts, slots, sizes, sorted(kinds))
        if self.layout.buckets:
            # One pass: all edits of a task are in one partition.
            number = F.dense_rank().over(W.partitionBy("task_id").orderBy("attempt"))
            return found.withColumn("rn", number).where(F.col("rn") <= n).select(*EDIT, "rn")
        found = self.layout.stored(found, "edits")
        kept = top_per_group(found.select("task_id", "attempt").distinct(), ["task_id"], ["attempt"], n)
        return found.join(self.layout.per_task(kept), ["task_id", "attempt"]).select(*EDIT, "rn")

    def edit_simple(self, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One of three plain edits per task: two goal facts change places, an initial fact goes, an object is added.

        Returns (task_id, kind) of all tasks, and the edits; tasks too small for their kind stay as they are.
        """
        sizes = self.layout.stored(section_sizes(facts), "sizes")
        names = F.array(*[F.lit(k) for k in ("reorder_goal", "drop_init", "add_object")])
        slots = sizes.select("task_id", F.lit(None).cast("int").alias("attempt"))
        slots = slots.withColumn("kind", F.get(names, self._below(self._hash(F.lit("simple")), 3)))
        goals = facts.where("section = 'goal'").join(self.layout.per_task(slots.where("kind = 'reorder_goal'")), "task_id")
        two = top_per_group(goals.withColumn("_h", self._hash(F.lit("reorder"), F.col("pos"))), ["task_id"], ["_h", "pos"], 2)
        pair = F.array_sort(F.collect_list(F.struct("rn", "pos", fact_text(F.col("w")).alias("fact"))))
        i, j = F.get("two", F.lit(0)), F.get("two", F.lit(1))
        swap = F.array(*[F.struct(x["pos"].alias("pos"), F.lit("replace").alias("op"), y["fact"].alias("fact")) for x, y in ((i, j), (j, i))])
        moved = two.groupBy("task_id", "attempt", "kind").agg(pair.alias("two")).where(F.size("two") == 2).select(
            "task_id", "attempt", "kind", F.lit("goal").alias("section"), F.inline(swap))
        other = self._edits(facts, slots, sizes, ["drop_init", "add_object"])
        return slots.select("task_id", "kind"), self.layout.stored(moved.unionByName(other), "edits")


def applied(facts: DataFrame, edits: DataFrame, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """(by, section, pos, fact) of facts with one set of edits per task applied; places of deleted facts stay empty."""
    place = [*by, "section", "pos"]
    shown_facts = facts.select(*place, shown(F.col("section"), F.col("w")).alias("_old"))
    at_place = edits.where("op <> 'insert'").select(*place, "op", "fact")
    kept = shown_facts.join(at_place, place, "left").where("op IS NULL OR op <> 'delete'")
    return kept.select(*place, F.coalesce("fact", "_old").alias("fact")).unionByName(
        edits.where("op = 'insert'").select(*place, "fact"))


def fact_diff(gold: DataFrame, other: DataFrame, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """Missing and extra facts of two fact tables (by, section, fact), their Jaccard similarity and whether the sets are equal.

    Facts are counted on both sides by (task, section, fact), so a task's facts spread over all partitions; only four
    numbers per task meet.
    """
    sides = gold.select(*by, "section", "fact", F.lit(1).alias("g"), F.lit(0).alias("c")).unionByName(
        other.select(*by, "section", "fact", F.lit(0).alias("g"), F.lit(1).alias("c")))
    each = sides.groupBy(*by, "section", "fact").agg(F.max("g").alias("g"), F.max("c").alias("c"))
    out = each.groupBy(*by).agg(*[F.sum(x).cast("int").alias(name) for name, x in (
        ("missing", F.col("g") * (1 - F.col("c"))), ("extra", F.col("c") * (1 - F.col("g"))), ("common", F.col("g") * F.col("c")))])
    return compared(out)


def edit_diff(facts: DataFrame, edits: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``fact_diff`` of facts and the same facts with ``edits`` applied, from the facts and a few edits per task.

    The edits of a task meet its facts in one join; a fact is on the other side unless all its places are edited, or
    where an edit writes it. New facts that the task does not have are the extra ones.
    """
    old = F.when((F.col("op") == "delete") | ((F.col("op") == "replace") & F.col("fact").isNotNull()), F.struct("section", "pos"))
    new = F.when((F.col("op") != "delete") & F.col("fact").isNotNull(), F.struct("section", "fact"))
    per_task = edits.groupBy("task_id").agg(F.collect_list(old).alias("old"), F.collect_set(new).alias("new"))
    rows = facts.join(layout.per_task(per_task), "task_id", "left").withColumn("fact", shown(F.col("section"), F.col("w")))

    def among(list_: str, *entry: str) -> Column:
        return F.coalesce(F.array_contains(list_, F.struct(*entry)), F.lit(False)).cast("int")

    each = rows.select("task_id", "section", "fact", (1 - among("old", "section", "pos")).alias("stays"),
                       among("new", "section", "fact").alias("written"),
                       F.coalesce(F.size("new"), F.lit(0)).alias("n_new"))
    each = each.groupBy("task_id", "section", "fact").agg(*[F.max(c).alias(c) for c in ("stays", "written", "n_new")])
    common = F.greatest("stays", "written")
    out = each.groupBy("task_id").agg(
        F.sum(1 - common).cast("int").alias("missing"),
        (F.max("n_new") - F.sum("written")).cast("int").alias("extra"), F.sum(common).cast("int").alias("common"))
    return compared(out)


def compared(counts: DataFrame) -> DataFrame:
    """Adds jaccard and exact to the counts of missing, extra and common facts."""
    union = F.col("missing") + F.col("extra") + F.col("common")
    return counts.select("*", (F.col("common") / F.greatest(union, F.lit(1))).alias("jaccard"),
                         ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("exact"))


def render(facts: DataFrame, head: Column, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """(by, artifact) from (by, section, pos, fact): the one place where a task's facts become a text, so a row."""
    def ordered(section: str) -> Column:
        found = F.collect_list(F.when(F.col("section") == section, F.struct("pos", "fact")))
        return F.transform(F.array_sort(found), lambda e: e["fact"])
    rows = facts.groupBy(*by).agg(*[ordered(s).alias(s) for s in SECTIONS])
    return rows.select(*by, text_form.render_artifact(head, F.col("objects"), F.col("init"), F.col("goal")).alias("artifact"))


def label(sizes: DataFrame, diff: DataFrame, policy: str) -> DataFrame:
    """Labels of corrupted artifacts by policy: one that equals gold is kept as positive, relabelled or dropped.

    ``sizes`` is (task_id, kind), ``diff`` the result of ``fact_diff``.
    """
    rows = sizes.join(diff, "task_id").withColumn("equals_gold", F.col("exact"))
    if policy == "drop":
        rows = rows.where(~F.col("equals_gold"))
    positive = F.when(F.col("equals_gold") & F.lit(policy == "keep"), 1).otherwise(0)
    return rows.withColumn("label", positive).withColumn("relabelled", F.col("equals_gold") & F.lit(policy == "relabel"))
