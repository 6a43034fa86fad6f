"""Structured-text operators: sections, facts and seeded corruptions of s-expression artifacts.

Every edit stays within one artifact, so all of them are row-local array
expressions: no shuffle, whatever the number of artifacts. Random choices take
the smallest md5 of (seed, kind, key, position), which no repartitioning changes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.text import balanced_from, collapse_space

# How a goal predicate is flipped and which fact contradicts another.
FLIP = {"on": "on-table", "on-table": "on", "clear": "holding", "holding": "clear",
        "at": "carry", "carry": "at", "free": "carry"}
UNARY = ("on-table", "holding", "clear", "free")
CONTRADICTION = {"clear": "holding", "on-table": "holding", "free": "carry"}
# Corruption types by domain.
GENERAL_TYPES = ("swap_goal_args", "drop_init", "add_object", "drop_goal", "dup_init_wrong_args",
                 "negate_goal", "swap_args", "contradict_init")
DOMAIN_TYPES = {"blocksworld": GENERAL_TYPES + ("swap_objects",), "gripper": GENERAL_TYPES + ("swap_named",)}
ALL_TYPES = GENERAL_TYPES + ("swap_objects", "swap_named")


def extract_section(text: Column, section: str) -> Column:
    """Text of one section, NULL if there is none or its parentheses never close."""
    return balanced_from(text, rf"\(:{section}\s")


def section_facts(section: Column) -> Column:
    """Innermost ``(...)`` groups of a section, in order."""
    return F.regexp_extract_all(section, F.lit(r"(\([^()]+\))"), F.lit(1))


def words(fact: Column) -> Column:
    return F.split(collapse_space(F.translate(fact, "()", "")), " ")


def object_names(section: Column) -> Column:
    return F.split(collapse_space(F.regexp_replace(section, r"^\(:objects|\)$", "")), " ")


def render_fact(name: Column, args: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.concat(F.array(name), args), " "), F.lit(")"))


def render_init(facts: Column) -> Column:
    return F.concat(F.lit("(:init "), F.array_join(facts, " "), F.lit(")"))


def render_goal(facts: Column) -> Column:
    return F.concat(F.lit("(:goal (and "), F.array_join(facts, " "), F.lit("))"))


def render_objects(names: Column) -> Column:
    return F.concat(F.lit("(:objects "), F.array_join(names, " "), F.lit(")"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence only; NULL if ``old`` does not occur."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.left(text, at - 1), new, F.substr(text, at + F.length(old))))


def staged(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``expr`` as a column that is computed exactly once per row.

    A plain projection would be copied into every later use and into pushed
    filters, also inside lambdas; the output of a generator is not.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def parse_artifacts(df: DataFrame, text: str = "artifact") -> DataFrame:
    """Adds the sections and their facts as columns."""
    sections = F.struct(*[extract_section(F.col(text), s).alias(s) for s in ("objects", "init", "goal")])
    out = staged(df, "_s", sections)
    lists = F.struct(object_names(F.col("_s.objects")).alias("object_list"),
                     section_facts(F.col("_s.init")).alias("init_facts"),
                     section_facts(F.col("_s.goal")).alias("goal_facts"))
    return staged(out, "_l", lists).select(*df.columns, "_s.*", "_l.*")


def with_words(parsed: DataFrame) -> DataFrame:
    """Adds the facts split into words, which the random choices look at."""
    def split(facts: str) -> Column:
        return F.transform(F.col(facts), lambda x: F.struct(x.alias("fact"), words(x).alias("w")))
    both = F.struct(split("init_facts").alias("init_words"), split("goal_facts").alias("goal_words"))
    return staged(parsed, "_w", both).select(*parsed.columns, "_w.*")


def explode_facts(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fact table: one row per fact with predicate and arguments."""
    def rows(section: str) -> DataFrame:
        return parsed.select(*keys, F.lit(section).alias("section"),
                             F.posexplode(f"{section}_facts").alias("pos", "fact"))
    facts = rows("init").unionByName(rows("goal")).withColumn("w", words(F.col("fact")))
    return facts.select(*keys, "section", "pos", F.get("w", F.lit(0)).alias("pred"),
                        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("args"))


def render_artifact(header: Column, objects: Column, init: Column, goal: Column) -> Column:
    return F.concat(header, F.lit(" "), render_objects(objects), F.lit(" "), render_init(init),
                    F.lit(" "), render_goal(goal), F.lit(")"))


def render_from_facts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts table back to section texts, by ordered aggregation of each artifact's facts."""
    entry = F.struct("pos", render_fact(F.col("pred"), F.col("args")).alias("fact"))
    def ordered(section: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == section, entry))),
                           lambda e: e["fact"])
    return facts.groupBy(*keys).agg(render_init(ordered("init")).alias("init"),
                                    render_goal(ordered("goal")).alias("goal"))


# ---------------------------------------------------------------- seeded choice

@dataclass(frozen=True)
class Draw:
    """Seed, kind and row key of a random choice."""
    seed: int
    kind: str
    key: Column
    salt: Column | None = None

    def hash(self, *parts: Column) -> Column:
        extra = [self.salt.cast("string")] if self.salt is not None else []
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.kind), self.key.cast("string"),
                                 *extra, *[p.cast("string") for p in parts]))

    def _marked(self, items: Column, eligible: Callable[[Column], Column]) -> Column:
        marked = F.transform(items, lambda x, i: F.when(
            eligible(x), F.struct(self.hash(i).alias("h"), i.alias("pos"), x.alias("item"))))
        return F.filter(marked, lambda s: s.isNotNull())

    def order(self, items: Column, eligible: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
        """Eligible items as (hash, pos, item), sorted by hash."""
        return F.array_sort(self._marked(items, eligible))

    def choose(self, facts: Column, eligible: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
        """The drawn fact as (pos, item, w) with its words, NULL if none is eligible."""
        best = F.array_min(self._marked(facts, eligible))
        return F.struct(best["pos"].alias("pos"), best["item"]["fact"].alias("item"), best["item"]["w"].alias("w"))

    def below(self, n: int, *parts: Column) -> Column:
        return (F.conv(F.substring(self.hash(*parts), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def _multi_arg(fact: Column) -> Column:
    return F.size(fact["w"]) >= 3


def _args(w: Column) -> Column:
    return F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))


def _fact(w: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(w, " "), F.lit(")"))


def _rotated(w: Column) -> Column:
    tail = F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0)))
    return _fact(F.concat(F.slice(w, 1, 1), tail, F.slice(w, 2, 1)))


def _reversed(w: Column) -> Column:
    return _fact(F.concat(F.slice(w, 1, 1), F.reverse(_args(w))))


def _without(items: Column, pos: Column) -> Column:
    return F.concat(F.slice(items, 1, pos), F.slice(items, pos + 2, F.size(items)))


def _edit(section: str, new: Column) -> Column:
    return replace_first(F.col("artifact"), F.col(section), new)


def _changed(old: Column, new: Column) -> Column:
    return F.when(new != old, new)


def _exchange(a: Column, b: Column) -> Column:
    """Exchange two argument tokens everywhere in the artifact."""
    tokens = F.split(F.col("artifact"), r"(?<= )|(?=[ )])")
    return F.array_join(F.transform(tokens, lambda t: F.when(t == a, b).when(t == b, a).otherwise(t)), "")


# ---------------------------------------------------------------- corruptions
# ``draw`` gives the random choice as one column; ``edit`` gives the new artifact from that
# column, or NULL where it does not apply. The choice is a projection of its own, so it is
# made once per artifact and not once per use.

@dataclass(frozen=True)
class Kind:
    draw: Callable[[Draw, "Corruption"], Column]
    edit: Callable[[Column, "Corruption"], Column]


def _swap_goal_args(t: Column, cfg: "Corruption") -> Column:
    return _edit("goal", replace_first(F.col("goal"), t["item"], _rotated(t["w"])))


def _drop_init(t: Column, cfg: "Corruption") -> Column:
    facts = F.col("init_facts")
    return F.when(F.size(facts) > 2, _edit("init", render_init(_without(facts, t["pos"]))))


def _add_object(t: Column, cfg: "Corruption") -> Column:
    return _edit("objects", render_objects(F.concat(F.col("object_list"), F.array(t))))


def _extra_name(d: Draw, cfg: "Corruption") -> Column:
    return F.concat(F.lit("extra_"), (d.below(99) + 1).cast("string"))


def _drop_goal(t: Column, cfg: "Corruption") -> Column:
    shorter = collapse_space(replace_first(F.col("goal"), t["item"], F.lit("")))
    return F.when(F.size("goal_facts") > 1, _edit("goal", shorter))


def _dup_init(t: Column, cfg: "Corruption") -> Column:
    copy = _changed(t["item"], _rotated(t["w"]))
    return F.when(copy.isNotNull(), _edit("init", render_init(F.concat(F.col("init_facts"), F.array(copy)))))


def _negate_goal(t: Column, cfg: "Corruption") -> Column:
    w = t["w"]
    name, args = F.get(w, F.lit(0)), _args(w)
    one, some = F.slice(args, 1, 1), F.size(args) > 0
    new = F.concat(F.lit("(not "), t["item"], F.lit(")"))
    for old, flipped in cfg.flips.items():
        if flipped in UNARY:
            fact = F.when(some, render_fact(F.lit(flipped), one))
        elif flipped == "on":
            fact = F.when(some, render_fact(F.lit(flipped), F.concat(one, one)))
        else:
            fact = render_fact(F.lit(flipped), args)
        new = F.when(name == old, fact).otherwise(new)
    return _edit("goal", replace_first(F.col("goal"), t["item"], new))


def _draw_swap_args(d: Draw, cfg: "Corruption") -> Column:
    """Section first, then one of its facts with several arguments."""
    in_init = d.below(2, F.lit("section")) == 0
    facts = F.when(in_init, F.col("init_words")).otherwise(F.col("goal_words"))
    return F.struct(in_init.alias("in_init"), d.choose(facts, _multi_arg).alias("t"))


def _swap_args(t: Column, cfg: "Corruption") -> Column:
    new = _changed(t["t"]["item"], _reversed(t["t"]["w"]))
    def edit(section: str) -> Column:
        return _edit(section, replace_first(F.col(section), t["t"]["item"], new))
    return F.when(t["in_init"], edit("init")).otherwise(edit("goal"))


def _draw_objects(d: Draw, cfg: "Corruption") -> Column:
    named = d.order(F.array_distinct("object_list"), lambda x: x.startswith(cfg.object_prefix))
    return F.transform(F.slice(named, 1, 2), lambda s: s["item"])


def _swap_objects(t: Column, cfg: "Corruption") -> Column:
    return F.when(F.size(t) == 2, _exchange(F.get(t, F.lit(0)), F.get(t, F.lit(1))))


def _swap_named(t: Column, cfg: "Corruption") -> Column:
    a, b = cfg.named
    text = F.col("artifact")
    return F.when(text.contains(a) & text.contains(b), _exchange(F.lit(a), F.lit(b)))


def _contradict_init(t: Column, cfg: "Corruption") -> Column:
    w = t["w"]
    name, args = F.get(w, F.lit(0)), _args(w)
    one = F.slice(args, 1, 1)
    new = F.lit(None).cast("string")
    for old, contra in cfg.contradictions.items():
        short = F.concat(one, F.array(F.lit("left"))) if contra == "carry" else one
        fact = render_fact(F.lit(contra), F.when(F.size(args) > 0, short).otherwise(args))
        new = F.when(name == old, fact).otherwise(new)
    return F.when(new.isNotNull(), _edit("init", render_init(F.concat(F.col("init_facts"), F.array(new)))))


CORRUPTIONS: dict[str, Kind] = {
    "swap_goal_args": Kind(lambda d, c: d.choose(F.col("goal_words"), _multi_arg), _swap_goal_args),
    "drop_init": Kind(lambda d, c: d.choose(F.col("init_words")), _drop_init),
    "add_object": Kind(_extra_name, _add_object),
    "drop_goal": Kind(lambda d, c: d.choose(F.col("goal_words")), _drop_goal),
    "dup_init_wrong_args": Kind(lambda d, c: d.choose(F.col("init_words"), _multi_arg), _dup_init),
    "negate_goal": Kind(lambda d, c: d.choose(F.col("goal_words")), _negate_goal),
    "swap_args": Kind(_draw_swap_args, _swap_args),
    "swap_objects": Kind(_draw_objects, _swap_objects),
    "swap_named": Kind(lambda d, c: F.lit(True), _swap_named),
    "contradict_init": Kind(
        lambda d, c: d.choose(F.col("init_words"),
                              lambda x: F.get(x["w"], F.lit(0)).isin(*c.contradictions)), _contradict_init),
}


@dataclass(frozen=True)
class Corruption:
    """Settings of a corruption run."""
    seed: int = 0
    key: str = "task_id"
    object_prefix: str = "b"
    named: tuple[str, str] = ("rooma", "roomb")
    flips: dict[str, str] = field(default_factory=lambda: dict(FLIP))
    contradictions: dict[str, str] = field(default_factory=lambda: dict(CONTRADICTION))

    def _draw(self, kind: str, salt: Column | None = None) -> Draw:
        return Draw(self.seed, kind, F.col(self.key), salt)

    def corrupt(self, parsed: DataFrame, kind: str) -> DataFrame:
        """One corruption of every artifact; artifacts it does not change drop out."""
        rule = CORRUPTIONS[kind]
        drawn = staged(with_words(parsed), "drawn", rule.draw(self._draw(kind), self))
        return (staged(drawn, "corrupted", rule.edit(F.col("drawn"), self))
                .select(self.key, F.lit(kind).alias("kind"), "artifact", "corrupted")
                .where("corrupted IS NOT NULL AND corrupted <> artifact"))

    def corrupt_many(self, parsed: DataFrame, n: int = 2, kinds: Sequence[str] = ALL_TYPES) -> DataFrame:
        """Up to ``n`` corruptions per artifact out of 3n attempts with drawn types.

        Attempts are entries of an array on the artifact's own row, so the text is
        neither repeated per attempt nor shuffled.
        """
        def no(kind: str) -> Column:
            return F.lit(kinds.index(kind))

        def draw(t: Column) -> Column:
            return F.struct(t["attempt"].alias("attempt"), t["type_no"].alias("type_no"), *[
                F.when(t["type_no"] == no(kind), CORRUPTIONS[kind].draw(self._draw(kind, t["attempt"]), self)).alias(kind)
                for kind in kinds])

        def result(d: Column) -> Column:
            new = F.lit(None).cast("string")
            for kind in kinds:
                new = F.when(d["type_no"] == no(kind), CORRUPTIONS[kind].edit(d[kind], self)).otherwise(new)
            names = F.array(*[F.lit(k) for k in kinds])
            return F.struct(d["attempt"].alias("attempt"), F.get(names, d["type_no"]).alias("kind"), new.alias("corrupted"))

        typed = F.transform(F.sequence(F.lit(1), F.lit(3 * n)), lambda a: F.struct(
            a.alias("attempt"), self._draw("type").below(len(kinds), a).alias("type_no")))
        attempts = F.transform(typed, draw)
        tried = F.transform(F.col("attempts"), result)
        changed = F.filter(tried, lambda r: F.coalesce(r["corrupted"] != F.col("artifact"), F.lit(False)))
        kept = staged(staged(with_words(parsed), "attempts", attempts), "kept", F.slice(changed, 1, n))
        return (kept.select(self.key, "artifact", F.posexplode("kept").alias("pos", "r"))
                .select(self.key, "r.attempt", "r.kind", "artifact", "r.corrupted", (F.col("pos") + 1).alias("rn")))

    def corrupt_simple(self, parsed: DataFrame) -> DataFrame:
        """One of three plain edits: two goal facts change places, an initial fact goes, an object is added."""
        facts = F.col("goal_facts")
        picked = self._draw("reorder").order(facts)
        drawn = staged(with_words(parsed), "d", F.struct(
            self._draw("simple").below(3).alias("choice"), F.slice(picked, 1, 2).alias("two"),
            *[CORRUPTIONS[k].draw(self._draw(k), self).alias(k) for k in ("drop_init", "add_object")]))
        i, j = F.get("d.two", F.lit(0)), F.get("d.two", F.lit(1))
        swapped = F.transform(facts, lambda x, p: F.when(p == i["pos"], j["item"])
                              .when(p == j["pos"], i["item"]).otherwise(x))
        choice = F.col("d.choice")
        new = (F.when(choice == 0, F.when(F.size(facts) >= 2, _edit("goal", render_goal(swapped))))
               .when(choice == 1, _drop_init(F.col("d.drop_init"), self))
               .otherwise(_add_object(F.col("d.add_object"), self)))
        kind = F.when(choice == 0, "reorder_goal").when(choice == 1, "drop_init").otherwise("add_object")
        return (staged(drawn, "corrupted", F.coalesce(new, F.col("artifact")))
                .select(self.key, kind.alias("kind"), "artifact", "corrupted"))


# ---------------------------------------------------------------- comparison and labels

def fact_set(text: Column) -> Column:
    """Objects, initial facts and goal facts of an artifact as one set of tagged strings."""
    def tagged(tag: str, items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")),
                           lambda x: F.concat(F.lit(f"{tag}:"), collapse_space(x)))
    return F.array_distinct(F.concat(
        tagged("object", object_names(extract_section(text, "objects"))),
        tagged("init", section_facts(extract_section(text, "init"))),
        tagged("goal", section_facts(extract_section(text, "goal")))))


def fact_diff(pairs: DataFrame, gold: str = "artifact", candidate: str = "corrupted") -> DataFrame:
    """Missing and extra facts, Jaccard similarity and exact set match of two artifacts per row."""
    sets = staged(pairs, "_sets", F.struct(fact_set(F.col(gold)).alias("g"), fact_set(F.col(candidate)).alias("c")))
    g, c = F.col("_sets.g"), F.col("_sets.c")
    sizes = F.struct(F.size(F.array_except(g, c)).alias("missing"), F.size(F.array_except(c, g)).alias("extra"),
                     F.size(F.array_intersect(g, c)).alias("common"))
    sized = staged(sets, "_n", sizes).select(*pairs.columns, "_n.*")
    union = F.col("missing") + F.col("extra") + F.col("common")
    return sized.select("*", (F.col("common") / F.greatest(union, F.lit(1))).alias("jaccard"),
                        ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("exact"))


def label_corruptions(corruptions: DataFrame, policy: str = "relabel") -> DataFrame:
    """Labels corrupted artifacts; one that still equals gold is kept as positive, relabelled or dropped."""
    rows = fact_diff(corruptions).withColumn("equals_gold", F.col("exact"))
    if policy == "drop":
        rows = rows.where(~F.col("equals_gold"))
    label = F.when(F.col("equals_gold") & F.lit(policy == "keep"), 1).otherwise(0)
    return rows.withColumn("label", label).withColumn("relabelled", F.col("equals_gold") & F.lit(policy == "relabel"))


def relabel_policy(examples: DataFrame, policy: str = "relabel") -> DataFrame:
    """The same policy on an example table: positive perturbations become negative or are dropped."""
    hit = F.coalesce((F.col("source") == "perturbation") & (F.col("label") == 1), F.lit(False))
    if policy == "drop":
        return examples.where(~hit).withColumn("touched", F.lit(False))
    return examples.withColumn("touched", hit).withColumn("label", F.when(hit, 0).otherwise(F.col("label")))


def label_timeouts(evaluations: DataFrame) -> DataFrame:
    """Labels from an evaluation table: correct gives 1, a timeout or error gives 0."""
    timed_out = F.coalesce(F.col("error") == "timeout", F.lit(False))
    failed = F.length(F.coalesce("error", F.lit(""))) > 0
    return (evaluations.withColumn("timed_out", timed_out)
            .withColumn("label", F.when(F.col("correct") & ~failed, 1).otherwise(0)))
