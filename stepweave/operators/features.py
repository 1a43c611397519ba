"""Feature dictionary and the step state table."""

from __future__ import annotations

import contextlib
import inspect
import io
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from stepweave.functions.scalars import clip, exact_sum, number, offset_key, order_key, ratio
from stepweave.functions.skew import skew_join
from stepweave.operators.grid import GridConfig, events_in_steps, grid_steps
from stepweave.operators.split import attach_split

# Missing-value strategies
FORWARD_FILL, MEDIAN, ZERO, NORMAL = "forward_fill", "median_train", "zero", "normal_value"
STRATEGIES = (FORWARD_FILL, MEDIAN, ZERO, NORMAL)

# What is broadcast to look items up, as a bound on its rows
MAX_DICTIONARY = 10_000


@dataclass(frozen=True)
class FeatureSpec:
    """One column of the state. Features with ``items`` come from ``source``
    events; ``parents`` make a ratio feature, also of other ratios; neither makes
    a static or grid column that already exists on the step rows. ``params`` go
    to the aggregation rule.
    """

    name: str
    source: str
    items: tuple = ()
    agg: str = "last"
    missing: str = FORWARD_FILL
    valid: tuple[float | None, float | None] = (None, None)
    clip: tuple[float | None, float | None] = (None, None)
    normal: float | None = None
    flag: bool = False
    parents: tuple[str, str] | None = None
    check_range: bool = True
    params: tuple[tuple[str, object], ...] = ()

    @property
    def is_event(self) -> bool:
        return bool(self.items)


Registry = dict[str, FeatureSpec]


@dataclass(frozen=True)
class Rule:
    """How the events of a step become one value.

    ``build(value, order, weight, **params)`` returns one aggregate that Spark
    can merge from partial results; ``order`` is a number that sorts events by
    time, ``weight`` is set for rows with a duration. A rule with ``running``
    counts from the window start on: that aggregate takes its step values over
    all steps so far, and its null steps are filled; ``F.sum`` adds exactly there.
    """

    build: Callable[..., Column]
    running: Callable[[Column], Column] | None = None

    @property
    def params(self) -> tuple[set[str], set[str]]:
        """Names of all parameters, and of those without a default."""
        given = list(inspect.signature(self.build).parameters.values())[3:]
        return {p.name for p in given}, {p.name for p in given if p.default is p.empty}


Rules = Mapping[str, Rule]

RULES: Rules = {
    "last": Rule(lambda value, order, weight: F.max_by(value, F.when(value.isNotNull(), order))),
    "mean": Rule(lambda value, order, weight: F.avg(value)),
    "max": Rule(lambda value, order, weight: F.max(value)),
    "min": Rule(lambda value, order, weight: F.min(value)),
    "sum": Rule(lambda value, order, weight: exact_sum(value)),
    "cumulative": Rule(lambda value, order, weight: exact_sum(value), running=F.sum),
    "weighted_mean": Rule(lambda value, order, weight: F.try_divide(F.sum(value * weight), F.sum(weight))),
}


# Rules that do not look at the order of events
UNORDERED = ("mean", "max", "min", "sum", "cumulative", "weighted_mean")


# Aggregates whose partial results grow with the group, as plans name them
UNBOUNDED = ("collect_", "listagg", "percentile(", "median(", "mode(", "histogram")


def with_rules(
    spark: SparkSession, extra: Rules, base: Rules = RULES, trial: Mapping[str, Mapping] | None = None
) -> Rules:
    """``base`` and more rules, each checked: a new name, and an aggregate that Spark merges from partial results.

    ``trial`` gives the parameters to check a rule with, by name, where it needs any.
    """
    for name, rule in extra.items():
        if name in base:
            raise ValueError(f"rule {name!r} is defined already")
        problem = rule_problem(spark, rule, (trial or {}).get(name, {}))
        if problem:
            raise ValueError(f"rule {name!r} {problem}")
    return {**base, **extra}


def rule_problem(spark: SparkSession, rule: Rule, params: Mapping[str, object]) -> str | None:
    """What keeps a rule from being merged from partial results of bounded size, judged by its plan."""
    rows = spark.range(0).select(
        F.col("id").alias("k"), F.col("id").cast("double").alias("v"), F.col("id").cast("decimal(38,0)").alias("o")
    )
    try:
        value = rule.build(F.col("v"), F.col("o"), F.col("v"), **params)
        found = rows.groupBy("k").agg(value.cast("double").alias("x"))
    except Exception as error:
        return f"is not an aggregate: {error}"
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain("simple")
    text = plan.getvalue().lower()
    if "python" in text or "pandas" in text or "arrow" in text or "partial_" not in text:
        return "cannot be merged from partial results"
    if any(name in text for name in UNBOUNDED):
        return "gathers the values of a group"
    return None


def make_registry(specs: Iterable[FeatureSpec], rules: Rules = RULES) -> Registry:
    registry: Registry = {}
    for spec in specs:
        if spec.name in registry:
            raise ValueError(f"feature {spec.name!r} is defined twice")
        registry[spec.name] = spec
    problems = registry_problems(registry, rules)
    if problems:
        raise ValueError("; ".join(problems))
    return registry


def registry_problems(registry: Mapping[str, FeatureSpec], rules: Rules = RULES) -> list[str]:
    """Broken rules of a dictionary, as text; empty when it is sound."""
    problems = []
    for name, spec in registry.items():
        if not name.strip() or not spec.source.strip():
            problems.append(f"feature {name!r} lacks a name or a source")
        if spec.agg not in rules:
            problems.append(f"{name}: unknown aggregation {spec.agg!r}")
        elif spec.is_event:
            known, needed = rules[spec.agg].params
            given = {k for k, _ in spec.params}
            if given - known or needed - given:
                problems.append(
                    f"{name}: rule {spec.agg!r} takes {sorted(known)} and needs {sorted(needed)}, given {sorted(given)}"
                )
        if spec.missing not in STRATEGIES:
            problems.append(f"{name}: unknown missing strategy {spec.missing!r}")
        for label, (low, high) in (("valid", spec.valid), ("clip", spec.clip)):
            if low is not None and high is not None and low >= high:
                problems.append(f"{name}: {label} range is empty")
        if spec.missing == NORMAL and spec.normal is None:
            problems.append(f"{name}: strategy {NORMAL} needs a normal value")
        if spec.parents and spec.is_event:
            problems.append(f"{name}: both items and parents")
        for parent in spec.parents or ():
            if parent not in registry:
                problems.append(f"{name}: unknown parent {parent!r}")
    cycle = dependency_cycle(registry)
    if cycle:
        problems.append("features depend on each other: " + " -> ".join(cycle))
    return problems


def _dependencies(registry: Mapping[str, FeatureSpec]) -> TopologicalSorter:
    return TopologicalSorter({n: [p for p in s.parents or () if p in registry] for n, s in registry.items()})


def dependency_cycle(registry: Mapping[str, FeatureSpec]) -> list[str]:
    """Names along a cycle of parents, the first again at the end; empty without one."""
    try:
        _dependencies(registry).prepare()
    except CycleError as error:
        return list(reversed(error.args[1]))
    return []


def derived_levels(registry: Mapping[str, FeatureSpec]) -> list[list[str]]:
    """Ratio features in groups that can be computed one after the other, each in registry order.

    A group needs base columns and earlier groups only.
    """
    order, levels = _dependencies(registry), []
    order.prepare()
    places = {n: i for i, n in enumerate(registry)}
    while order.is_active():
        ready = order.get_ready()
        level = sorted((n for n in ready if registry[n].parents), key=places.__getitem__)
        levels += [level] if level else []
        order.done(*ready)
    return levels


def select_features(
    registry: Registry,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    flags: bool | None = None,
    warn: Callable[[str], None] = lambda text: None,
) -> Registry:
    """Subset in registry order. Unknown included names are an error, unknown
    excluded ones only a warning; ``flags`` sets every flag on or off.
    """
    unknown = [n for n in include or () if n not in registry]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    for name in exclude:
        if name not in registry:
            warn(f"excluded feature {name!r} does not exist")
    kept = {
        n: s for n, s in registry.items() if (include is None or n in include) and n not in exclude
    }
    if flags is not None:
        kept = {n: replace(s, flag=flags) for n, s in kept.items()}
    return kept


def feature_columns(registry: Mapping[str, FeatureSpec]) -> list[str]:
    """State columns in order: each feature, then its flag."""
    columns = []
    for name, spec in registry.items():
        columns.append(name)
        if spec.flag:
            columns.append(f"{name}_missing")
    return columns


def items_of(registry: Mapping[str, FeatureSpec], source: str) -> list:
    """All item ids a source has to deliver."""
    return sorted({i for s in registry.values() if s.source == source for i in s.items}, key=str)


def registry_frame(spark, registry: Mapping[str, FeatureSpec]) -> DataFrame:
    """The dictionary as a small dimension table, one row per feature."""
    def bound(x: float | None) -> float | None:
        return None if x is None else float(x)

    rows = [
        (s.name, s.source, [str(i) for i in s.items], s.agg, s.missing, *map(bound, (*s.valid, *s.clip, s.normal)), s.flag)
        for s in registry.values()
    ]
    schema = (
        "feature string, source string, items array<string>, agg string, missing string, valid_low double, "
        "valid_high double, clip_low double, clip_high double, normal double, flag boolean"
    )
    return spark.createDataFrame(rows, schema)


def registry_summary(dictionary: DataFrame) -> DataFrame:
    """Feature counts by source, aggregation rule and missing strategy."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
            for kind in ("source", "agg", "missing")
        ]
    )
    return dictionary.select(F.inline(kinds)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("features"))


@dataclass(frozen=True)
class EventSource:
    """Where the events of one source live and how their columns are called.

    ``key`` joins to the episodes. ``tie`` is a unique integer that orders equal
    times; without it equal times fall back to item and value.
    """

    frame: DataFrame
    time: str
    value: str
    item: str = "itemid"
    key: str = "stay_id"
    tie: str | None = None


@dataclass(frozen=True)
class Placed:
    """Rows that already stand in steps and join the state under a name.

    ``rows`` has ``stay_id, step_index, value`` and, for rows with a duration,
    ``weight``. A step without rows gets ``default``.
    """

    name: str
    rule: str
    rows: DataFrame
    default: float | None = None


def item_dictionary(spark: SparkSession, specs: Sequence[FeatureSpec], rules: Rules, kind: str) -> DataFrame:
    """``_item, _f, _place, _low, _high, _check, _running``: what becomes of an item's events.

    ``_f`` counts the features in the order given; an item may serve several.
    """
    rows = [
        (item, f, place, *(None if x is None else float(x) for x in spec.valid), spec.check_range,
         rules[spec.agg].running is not None)
        for f, spec in enumerate(specs)
        for place, item in enumerate(spec.items)
    ]
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary of {len(rows)} items is too large to broadcast")
    schema = f"_item {kind}, _f int, _place int, _low double, _high double, _check boolean, _running boolean"
    return spark.createDataFrame(rows, schema)


def event_rows(
    source: EventSource,
    episodes: DataFrame,
    specs: Sequence[FeatureSpec],
    cfg: GridConfig = GridConfig(),
    rules: Rules = RULES,
) -> DataFrame:
    """``stay_id, step_index, _f, _value, _seen, _order``: one row per event and feature it serves.

    The item is looked up once, in a hash table of the dictionary. ``_seen`` is
    the value if it lies in the valid range, ``_value`` what the rule gets, and
    ``_order`` one number, so that the last value needs no sort. Rules that run
    over the episode also see events before the first realised step.
    """
    columns = [source.key, source.time, source.item, source.value] + ([source.tie] if source.tie else [])
    wanted = sorted({i for s in specs for i in s.items}, key=str)
    events = source.frame.select(*dict.fromkeys(columns)).where(F.col(source.item).isin(wanted))
    rows = events_in_steps(events, episodes, source.key, source.time, cfg, from_window_start=True)
    kind = source.frame.schema[source.item].dataType.simpleString()
    dictionary = item_dictionary(source.frame.sparkSession, specs, rules, kind)
    rows = rows.join(F.broadcast(dictionary), F.col(source.item) == F.col("_item"))
    rows = rows.where((F.col("step_index") >= F.col("first_step")) | F.col("_running"))

    raw = number(F.col(source.value))
    within = (F.col("_low").isNull() | (raw >= F.col("_low"))) & (F.col("_high").isNull() | (raw <= F.col("_high")))
    seen = F.when(within, raw)
    if source.tie:
        order = order_key(F.col(source.time), F.col(source.tie))
    else:
        order = offset_key(F.col("window_offset"), F.col("_place"), F.col(source.value).cast("double"))
    # the order is only worked out for the rules that may ask for it
    asking = [f for f, s in enumerate(specs) if s.agg not in UNORDERED]
    order = F.when(F.col("_f").isin(asking), order) if asking else F.lit(None)
    return rows.select(
        "stay_id", "step_index", "_f", F.when(F.col("_check"), seen).otherwise(raw).alias("_value"),
        seen.alias("_seen"), order.cast("decimal(38,0)").alias("_order"),
    )


def _per_feature(rows: DataFrame, asked: Sequence[tuple[str, tuple]], rules: Rules) -> DataFrame:
    """``stay_id, step_index, _f, value, n_valid``; ``asked`` names rule and parameters of each ``_f``.

    Every rule is a partial aggregate, so at most one row per input task, step
    and feature is shuffled.
    """
    kinds = list(dict.fromkeys(asked))
    value, order, weight = F.col("_value"), F.col("_order"), F.col("_weight")
    if "_weight" not in rows.columns:
        rows = rows.withColumn("_weight", F.lit(None).cast("double"))
    grouped = rows.groupBy("stay_id", "step_index", "_f").agg(
        *[
            rules[rule].build(value, order, weight, **dict(params)).cast("double").alias(f"_rule{k}")
            for k, (rule, params) in enumerate(kinds)
        ],
        F.count("_seen").alias("n_valid"),
    )
    picked = F.lit(None).cast("double")
    for k, kind in enumerate(kinds):
        mine = F.col("_f").isin([f for f, a in enumerate(asked) if a == kind])
        picked = F.when(mine, F.col(f"_rule{k}")).otherwise(picked)
    return grouped.select("stay_id", "step_index", "_f", picked.alias("value"), "n_valid")


def feature_long(
    source: EventSource,
    episodes: DataFrame,
    specs: Sequence[FeatureSpec],
    cfg: GridConfig = GridConfig(),
    rules: Rules = RULES,
) -> DataFrame:
    """``stay_id, step_index, feature, value, n_valid`` for the events of one source."""
    rows = event_rows(source, episodes, specs, cfg, rules)
    found = _per_feature(rows, [(s.agg, s.params) for s in specs], rules)
    names = F.array(*(F.lit(s.name) for s in specs))
    return found.select("stay_id", "step_index", F.get(names, F.col("_f")).alias("feature"), "value", "n_valid")


def static_weight(infusions: DataFrame, weight: str = "patientweight") -> DataFrame:
    """Median recorded weight per stay; a stay's distinct weights are few."""
    rows = infusions.select("stay_id", number(F.col(weight)).cast("double").alias("_w")).where(F.col("_w").isNotNull())
    return rows.groupBy("stay_id").agg(F.percentile("_w", 0.5).alias("weight_kg"))


def step_context(
    episodes: DataFrame,
    ages: DataFrame | None = None,
    weights: DataFrame | None = None,
    splits: DataFrame | None = None,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """Per-episode attributes that the state rows carry."""
    rows = episodes.select("stay_id", "subject_id", "hadm_id", "onset_time")
    if ages is not None:
        rows = skew_join(rows, ages.select("subject_id", "age_years"), "subject_id", "left")
    if weights is not None:
        rows = rows.join(weights.select("stay_id", "weight_kg"), "stay_id", "left")
    if outcomes is not None:
        rows = rows.join(outcomes, "stay_id", "left")
    return rows if splits is None else attach_split(rows, splits)


def raw_state(
    sources: Mapping[str, EventSource],
    episodes: DataFrame,
    registry: Registry,
    cfg: GridConfig = GridConfig(),
    rules: Rules = RULES,
    placed: Sequence[Placed] = (),
) -> DataFrame:
    """Wide table with one row per realised step, before imputation.

    Columns: ``stay_id, step_index, step_start, step_end, hours_relative``, per
    event feature its observed value (null if none) and ``<name>__n`` valid rows,
    and one column per table in ``placed``. Running features hold their value
    from the window start on.

    Events of all sources and the placed rows are aggregated together. What is
    left and the realised steps are stacked and grouped in one exchange on
    ``stay_id``; running features reuse that partitioning, and so does whatever
    follows by stay.
    """
    events = [s for name in sources for s in registry.values() if s.is_event and s.source == name]
    asked = [(s.agg, s.params) for s in events] + [(p.rule, ()) for p in placed]
    stacked = grid_steps(episodes, cfg).select("stay_id", "step_index", "step_start", "step_end", "hours_relative")
    parts, at = [], 0
    for name, source in sources.items():
        specs = [s for s in events if s.source == name]
        if specs:
            # features are numbered through, source by source
            rows = event_rows(source, episodes, specs, cfg, rules)
            parts.append(rows.withColumn("_f", F.col("_f") + at))
            at += len(specs)
    for i, table in enumerate(placed):
        weight = F.col("weight") if "weight" in table.rows.columns else F.lit(None)
        parts.append(
            table.rows.select(
                "stay_id", "step_index", F.lit(at + i).alias("_f"), F.col("value").cast("double").alias("_value"),
                F.col("value").cast("double").alias("_seen"), weight.cast("double").alias("_weight"),
            )
        )
    if parts:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        if "_order" not in rows.columns:
            rows = rows.withColumn("_order", F.lit(None).cast("decimal(38,0)"))
        stacked = stacked.unionByName(_per_feature(rows, asked, rules), allowMissingColumns=True)
    else:
        nothing = F.lit(None)
        kinds = {"_f": "int", "value": "double", "n_valid": "long"}
        stacked = stacked.withColumns({c: nothing.cast(kind) for c, kind in kinds.items()})
    stacked = stacked.repartition("stay_id")

    aggs = [F.max(c).alias(c) for c in ("step_start", "step_end", "hours_relative")]
    numbers = {s.name: f for f, s in enumerate(events)}
    for spec in registry.values():
        if not spec.is_event:
            continue
        # a feature without a source given is never observed
        mine = F.col("_f") == numbers.get(spec.name, -1)
        aggs.append(F.max(F.when(mine, F.col("value"))).alias(spec.name))
        aggs.append(F.coalesce(F.max(F.when(mine, F.col("n_valid"))), F.lit(0)).alias(f"{spec.name}__n"))
    for i, table in enumerate(placed):
        found = F.max(F.when(F.col("_f") == len(events) + i, F.col("value")))
        default = F.lit(table.default).cast("double")
        aggs.append(F.coalesce(found, default).alias(table.name))
    wide = stacked.groupBy("stay_id", "step_index").agg(*aggs)
    so_far = Window.partitionBy("stay_id").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)
    running = {s.name: _running(rules[s.agg].running, F.col(s.name), so_far) for s in events if rules[s.agg].running}
    wide = wide.withColumns(running) if running else wide
    return wide.where(F.col("step_start").isNotNull())


def _running(rule: Callable[[Column], Column], value: Column, so_far: WindowSpec) -> Column:
    return exact_sum(value, so_far) if rule is F.sum else rule(value).over(so_far)


def impute_state(
    wide: DataFrame, registry: Registry, medians: Mapping[str, float | None] | None = None, impute: bool = True
) -> DataFrame:
    """Fill, clip and flag every feature, then derive the ratios.

    Order per feature: last known value, train median, normal value, as far as
    its strategy allows, and the clip last. ``wide`` needs the static and grid
    columns the registry names. Ratios follow their parents, so a ratio of
    ratios sees filled values; the windows of all share one sort.
    """
    medians = medians or {}
    known = Window.partitionBy("stay_id").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)

    def constant(value: float | None) -> Column:
        return F.lit(None if value is None else float(value)).cast("double")

    def filled(spec: FeatureSpec, raw: Column) -> Column:
        if not impute:
            return clip(raw, *spec.clip)
        median, normal = constant(medians.get(spec.name)), constant(spec.normal)
        if spec.missing == FORWARD_FILL:
            raw = F.coalesce(F.last(raw, ignorenulls=True).over(known), median, normal)
        elif spec.missing == MEDIAN:
            raw = F.coalesce(raw, median, normal)
        elif spec.missing == ZERO:
            raw = F.coalesce(raw, F.lit(0.0))
        else:
            raw = F.coalesce(raw, normal)
        return clip(raw, *spec.clip)

    base = {n: filled(s, F.col(n)) for n, s in registry.items() if s.parents is None}
    rows = wide.withColumns(base)
    for level in derived_levels(registry):
        derived = [registry[n] for n in level]
        rows = rows.withColumns({f"__{s.name}": ratio(*map(F.col, s.parents)) for s in derived})
        rows = rows.withColumns({s.name: filled(s, F.col(f"__{s.name}")) for s in derived})
    flags = {
        f"{s.name}_missing": (
            (F.col(f"{s.name}__n") == 0).cast("int") if s.is_event else F.lit(1)
        )
        for s in registry.values()
        if s.flag
    }
    rows = rows.withColumns(flags) if flags else rows
    order = feature_columns(registry)
    helpers = {f"{n}__n" for n in registry} | {f"__{n}" for n in registry}
    kept = [c for c in rows.columns if c not in helpers and c not in order]
    return rows.select(*kept, *order)


def clinical_proxy(state: DataFrame, limits: Mapping[str, float], name: str = "sofa_score") -> DataFrame:
    """One point per imputed feature below its limit."""
    points = [(F.col(c) < F.lit(float(limit))).cast("int") for c, limit in limits.items()]
    return state.withColumn(name, sum(points[1:], points[0]))


def outcome_label(
    episodes: DataFrame, deaths: DataFrame, horizon_days: int = 90, key: str = "hadm_id", name: str = "mortality_90d"
) -> DataFrame:
    """1 when the death time is at most ``horizon_days`` after onset, else 0."""
    joined = skew_join(
        episodes.select("stay_id", key, "onset_time"), deaths.select(key, "deathtime"), key, "left"
    )
    limit = F.col("onset_time") + F.make_dt_interval(F.lit(horizon_days))
    label = F.col("deathtime").isNotNull() & (F.col("deathtime") <= limit)
    return joined.select("stay_id", label.cast("int").alias(name))


def state_problems(state: DataFrame) -> DataFrame:
    """Rows that break the state contract: repeated steps, stays of two subjects."""
    repeated = (
        state.groupBy("stay_id", "step_index")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .select("stay_id", F.lit("duplicate_step_index").alias("violation"))
    )
    found = repeated
    if "subject_id" in state.columns:
        shared = (
            state.groupBy("stay_id")
            .agg((F.min("subject_id") != F.max("subject_id")).alias("shared"))
            .where("shared")
            .select("stay_id", F.lit("several_subjects").alias("violation"))
        )
        found = repeated.unionByName(shared)
    return found.distinct()
