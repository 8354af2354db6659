"""Task planning over row-group statistics: sizes, key ranges, overlaps, batches.

Row groups are few beside rows, yet relational parts (ranges, overlaps, islands, tightness) are DataFrame
operations on a table of them: full_path, rg_id, size_mb, rows, lo, hi. Greedy folds are order-bound and
run over one relation's groups in order, as plain functions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may hold.
MAX_ROWS = 45_000_000


@dataclass(frozen=True)
class Group:
    """A row group, or a whole file where rg_id is None."""

    path: str
    rg_id: int | None
    size_mb: float
    rows: int = 0
    lo: float | None = None
    hi: float | None = None

    def meets(self, other: Group) -> bool:
        return self.lo <= other.hi and other.lo <= self.hi


# ---------------------------------------------------------------- scans


def split_by_size(groups: Iterable[Group], max_mb: float = 50, single: bool = False, max_rows: int = MAX_ROWS) -> list[list[Group]]:
    """Tasks of consecutive groups of at most ``max_mb`` in all, a larger group alone; single: one group a task."""
    if single:
        return [[g] for g in groups]
    tasks: list[list[Group]] = []
    room = 0.0
    for g in groups:
        if not tasks or room <= 0 or g.size_mb > room:
            tasks.append([])
            room = max_mb
        tasks[-1].append(g)
        room -= g.size_mb
    return [part for t in tasks for part in split_by_rows(t, max_rows)]


def split_by_rows(task: list[Group], max_rows: int = MAX_ROWS) -> list[list[Group]]:
    """A task of too many rows as the fewest runs of about equal rows."""
    total = sum(g.rows for g in task)
    parts = min(len(task), -(-total // max_rows)) if total else 1
    if parts <= 1:
        return [task]
    out: list[list[Group]] = [[] for _ in range(parts)]
    seen = 0
    for g in task:
        out[min(parts - 1, seen * parts // total)].append(g)
        seen += g.rows
    return [t for t in out if t]


# ---------------------------------------------------------------- ranges, as DataFrames


def key_ranges(groups: DataFrame, key: str) -> DataFrame:
    """full_path, rg_id, size_mb, rows, lo, hi of the groups whose statistics (map<column, (min, max)>) know the key."""
    s = F.col("stats")[key]
    return groups.select("full_path", "rg_id", (F.col("size_bytes") / 1048576).alias("size_mb"), F.col("num_rows").alias("rows"),
                         s["min"].try_cast("double").alias("lo"), s["max"].try_cast("double").alias("hi")).where("lo is not null and hi is not null")


def overlap_pairs(build: DataFrame, probe: DataFrame) -> DataFrame:
    """build_path, build_rg, probe_path, probe_rg of groups whose key ranges overlap.

    The ranges are cut at the probe's own minima into cells, so overlaps are found by an equi-join on cells that a range
    starts in or runs over, rather than by comparing all pairs.
    """
    span = probe.agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("*").alias("n")).first()
    if not span["n"]:
        return build.select(F.col("full_path").alias("build_path"), F.col("rg_id").alias("build_rg")).limit(0).crossJoin(
            probe.select(F.col("full_path").alias("probe_path"), F.col("rg_id").alias("probe_rg")).limit(0))
    width = max((span["b"] - span["a"]) / span["n"], 1e-9)
    cell = lambda c: F.floor((F.least(F.greatest(F.col(c), F.lit(span["a"])), F.lit(span["b"])) - F.lit(span["a"])) / F.lit(width)).cast("long")
    b = build.where((F.col("hi") >= span["a"]) & (F.col("lo") <= span["b"])).withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    p = probe.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    met = b.alias("b").join(p.alias("p"), "cell").where("b.lo <= p.hi and p.lo <= b.hi")
    return met.select(F.col("b.full_path").alias("build_path"), F.col("b.rg_id").alias("build_rg"), F.col("p.full_path").alias("probe_path"), F.col("p.rg_id").alias("probe_rg")).distinct()


def conflict_groups(build: DataFrame, probe: DataFrame) -> DataFrame:
    """Both sides' groups with side and island: a chain of overlapping ranges; islands of one side only go.

    An island starts where a range begins above all before it: one window in order of lo, over row groups.
    """
    both = build.withColumn("side", F.lit("build")).unionByName(probe.withColumn("side", F.lit("probe")))
    order = Window.orderBy("lo", "hi", "side", "full_path", "rg_id")
    above = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", F.when(above.isNull() | (F.col("lo") > above), 1).otherwise(0)).withColumn("island", F.sum("_new").over(order)).drop("_new")
    sides = F.size(F.collect_set("side").over(Window.partitionBy("island")))
    return both.withColumn("_s", sides).where("_s = 2").drop("_s")


def text_tightness(groups: DataFrame, limit: float = 0.3) -> DataFrame:
    """groups, overlapping, tight, for keys that have no distance: whether the share of pairs of ranges that overlap is under ``limit``.

    In order of lo a range overlaps as many earlier ones as don't end before it: those that started less those that ended.
    """
    n = F.count("*")
    starts = groups.select(F.col("lo").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("order"))
    ends = groups.select(F.col("hi").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(1).alias("order"))
    by = Window.orderBy("at", "order").rowsBetween(Window.unboundedPreceding, -1)
    met = starts.unionByName(ends).withColumn("open", F.coalesce(F.sum(F.col("s") - F.col("e")).over(by), F.lit(0))).where("s = 1")
    pairs = F.col("groups") * (F.col("groups") - 1) / 2
    out = met.agg(n.alias("groups"), F.coalesce(F.sum("open"), F.lit(0)).alias("overlapping"))
    return out.withColumn("tight", F.when(F.col("groups") < 2, F.col("groups") == 1).otherwise(F.col("overlapping") / pairs < limit))


def sort_tightness(groups: DataFrame, limit: float = 0.2) -> DataFrame:
    """groups, avg_span, global_span, tight: whether ranges span at most ``limit`` of the whole on average. Keys that aren't numbers
    go by ``text_tightness``."""
    s = groups.agg(F.count("*").alias("groups"), F.avg(F.col("hi") - F.col("lo")).alias("avg_span"), (F.max("hi") - F.min("lo")).alias("global_span"))
    tight = F.when(F.col("groups") < 2, F.col("groups") == 1).otherwise((F.col("global_span") > 0) & (F.col("avg_span") <= limit * F.col("global_span")))
    return s.withColumn("tight", tight)


def skew_threshold(build: DataFrame, max_task_mb: float, parallel: int = 20, override: int | None = None) -> int:
    """Build groups that a probe group may meet in one task, at least 5 where there are several: the lesser of two bounds.

    by_size is how many large groups (the mean, or seven tenths of the 95th percentile) half a task's size holds; by_share
    a group's share of the groups if a quarter of the tasks work at once. Without sizes it is 20.
    """
    if override:
        return override
    mb = F.when(F.col("size_mb") > 0, F.col("size_mb"))
    s = build.agg(F.count("*").alias("n"), F.avg(mb).alias("mean"), F.percentile(mb, 0.95).alias("p95"))
    by_size = F.floor(F.lit(max_task_mb / 2) / F.greatest("mean", 0.7 * F.col("p95"), F.lit(0.1)))
    by_share = F.greatest(F.lit(5), F.floor(F.col("n") / max(parallel // 4, 2)))
    bound = F.when(F.col("n") < 2, F.greatest(F.lit(1), "n")).when(F.col("mean").isNull(), 20).otherwise(F.greatest(F.lit(5), F.least(by_size, by_share)))
    return int(s.select(bound.alias("bound")).first()["bound"])


# ---------------------------------------------------------------- joins, as folds


@dataclass(frozen=True)
class JoinTask:
    builds: tuple[Group, ...]
    probes: tuple[Group, ...]

    @property
    def size_mb(self) -> float:
        return sum(g.size_mb for g in (*self.builds, *self.probes))


def pair_by_range(build: list[Group], probe: list[Group]) -> list[tuple[Group, list[Group]]]:
    """Each probe group with the build groups that its range meets, in key order; probe groups that meet none go."""
    build = sorted(build, key=lambda g: g.lo)
    pairs = [(p, [b for b in itertools.takewhile(lambda b: b.lo <= p.hi, build) if b.hi >= p.lo]) for p in sorted(probe, key=lambda g: g.lo)]  # noqa: B023
    return [x for x in pairs if x[1]]


def chunks(groups: Iterable[Group], max_mb: float, max_count: int | None = None) -> list[tuple[Group, ...]]:
    """Runs of groups within a size and a number."""
    out: list[list[Group]] = []
    size = 0.0
    for g in groups:
        if not out or size + g.size_mb > max_mb or (max_count and len(out[-1]) >= max_count):
            out.append([])
            size = 0.0
        out[-1].append(g)
        size += g.size_mb
    return [tuple(c) for c in out]


def batch_pairs(pairs: DataFrame, max_mb: float = 50) -> DataFrame:
    """Tasks for pairs of overlapping groups (build_path, build_rg, build_mb, probe_path, probe_rg, probe_mb, probe_lo): adds task and budget.

    A unit is a probe group with all build groups that it meets. The budget is ``max_mb``, or 1.3 times the units' 90th
    percentile where that is more and over three tenths of the units exceed it. Units of up to half a budget, in key order, share a
    task if they start in the same half budget of the running sum, so a task stays within the budget; larger ones are a task
    each. A unit above the budget is cut by the running sum of its build groups, smallest first, at what room its probe group
    leaves, three tenths of the budget at least. Row groups are few, so one window runs over all units.
    """
    unit = ["probe_path", "probe_rg"]
    units = pairs.groupBy(*unit, "probe_mb", "probe_lo").agg((F.sum("build_mb") + F.col("probe_mb")).alias("mb"))
    whole = units.agg(F.avg((F.col("mb") > max_mb).cast("int")).alias("over"), F.percentile("mb", 0.9).alias("p90"))
    budget = F.when(F.col("over") > 0.3, F.greatest(F.lit(float(max_mb)), F.floor(1.3 * F.col("p90")).cast("double"))).otherwise(F.lit(float(max_mb)))
    units = units.join(F.broadcast(whole.select(budget.alias("budget"))), F.lit(True))
    half = F.when(2 * F.col("mb") <= F.col("budget"), F.col("mb")).otherwise(0.0)
    before = Window.orderBy("probe_lo", *unit).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_start", F.coalesce(F.sum(half).over(before), F.lit(0.0)))
    shared = F.concat(F.lit("s"), F.floor(2 * F.col("_start") / F.col("budget")))
    units = units.withColumn("_task", F.when(half > 0, shared).otherwise(F.concat_ws("/", F.lit("u"), *unit)))
    out = pairs.join(units.select(*unit, "mb", "budget", "_task"), unit)
    inner = Window.partitionBy(*unit).orderBy("build_mb", "build_path", "build_rg").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("budget") - F.col("probe_mb"), 0.3 * F.col("budget"))
    part = F.floor(F.coalesce(F.sum("build_mb").over(inner), F.lit(0.0)) / room)
    return out.withColumn("task", F.when(F.col("mb") > F.col("budget"), F.concat_ws("/", "_task", part)).otherwise(F.col("_task"))).drop("mb", "_task")


def split_island(build: list[Group], probe: list[Group], max_mb: float = 50, max_builds: int = 20) -> list[JoinTask]:
    """An island as tasks: build groups by number, probe groups by what room they leave; tasks whose ranges can't meet go."""
    out = []
    for bs in chunks(sorted(build, key=lambda g: g.lo), float("inf"), max_builds):
        near = [p for p in sorted(probe, key=lambda g: g.lo) if any(b.meets(p) for b in bs)]
        out += [JoinTask(bs, ps) for ps in chunks(near, max(max_mb - sum(b.size_mb for b in bs), 0.3 * max_mb))]
    return out


def build_anchored(build: list[Group], probe: list[Group], max_mb: float = 50, max_files: int = 10, max_groups: int = 40) -> list[JoinTask]:
    """For each build file, the probe groups that its ranges meet, in tasks within a size, a number of files and of groups."""
    out = []
    for _, file in itertools.groupby(sorted(build, key=lambda g: (g.path, g.rg_id or 0)), key=lambda g: g.path):
        bs = tuple(file)
        room = max(max_mb - sum(b.size_mb for b in bs), 0.3 * max_mb)
        near = [p for p in sorted(probe, key=lambda g: (g.path, g.rg_id or 0)) if any(b.meets(p) for b in bs)]
        for part in chunks(near, room, max_groups):
            for files in _by_files(part, max_files):
                out.append(JoinTask(bs, files))
    return out


def _by_files(groups: tuple[Group, ...], most: int) -> list[tuple[Group, ...]]:
    paths = list(dict.fromkeys(g.path for g in groups))
    return [tuple(g for g in groups if g.path in paths[k : k + most]) for k in range(0, len(paths), most)]
