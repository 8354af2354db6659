"""Joins, oriented as FROM probe JOIN build, with selectable strategies that all give the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "left_semi": "left_semi", "left_anti": "left_anti"}
#: Bytes of a build side that may be broadcast, by its plan's statistics.
BROADCAST_BYTES = 100 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """The size that the optimizer estimates for a relation; very large where it can't tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(probe: DataFrame, build: DataFrame, on: str | Column | Sequence[str], how: str = "inner") -> DataFrame:
    """The rows of ``probe`` with those of ``build``. Conditions in SQL name the sides probe_table and build_table."""
    if how not in KINDS:
        raise ValueError(f"join type {how!r}; known: {', '.join(KINDS)}")
    return probe.alias("probe_table").join(build.alias("build_table"), F.expr(on) if isinstance(on, str) else on, KINDS[how])


def join_broadcast(probe: DataFrame, build: DataFrame, on: str | Column | Sequence[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts the build side if its size is known to be small enough; else the join is left to the optimizer."""
    return join(probe, F.broadcast(build) if planned_bytes(build) <= most else build, on, how)


def join_hash(probe: DataFrame, build: DataFrame, keys: Sequence[str], buckets: int, how: str = "inner") -> DataFrame:
    """Pairs equal hash buckets of both sides; keys have one name on both. An empty bucket only loses its own matches."""
    return probe.repartition(buckets, *keys).join(build.repartition(buckets, *keys).hint("shuffle_hash"), list(keys), KINDS[how])


def join_pushdown(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, how: str = "inner") -> DataFrame:
    """Reads of the probe only the build key's range, then joins.

    The range is a scalar subquery, so the plan stays lazy and the filter reaches the scan, where row groups outside it
    are skipped by their statistics. Only for inner and left_semi, where rows outside the range can't be in the result.
    """
    condition = F.col(f"probe_table.{probe_key}") == F.col(f"build_table.{build_key}")
    if how not in ("inner", "left_semi"):
        return join(probe, build, condition, how)
    ends = build.agg(F.min(build_key).alias("lo"), F.max(build_key).alias("hi"))
    key = F.col(probe_key)
    within = probe.where((key >= ends.select("lo").scalar()) & (key <= ends.select("hi").scalar()))
    return join(within, build, condition, how)


def key_spans(df: DataFrame, key: str, parts: int) -> list[tuple]:
    """At most ``parts`` ranges (lo, hi) that hold all of a column's values and leave gaps between them out: the ends of as many
    ranges of about equal rows. Only their ends reach the driver."""
    ranges = df.select(F.col(key).alias("k")).where("k is not null").repartitionByRange(parts, "k")
    ends = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return sorted((r["lo"], r["hi"]) for r in ends.collect())


def within(key: str, spans: Sequence[tuple]) -> Column:
    """Whether a value is in one of the ranges: comparisons that a Parquet scan holds against each row group's statistics."""
    found = F.lit(False)
    for lo, hi in spans:
        found = found | F.col(key).between(F.lit(lo), F.lit(hi))
    return found


def join_range(probe: DataFrame, build: DataFrame, key: str, parts: int, how: str = "inner") -> DataFrame:
    """A sort-merge join whose probe reads only the ranges of keys that the build side has.

    The build side is cut into ``parts`` ranges of about equal rows, whose ends are looked up when the join is made; the probe's
    scan skips row groups outside all of them, and rows in the gaps never reach the shuffle. Kinds that keep probe
    rows without a match read the whole probe.
    """
    if how in ("inner", "left_semi"):
        probe = probe.where(within(key, key_spans(build, key, parts)))
    return probe.join(build.hint("merge"), key, KINDS[how])


def choose_strategy(build_mb: float, threshold_mb: float = 100, force: str | None = None) -> str:
    """broadcast for a small build side, range beyond; hash can't be forced, as a range plan needs no buckets."""
    if force == "hash":
        raise ValueError("an adaptive join can't be forced to hash: use a hash join")
    if force is not None:
        return force
    return "broadcast" if build_mb <= threshold_mb else "range"


def join_adaptive(probe: DataFrame, build: DataFrame, key: str, parts: int, how: str = "inner", threshold_mb: float = 100, force: str | None = None) -> DataFrame:
    """Broadcast or range join by the build side's planned size."""
    chosen = choose_strategy(planned_bytes(build) / 1024 / 1024, threshold_mb, force)
    return probe.join(F.broadcast(build), key, KINDS[how]) if chosen == "broadcast" else join_range(probe, build, key, parts, how)
