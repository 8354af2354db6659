"""A cost model over run logs, as DataFrame operations, and the choice of plans by time and price.

A run log is a table of tasks: run, stage, start_s and end_s (seconds), t_total, t_read, t_comp, t_write, disp (seconds),
cold, bytes_in, req_in, bytes_out, req_out, rows_in, rows_out, size_mb.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices in dollars: a GB of memory for a second, a call, a read and a write request. Fixed values of a public price list.
PRICES = {"gb_s": 1.66667e-5, "call": 0.2e-6, "get": 0.4e-6, "put": 5e-6}


# ---------------------------------------------------------------- measuring


def measure(tasks: DataFrame) -> DataFrame:
    """run, stage and sums, means and maxima of its tasks."""
    total = ("bytes_in", "req_in", "bytes_out", "req_out", "rows_in", "rows_out")
    mean = ("disp", "t_read", "t_comp", "t_write")
    return tasks.groupBy("run", "stage").agg(
        F.count("*").alias("p"), F.max(F.col("t_total") + F.col("disp")).alias("d_fn"), F.sum("t_total").alias("billed"),
        F.count(F.when(F.col("cold"), 1)).alias("cold"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        *(F.avg(c).alias(c) for c in mean), *(F.sum(c).alias(c) for c in total))


def task_overlap(tasks: DataFrame, by: str = "run", width_s: float = 60.0) -> DataFrame:
    """Adds k, the tasks of the run (itself too) that were running at some time while this one was.

    That is how many started before its end less how many had ended by its start: two ranks among the run's events in order of
    time. Events are dealt out by spans of time, ranked within their span, and the spans' sums, one row each, are added on, so
    a long run is many windows.
    """
    t = tasks.withColumn("_id", F.monotonically_increasing_id())
    # at one time: starts of others aren't before an end there, ends there are by a start
    kinds = F.array(*(F.struct(F.col(at).alias("at"), F.lit(o).alias("order"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(w).alias("what")) for at, o, s, e, w in (
        ("start_s", 2, 1, 0, None), ("end_s", 0, 0, 1, None), ("start_s", 1, 0, 0, "ended"), ("end_s", 1, 0, 0, "started"))))
    events = t.select(by, F.col("_id").alias("q"), F.inline(kinds)).withColumn("_span", F.floor(F.col("at") / width_s))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(by, "_span").agg(F.sum("s").alias("_s"), F.sum("e").alias("_e"))
    sums = sums.select(F.col(by).alias("_by"), F.col("_span").alias("_at"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_s", "_e")))
    so_far = Window.partitionBy(by, "_span").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("_s", F.sum("s").over(so_far)).withColumn("_e", F.sum("e").over(so_far)).where("what is not null")
    events = events.join(sums, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_at")))
    k = events.groupBy(F.col("q").alias("_q")).agg((F.max(F.when(F.col("what") == "started", F.col("_s") + F.col("_s0"))) - F.max(F.when(F.col("what") == "ended", F.col("_e") + F.col("_e0")))).alias("k"))
    return t.join(k, F.col("_id") == F.col("_q")).drop("_id", "_q").withColumn("k", F.greatest("k", F.lit(1)))


def bloom_work(role: Column, rows_in: Column, rows_out: Column, error_rate: Column) -> Column:
    """Hashes that a stage computes: k for each row it adds to a filter or holds against one."""
    k = F.greatest(F.lit(1), F.round(-F.log2(F.coalesce(error_rate, F.lit(0.001)))))
    return F.when(role == "build", k * rows_out).when(role == "apply", k * rows_in).otherwise(F.lit(0.0))


def price(stages: DataFrame, memory_gb: float = 2.0, prices: dict[str, float] = PRICES) -> DataFrame:
    """Adds cost_in, cost_compute, cost_out and cost to measured stages."""
    s = stages.withColumn("cost_in", F.col("req_in") * prices["get"]).withColumn("cost_compute", F.col("p") * prices["call"] + F.col("billed") * (memory_gb * prices["gb_s"]))
    s = s.withColumn("cost_out", F.col("req_out") * prices["put"])
    return s.withColumn("cost", F.col("cost_in") + F.col("cost_compute") + F.col("cost_out"))


def summary(tasks: DataFrame) -> DataFrame:
    """run and its tasks, time, MB in and out, and least and largest task time."""
    return tasks.groupBy("run").agg(F.count("*").alias("tasks"), F.sum("t_total").alias("task_s"), (F.max("end_s") - F.min("start_s")).alias("wall_s"),
                                    (F.sum("bytes_in") / 1048576).alias("mb_in"), (F.sum("bytes_out") / 1048576).alias("mb_out"), F.min("t_total").alias("least_s"), F.max("t_total").alias("most_s"))


def export(tasks: DataFrame) -> DataFrame:
    """run, stage and its calls, MB and latency: least, mean and largest."""
    return tasks.groupBy("run", "stage").agg(F.count("*").alias("calls"), (F.sum("bytes_in") / 1048576).alias("mb_in"),
                                             F.min("t_total").alias("least_s"), F.avg("t_total").alias("mean_s"), F.max("t_total").alias("most_s"))


def cheapest(runs: DataFrame, n: int) -> DataFrame:
    """The n runs of the least task time."""
    return runs.orderBy("task_s", "run").limit(n)


# ---------------------------------------------------------------- calibrating and predicting


def fit_line(df: DataFrame, x: Column, y: Column, by: Iterable[str] = ()) -> DataFrame:
    """slope and intercept, neither below 0, of least squares: where one would be, the other alone is fitted.

    Only sums leave a task, so any number of points takes one pass.
    """
    s = df.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y")).groupBy(*by).agg(
        F.count("*").alias("points"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    free = F.try_divide(F.col("points") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("points") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("_b", F.coalesce(free, F.lit(0.0))).withColumn("_a", (F.col("sy") - F.col("_b") * F.col("sx")) / F.col("points"))
    slope = F.when(F.col("_b") < 0, 0.0).when(F.col("_a") < 0, F.greatest(F.lit(0.0), F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))).otherwise(F.col("_b"))
    intercept = F.when(F.col("_b") < 0, F.greatest(F.lit(0.0), F.col("sy") / F.col("points"))).when(F.col("_a") < 0, 0.0).otherwise(F.col("_a"))
    return s.select(*by, "points", slope.alias("slope"), intercept.alias("intercept"))


def fit_pair(df: DataFrame, x1: Column, x2: Column, y: Column, by: Iterable[str] = ()) -> DataFrame:
    """a and b, neither below 0, of the least squares of y = a * x1 + b * x2: exact, as with two unknowns the best is the free
    solution or that of one of them alone. Only sums leave a task; what can't be told (no such rows, x in one proportion) is
    left to the one that explains more. Rows with a null are no points."""
    s = df.select(*by, x1.cast("double").alias("_u"), x2.cast("double").alias("_v"), y.cast("double").alias("_y")).dropna(subset=["_u", "_v", "_y"])
    s = s.groupBy(*by).agg(F.count("*").alias("points"), *(F.sum(F.col(f"_{m}") * F.col(f"_{n}")).alias(f"_{m}{n}") for m, n in ("uu", "uv", "vv", "uy", "vy")))
    det = F.expr("_uu * _vv - _uv * _uv")
    whole = F.when(det > 1e-12 * F.col("_uu") * F.col("_vv"), det)  # null where both are one
    s = s.withColumn("_a", F.try_divide(F.expr("_uy * _vv - _vy * _uv"), whole)).withColumn("_b", F.try_divide(F.expr("_vy * _uu - _uy * _uv"), whole))
    alone = {m: F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(f"_{m}y"), F.col(f"_{m}{m}")), F.lit(0.0))) for m in "uv"}
    free, first = F.expr("_a >= 0 and _b >= 0"), alone["u"] * F.col("_uy") >= alone["v"] * F.col("_vy")
    return s.select(*by, "points", F.when(free, F.col("_a")).when(first, alone["u"]).otherwise(0.0).alias("a"), F.when(free, F.col("_b")).when(first, 0.0).otherwise(alone["v"]).alias("b"))


def rates(tasks: DataFrame) -> DataFrame:
    """stage and its separate constants: seconds a request and a MB of reading and of writing, seconds of work a row, the
    median dispatch, and the MB/s that one task in twenty gets beyond. Percentiles are Spark's approximate ones, of bounded size."""
    mb = {c: F.col(c) / 1048576 for c in ("bytes_in", "bytes_out")}
    read = fit_pair(tasks, F.col("req_in"), mb["bytes_in"], F.col("t_read"), ["stage"]).select("stage", "points", F.col("a").alias("read_request_s"), F.col("b").alias("read_mb_s"))
    write = fit_pair(tasks, F.col("req_out"), mb["bytes_out"], F.col("t_write"), ["stage"]).select("stage", F.col("a").alias("write_request_s"), F.col("b").alias("write_mb_s"))
    rows = F.col("rows_in").cast("double")
    rest = tasks.groupBy("stage").agg(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.sum(F.col("t_comp") * rows), F.sum(rows * rows)), F.lit(0.0))).alias("row_s"),
                                      F.percentile_approx("disp", 0.5).alias("disp"), F.percentile_approx(F.try_divide(mb["bytes_in"], F.col("t_total")), 0.95).alias("mbps_p95"))
    return read.join(write, "stage").join(rest, "stage")


def calibrate(tasks: DataFrame) -> DataFrame:
    """stage and its seconds a byte and a task, its median dispatch, and how far its last task lags: the model's constants."""
    line = fit_line(tasks, F.col("bytes_in"), F.col("t_total"), ["stage"])
    rest = tasks.groupBy("stage").agg(F.percentile("disp", 0.5).alias("disp"), F.greatest(F.lit(0.0), F.max("t_total") / F.percentile("t_total", 0.5) - 1).alias("tail"))
    return line.join(rest, "stage")


def predict(tasks: DataFrame, constants: DataFrame, slots: int, gamma: float = 0.0, store: tuple[float, float, float] | None = None) -> DataFrame:
    """run, stage, and by the model its tasks, longest task, billed seconds, waves on so many slots, and time.

    A task takes its bytes' time, which tasks that run at once slow down by their number to the power ``gamma``, and its fixed
    time. A stage takes its longest task, which lags by the constants' ``tail`` (if they have one), or its work
    shared by the slots, or what the store's joint bandwidth allows (``store``: MB/s of one reader, peak and fall, as in
    ``bandwidth``), whichever is most. ``waves`` follows tasks slot by slot where their order matters.
    """
    tail = F.col("tail") if "tail" in constants.columns else F.lit(0.0)
    t = tasks.join(constants.select("stage", "slope", "intercept", F.col("disp").alias("disp0"), tail.alias("_tail")), "stage")
    sizes = tasks.groupBy("run", "stage").agg(F.least(F.count("*"), F.lit(slots)).alias("_k"))
    t = t.join(sizes.withColumnsRenamed({"run": "_r", "stage": "_t"}), F.expr("run = _r and stage = _t")) if gamma else t.withColumn("_k", F.lit(1))
    t = t.withColumn("d", F.col("slope") * F.col("bytes_in") * F.pow("_k", F.lit(gamma)) + F.col("intercept") + F.col("disp0"))
    s = t.groupBy("run", "stage").agg(F.count("*").alias("p"), F.max("d").alias("longest"), F.sum("d").alias("billed"), F.sum("bytes_in").alias("_bytes"), F.max("_tail").alias("_tail"))
    busy = F.least(F.col("p"), F.lit(slots))
    read = F.col("_bytes") / 1048576 / bandwidth(busy, *map(F.lit, store)) if store else F.lit(0.0)
    time = F.greatest(F.col("longest") * (1 + F.col("_tail")), F.col("billed") / busy, read)
    return s.select("run", "stage", "p", "longest", "billed", F.ceil(F.col("p") / slots).alias("waves"), time.alias("time"))


def waves(tasks: DataFrame, constants: DataFrame, slots: int) -> DataFrame:
    """run, stage, time: each stage's tasks by the model, in order of submission, each on the slot that is free first.

    The order matters, so a stage of a run, which one scheduler held, is one fold.
    """
    t = tasks.join(constants.select("stage", "slope", "intercept", F.col("disp").alias("disp0")), "stage")
    t = t.select("run", "stage", "start_s", "task", (F.col("slope") * F.col("bytes_in") + F.col("intercept") + F.col("disp0")).alias("d"))

    def fold(key, frame):
        import heapq as heap

        import pandas as pd

        ends = [0.0] * slots
        for d in frame.sort_values(["start_s", "task"])["d"]:
            heap.heapreplace(ends, ends[0] + d)
        return pd.DataFrame([(*key, max(ends))], columns=["run", "stage", "time"])

    kinds = {c: tasks.schema[c].dataType.simpleString() for c in ("run", "stage")}
    return t.groupBy("run", "stage").applyInPandas(fold, f"run {kinds['run']}, stage {kinds['stage']}, time double")


def makespan(durations: Iterable[float], slots: int | None) -> float:
    """The time that tasks take in submission order on so many slots."""
    ends: list[float] = []
    for d in durations:
        ends_first = heapq.heappop(ends) if slots and len(ends) >= slots else 0.0
        heapq.heappush(ends, ends_first + d)
    return max(ends, default=0.0)


def error_percent(model: Column, measured: Column) -> Column:
    """By how much a model is off, in percent of the measured."""
    return 100 * F.try_divide(model - measured, measured)


def accuracy(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """run and the mean of its stages' absolute errors, in percent: predicted time against measured d_fn."""
    j = predicted.select("run", "stage", "time").join(measured.select("run", "stage", "d_fn"), ["run", "stage"])
    return j.groupBy("run").agg(F.avg(F.abs(error_percent(F.col("time"), F.col("d_fn")))).alias("mape"))


def bandwidth(readers: Column, b1: Column, peak: Column, gamma: Column) -> Column:
    """MB/s that so many readers get together: each its own until the store's limit, which falls with their number."""
    return F.least(readers * b1, peak / (1 + gamma * readers))


def fit_bandwidth(points: DataFrame, grid: DataFrame) -> DataFrame:
    """The row of the grid (b1, peak, gamma) with the least mean squared relative error over points (readers, mbps).

    The grid is a stated list of parameters: it is broadcast, the points are read once and only sums leave a task.
    """
    off = (bandwidth(F.col("readers"), F.col("b1"), F.col("peak"), F.col("gamma")) - F.col("mbps")) / F.col("mbps")
    scored = points.join(F.broadcast(grid), F.lit(True)).groupBy("b1", "peak", "gamma").agg(F.avg(off * off).alias("error"))
    return scored.orderBy("error", "b1", "peak", "gamma").limit(1)


def read_grid(tasks: DataFrame) -> DataFrame:
    """parallel, size_mb and the median and 95th percentile of read time over its p tasks."""
    return tasks.groupBy("parallel", "size_mb").agg(F.percentile("t_read", 0.5).alias("read_s"), F.percentile("t_read", 0.95).alias("read_p95"), F.count("*").alias("p"))


def fit_size(tasks: DataFrame, exponents: Iterable[float]) -> DataFrame:
    """stage and the fixed seconds, seconds a MB and contention exponent g of t = a + b * MB * k^g, of the least median
    relative error over the stated exponents; stages of under 20 tasks are left out. Tasks need k."""
    t = tasks.where("t_total > 0").withColumn("g", F.explode(F.array(*(F.lit(float(g)) for g in exponents))))
    t = t.withColumn("x", F.col("bytes_in") / 1048576 * F.pow("k", "g"))
    line = fit_line(t, F.col("x"), F.col("t_total"), ["stage", "g"]).where("points >= 20")
    off = F.abs(F.col("slope") * F.col("x") + F.col("intercept") - F.col("t_total")) / F.col("t_total")
    scored = t.join(line, ["stage", "g"]).groupBy("stage", "g", "slope", "intercept").agg(F.percentile(off, 0.5).alias("error"))
    best = Window.partitionBy("stage").orderBy("error", "g")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


# ---------------------------------------------------------------- the graph of steps, which is small


@dataclass(frozen=True)
class Stage:
    name: str
    deps: tuple[str, ...] = ()
    func: str = "scan"


def reach(stages: Iterable[Stage], name: str, down: bool = False) -> set[str]:
    """A stage and all that it depends on, or all that depend on it."""
    stages = list(stages)
    edges = {s.name: {x.name for x in stages if s.name in x.deps} if down else set(s.deps) for s in stages}
    found, todo = set(), [name]
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += edges.get(n, ())
    return found


def critical_path(stages: list[Stage], duration: dict[str, float], serial: bool = False) -> tuple[float, dict[str, float]]:
    """The earliest end of all and of each stage, stages in order; serial: each waits for the one before it too."""
    ends: dict[str, float] = {}
    before: tuple[str, ...] = ()
    for s in stages:
        ends[s.name] = duration[s.name] + max((ends[d] for d in (*s.deps, *before) if d in ends), default=0.0)
        before = (s.name,) if serial else ()
    return max(ends.values(), default=0.0), ends


def semijoin_share(rows_joined: float, rows_probe: float) -> float:
    """sigma: the share of probe rows that find a match."""
    return min(rows_joined / rows_probe, 1.0) if rows_probe else math.nan


def semijoin_sigma(probe: DataFrame, probe_key: str, build: DataFrame, build_key: str, by: Iterable[str] = ()) -> DataFrame:
    """rows, joined and sigma: the share of a relation's rows whose key the build side has, for all or by some columns."""
    keys = build.select(F.col(build_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    met = probe.join(keys, F.col(probe_key) == F.col("_k"), "left")
    return met.groupBy(*by).agg(F.count("*").alias("rows"), F.count("_hit").alias("joined")).withColumn("sigma", F.try_divide(F.col("joined").cast("double"), F.col("rows")))


def subset_demand(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """subset (the bits of the filters that are on), demand and moved: what probes have left to read under each subset of filters.

    filters: bit, stage, phi (the share that passes), bytes (of the filter). probes: stage, rows. The rows of a stage shrink by
    the shares of all its filters that are on; each filter that is on costs its bytes. Filters are few: there are 2 ** n
    subsets, made by one join with as many numbers.
    """
    spark = filters.sparkSession
    n = filters.agg(F.max("bit")).first()[0]
    subsets = spark.range(1 << (n + 1)).withColumnRenamed("id", "subset")
    on = F.getbit("subset", F.col("bit").cast("int")) == 1
    each = subsets.join(F.broadcast(filters), F.lit(True)).groupBy("subset", "stage").agg(
        F.exp(F.sum(F.when(on, F.log(F.greatest("phi", F.lit(1e-12)))).otherwise(0.0))).alias("share"), F.sum(F.when(on, F.col("bytes")).otherwise(0)).alias("moved"))
    met = each.join(probes, "stage")
    return met.groupBy("subset").agg(F.sum(F.col("rows") * F.col("share")).alias("demand"), F.sum("moved").alias("moved"))


def classify(steps: DataFrame) -> DataFrame:
    """Adds kind: fixed, optimizable, bloom or both, as ``amdahl`` counts a step (func, builds_bloom, final_agg, base_scan)."""
    f = F.col("func")
    combine = (f == "aggregate") & ~F.col("final_agg")
    kind = F.when((f == "merge_bf"), "bloom").when(combine & F.col("builds_bloom"), "both").when(combine | (f == "scan") & F.col("base_scan") | f.isin("broadcast_join", "hash_join", "range_join", "hash_partition"), "optimizable")
    return steps.withColumn("kind", F.coalesce(kind, F.lit("fixed")))


def resize_stages(stages: DataFrame, size_mb: float, new_size_mb: float) -> DataFrame:
    """Adds tasks: a stage's at another task size, by its data (mb), its tasks (p) and how full these were."""
    full = F.greatest(F.lit(1e-9), F.least(F.col("mb") / F.col("p"), F.lit(float(size_mb))) * (new_size_mb / size_mb))
    return stages.withColumn("tasks", F.greatest(F.lit(1), F.ceil(F.col("mb") / full)))


def bloom_report(builders: int, appliers: int, bits: int, elements: int, sigma: float, error_rate: float = 0.001) -> dict[str, float]:
    """What a filter passes (phi) and moves: requests, bytes, and its false-positive rate, by the usual formulas."""
    k = max(1, round(-math.log2(error_rate)))
    f = (1 - math.exp(-k * elements / bits)) ** k if bits else math.nan
    requests = 2 * builders + 1 + appliers
    return {"k": k, "fpr": f, "phi": sigma + (1 - sigma) * f, "requests": requests, "bytes": bits / 8 * requests, "work": k * elements}


# ---------------------------------------------------------------- choosing plans


def pareto(plans: DataFrame, time: str = "time", cost: str = "cost", by: Iterable[str] = ()) -> DataFrame:
    """The plans that no other beats in time and cost."""
    quicker = Window.partitionBy(*by).orderBy(time, cost).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(cost).over(quicker)
    return plans.withColumn("_least", least).where(F.col("_least").isNull() | (F.col(cost) < F.col("_least"))).drop("_least")


def knee(front: DataFrame, time: str = "time", cost: str = "cost", by: Iterable[str] = ()) -> DataFrame:
    """The plan of a front nearest to its least time and cost, both in relation."""
    all_ = Window.partitionBy(*by)
    d = F.hypot(F.col(time) / F.min(time).over(all_) - 1, F.col(cost) / F.min(cost).over(all_) - 1)
    d = front.withColumn("distance", d)
    return d.withColumn("_r", F.row_number().over(all_.orderBy("distance", time))).where("_r = 1").drop("_r")


def sweep(curves: DataFrame, lambdas: Iterable[float], default_mb: float = 50, tolerance: float = 0.05) -> DataFrame:
    """lam, stage, size_mb: each stage's best size by lam * time / T + (1 - lam) * cost / C from curves
    (stage, size_mb, time, cost); the default stays where it is within the tolerance of the best."""
    whole = curves.where(F.col("size_mb") == default_mb).agg(F.sum("time").alias("T"), F.sum("cost").alias("C"))
    c = curves.join(F.broadcast(whole), F.lit(True)).withColumn("lam", F.explode(F.array(*(F.lit(float(x)) for x in lambdas))))
    c = c.withColumn("score", F.col("lam") * F.col("time") / F.col("T") + (1 - F.col("lam")) * F.col("cost") / F.col("C"))
    w = Window.partitionBy("lam", "stage")
    c = c.withColumn("_r", F.row_number().over(w.orderBy("score", "size_mb"))).withColumn("_own", F.max(F.when(F.col("size_mb") == default_mb, F.col("score"))).over(w))
    return c.where("_r = 1").select("lam", "stage", F.when(F.col("_own") <= F.col("score") * (1 + tolerance), F.lit(float(default_mb))).otherwise(F.col("size_mb").cast("double")).alias("size_mb"))


def pick_scenario(grid: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """parallel, size_mb: the parallelism of the least median wall, then its size of the least wall; among those within
    the tolerance the one that reads least in all. grid: parallel, size_mb, wall, p, t_read."""
    whole = grid.groupBy("parallel").agg(F.percentile("wall", 0.5).alias("wall"), F.avg(F.col("p") * F.col("t_read")).alias("read"))
    best = whole.join(F.broadcast(whole.agg(F.min("wall").alias("_w"))), F.lit(True)).where(F.col("wall") <= F.col("_w") * (1 + tolerance)).orderBy("read", "parallel").limit(1)
    own = grid.join(F.broadcast(best.select("parallel")), "parallel")
    near = own.join(F.broadcast(own.agg(F.min("wall").alias("_w"))), F.lit(True)).where(F.col("wall") <= F.col("_w") * (1 + tolerance))
    return near.orderBy(F.col("p") * F.col("t_read"), "size_mb").limit(1).select("parallel", "size_mb")


def resize(mb: float, tasks: int, size_mb: float, new_size_mb: float) -> int:
    """The tasks of a stage at another size, by its data and how full its tasks were."""
    return max(1, math.ceil(mb / max(1e-9, min(mb / tasks, size_mb) * new_size_mb / size_mb)))


def search(start: dict[str, float], options: dict[str, list[float]], score: Callable[[dict[str, float]], tuple[float, float]], lam: float, feasible: Callable[[dict[str, float]], bool] = lambda _: True, rounds: int = 20) -> dict[str, float]:
    """Coordinate descent on lam * T / T0 + (1 - lam) * C / C0 from a starting plan: one setting at a time, until none helps."""
    t0, c0 = score(start)

    def value(plan: dict[str, float]) -> float:
        t, c = score(plan)
        return lam * t / t0 + (1 - lam) * c / c0

    now, best = dict(start), 1.0
    for _ in range(rounds):
        moved = False
        for name, choices in options.items():
            for choice in choices:
                plan = {**now, name: choice}
                if feasible(plan) and (v := value(plan)) < best - 1e-12:
                    now, best, moved = plan, v, True
        if not moved:
            break
    return now


def compare(runs: DataFrame, default: str = "default") -> DataFrame:
    """query, plan, median time and cost, speedup and saving (percent) against the default plan; runs: query, plan, time, cost."""
    m = runs.groupBy("query", "plan").agg(F.percentile("time", 0.5).alias("time"), F.percentile("cost", 0.5).alias("cost"))
    base = m.where(F.col("plan") == default).select("query", F.col("time").alias("t0"), F.col("cost").alias("c0"))
    return m.join(base, "query").select("query", "plan", "time", "cost", F.try_divide("t0", "time").alias("speedup"), (100 * (1 - F.try_divide("cost", "c0"))).alias("saving"))


def pooled_rate(results: DataFrame) -> DataFrame:
    """query, sizing and the false positives of all its edges in percent of their negatives; 0 without negatives."""
    return results.groupBy("query", "sizing").agg(F.coalesce(100 * F.try_divide(F.sum("false_positives"), F.sum("negatives")), F.lit(0.0)).alias("fpr_percent"))


def amdahl(steps: DataFrame) -> DataFrame:
    """run, fixed_s, optimizable_s, bloom_s, total_s: what filters can't shorten, can, and add.

    steps: run, func, time_s, builds_bloom, final_agg, base_scan. A step that builds a filter beside its own work counts
    a fifth of its time for the filter.
    """
    f, t = F.col("func"), F.col("time_s")
    joins = f.isin("broadcast_join", "hash_join", "range_join", "hash_partition")
    combine = (f == "aggregate") & ~F.col("final_agg")
    bloom = F.when(f == "merge_bf", t).when(combine & F.col("builds_bloom"), 0.2 * t).otherwise(0.0)
    able = F.when((f == "scan") & F.col("base_scan") | joins, t).when(combine, F.when(F.col("builds_bloom"), 0.8 * t).otherwise(t)).otherwise(0.0)
    s = steps.groupBy("run").agg(F.sum(t).alias("total_s"), F.sum(able).alias("optimizable_s"), F.sum(bloom).alias("bloom_s"))
    return s.select("run", (F.col("total_s") - F.col("optimizable_s") - F.col("bloom_s")).alias("fixed_s"), "optimizable_s", "bloom_s", "total_s")
