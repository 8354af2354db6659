"""Predicates, task planning, the cost model and pipelines on small values."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidesift import workload
from tidesift.functions import predicates
from tidesift.plans import costs, dags, planner, sqltext, steps, template, tpch


def test_predicate_texts():
    t = predicates.parse("a > 1 AND NOT (b LIKE 'x%' OR c IN (1, 2)) AND d < DATE '2020-01-31' + INTERVAL 1 MONTH AND e IS NOT NULL")
    assert t.kind == "and" and t.items[2].items[1] == dt.date(2020, 2, 29)
    for bad in ("a >", "a = 1 b", "a ? 1"):
        with pytest.raises((ValueError, IndexError)):
            predicates.parse(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=6), st.randoms())
def test_pruning_keeps_every_group_with_a_match(values, rnd):
    def text(depth):
        kind = rnd.choice(["cmp", "flip", "between", "in", "and", "or", "not"] if depth else ["cmp", "flip"])
        c, v, w = rnd.choice("ab"), rnd.randint(0, 9), rnd.randint(0, 9)
        op = rnd.choice(["=", "<>", "<", "<=", ">", ">="])
        return {"cmp": f"{c} {op} {v}", "flip": f"{v} {op} {c}", "between": f"{c} BETWEEN {v} AND {w}", "in": f"{c} NOT IN ({v}, {w})",
                "not": f"NOT ({text(depth - 1) if depth else 'a = 1'})", "and": f"({text(depth - 1) if depth else 'a = 1'}) AND ({text(depth - 1) if depth else 'b = 1'})",
                "or": f"({text(depth - 1) if depth else 'a = 1'}) OR ({text(depth - 1) if depth else 'b = 1'})"}[kind]

    where = text(3)
    table = pa.table({"a": [v[0] for v in values], "b": [v[1] for v in values]})
    stats = {c: (min(table[c].to_pylist()), max(table[c].to_pylist())) for c in "ab"}
    if table.filter(predicates.to_arrow(where, table.schema)).num_rows:
        assert predicates.prune([{"stats": stats}], where), where
    assert predicates.prune([{"stats": None}], where)


def test_like_in_arrow():
    t = pa.table({"s": ["abc", "aXc", "ABC", None]})
    assert t.filter(predicates.to_arrow("s LIKE 'a_c'", t.schema)).num_rows == 2
    assert t.filter(predicates.to_arrow("s ILIKE 'ab%'", t.schema)).num_rows == 2


def groups(n, seed, key=True):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lo = rnd.uniform(0, 1000)
        out.append(planner.Group(f"f{k % 5}", k, rnd.uniform(0.5, 40), rnd.randint(1, 10_000_000), lo, lo + rnd.uniform(0, 80)))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_scan_tasks_hold_each_group_once(seed):
    g = groups(60, seed)
    tasks = planner.split_by_size(g, 50)
    assert [x for t in tasks for x in t] == g
    assert all(len(t) == 1 or sum(x.size_mb for x in t) <= 50 for t in tasks)
    assert all(len(t) == 1 for t in planner.split_by_size(g, 50, single=True))
    parts = planner.split_by_rows(g, 45_000_000)
    assert [x for t in parts for x in t] == g


@pytest.mark.parametrize("seed", range(5))
def test_join_tasks_lose_no_pair(seed):
    b, p = groups(40, seed), groups(60, seed + 100)
    want = {(x.rg_id, y.rg_id) for x in b for y in p if x.meets(y)}
    for tasks in (planner.split_island(b, p, 50, 5), planner.build_anchored(b, p, 50, 3, 10)):
        assert {(x.rg_id, y.rg_id) for t in tasks for x in t.builds for y in t.probes if x.meets(y)} == want


@pytest.mark.parametrize("max_mb", [20, 120, 4000])
def test_batched_pairs_keep_to_the_budget(spark, max_mb):
    b, p = groups(40, 7), groups(60, 107)
    pairs = [(x.path, x.rg_id, x.size_mb, y.path, y.rg_id, y.size_mb, y.lo) for x in b for y in p if x.meets(y)]
    shape = "build_path string, build_rg int, build_mb double, probe_path string, probe_rg int, probe_mb double, probe_lo double"
    found = planner.batch_pairs(spark.createDataFrame(pairs, shape), max_mb).collect()
    assert sorted((r["build_rg"], r["probe_rg"]) for r in found) == sorted((x[1], x[4]) for x in pairs)
    tasks = {}
    for r in found:
        builds, probes = tasks.setdefault(r["task"], ({}, {}))
        builds[r["build_rg"]], probes[r["probe_rg"]] = r["build_mb"], r["probe_mb"]
    budget = found[0]["budget"]
    units = [sum(x[2] for x in pairs if x[4] == y.rg_id) + y.size_mb for y in p if any(x.meets(y) for x in b)]
    assert budget == max_mb if sum(u > max_mb for u in units) <= 0.3 * len(units) else budget >= max_mb
    for builds, probes in tasks.values():
        room = max(budget - sum(probes.values()), 0.3 * budget)
        assert sum(builds.values()) + sum(probes.values()) <= budget + 1e-6 or len(probes) == 1 and sum(builds.values()) <= room + max(builds.values())
    assert planner.batch_pairs(spark.createDataFrame([], shape)).count() == 0


def test_overlap_pairs_match_all_pairs(spark):
    b, p = groups(40, 1), groups(60, 2)
    shape = "full_path string, rg_id int, size_mb double, rows long, lo double, hi double"
    df = [spark.createDataFrame([(g.path, g.rg_id, g.size_mb, g.rows, g.lo, g.hi) for g in x], shape) for x in (b, p)]
    got = {(r["build_rg"], r["probe_rg"]) for r in planner.overlap_pairs(*df).collect()}
    assert got == {(x.rg_id, y.rg_id) for x in b for y in p if x.meets(y)}
    assert planner.overlap_pairs(df[0], df[1].limit(0)).count() == 0
    assert planner.skew_threshold(df[0], 50) >= 5 and planner.skew_threshold(df[0], 50, override=7) == 7


def test_makespan_and_critical_path():
    assert costs.makespan([3, 1, 1, 1], 2) == 3 and costs.makespan([1, 2], None) == 2 and costs.makespan([], 3) == 0
    s = [costs.Stage("a"), costs.Stage("b"), costs.Stage("c", ("a", "b"))]
    assert costs.critical_path(s, {"a": 1, "b": 2, "c": 3})[0] == 5
    assert costs.critical_path(s, {"a": 1, "b": 2, "c": 3}, serial=True)[0] == 6
    assert costs.reach(s, "c") == {"a", "b", "c"} and costs.reach(s, "a", down=True) == {"a", "c"}


def test_fit_line_keeps_signs(spark):
    from pyspark.sql import functions as F

    def fit(points):
        r = costs.fit_line(spark.createDataFrame(points, "x double, y double"), F.col("x"), F.col("y")).first()
        return round(r["slope"], 6), round(r["intercept"], 6)

    assert fit([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)]) == (2, 1)
    assert fit([(1.0, 5.0), (2.0, 3.0)]) == (0, 4)
    assert fit([(1.0, 1.0), (2.0, 4.0)]) == (1.8, 0)


def test_search_reaches_the_least():
    at = {10.0: 5.0, 20.0: 1.0, 30.0: 2.0}
    assert costs.search({"s": 10.0, "t": 30.0}, {"s": list(at), "t": list(at)}, lambda p: (at[p["s"]] + at[p["t"]],) * 2, 0.5) == {"s": 20.0, "t": 20.0}


@pytest.mark.parametrize("change", [{"func": "nope"}, {"params": {}}, {"params": {"select": "SELECT 1", "output_file": "o", "odd": 1}}, {"name": None}])
def test_bad_steps_are_refused(change):
    with pytest.raises(ValueError):
        steps.read_step({"name": "s", "func": "scan", "params": {"select": "SELECT *", "output_file": "o"}} | change)


def test_each_func_reads_its_required_parameters():
    for func, need in steps.REQUIRED.items():
        params = dict.fromkeys(need, "1")
        assert steps.read_step({"name": "s", "func": func, "params": params}).func == func
        for k in need:
            with pytest.raises(ValueError):
                steps.read_step({"name": "s", "func": func, "params": {x: v for x, v in params.items() if x != k}})


def test_values_and_order_of_steps():
    assert steps.value_of("filter_by_bf", "yes") is True and steps.value_of("sort_by", "a, b") == ["a", "b"] and steps.value_of("location", "none") is None
    with pytest.raises(ValueError):
        steps.value_of("is_delete", "maybe")
    with pytest.raises(ValueError):
        steps.read_pipeline([{"name": "a", "func": "aggregate", "from_previous_task": "b", "params": {"output_file": "o"}}])


def test_results_do_not_depend_on_filters(spark, sf_dir):
    want = rows(workload.run_pipeline(spark, sf_dir, filters=False))
    assert want and rows(workload.run_pipeline(spark, sf_dir)) == want == rows(workload.run_pipeline(spark, sf_dir, exact=False))


def test_replanned_steps():
    read = steps.read_pipeline(workload.pipeline(), price=1)
    changed = {s.name: s for s in steps.replan(read, ["merge"], {"join": 9}, {"join": 3})}
    assert "merge" not in changed and "merge" in {s.name for s in read}
    assert changed["scan-lines"].deps == () and "filter_by_bf" not in changed["scan-lines"].params and "bf_column" not in changed["orders"].params
    assert (changed["join"].max_size_mb, changed["join"].max_parallel) == (9, 3) and steps.left_to_spark(list(changed.values())) == {"join": ("max_size_mb", "max_parallel")}
    for bad in ({"bf_off": ["nothing"]}, {"max_size_mb": {"nothing": 1}}):
        with pytest.raises(ValueError):
            steps.replan(read, **bad)


def test_templates():
    text = "{% set k = 2 %}{% for x in range(k + 1) %}{% if x == 1 %}one{% elif x > 1 and not off %}{{ names[0] }}{% else %}-{% endif %},{% endfor %}{# gone #}{{ k if k in [1, 2] else 'no' }}"
    assert template.render(text, off=False, names=["many"]) == "-,one,many,2" and template.render(text, off=True, names=[]) == "-,one,-,2"
    assert template.render("{% if a %}{% for x in missing %}x{% endfor %}{% endif %}b", a=False) == "b" and template.render("{% for x in [] %}{{ y }}{% endfor %}") == ""
    for bad in ("{{ a }}", "{{ open('x') }}", "{{ a.b }}", "{% if a %}", "{% endif %}", "{% for x in [1] %}", "{% odd %}", "{{ (lambda: 1)() }}"):
        with pytest.raises((ValueError, SyntaxError)):
            template.render(bad, **({"a": 1} if bad != "{{ a }}" else {}))


@pytest.mark.parametrize("name", sorted(dags.TEMPLATES))
def test_pipelines_of_the_suite(name):
    plain, filtered = dags.pipeline(name, False), dags.pipeline(name)
    assert not any(s.func == "merge_bf" for s in plain) and {s.name for s in plain} <= {s.name for s in filtered}
    with pytest.raises(ValueError):
        dags.pipeline(name, odd="1")


def test_suite_without_filters(spark, sf_dir):
    for name in ("q3", "q9"):
        assert rows(dags.run(spark, sf_dir, name, enable_bf=False)) == rows(dags.run(spark, sf_dir, name))


def test_waves_follow_the_slots(spark):
    rnd = random.Random(6)
    tasks = [(run, s, k, float(k % 7), rnd.randrange(1, 9) * 65536) for run in (1, 2) for s in "ab" for k in range(25)]
    constants = spark.createDataFrame([(s, 1 / 65536, 0.5, 0.25) for s in "ab"], "stage string, slope double, intercept double, disp double")
    found = {(r["run"], r["stage"]): r["time"] for r in costs.waves(spark.createDataFrame(tasks, "run long, stage string, task long, start_s double, bytes_in long"), constants, 4).collect()}
    for key, time in found.items():
        own = [b / 65536 + 0.75 for *_, b in sorted((x for x in tasks if x[:2] == key), key=lambda x: (x[3], x[2]))]
        assert time == pytest.approx(costs.makespan(own, 4))


def test_overlap_by_spans_of_time(spark):
    rnd = random.Random(9)
    tasks = [(run, k, a := float(rnd.randrange(500)), a + rnd.choice([0.0, 0.5, 3.0, 90.0])) for run in (1, 2) for k in range(60)]
    df = spark.createDataFrame(tasks, "run long, task long, start_s double, end_s double")
    want = {(r, k): max(1, sum(x[2] < b and x[3] > a for x in tasks if x[0] == r)) for r, k, a, b in tasks}
    for width in (1.0, 60.0, 1e6):
        assert {(r["run"], r["task"]): r["k"] for r in costs.task_overlap(df, width_s=width).collect() if r["end_s"] > r["start_s"]} == {k: n for k, n in want.items() if next(x for x in tasks if x[:2] == k)[3] > next(x for x in tasks if x[:2] == k)[2]}


@pytest.mark.parametrize("name", sorted(tpch.QUERIES))
def test_parameters_are_found_again(name):
    assert sqltext.parameters_of(name, tpch.render(name)) == tpch.PARAMETERS[name]
    with pytest.raises(ValueError):
        tpch.render(name, odd="1")


def test_transpile():
    assert sqltext.transpile("select 1 from t where d < date '1998-12-01' - interval '90' day (3)\n;\n:n -1") == "select 1 from t where d < date '1998-12-01' - interval '90' day"
    assert sqltext.transpile("select a from t;\n:n 5").endswith("LIMIT 5")


def test_rates_of_two_are_the_best_that_are_not_negative(spark):
    rng = random.Random(5)
    groups = {"both": (0.5, 2.0), "first": (3.0, -1.0), "second": (-2.0, 1.5), "none": (-1.0, -1.0)}
    data = [(g, u, v, a * u + b * v + rng.gauss(0, 0.1)) for g, (a, b) in groups.items() for u, v in ((rng.random(), rng.random()) for _ in range(60))]
    found = {r["g"]: r for r in costs.fit_pair(spark.createDataFrame(data, "g string, u double, v double, y double"), costs.F.col("u"), costs.F.col("v"), costs.F.col("y"), ["g"]).collect()}
    for g in groups:
        own = [d[1:] for d in data if d[0] == g]
        loss = lambda a, b: sum((y - a * u - b * v) ** 2 for u, v, y in own)  # noqa: B023, E731
        best = min(loss(a / 50, b / 50) for a in range(200) for b in range(200))
        assert found[g]["a"] >= 0 and found[g]["b"] >= 0 and loss(found[g]["a"], found[g]["b"]) <= best + 1e-9, g
    alike = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 6.0), (None, 1.0, 1.0)], "u double, v double, y double")
    r = costs.fit_pair(alike, costs.F.col("u"), costs.F.col("v"), costs.F.col("y")).first()
    assert r["a"] >= 0 and r["b"] >= 0 and r["points"] == 2 and r["a"] + 2 * r["b"] == pytest.approx(3)
    assert costs.fit_pair(alike.limit(0), costs.F.col("u"), costs.F.col("v"), costs.F.col("y"), ["y"]).count() == 0


def test_pipeline_as_text_and_its_scenarios():
    read = steps.read_pipeline(workload.pipeline("adaptive_join").replace("> $price", "> 1 AND '$' <> 'a: b'"))
    assert steps.read_pipeline(steps.to_text(read)) == read
    made = steps.scenarios(read, (2, 8), (12.5,))
    assert set(made) == {"p2-s12.5", "p8-s12.5"}
    for s in steps.read_pipeline(made["p8-s12.5"]):
        assert (s.max_parallel, s.max_size_mb) == ((None, None) if s.func in ("merge_bf", "summary_clean") else (8, 12.5))


def test_estimates_of_filters(spark, sf_dir):
    read = steps.read_pipeline(workload.pipeline(), price=200000)
    piped = steps.compile_pipeline(spark, read, lambda n: workload.table(spark, sf_dir, n))
    keys = piped.frames["orders"].count()
    told = {r["task"]: r["est_elements"] for r in steps.filter_estimates(piped).collect()}
    assert set(told) == {"orders", "merge"} and 0.95 * keys / 0.9 - 5 <= told["orders"] <= 1.05 * keys / 0.9 + 5
    again = {s.name: s.params.get("est_elements") for s in steps.with_estimates(read, told)}
    assert again["orders"] == told["orders"] and again["scan-orders"] is None
    assert steps.with_estimates(read, {"orders": None, "else": 5}) == read


def test_estimates_of_overfull_filters(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(workload, "_pipe", workload._pipe.replace("est_elements: 5000", "est_elements: 10"))
    read = steps.read_pipeline(workload.pipeline(), price=200000)
    piped = steps.compile_pipeline(spark, read, lambda n: workload.table(spark, sf_dir, n))
    keys = piped.frames["orders"].count()
    told = {r["task"]: r["est_elements"] for r in steps.filter_estimates(piped).collect()}
    assert set(told) == {"orders", "merge"} and all(abs(0.9 * n - keys) <= 1 for n in told.values())
    assert rows(workload.queries()["bloom_estimates"](spark, sf_dir)) == rows(workload.queries()["steps_without_filters"](spark, sf_dir))
