"""A declarative pipeline of steps that compiles to lazy DataFrames: nothing runs until the result is asked for.

A pipeline is a list of dicts (or YAML of one): name, func, input (a table's name or a path) or from_previous_task (names
of steps; for joins the build side, then the probe side), params. SELECT and clause text is SQL; joins name their sides
build_table and probe_table, scans and aggregations read _t.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from string import Template
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import bloom, joins
from ..operators.aggregates import combine, with_bucket, write_bucketed, write_sorted
from .template import render


@dataclass(frozen=True)
class Step:
    name: str
    func: str
    deps: tuple[str, ...] = ()
    source: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    max_size_mb: float | None = None
    max_parallel: int | None = None


# ---------------------------------------------------------------- reading and checking

REQUIRED: dict[str, tuple[str, ...]] = {
    "scan": ("select", "output_file"),
    "aggregate": ("output_file",),
    "hash_aggregate": ("output_file",),
    "merge_bf": ("file_output", "error_rate"),
    "create_bf": (),
    "broadcast_join": ("probe_select", "join_condition", "output_file"),
    "hash_join": ("probe_select", "join_condition", "output_file"),
    "broadcast_join_pushdown": ("probe_select", "join_condition", "output_file", "build_key", "probe_key"),
    "range_join": ("probe_select", "join_condition", "output_file", "build_key", "probe_key"),
    "adaptive_join": ("probe_select", "join_condition", "output_file", "build_key", "probe_key"),
    "hash_partition": (),
    "summary_clean": (),
}
OPTIONAL: dict[str, tuple[str, ...]] = {
    "scan": ("location", "sql_clauses", "bf_column", "filter_by_bf", "est_elements", "sort_by", "max_workers", "single_row_group_per_task"),
    "aggregate": ("select", "sql_clauses", "single_file", "bf_column", "bf_path", "est_elements", "error_rate", "sort_by", "hash_column", "num_buckets", "partition_output_folder"),
    "merge_bf": ("folder_bf",),
    "create_bf": ("input_paths", "bf_column", "est_elements", "error_rate"),
    "broadcast_join": ("join_type", "sort_by", "build_table_paths", "probe_table_paths"),
    "broadcast_join_pushdown": ("join_type", "sort_by"),
    "range_join": ("join_type", "sort_by", "skew_threshold", "max_files_per_task"),
    "adaptive_join": ("join_type", "sort_by", "broadcast_threshold_mb", "force_strategy", "max_probe_files_per_task", "max_probe_row_groups_per_task", "max_build_file_ratio"),
    "hash_partition": ("hash_column", "num_buckets", "output_folder"),
    "summary_clean": ("output_s3", "nfs_folder", "is_delete", "exclude_patterns"),
}
OPTIONAL["hash_aggregate"], OPTIONAL["hash_join"] = OPTIONAL["aggregate"], OPTIONAL["broadcast_join"]
FLAGS = ("filter_by_bf", "single_file", "is_delete", "single_row_group_per_task")
NUMBERS = {"est_elements": int, "num_buckets": int, "error_rate": float, "broadcast_threshold_mb": float, "max_workers": int, "skew_threshold": int}
LISTS = ("sort_by", "exclude_patterns")


def value_of(name: str, value: Any) -> Any:
    """A parameter's value: none words are None, flags and numbers are read from words, lists from comma text."""
    if isinstance(value, str) and value.strip().lower() in ("", "none", "null"):
        return None
    if value is None:
        return None
    if name in FLAGS:
        if isinstance(value, str):
            if value.strip().lower() not in ("true", "false", "yes", "no", "1", "0", "on", "off"):
                raise ValueError(f"{name}: {value!r} is no flag")
            return value.strip().lower() in ("true", "yes", "1", "on")
        return bool(value)
    if name in NUMBERS:
        return NUMBERS[name](value)
    if name in LISTS and isinstance(value, str):
        return [v.strip() for v in value.split(",") if v.strip()]
    return value


def read_step(raw: Mapping[str, Any]) -> Step:
    """A checked step; an unknown func, a missing or an unknown parameter is refused."""
    func, name = raw.get("func"), raw.get("name")
    if not name:
        raise ValueError("a step needs a name")
    if func not in REQUIRED:
        raise ValueError(f"{name}: unknown func {func!r}; known: {', '.join(REQUIRED)}")
    params = {k: value_of(k, v) for k, v in (raw.get("params") or {}).items()}
    before = raw.get("from_previous_task") or []
    before = tuple(d for d in ([before] if isinstance(before, str) else before) if value_of("", d) is not None)
    if missing := [k for k in REQUIRED[func] if params.get(k) is None]:
        raise ValueError(f"{name}: {func} needs {', '.join(missing)}")
    if extra := set(params) - {*REQUIRED[func], *OPTIONAL[func]}:
        raise ValueError(f"{name}: {func} has no parameter {', '.join(sorted(extra))}")
    if params.get("join_type") and params["join_type"].replace(" ", "_") not in joins.KINDS:
        raise ValueError(f"{name}: join type {params['join_type']!r}")
    return Step(name, func, before, raw.get("input"), params, raw.get("max_size_mb"), raw.get("max_parallel"))


def read_pipeline(text: str | list, **values: Any) -> list[Step]:
    """Steps from YAML text or a list. The text is a template (``template.render``: conditions, loops, expressions of the values)
    in which also $name stands for a value and $random for a new word.

    Steps may be under "steps". Two steps of a name, or one that needs a step it doesn't come after, are refused.
    """
    if isinstance(text, str):
        import yaml

        text = yaml.safe_load(Template(render(text, **values)).safe_substitute(random=uuid.uuid4().hex[:8], **values))
    steps = [read_step(s) for s in (text.get("steps", []) if isinstance(text, Mapping) else text)]
    known: set[str] = set()
    for s in steps:
        if s.name in known:
            raise ValueError(f"two steps are named {s.name}")
        if unknown := set(s.deps) - known:
            raise ValueError(f"{s.name} needs {', '.join(sorted(unknown))}, which no earlier step is")
        known.add(s.name)
    return steps


# ---------------------------------------------------------------- compiling


@dataclass
class Bloom:
    """What a step knows of a filter: the keys that it is of, by parts, and its sizing."""

    parts: list[tuple[DataFrame, str]]
    size: bloom.Sizing


@dataclass
class Pipeline:
    """The compiled steps: a lazy DataFrame for each that has rows, a filter for those that build one."""

    frames: dict[str, DataFrame]
    filters: dict[str, Bloom]
    last: str

    @property
    def result(self) -> DataFrame:
        return self.frames[self.last]


def compile_pipeline(spark: SparkSession, steps: list[Step], tables: Callable[[str], DataFrame], filters: bool = True, exact: bool = True) -> Pipeline:
    """Composes all steps. ``tables`` gives the relation that an input names.

    A filter drops rows early and nothing else, so results don't depend on ``filters``. exact uses the semi-join
    that Catalyst plans itself, the default; else the bitmap filter is built and probed as it is.
    """
    out = Pipeline({}, {}, "")

    def sql(select: str, clauses: str | None, rows: DataFrame) -> DataFrame:
        text = select if re.search(r"\bfrom\b", select, re.I) else f"{select} FROM _t"
        return spark.sql(re.sub(r"\bfrom\s+_t\b", "FROM {_t} AS _t", f"{text} {clauses or ''}", flags=re.I), _t=rows)

    def relation(step: Step, dep: str) -> DataFrame:
        if dep not in out.frames:
            raise ValueError(f"{step.name}: {dep} has no rows to read")
        return out.frames[dep]

    def rows_of(step: Step) -> DataFrame:
        own = [d for d in step.deps if d in out.frames]
        return combine(*(relation(step, d) for d in own)) if own else tables(step.source or step.params.get("location") or "")

    def filtered(step: Step, df: DataFrame) -> DataFrame:
        if not (filters and step.params.get("filter_by_bf")):
            return df
        held = [out.filters[d] for d in step.deps if d in out.filters]
        if not held:
            raise ValueError(f"{step.name}: filter_by_bf without a step that builds a filter")
        column = step.params.get("bf_column")
        for f in held:
            if exact:
                keys = combine(*(k.selectExpr(f"`{c}` AS k") for k, c in f.parts))
                df = bloom.semi_filter(df, column, keys, "k")
            else:
                made = bloom.merge(*(bloom.build(k, c, f.size) for k, c in f.parts))
                df = bloom.contains(df, column, made, f.size, "_bf").where("_bf").drop("_bf")
        return df

    def sorted_by(step: Step, df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(*step.params["sort_by"]) if step.params.get("sort_by") else df

    for s in steps:
        p = s.params
        if s.func == "scan":
            source = tables(s.source or p.get("location") or "") if (s.source or p.get("location")) else rows_of(s)
            df = filtered(s, source)
            out.frames[s.name] = sorted_by(s, sql(p["select"], p.get("sql_clauses"), df))
        elif s.func in ("aggregate", "hash_aggregate"):
            df = rows_of(s)
            # groups are made in each task first; what is dealt out by a column are their partial results
            if p.get("select"):
                df = sql(p["select"], p.get("sql_clauses"), df)
            if p.get("hash_column") and p["hash_column"] in df.columns:
                df = df.repartition(int(p.get("num_buckets") or 8), p["hash_column"])
            out.frames[s.name] = sorted_by(s, df)
            if p.get("bf_column"):
                out.filters[s.name] = Bloom([(df, p["bf_column"])], bloom.Sizing.of(p.get("est_elements") or 1000, p.get("error_rate") or 0.001))
        elif s.func == "create_bf":
            df = rows_of(s)
            out.filters[s.name] = Bloom([(df, p["bf_column"])], bloom.Sizing.of(p.get("est_elements") or 1000, p.get("error_rate") or 0.001))
        elif s.func == "merge_bf":
            made = [out.filters[d] for d in s.deps if d in out.filters]
            if made:
                out.filters[s.name] = Bloom([x for f in made for x in f.parts], max((f.size for f in made), key=lambda z: z.bits))
        elif s.func == "hash_partition":
            df = rows_of(s)
            out.frames[s.name] = with_bucket(df, p["hash_column"], p["num_buckets"]).repartition(p["num_buckets"], "_bucket_id").drop("_bucket_id") if p.get("hash_column") else df
        elif s.func == "summary_clean":
            continue  # nothing is written before write_outputs
        else:
            if len(s.deps) != 2:
                raise ValueError(f"{s.name}: a join needs two steps, the build side and the probe side")
            build, probe = (relation(s, d) for d in s.deps)
            how = (p.get("join_type") or "inner").replace(" ", "_")
            if s.func == "range_join" and how in ("inner", "left_semi"):
                probe = probe.where(joins.within(p["probe_key"], joins.key_spans(build, p["build_key"], 8)))
            if s.func == "broadcast_join_pushdown" and how in ("inner", "left_semi"):
                from pyspark.sql import functions as F

                ends = build.agg(F.min(p["build_key"]).alias("lo"), F.max(p["build_key"]).alias("hi"))
                probe = probe.where((F.col(p["probe_key"]) >= ends.select("lo").scalar()) & (F.col(p["probe_key"]) <= ends.select("hi").scalar()))
            hint = {"broadcast_join": "", "broadcast_join_pushdown": "", "hash_join": "SHUFFLE_HASH(build_table)", "range_join": "MERGE(build_table)", "adaptive_join": ""}[s.func]
            if s.func == "adaptive_join":
                mb = joins.planned_bytes(build) / 1048576
                hint = "BROADCAST(build_table)" if joins.choose_strategy(mb, p.get("broadcast_threshold_mb") or 100, p.get("force_strategy")) == "broadcast" else "MERGE(build_table)"
            elif s.func.startswith("broadcast_join") and joins.planned_bytes(build) <= joins.BROADCAST_BYTES:
                hint = "BROADCAST(build_table)"
            word = {"inner": "INNER JOIN", "left": "LEFT JOIN", "left_semi": "LEFT SEMI JOIN", "left_anti": "LEFT ANTI JOIN"}[how]
            select = re.sub(r"^\s*select\b", f"SELECT /*+ {hint} */" if hint else "SELECT", p["probe_select"], count=1, flags=re.I)
            select = re.sub(r"\bfrom\s+probe_table\b.*$", "", select, flags=re.I | re.S)
            text = f"{select} FROM {{probe_table}} AS probe_table {word} {{build_table}} AS build_table ON {p['join_condition']}"
            out.frames[s.name] = sorted_by(s, spark.sql(text, probe_table=probe, build_table=build))
        if s.name in out.frames:
            out.last = s.name
    return out


def replan(steps: list[Step], bf_off: Iterable[str] = (), max_size_mb: Mapping[str, float] | None = None, max_parallel: Mapping[str, int] | None = None) -> list[Step]:
    """The steps under a plan: without the filters that the merge steps in ``bf_off`` make, and with other sizes.

    A filter is an edge of the graph from the steps that build it through its merge step to those that read it, so the edge goes:
    the merge step, what makes its builders build, and what makes its readers ask for it.
    """
    off, sizes = frozenset(bf_off), {"max_size_mb": max_size_mb or {}, "max_parallel": max_parallel or {}}
    named = {s.name for s in steps}
    if unknown := (off | {n for by in sizes.values() for n in by}) - named:
        raise ValueError(f"no step {', '.join(sorted(unknown))}")
    builders = {d for s in steps if s.name in off for d in s.deps}
    out = []
    for s in (s for s in steps if s.name not in off):
        gone = (("bf_column", "bf_path", "est_elements") if s.name in builders else ()) + (("filter_by_bf", "bf_column") if off & set(s.deps) else ())
        changed = {k: by[s.name] for k, by in sizes.items() if s.name in by}
        out.append(replace(s, deps=tuple(d for d in s.deps if d not in off), params={k: v for k, v in s.params.items() if k not in gone}, **changed))
    return out


def filter_estimates(pipeline: Pipeline, fill_target: float = 0.9) -> DataFrame:
    """task, est_elements: for each step that builds a filter of its own rows, the elements that its filter holds (``bloom.held_elements``),
    so that one sized for them is filled to the target. Written as JSON, it serves ``with_estimates`` of later runs."""
    each = []
    for name, f in pipeline.filters.items():
        if len(f.parts) == 1:
            (keys, column), = f.parts
            each.append((name, bloom.calibrated_elements(bloom.held_elements(keys, column, f.size), fill_target)))
    if not each:
        raise ValueError("no step builds a filter")
    return keys.sparkSession.createDataFrame(each, "task string, est_elements long")


def with_estimates(steps: list[Step], estimates: Mapping[str, int | None]) -> list[Step]:
    """The steps with est_elements as measured before; a step without a measure, or one that was empty, keeps its own."""
    known = {s.name for s in steps if s.params.get("bf_column") and "est_elements" in (*REQUIRED[s.func], *OPTIONAL[s.func])}
    return [replace(s, params={**s.params, "est_elements": int(estimates[s.name])}) if s.name in known and estimates.get(s.name) else s for s in steps]


def to_text(steps: list[Step]) -> str:
    """The pipeline as YAML that ``read_pipeline`` reads as the same steps: plans and scenarios are kept as such texts."""
    import yaml

    raw = []
    for s in steps:
        one = {"name": s.name, "func": s.func, "input": s.source, "from_previous_task": list(s.deps) or None, "max_size_mb": s.max_size_mb, "max_parallel": s.max_parallel, "params": dict(s.params)}
        raw.append({k: v for k, v in one.items() if v is not None})
    return yaml.safe_dump({"steps": raw}, sort_keys=False, allow_unicode=True).replace("$", "$$")


def scenarios(steps: list[Step], parallel: Iterable[int], sizes_mb: Iterable[float]) -> dict[str, str]:
    """A pipeline's text for each parallelism and size, by a name of both: every step that reads data is set to them."""
    reads = [s.name for s in steps if s.func not in ("merge_bf", "summary_clean")]
    return {f"p{p}-s{m:g}": to_text(replan(steps, max_size_mb=dict.fromkeys(reads, m), max_parallel=dict.fromkeys(reads, p))) for p in parallel for m in sizes_mb}


#: What tells an engine of functions how to cut work up. Spark's planner and adaptive execution decide that here, so these change
#: no plan; ``left_to_spark`` says which a pipeline has.
SCHEDULING = ("max_workers", "single_row_group_per_task", "skew_threshold", "max_files_per_task", "max_probe_files_per_task", "max_probe_row_groups_per_task", "max_build_file_ratio", "build_table_paths", "probe_table_paths", "folder_bf", "bf_path", "input_paths", "output_s3", "nfs_folder")


def left_to_spark(steps: list[Step]) -> dict[str, tuple[str, ...]]:
    """By step, the settings that are read and checked but that Spark decides itself."""
    found = {s.name: tuple(k for k in (*SCHEDULING, "max_size_mb", "max_parallel") if s.params.get(k) is not None or k.startswith("max_") and getattr(s, k, None) is not None) for s in steps}
    return {n: k for n, k in found.items() if k}


def write_outputs(pipeline: Pipeline, steps: list[Step], folder: str) -> dict[str, str]:
    """Writes what steps name as output_file (partition_output_folder: by hash buckets) below a folder and gives back the paths.

    single_file makes it one file; sort_by clusters it. A summary_clean step with is_delete removes what the steps before it
    wrote, except paths that match exclude_patterns. Only the outputs asked for are computed.
    """
    spark, written = pipeline.result.sparkSession, {}
    for s in steps:
        p = s.params
        if s.func == "summary_clean":
            if p.get("is_delete"):
                from ..sources.catalog import folder_summary

                for name in [n for n, path in written.items() if not any(re.search(x, path) for x in p.get("exclude_patterns") or ())]:
                    folder_summary(spark, written.pop(name), delete=True)
        elif s.name in pipeline.frames and (p.get("output_file") or p.get("partition_output_folder") or p.get("output_folder")):
            path = f"{folder.rstrip('/')}/{p.get('partition_output_folder') or p.get('output_folder') or p['output_file']}"
            df = pipeline.frames[s.name]
            if p.get("hash_column") and p.get("num_buckets") and not p.get("single_file"):
                write_bucketed(df, path, p["hash_column"], p["num_buckets"], p.get("sort_by") or ())
            else:
                write_sorted(df.coalesce(1) if p.get("single_file") else df, path, () if p.get("single_file") else p.get("sort_by") or ())
            written[s.name] = path
    return written
