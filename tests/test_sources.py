"""Footers, catalogs, text sources and run logs on files written here."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidesift.plans import planner
from tidesift.sources import catalog, results, text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files of several row groups, one sorted by k and one not."""
    top = tmp_path_factory.mktemp("files")
    ks = list(range(1000))
    pq.write_table(pa.table({"k": ks, "s": [f"x{k}" for k in ks]}), top / "sorted.parquet", row_group_size=100)
    pq.write_table(pa.table({"k": [k * 37 % 1000 for k in ks], "s": ["y"] * 1000}), top / "mixed.parquet", row_group_size=250)
    (top / "notes.txt").write_text("no table")
    return top


def test_footers(spark, folder):
    f = catalog.footer_stats(spark, str(folder))
    rows = {r["full_path"].rsplit("/", 1)[1]: r for r in f.collect()}
    assert set(rows) == {"sorted.parquet", "mixed.parquet"}
    assert rows["sorted.parquet"]["num_row_groups"] == 10 and rows["mixed.parquet"]["num_rows"] == 1000
    g = catalog.selected_size(catalog.row_groups(f), ["k"])
    assert g.count() == 14 and g.where("selected_bytes <= 0 or selected_bytes >= size_bytes").count() == 0
    assert g.agg({"num_rows": "sum"}).first()[0] == 2000


def test_ranges_and_tightness(spark, folder):
    groups = catalog.row_groups(catalog.footer_stats(spark, str(folder)))
    ranges = planner.key_ranges(groups, "k")
    assert {(r["lo"], r["hi"]) for r in ranges.where("full_path like '%sorted%'").collect()} == {(100.0 * i, 100.0 * i + 99) for i in range(10)}
    assert planner.sort_tightness(ranges.where("full_path like '%sorted%'")).first()["tight"]
    assert not planner.sort_tightness(ranges.where("full_path like '%mixed%'")).first()["tight"]
    assert planner.key_ranges(groups, "s").count() == 0 and planner.key_ranges(groups, "none").count() == 0


def test_catalog_lookup_and_saving(spark, folder, tmp_path):
    f = catalog.footer_stats(spark, str(folder))
    catalog.save(f, f"{tmp_path}/catalog")
    again = catalog.load(spark, f"{tmp_path}/catalog")
    assert {(r["dataset"], r["total_rows"]) for r in catalog.catalog(again).collect()} == {("sorted", 1000), ("mixed", 1000)}
    assert catalog.catalog(again, exclude="mixed").count() == 1 and catalog.search(again, "sorted").count() == 1
    assert {r["dataset"] for r in catalog.catalog(again, depth=2).collect()} == {folder.name}


def test_folder_summary(spark, folder, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/out")
    found = catalog.folder_summary(spark, f"{tmp_path}/out", delete=True)
    assert found["files"] == 1 and found["bytes"] == found["avg_bytes"] > 0 and not (tmp_path / "out").exists()
    assert catalog.folder_summary(spark, f"{tmp_path}/none") == {"files": 0, "bytes": 0, "avg_bytes": 0.0}


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,b\n\nc|d,e\n")
    lines = text.lines(spark, str(tmp_path / "a.txt"))
    assert lines.count() == 3 and sorted(r["value"] for r in text.tokens(lines).collect()) == ["", "a", "b", "c|d", "e"]
    assert sorted(r["value"] for r in text.tokens(lines, separator="|").collect()) == ["", "a,b", "c", "d,e"]


def test_metrics_and_their_differences(spark):
    def snap(*samples):
        body = ["# HELP x y", "up 1", *(f'requests_total{{api="{a}",bucket="{b}"}} {v}' for a, b, v in samples)]
        return text.metrics(spark.createDataFrame([(x,) for x in body], "line string"))

    before, after = snap(("getobject", "b", 5), ("putobject", "b", "1e2"), ("listbuckets", "c", 3)), snap(("getobject", "b", 9), ("putobject", "b", 100), ("deleteobject", "b", 2), ("listbuckets", "c", 1))
    assert before.count() == 3
    assert {r["kind"]: r["requests"] for r in text.request_diff(before, after).collect()} == {"read": 4.0, "write": 0.0, "delete": 2.0, "metadata": 0.0}
    assert {r["kind"] for r in text.request_diff(before, after, bucket="c").collect()} == {"metadata"}


def test_run_logs(spark, tmp_path):
    (tmp_path / "step.json").write_text(json.dumps({"pipeline_execution_time_s": 1.5, "total_task": 2, "tasks": [{"name": "a", "time": 1.0}, {"name": "b", "time": 0.5}]}, indent=1))
    r = text.run_logs(spark, str(tmp_path / "step.json")).first()
    assert r["total_task"] == 2 and [t["name"] for t in r["tasks"]] == ["a", "b"] and r["file"].endswith("step.json")


def test_runs_against_the_run_before(spark):
    rows = [("s", "r1", "getobject", "b", 5.0), ("s", "r1", "putobject", "b", 7.0), ("s", "r2", "getobject", "b", 9.0), ("s", "r2", "deleteobject", "b", 2.0),
            ("s", "r3", "getobject", "b", 1.0), ("s", "r3", "putobject", "b", 8.0), ("t", "r1", "getobject", "b", 4.0), ("s", "r2", "getobject", "b", 9.0)]
    d = text.run_diffs(spark.createDataFrame(rows, "system string, run string, api string, bucket string, value double"))
    # the counter gone in r2 starts from 0 in r3; the one that shrank was reset; t has one run
    assert sorted(map(tuple, d.select("system", "run", "kind", "requests").collect())) == [
        ("s", "r2", "delete", 2.0), ("s", "r2", "read", 4.0), ("s", "r2", "write", 0.0), ("s", "r3", "delete", 0.0), ("s", "r3", "read", 0.0), ("s", "r3", "write", 8.0)]


def test_result_sinks(spark, tmp_path):
    top = f"file://{tmp_path}"
    for _ in range(2):
        told = results.run_all(spark, {"ok": lambda: spark.range(3), "bad": lambda: spark.sql("select no_such_column")}, top)
    assert {r["query"]: r["status"] for r in told.collect()} == {"ok": "OK", "bad": "failed: AnalysisException"}
    assert spark.read.parquet(f"{top}/results/ok").count() == 3 and spark.read.json(f"{top}/summary").count() == 2
    assert spark.read.option("header", "true").csv(f"{top}/timings").count() == 4
