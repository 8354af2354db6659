"""Strategies agree, empty sides have their SQL meaning, plans are what they should be."""

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidesift.operators import bloom, joins
from tidesift.operators.aggregates import aggregate_bucketed, write_bucketed
from tidesift.operators.scan import empty_like, read_columns, scan


def sides(spark, sf_dir):
    p = scan(spark, f"{sf_dir}/lineitem.parquet", select=["l_orderkey AS k", "l_linenumber", "l_quantity"])
    return p, scan(spark, f"{sf_dir}/orders.parquet", select=["o_orderkey AS k", "o_custkey"], where="o_totalprice > 200000")


@pytest.mark.parametrize("how", list(joins.KINDS))
def test_join_strategies_agree(spark, sf_dir, how):
    p, b = sides(spark, sf_dir)
    want = rows(p.join(b, "k", how))
    assert rows(joins.join_hash(p, b, ["k"], 4, how)) == want
    assert rows(joins.join_range(p, b, "k", 4, how)) == want
    for mb in (0, 100):
        assert rows(joins.join_adaptive(p, b, "k", 4, how, mb)) == want
    q, c = p.withColumnRenamed("k", "pk"), b.withColumnRenamed("k", "bk")
    want = rows(joins.join(q, c, "pk = bk", how))
    assert rows(joins.join_pushdown(q, c, "pk", "bk", how)) == want
    assert rows(joins.join_broadcast(q, c, "pk = bk", how)) == want
    assert rows(joins.join_broadcast(q, c, "pk = bk", how, most=0)) == want


def test_empty_build_side(spark, sf_dir):
    p, b = sides(spark, sf_dir)
    none = empty_like(b)
    n = p.count()
    for how, count in (("inner", 0), ("left", n), ("left_semi", 0), ("left_anti", n)):
        assert joins.join_hash(p, none, ["k"], 4, how).count() == count
        assert joins.join_pushdown(p.withColumnRenamed("k", "a"), none, "a", "k", how).count() == count


def test_unknown_kind_and_forced_hash_are_refused(spark, sf_dir):
    p, b = sides(spark, sf_dir)
    with pytest.raises(ValueError):
        joins.join(p, b, "k", "outer")
    with pytest.raises(ValueError):
        joins.choose_strategy(1, force="hash")


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    df = scan(spark, f"{sf_dir}/lineitem.parquet", select=["l_quantity"], where="l_returnflag = 'R'")
    assert sorted(read_columns(df)[0]) == ["l_quantity", "l_returnflag"]
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(l_returnflag,R)" in plan


def test_bucketed_aggregation_shuffles_once(spark, sf_dir):
    from pyspark.sql import functions as F

    df = aggregate_bucketed(scan(spark, f"{sf_dir}/lineitem.parquet"), ["l_suppkey"], 4, n=F.count("*"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_write_bucketed_makes_a_file_a_bucket(spark, sf_dir, tmp_path):
    write_bucketed(scan(spark, f"{sf_dir}/orders.parquet"), f"{tmp_path}/o", "o_custkey", 5)
    assert len(list(tmp_path.glob("o/*/part-*.parquet"))) == len(list(tmp_path.glob("o/_bucket_id=*"))) <= 5


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=200), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_bloom_bytes(keys, others):
    size = bloom.Sizing.of(200, 0.01)
    a, b = bloom.BloomBytes(size), bloom.BloomBytes(size)
    for k in keys:
        a.add(k)
    for k in others:
        b.add(k)
    both = bloom.BloomBytes.load((a | b).dump())
    assert all(k in both for k in keys | others)
    assert sum(k in a for k in others - keys) <= 5 + 0.1 * len(others)


def test_bitmap_filter(spark):
    size = bloom.Sizing.of(1000, 0.01)
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    held = bloom.contains(spark.range(6000).withColumnRenamed("id", "k").unionByName(spark.sql("select cast(null as bigint) as k")), "k", bloom.build(keys, "k", size), size)
    found = {r["k"]: r["found"] for r in held.collect()}
    assert len(found) == 6001 and not found[None]
    assert all(found[k] for k in range(0, 3000, 3))
    assert sum(v for k, v in found.items() if k is not None and (k % 3 or k >= 3000)) / 5000 < 0.03
    rate = bloom.false_positive_rate(spark.range(6000).withColumnRenamed("id", "k"), "k", keys, "k", size).first()
    assert rate["negatives"] == 5000 and rate["rate"] < 0.03
    assert bloom.merge() is None
    empty = bloom.contains(keys, "k", bloom.build(keys.limit(0), "k", size), size)
    assert not empty.where("found").count()
    with pytest.raises(TypeError):
        bloom.build(keys.selectExpr("cast(k as string) as k"), "k", size)


def test_elements_of_an_overfull_filter_are_counted(spark, sf_dir, monkeypatch):
    from tidesift import workload

    keys, size = spark.range(30_000).withColumnRenamed("id", "k"), bloom.Sizing.of(100, 0.01)
    assert bloom.stats(bloom.build(keys, "k", size), size).first()["estimated_elements"] is None
    assert bloom.held_elements(keys.union(keys), "k", size) == 30_000
    monkeypatch.setattr(workload, "_size", size)
    assert [r["near"] for r in workload.queries()["bloom_calibrate"](spark, sf_dir).collect()] == [True]


def test_false_positives_stay_rare_however_many_keys(spark, sf_dir, monkeypatch):
    from tidesift import workload

    few = workload.rich(spark, sf_dir).select("o_orderkey")
    monkeypatch.setattr(workload, "rich", lambda spark, sf: few.union(spark.range(10**9, 10**9 + 150_000)))
    want = {r["l_orderkey"] for r in scan(spark, f"{sf_dir}/lineitem.parquet", select=["l_orderkey"]).collect()} - {r["o_orderkey"] for r in few.collect()}
    assert [tuple(r) for r in workload.queries()["bloom_fpr"](spark, sf_dir).collect()] == [(len(want), True)]
