"""All queries of the library outside the optional subpackage, with their oracle SQL.

An operator's query applies it through the DataFrame API to whole tables; its oracle says the same in SQL. Task logs and
row-group tables, which the data has none of, are derived from events, orders and lineitem by the same SQL on both sides.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as agg
from .operators import bloom, joins
from .operators.scan import empty_like, read_columns, referenced_columns, scan
from .plans import costs, dags, planner, sqltext, steps, tpch
from .session import register, table
from .sources import catalog, results, text
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _oracles[key] = sql
        return f

    return add


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def scratch(spark: SparkSession) -> str:
    """A new folder for written results: in the cluster's shared folder, a local one only where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/tidesift-{uuid.uuid4().hex}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


def d2(column: str) -> Column:
    return agg.money(column)


REV = tpch.REVENUE


def revenue() -> Column:
    return d2("l_extendedprice") * (1 - d2("l_discount"))


# ---------------------------------------------------------------- scans, sinks, catalog


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipmonth FROM (SELECT *, CAST(EXTRACT(MONTH FROM l_shipdate) AS BIGINT) AS l_shipmonth FROM lineitem) t WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def scan_full(spark, sf):
    return scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber", "l_quantity", "CAST(month(l_shipdate) AS BIGINT) AS l_shipmonth"], where="l_quantity >= 45 AND l_returnflag = 'R'")


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_discount < 0.05 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def scan_pruned(spark, sf):
    rich = scan(spark, path(sf, "supplier"), select=["s_suppkey"], where="s_acctbal > 5000")
    return bloom.semi_filter(scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_suppkey"], where="l_discount < 0.05"), "l_suppkey", rich, "s_suppkey")


@query("SELECT 'l_quantity' AS name UNION ALL SELECT 'l_returnflag'")
def scan_columns(spark, sf):
    df = scan(spark, path(sf, "lineitem"), select=["l_quantity"], where="l_returnflag = 'R'")
    named = referenced_columns(spark, "SELECT l_quantity FROM _t WHERE l_returnflag = 'R'", table(spark, sf, "lineitem").columns)
    read = {c for columns in read_columns(df) for c in columns}
    return spark.createDataFrame([(c,) for c in named if c in read], "name string")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def scan_intermediate(spark, sf):
    a = scan(spark, path(sf, "nation"), select=["n_nationkey AS k", "n_name AS name"])
    b = scan(spark, path(sf, "region"), select=["r_regionkey AS k", "r_name AS name"])
    out = scratch(spark)
    a.write.parquet(f"{out}/a")
    b.write.parquet(f"{out}/b")
    return scan(spark, f"{out}/a", f"{out}/b")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999")
def scan_row_groups(spark, sf):
    return scan(spark, path(sf, "orders"), select=["o_orderkey", "o_totalprice"], where="o_orderkey BETWEEN 1000 AND 1999")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def sink_parquet(spark, sf):
    out = scratch(spark)
    agg.write_sorted(scan(spark, path(sf, "orders"), select=["o_orderkey", "o_custkey", "o_orderstatus"], where="o_totalprice > 100000"), out, ["o_orderkey"])
    return scan(spark, out)


@query("SELECT CAST(12 AS BIGINT) AS buckets, COUNT(*) AS rows, true AS told FROM orders WHERE o_orderstatus = 'P' AND o_custkey = (SELECT MIN(o_custkey) FROM orders WHERE o_orderstatus = 'P')")
def sink_empty_buckets(spark, sf):
    """One customer's orders fill one bucket of twelve; the others are told as empty."""
    out, o = scratch(spark), scan(spark, path(sf, "orders"), select=["o_custkey", "o_orderkey"], where="o_orderstatus = 'P'")
    told = agg.write_bucketed(o.where(F.col("o_custkey") == o.agg(F.min("o_custkey")).scalar()), out, "o_custkey", 12)
    return told.agg(F.count("*").alias("buckets"), F.sum("rows").alias("rows"), (F.count(F.when(F.col("rows") == 0, 1)) == 11).alias("told"))


@query("SELECT o_custkey, COUNT(*) AS orders, CAST(1 AS BIGINT) AS buckets FROM orders GROUP BY o_custkey")
def sink_hash_bucketed(spark, sf):
    out = scratch(spark)
    agg.write_bucketed(scan(spark, path(sf, "orders"), select=["o_custkey", "o_orderkey"]), out, "o_custkey", 4)
    return scan(spark, out).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.countDistinct("_bucket_id").alias("buckets"))


FOUR = ("region", "nation", "customer", "supplier")
_counts = " UNION ALL ".join(f"SELECT '{t}' AS dataset, COUNT(*) AS total_rows FROM {t}" for t in FOUR)


@query(_counts)
def footer_stats(spark, sf):
    f = catalog.row_groups(catalog.footer_stats(spark, *(path(sf, t) for t in FOUR)))
    name = F.regexp_extract("full_path", r"([^/]+)\.parquet$", 1)
    return f.groupBy(name.alias("dataset")).agg(F.sum("num_rows").alias("total_rows"))


@query(f"SELECT dataset, CAST(1 AS BIGINT) AS num_files, total_rows, CAST(total_rows AS DOUBLE) AS avg_rows_per_file FROM ({_counts}) t WHERE dataset <> 'region'")
def catalog_scan(spark, sf):
    return catalog.catalog(catalog.footer_stats(spark, *(path(sf, t) for t in FOUR)), exclude="region").select("dataset", "num_files", "total_rows", "avg_rows_per_file")


@query(f"SELECT dataset, total_rows FROM ({_counts}) t WHERE dataset IN ('customer', 'supplier')")
def catalog_lookup(spark, sf):
    out = scratch(spark)
    catalog.save(catalog.footer_stats(spark, *(path(sf, t) for t in FOUR)), out)
    return catalog.catalog(catalog.search(catalog.load(spark, out), r"/(customer|supplier)\.parquet$")).select("dataset", "total_rows")


@query("SELECT CAST(3 AS BIGINT) AS files, true AS counted, CAST(0 AS BIGINT) AS files_after")
def summary_clean(spark, sf):
    out = scratch(spark)
    for k in range(3):
        scan(spark, path(sf, "region")).coalesce(1).write.parquet(f"{out}/{k}")
    found = catalog.folder_summary(spark, out, delete=True)
    return spark.createDataFrame([(found["files"], found["bytes"] > 0, catalog.folder_summary(spark, out)["files"])], "files long, counted boolean, files_after long")


@query("SELECT value, COUNT(*) AS n FROM (SELECT UNNEST(string_split(r_name || ',' || CAST(r_regionkey AS VARCHAR) || ',x', ',')) AS value FROM region) t GROUP BY value")
def text_to_rows(spark, sf):
    out = scratch(spark)
    scan(spark, path(sf, "region"), select=["concat_ws(',', r_name, r_regionkey, 'x') AS value"]).write.text(out)
    return text.tokens(text.lines(spark, out)).groupBy("value").agg(F.count("*").alias("n"))


_metric = "concat('minio_bucket_requests_total{{api=\"', {api}, '\",bucket=\"b', CAST({b} AS VARCHAR(9)), '\"}} ', CAST({v} AS VARCHAR(9)))"
_api = "CASE n_nationkey % 4 WHEN 0 THEN 'getobject' WHEN 1 THEN 'putobject' WHEN 2 THEN 'headobject' ELSE 'deleteobject' END"


@query(f"SELECT {_api} AS api, 'b' || CAST(n_regionkey AS VARCHAR) AS bucket, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def prom_text(spark, sf):
    rows = scan(spark, path(sf, "nation"), select=[_metric.format(api=_api, b="n_regionkey", v="n_nationkey") + " AS line"])
    return text.metrics(rows, name="minio_bucket_requests_total").select("api", "bucket", "value")


@query("""SELECT CASE n_nationkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'metadata' ELSE 'delete' END AS kind,
CAST(SUM(n_regionkey + 1) AS DOUBLE) AS requests FROM nation GROUP BY 1""")
def request_diff(spark, sf):
    n = scan(spark, path(sf, "nation"))
    snap = lambda v: text.metrics(n.select(F.expr(_metric.format(api=_api, b="n_nationkey", v=v)).alias("line")))
    return text.request_diff(snap("n_nationkey"), snap("n_nationkey + n_regionkey + 1"))


SNAPSHOTS = """SELECT 's' || CAST(user_id % 2 AS VARCHAR(9)) AS system, CAST(user_id % 5 AS BIGINT) AS run,
CASE event_type WHEN 'click' THEN 'getobject' WHEN 'view' THEN 'putobject' WHEN 'purchase' THEN 'headobject' ELSE 'deleteobject' END AS api, 'b' || CAST(event_id % 3 AS VARCHAR(9)) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3, 4"""


@query(f"""WITH s AS ({SNAPSHOTS}), r AS (SELECT system, run, LAG(run) OVER (PARTITION BY system ORDER BY run) AS last FROM (SELECT DISTINCT system, run FROM s) d),
n AS (SELECT r.run AS at, s.* FROM r JOIN s ON r.system = s.system AND r.run = s.run WHERE r.last IS NOT NULL),
w AS (SELECT r.run AS at, s.* FROM r JOIN s ON r.system = s.system AND r.last = s.run)
SELECT system, run, kind, SUM(grown) AS requests FROM (SELECT COALESCE(n.system, w.system) AS system, COALESCE(n.at, w.at) AS run,
CASE COALESCE(n.api, w.api) WHEN 'getobject' THEN 'read' WHEN 'putobject' THEN 'write' WHEN 'headobject' THEN 'metadata' ELSE 'delete' END AS kind, GREATEST(COALESCE(n.value, 0) - COALESCE(w.value, 0), 0) AS grown
FROM n FULL JOIN w ON n.system = w.system AND n.at = w.at AND n.api = w.api AND n.bucket = w.bucket) g GROUP BY 1, 2, 3""")
def request_diff_runs(spark, sf):
    register(spark, sf, ["events"])
    return text.run_diffs(spark.sql(SNAPSHOTS))


# ---------------------------------------------------------------- projections and filters


def simple(name: str, of: str, select: list[str], where: str | None = None, sql_where: str | None = None, sql_select: list[str] | None = None) -> None:
    """A scan of one table whose expressions read alike in both dialects."""
    query(f"SELECT {', '.join(sql_select or select)} FROM {of}" + (f" WHERE {sql_where or where}" if where else ""), name)(
        lambda spark, sf: scan(spark, path(sf, of), select=select, where=where))


simple("project_columns", "customer", ["c_custkey", "c_mktsegment"])
simple("project_expr", "lineitem", ["l_orderkey", "l_linenumber", f"CAST({REV} AS DECIMAL(38,4)) AS revenue", "l_quantity * 2 - 1 AS q"])
simple("project_case", "orders", ["o_orderkey", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent"])
simple("project_coalesce", "part", ["p_partkey", "COALESCE(CASE WHEN p_size > 25 THEN p_size END, 0) AS size"])
simple("filter_cmp", "part", ["p_partkey"], "p_size <> 10 AND p_size >= 5 AND p_size <= 45 AND p_retailprice > 905 AND p_retailprice < 990 AND p_brand = 'Brand#1'")
simple("filter_colcol", "lineitem", ["l_orderkey", "l_linenumber"], "l_tax < l_discount")
simple("filter_in", "part", ["p_partkey"], "p_size IN (1, 4, 9, 14)")
simple("filter_not_in", "part", ["p_partkey"], "p_type NOT IN ('PROMO', 'SMALL')")
simple("filter_like", "part", ["p_partkey"], "p_name LIKE 'red%' OR p_name LIKE '%widget' OR p_name LIKE '%e%g%'")
simple("filter_not_like", "part", ["p_partkey"], "p_name NOT LIKE '%red%'")
simple("filter_null", "events", ["event_id"], "user_id IS NOT NULL AND value IS NOT NULL")
simple("filter_date_range", "orders", ["o_orderkey"], "o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-03-01' + INTERVAL '3' MONTH")
simple("filter_between", "lineitem", ["l_orderkey", "l_linenumber"], "CAST(l_discount AS DECIMAL(12,2)) BETWEEN 0.06 - 0.01 AND 0.06 + 0.01")
simple("filter_or_blocks", "part", ["p_partkey"], "(p_brand = 'Brand#1' AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#2' AND p_size BETWEEN 1 AND 10) OR (p_type = 'PROMO' AND p_size > 40)")
simple("scalar_functions", "orders", ["o_orderkey", "CAST(YEAR(o_orderdate) AS BIGINT) AS y", "SUBSTRING(o_orderpriority, 1, 2) AS p", "CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH > DATE '1997-01-01' AS late",
                               "ROUND(100.00 * o_totalprice / 7.0, 4) AS share", "NULLIF(o_orderstatus, 'F') AS open_status"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE 1 = 0")
def filter_false(spark, sf):
    return empty_like(scan(spark, path(sf, "orders"), select=["o_orderkey", "o_orderstatus"]))


@query("SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS qty FROM lineitem GROUP BY l_orderkey HAVING SUM(CAST(l_quantity AS DECIMAL(12,2))) > 200")
def filter_having(spark, sf):
    return agg.aggregate(scan(spark, path(sf, "lineitem")), ["l_orderkey"], "qty > 200", qty=agg.money_sum(d2("l_quantity")))


WHERE = "l_quantity > 10 AND NOT (l_returnflag = 'R' OR l_discount BETWEEN 0.02 AND 0.04) AND l_linestatus IN ('F', 'O') AND l_shipdate < DATE '1998-01-01' + INTERVAL 6 MONTH"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND NOT (l_returnflag = 'R' OR l_discount BETWEEN 0.02 AND 0.04) AND l_linestatus IN ('F', 'O') AND l_shipdate < DATE '1998-01-01' + INTERVAL 6 MONTH")
def arrow_filter(spark, sf):
    """Each Arrow batch is filtered by the converted expression, where a table isn't Spark's to scan."""
    import pyarrow as pa

    df = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount", "l_linestatus", "l_shipdate"])

    def each(batches):
        from tidesift.functions.predicates import to_arrow

        for b in batches:
            yield from pa.Table.from_batches([b]).filter(to_arrow(WHERE, b.schema)).select(["l_orderkey", "l_linenumber"]).to_batches()

    ship(spark)
    return df.mapInArrow(each, "l_orderkey long, l_linenumber int")


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context: they may lack the folder that the driver imports it from."""
    from pathlib import Path
    from zipfile import ZipFile

    context = spark.sparkContext
    if getattr(context, "_tidesift_core", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidesift-")) / "tidesift_core.zip"
    with ZipFile(target, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    context._tidesift_core = True


#: Row groups over all rows: every 2000 keys a gap of 1500 opens, so that ranges of keys make islands.
_island = "CAST(FLOOR({k} / 2000.0) AS BIGINT)"
_group = _island + " * 100 + CAST(FLOOR(({k} % 2000) / {n}.0) AS BIGINT)"
RANGES = f"""SELECT 'f' || CAST(({_group}) % 7 AS VARCHAR(9)) AS full_path, CAST({_group} AS INT) AS rg_id, CAST(COUNT(*) AS DOUBLE) / {{mb}} AS size_mb,
    COUNT(*) AS rows, CAST(MIN({{k}} + {_island} * 1500) AS DOUBLE) AS lo, CAST(MAX({{k}} + {_island} * 1500) AS DOUBLE) AS hi FROM {{t}} GROUP BY {_group}"""
BUILD = RANGES.format(k="o_orderkey", n=300, t="orders", mb=64)
PROBE = RANGES.format(k="l_orderkey", n=170, t="lineitem", mb=32)


def ranges(spark: SparkSession, sf: str, text: str) -> DataFrame:
    register(spark, sf, ["orders", "lineitem"])
    return spark.sql(text)


def groups_of(df: DataFrame) -> list[planner.Group]:
    """Row groups as plain values, in key order; a table's footers, not its rows."""
    return [planner.Group(r["full_path"], r["rg_id"], r["size_mb"], r["rows"], r["lo"], r["hi"]) for r in df.orderBy("lo", "rg_id").collect()]


@query(f"SELECT rg_id FROM ({BUILD}) t WHERE hi >= 3000 AND lo <= 9000 OR hi >= 12000")
def prune_stats(spark, sf):
    from .functions.predicates import prune

    found = [{"rg_id": g.rg_id, "stats": {"o_orderkey": (g.lo, g.hi)}} for g in groups_of(ranges(spark, sf, BUILD))]
    kept = prune(found, "o_orderkey BETWEEN 3000 AND 9000 OR 12000 <= o_orderkey")
    return spark.createDataFrame([(g["rg_id"],) for g in kept], "rg_id int")


# ---------------------------------------------------------------- joins


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    probe = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber", "l_quantity"], where="l_quantity > 30")
    return probe, scan(spark, path(sf, "orders"), select=["o_orderkey", "o_custkey"], where="o_totalprice > 150000")


_on = "l_orderkey = o_orderkey"
_probe = "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30) p"
_build = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000) b"
_inner = f"SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_custkey FROM {_probe} JOIN {_build} ON {_on}"
for _kind, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("left_semi", "SEMI JOIN"), ("left_anti", "ANTI JOIN")):
    query(f"SELECT * FROM {_probe} {_word} {_build} ON {_on}", f"join_{_kind.removeprefix('left_')}")(
        functools.partial(lambda spark, sf, how: joins.join(*sides(spark, sf), _on, how), how=_kind))
query(_inner, "join_broadcast")(lambda spark, sf: joins.join_broadcast(*sides(spark, sf), _on))
query(_inner, "join_pushdown")(lambda spark, sf: joins.join_pushdown(*sides(spark, sf), "l_orderkey", "o_orderkey"))


def keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, b = sides(spark, sf)
    return p.withColumnRenamed("l_orderkey", "k"), b.withColumnRenamed("o_orderkey", "k")


_keyed = f"SELECT l_orderkey AS k, l_linenumber, l_quantity, o_custkey FROM {_probe} JOIN {_build} ON {_on}"
query(_keyed, "join_hash")(lambda spark, sf: joins.join_hash(*keyed(spark, sf), ["k"], 8))
query(_keyed, "join_range_pruned")(lambda spark, sf: joins.join_range(*keyed(spark, sf), "k", 8))
query(_keyed, "join_adaptive")(lambda spark, sf: joins.join_adaptive(*keyed(spark, sf), "k", 8))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier) * 1.2")
def join_theta(spark, sf):
    s = scan(spark, path(sf, "supplier"), select=["s_suppkey", "s_acctbal"])
    return s.where(F.col("s_acctbal") > s.agg(F.avg("s_acctbal")).scalar() * 1.2)


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT l_partkey AS k, 0.5 * AVG(l_quantity) AS q FROM lineitem GROUP BY l_partkey) a ON l.l_partkey = a.k AND l.l_quantity < a.q")
def join_equi_theta(spark, sf):
    l = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    a = l.groupBy(F.col("l_partkey").alias("k")).agg((0.5 * F.avg("l_quantity")).alias("q"))
    return joins.join(l, a, "l_partkey = k AND l_quantity < q").select("l_orderkey", "l_linenumber")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey AS p, l_suppkey AS s, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) b ON a.l_partkey = b.p AND a.l_suppkey = b.s WHERE b.n > 1")
def join_multi_key(spark, sf):
    l = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    b = l.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    return joins.join(l, b, "l_partkey = p AND l_suppkey = s").select("l_orderkey", "l_linenumber", "n")


@query("""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, COUNT(*) AS n FROM supplier JOIN customer ON s_suppkey % 50 = c_custkey % 50
JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY 1, 2""")
def join_self_dim_twice(spark, sf):
    s, c, n = (scan(spark, path(sf, t)) for t in ("supplier", "customer", "nation"))
    pairs = s.withColumn("m", F.col("s_suppkey") % 50).groupBy("m", "s_nationkey").agg(F.count("*").alias("a")).join(c.withColumn("m", F.col("c_custkey") % 50).groupBy("m", "c_nationkey").agg(F.count("*").alias("b")), "m")
    a, b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation"), F.col("n_regionkey").alias("q"))
    met = pairs.join(a, "s_nationkey").join(b, "c_nationkey").where("r = q")
    return met.groupBy("supp_nation", "cust_nation").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


def sql_query(name: str, tables: str, text_: str) -> None:
    """SQL that is the feature: the same text on both engines."""

    def run(spark, sf):
        register(spark, sf, tables.split())
        return spark.sql(text_)

    query(text_, name)(run)


sql_query("join_subquery_exists", "orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
sql_query("join_subquery_not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')")
sql_query("join_subquery_in", "orders lineitem", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1)")
sql_query("join_subquery_not_in", "supplier lineitem", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax = 0.08)")
sql_query("join_subquery_scalar", "part lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > (SELECT AVG(p_size) FROM part) + 20")
sql_query("join_left_count", "customer orders", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' AND o_orderdate >= DATE '2000-06-01' GROUP BY c_custkey")

# ---------------------------------------------------------------- planning over row groups

query(BUILD, "rg_ranges")(lambda spark, sf: ranges(spark, sf, BUILD))


@query(f"SELECT b.rg_id AS build_rg, p.rg_id AS probe_rg FROM ({BUILD}) b JOIN ({PROBE}) p ON b.lo <= p.hi AND p.lo <= b.hi")
def rg_overlap_pairs(spark, sf):
    return planner.overlap_pairs(ranges(spark, sf, BUILD), ranges(spark, sf, PROBE)).select("build_rg", "probe_rg")


@query(f"""WITH t AS (SELECT 'build' AS side, * FROM ({BUILD}) b UNION ALL SELECT 'probe', * FROM ({PROBE}) p),
m AS (SELECT *, MAX(hi) OVER (ORDER BY lo, hi, side, full_path, rg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM t),
i AS (SELECT *, CAST(SUM(CASE WHEN above IS NULL OR lo > above THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi, side, full_path, rg_id) AS BIGINT) AS island FROM m)
SELECT side, rg_id, island FROM i WHERE island IN (SELECT island FROM i GROUP BY island HAVING COUNT(DISTINCT side) = 2)""")
def rg_conflict_groups(spark, sf):
    return planner.conflict_groups(ranges(spark, sf, BUILD), ranges(spark, sf, PROBE)).select("side", "rg_id", "island")


def task_rows(spark: SparkSession, tasks: list[planner.JoinTask], fits: Callable[[planner.JoinTask], bool]) -> DataFrame:
    """The pairs of build and probe groups that meet in any task, and whether all tasks keep to their limits."""
    rows = {(b.rg_id, p.rg_id) for t in tasks for b in t.builds for p in t.probes if b.meets(p)}
    kept = all(map(fits, tasks))
    return spark.createDataFrame([(*x, kept) for x in sorted(rows)], "build_rg int, probe_rg int, fits boolean")


_met = f"({BUILD}) b JOIN ({PROBE}) p ON b.lo <= p.hi AND p.lo <= b.hi"
_fit_pairs = f"SELECT b.rg_id AS build_rg, p.rg_id AS probe_rg, true AS fits FROM {_met}"


@query(f"""WITH m AS (SELECT b.rg_id AS build_rg, b.full_path AS build_path, b.size_mb AS build_mb, p.rg_id AS probe_rg, p.full_path AS probe_path, p.size_mb AS probe_mb, p.lo AS probe_lo FROM {_met}),
u AS (SELECT probe_rg, probe_path, probe_mb, probe_lo, SUM(build_mb) + probe_mb AS mb FROM m GROUP BY 1, 2, 3, 4),
w AS (SELECT CASE WHEN AVG(CASE WHEN mb > 20 THEN 1.0 ELSE 0.0 END) > 0.3 THEN GREATEST(20.0, FLOOR(1.3 * QUANTILE_CONT(mb, 0.9))) ELSE 20.0 END AS budget FROM u),
h AS (SELECT u.*, budget, COALESCE(SUM(CASE WHEN 2 * mb <= budget THEN mb ELSE 0 END) OVER (ORDER BY probe_lo, probe_path, probe_rg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u, w),
t AS (SELECT m.*, h.mb, h.budget, CASE WHEN 2 * h.mb <= h.budget THEN 's' || CAST(CAST(FLOOR(2 * start / h.budget) AS BIGINT) AS VARCHAR) ELSE 'u/' || m.probe_path || '/' || CAST(m.probe_rg AS VARCHAR) END AS unit,
  FLOOR(COALESCE(SUM(build_mb) OVER (PARTITION BY m.probe_path, m.probe_rg ORDER BY build_mb, build_path, build_rg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / GREATEST(h.budget - m.probe_mb, 0.3 * h.budget)) AS part
  FROM m JOIN h ON m.probe_rg = h.probe_rg AND m.probe_path = h.probe_path)
SELECT build_rg, probe_rg, CASE WHEN mb > budget THEN unit || '/' || CAST(CAST(part AS BIGINT) AS VARCHAR) ELSE unit END AS task FROM t""")
def rg_batch_pairs(spark, sf):
    b, p = ranges(spark, sf, BUILD), ranges(spark, sf, PROBE)
    b, p = (x.select(F.col("full_path").alias(f"{n}_path"), F.col("rg_id").alias(f"{n}_rg"), F.col("size_mb").alias(f"{n}_mb"), F.col("lo").alias(f"{n}_lo")) for n, x in (("build", b), ("probe", p)))
    pairs = planner.overlap_pairs(ranges(spark, sf, BUILD), ranges(spark, sf, PROBE)).join(b, ["build_path", "build_rg"]).join(p, ["probe_path", "probe_rg"])
    return planner.batch_pairs(pairs, 20).select("build_rg", "probe_rg", "task")


@query(_fit_pairs)
def rg_split_group(spark, sf):
    tasks = planner.split_island(groups_of(ranges(spark, sf, BUILD)), groups_of(ranges(spark, sf, PROBE)), 30, 4)
    room = lambda t: max(30 - sum(b.size_mb for b in t.builds), 9.0)
    return task_rows(spark, tasks, lambda t: len(t.builds) <= 4 and (len(t.probes) == 1 or sum(p.size_mb for p in t.probes) <= room(t) + 1e-9))


@query(_fit_pairs)
def rg_build_anchored(spark, sf):
    tasks = planner.build_anchored(groups_of(ranges(spark, sf, BUILD)), groups_of(ranges(spark, sf, PROBE)), 50, 3, 20)
    return task_rows(spark, tasks, lambda t: len({b.path for b in t.builds}) == 1 and len(t.probes) <= 20 and len({p.path for p in t.probes}) <= 3)


@query(f"SELECT COUNT(*) AS groups, ROUND(AVG(hi - lo), 6) AS avg_span, MAX(hi) - MIN(lo) AS global_span, AVG(hi - lo) <= 0.2 * (MAX(hi) - MIN(lo)) AS tight FROM ({BUILD}) t")
def sort_tightness(spark, sf):
    return planner.sort_tightness(ranges(spark, sf, BUILD)).withColumn("avg_span", F.round("avg_span", 6))


@query(f"""WITH s AS (SELECT COUNT(*) AS n, AVG(size_mb) AS mean, QUANTILE_CONT(size_mb, 0.95) AS p95 FROM ({BUILD}) t)
SELECT CAST(GREATEST(5, LEAST(FLOOR(100 / 2 / GREATEST(mean, 0.7 * p95, 0.1)), GREATEST(5, n // 5))) AS BIGINT) AS threshold FROM s""")
def skew_threshold(spark, sf):
    return spark.createDataFrame([(planner.skew_threshold(ranges(spark, sf, BUILD), 100),)], "threshold long")


_mbs = " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(COUNT(*) AS DOUBLE) / 4096 AS mb FROM {t}" for t in ("part", "orders", "lineitem"))


@query(f"SELECT name, CASE WHEN mb <= 2.0 THEN 'broadcast' ELSE 'range' END AS strategy FROM ({_mbs}) t")
def choose_join(spark, sf):
    register(spark, sf, ["part", "orders", "lineitem"])
    return spark.createDataFrame([(r["name"], joins.choose_strategy(r["mb"], 2.0)) for r in spark.sql(_mbs).collect()], "name string, strategy string")


@query(f"""WITH g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY lo) AS r FROM ({BUILD}) t)
SELECT COUNT(*) AS groups, CAST(SUM(n) AS BIGINT) AS overlapping, COUNT(*) < 2 OR SUM(n) / (COUNT(*) * (COUNT(*) - 1) / 2) < 0.3 AS tight FROM (SELECT a.r, (SELECT COUNT(*) FROM g b WHERE b.r < a.r AND b.hi >= a.lo) AS n FROM g a) t""")
def sort_tightness_text(spark, sf):
    return planner.text_tightness(ranges(spark, sf, BUILD))


@query(f"SELECT rg_id, rows FROM ({BUILD}) t")
def split_by_size(spark, sf):
    tasks = planner.split_by_size(groups_of(ranges(spark, sf, BUILD)), 20)
    return spark.createDataFrame([(g.rg_id, g.rows) for t in tasks for g in t], "rg_id int, rows long")


@query(f"SELECT rg_id, rows FROM ({BUILD}) t")
def split_by_rows(spark, sf):
    tasks = planner.split_by_rows(groups_of(ranges(spark, sf, BUILD)), 1000)
    return spark.createDataFrame([(g.rg_id, g.rows) for t in tasks for g in t], "rg_id int, rows long")


# ---------------------------------------------------------------- aggregates, sorts, set operations


def grouped(spark, sf, how: str) -> DataFrame:
    l = scan(spark, path(sf, "lineitem"), select=["l_suppkey", "l_quantity"])
    sums = {"qty": agg.money_sum(d2("l_quantity")), "n": F.count("*")}
    if how == "bucketed":
        return agg.aggregate_bucketed(l, ["l_suppkey"], 8, **sums)
    if how == "partitioned":
        out = scratch(spark)
        agg.write_bucketed(agg.aggregate(l, ["l_suppkey"], **sums), out, "l_suppkey", 4)
        return scan(spark, out).drop("_bucket_id")
    if how == "partial":
        part = agg.aggregate(l.withColumn("part", F.col("l_quantity") % 5), ["l_suppkey", "part"], qty=F.sum(d2("l_quantity")), n=F.count("*"))
        return agg.aggregate(part, ["l_suppkey"], qty=F.sum("qty").cast("decimal(38,4)"), n=F.sum("n"))
    return agg.aggregate(l, ["l_suppkey"], **sums)


_grouped = "SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS qty, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey"
for _name, _how in (("agg_hash", "plain"), ("agg_bucketed", "bucketed"), ("agg_then_partition", "partitioned"), ("agg_partial_final", "partial")):
    query(_grouped, _name)(functools.partial(grouped, how=_how))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def agg_combine(spark, sf):
    parts = [scan(spark, path(sf, "orders"), select=["o_orderkey AS k"], where=f"o_orderstatus = '{s}'") for s in "FP"]
    return agg.combine(*parts)


query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier", "set_union_all")(
    lambda spark, sf: agg.combine(scan(spark, path(sf, "customer"), select=["c_custkey AS k"]), scan(spark, path(sf, "supplier"), select=["s_suppkey AS k"])))


def one(name: str, of: str, keys: list, sql: str, having: str | None = None, **sums: Callable[[], Column]) -> None:
    """One aggregation of one table; columns are made when it runs, as they need a session."""
    query(sql, name)(lambda spark, sf: agg.aggregate(scan(spark, path(sf, of)), [k() if callable(k) else k for k in keys], having, **{n: c() for n, c in sums.items()}))


one("agg_sum", "orders", ["o_orderstatus"], "SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS s FROM orders GROUP BY 1", s=lambda: agg.money_sum(d2("o_totalprice")))
one("agg_count", "orders", ["o_orderstatus"], "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1", n=lambda: F.count("*"))
one("agg_avg", "orders", ["o_orderstatus"], "SELECT o_orderstatus, ROUND(AVG(o_totalprice), 4) AS m FROM orders GROUP BY 1", m=lambda: F.round(F.avg("o_totalprice"), 4))
one("agg_min", "orders", ["o_custkey"], "SELECT o_custkey, MIN(o_orderdate) AS m FROM orders GROUP BY 1", m=lambda: F.min("o_orderdate"))
one("agg_max", "orders", ["o_custkey"], "SELECT o_custkey, MAX(o_totalprice) AS m FROM orders GROUP BY 1", m=lambda: F.max("o_totalprice"))
one("agg_count_distinct", "lineitem", ["l_returnflag"], "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1", n=lambda: F.countDistinct("l_suppkey"))
one("agg_conditional", "orders", ["o_orderstatus"], "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders GROUP BY 1",
    urgent=lambda: F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)))
one("agg_global", "lineitem", [], f"SELECT CAST(SUM({REV}) AS DECIMAL(38,4)) AS revenue, COUNT(*) AS n FROM lineitem", revenue=lambda: agg.money_sum(revenue()), n=lambda: F.count("*"))
one("agg_expr_key", "orders", [lambda: F.year("o_orderdate").cast("long").alias("y")], "SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY 1", n=lambda: F.count("*"))
one("agg_having", "orders", ["o_custkey"], "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 12", "n > 12", n=lambda: F.count("*"))
query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "agg_distinct_rows")(lambda spark, sf: scan(spark, path(sf, "customer"), select=["c_nationkey", "c_mktsegment"]).distinct())
query("SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) t GROUP BY n", "agg_two_level")(
    lambda spark, sf: agg.aggregate(agg.aggregate(scan(spark, path(sf, "orders")), ["o_custkey"], n=F.count("*")), ["n"], customers=F.count("*")))
query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey", "sort_asc_desc")(
    lambda spark, sf: scan(spark, path(sf, "customer"), select=["c_custkey", "c_nationkey", "c_acctbal"]).orderBy(F.desc("c_nationkey"), "c_acctbal", "c_custkey"))
query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "topk_limit")(
    lambda spark, sf: scan(spark, path(sf, "orders"), select=["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < DATE '1996-01-01'")
def sort_clustered_write(spark, sf):
    out = scratch(spark)
    agg.write_sorted(scan(spark, path(sf, "orders"), select=["o_orderkey", "o_orderdate"]), out, ["o_orderdate"], parts=4)
    return scan(spark, out, where="o_orderdate < DATE '1996-01-01'")


# ---------------------------------------------------------------- Bloom filters

_rich = "o_totalprice > 250000"
_size = bloom.Sizing.of(20_000, 0.001)


def rich(spark, sf) -> DataFrame:
    return scan(spark, path(sf, "orders"), select=["o_orderkey", "o_custkey"], where=_rich)


@query(f"SELECT o_orderkey AS k, true AS found FROM orders WHERE {_rich}")
def bloom_build(spark, sf):
    """No false negatives: each key that was added is found."""
    keys = rich(spark, sf).select(F.col("o_orderkey").alias("k"))
    return bloom.contains(keys, "k", bloom.build(keys, "k", _size), _size)


@query("SELECT l_orderkey AS k, true AS found FROM lineitem GROUP BY l_orderkey HAVING SUM(CAST(l_quantity AS DECIMAL(12,2))) > 200")
def agg_bloom_build(spark, sf):
    """The groups of an aggregate and the filter of their keys."""
    large = agg.aggregate(scan(spark, path(sf, "lineitem"), select=["l_orderkey AS k", "l_quantity"]), ["k"], "qty > 200", qty=agg.money_sum(d2("l_quantity"))).select("k")
    return bloom.contains(large, "k", bloom.build(large, "k", _size), _size)


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_rich})")
def bloom_contains(spark, sf):
    """A filtered scan, then the exact join that the filter spares work."""
    l = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_linenumber"])
    passed = bloom.contains(l, "l_orderkey", bloom.build(rich(spark, sf), "o_orderkey", _size), _size).where("found").drop("found")
    return bloom.semi_filter(passed, "l_orderkey", rich(spark, sf), "o_orderkey")


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS same FROM (SELECT 1) t")
def bloom_merge(spark, sf):
    """The filter of two parts' union is the union of their filters."""
    r = rich(spark, sf)
    a, b = (bloom.build(r.where(f"o_orderkey % 2 = {k}"), "o_orderkey", _size) for k in (0, 1))
    whole, merged = bloom.build(r, "o_orderkey", _size), bloom.merge(a, b)
    differ = whole.join(merged.withColumnRenamed("bits", "m"), "bucket", "full_outer").where("not (bits <=> m)")
    return differ.agg((F.count("*") + 1).alias("same"))


@query(f"SELECT CAST({_size.bits} AS BIGINT) AS bits, {_size.hashes} AS hashes, true AS near FROM (SELECT 1) t")
def bloom_stats(spark, sf):
    r = rich(spark, sf)
    s = bloom.stats(bloom.build(r, "o_orderkey", _size), _size)
    return s.select("bits", "hashes", (F.abs(F.col("estimated_elements") - r.select("o_orderkey").distinct().agg(F.count("*")).scalar()) <= 0.03 * F.col("estimated_elements") + 5).alias("near"))


@query(f"SELECT true AS near FROM (SELECT 1) t")
def bloom_calibrate(spark, sf):
    r = rich(spark, sf)
    found = bloom.held_elements(r, "o_orderkey", _size)
    return spark.createDataFrame([(abs(bloom.calibrated_elements(found) * 0.9 - r.count()) <= 0.03 * r.count() + 5,)], "near boolean")


@query(f"SELECT COUNT(*) AS negatives, true AS low FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_rich})) t")
def bloom_fpr(spark, sf):
    l, r = scan(spark, path(sf, "lineitem"), select=["l_orderkey"]), rich(spark, sf)
    return bloom.false_positive_rate(l, "l_orderkey", r, "o_orderkey", bloom.sized_for(r, "o_orderkey", 0.01)).select("negatives", (F.col("rate") < 0.05).alias("low"))


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS found FROM nation")
def bloom_python_udf(spark, sf):
    ship(spark)
    made = bloom.BloomBytes(bloom.Sizing.of(1000, 1e-6))
    for k in range(0, 25, 3):
        made.add(k)
    return scan(spark, path(sf, "nation"), select=["n_nationkey", "n_nationkey AS k"]).withColumn("found", bloom.contains_udf(bloom.BloomBytes.load(made.dump()))("k")).drop("k")


@query(f"SELECT o_orderkey AS k, true AS found FROM orders WHERE {_rich}")
def bloom_load(spark, sf):
    """A filter saved over another one and loaded."""
    ship(spark)
    out, keys = scratch(spark), rich(spark, sf).select(F.col("o_orderkey").alias("k"))
    for part in (keys.limit(1), keys):
        bloom.save_bytes(part, "k", _size, out)
    return keys.withColumn("found", bloom.contains_udf(bloom.load_bytes(spark, out))("k"))


@query("SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS distinct_count, true AS integral FROM orders")
def key_statistics(spark, sf):
    o = scan(spark, path(sf, "orders"), select=["o_custkey"])
    return agg.aggregate(o, row_count=F.count("*"), distinct_count=F.countDistinct("o_custkey"), integral=F.lit(bloom.integral(o, "o_custkey")))


query("SELECT COUNT(*) AS row_count FROM orders", "row_count")(lambda spark, sf: agg.aggregate(scan(spark, path(sf, "orders")), row_count=F.count("*")))
query("SELECT COUNT(DISTINCT o_custkey) AS distinct_count FROM orders", "distinct_count")(lambda spark, sf: agg.aggregate(scan(spark, path(sf, "orders")), distinct_count=F.countDistinct("o_custkey")))


@query("SELECT * FROM (VALUES ('c_custkey', true), ('c_name', false), ('c_nationkey', true), ('c_acctbal', false), ('c_mktsegment', false)) t(name, integral)")
def col_is_integral(spark, sf):
    c = scan(spark, path(sf, "customer"))
    return spark.createDataFrame([(n, bloom.integral(c, n)) for n in c.columns], "name string, integral boolean")


@query("SELECT * FROM (VALUES ('customer', 'c_custkey', 'orders', 'o_custkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey')) t(t1, c1, t2, c2)")
def join_edges(spark, sf):
    columns = {t: table(spark, sf, t).columns for t in ("customer", "orders", "lineitem")}
    return spark.createDataFrame(sqltext.join_edges(tpch.render("q3"), columns), "t1 string, c1 string, t2 string, c2 string")


# ---------------------------------------------------------------- run logs

LOG = """SELECT CAST(user_id % 3 AS BIGINT) AS run, event_type AS stage, event_id AS task, CAST(event_id % 997 AS DOUBLE) AS start_s,
    CAST(event_id % 997 + 0.25 + (event_id % 7) * 0.25 + (event_id % 5) * 0.5 + (event_id % 3) * 0.25 AS DOUBLE) AS end_s,
    CAST(0.25 + (event_id % 7) * 0.25 + (event_id % 5) * 0.5 + (event_id % 3) * 0.25 AS DOUBLE) AS t_total,
    CAST((event_id % 7) * 0.25 AS DOUBLE) AS t_read, CAST((event_id % 5) * 0.5 AS DOUBLE) AS t_comp, CAST((event_id % 3) * 0.25 AS DOUBLE) AS t_write,
    CAST((event_id % 4) * 0.125 AS DOUBLE) AS disp, event_id % 10 = 0 AS cold, (event_id % 50 + 1) * 65536 AS bytes_in, event_id % 4 + 1 AS req_in,
    (event_id % 20) * 4096 AS bytes_out, event_id % 2 AS req_out, event_id % 1000 AS rows_in, event_id % 100 AS rows_out,
    CAST(25 * (1 + user_id % 4) AS DOUBLE) AS size_mb FROM events"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf, ["events"])
    return spark.sql(LOG)


_measure = f"""SELECT run, stage, COUNT(*) AS p, MAX(t_total + disp) AS d_fn, SUM(t_total) AS billed, COUNT(CASE WHEN cold THEN 1 END) AS cold, MIN(start_s) AS start_s, MAX(end_s) AS end_s,
ROUND(AVG(disp), 6) AS disp, ROUND(AVG(t_read), 6) AS t_read, ROUND(AVG(t_comp), 6) AS t_comp, ROUND(AVG(t_write), 6) AS t_write,
{', '.join(f'CAST(SUM({c}) AS BIGINT) AS {c}' for c in ('bytes_in', 'req_in', 'bytes_out', 'req_out', 'rows_in', 'rows_out'))} FROM ({LOG}) l GROUP BY run, stage"""


@query(_measure)
def cost_measure(spark, sf):
    return costs.measure(log(spark, sf)).withColumns({c: F.round(c, 6) for c in ("disp", "t_read", "t_comp", "t_write")})


@query(f"SELECT a.run, a.task, COUNT(*) AS k FROM ({LOG}) a JOIN ({LOG}) b ON a.run = b.run AND b.start_s < a.end_s AND b.end_s > a.start_s GROUP BY a.run, a.task")
def task_overlap(spark, sf):
    return costs.task_overlap(log(spark, sf)).select("run", "task", "k")


@query(f"SELECT run, stage, CAST(10 * SUM(rows_in) AS DOUBLE) AS work FROM ({LOG}) l GROUP BY run, stage")
def bf_work(spark, sf):
    m = costs.measure(log(spark, sf))
    return m.select("run", "stage", costs.bloom_work(F.lit("apply"), F.col("rows_in"), F.col("rows_out"), F.lit(0.001)).cast("double").alias("work"))


@query(f"SELECT run, stage, ROUND(req_in * 0.4e-6 + p * 0.2e-6 + billed * 2 * 1.66667e-5 + req_out * 5e-6, 9) AS cost FROM ({_measure}) m")
def cost_price(spark, sf):
    return costs.price(costs.measure(log(spark, sf))).select("run", "stage", F.round("cost", 9).alias("cost"))


@query(f"SELECT stage, COUNT(*) AS points, ROUND(GREATEST(REGR_SLOPE(t_total, CAST(bytes_in AS DOUBLE)), 0) * 1e6, 4) AS slope FROM ({LOG}) l GROUP BY stage")
def calibrate(spark, sf):
    return costs.calibrate(log(spark, sf)).select("stage", "points", F.round(F.col("slope") * 1e6, 4).alias("slope"))


_sums = "SUM(u * u) AS uu, SUM(u * v) AS uv, SUM(v * v) AS vv, SUM(u * y) AS uy, SUM(v * y) AS vy"
_pair = """SELECT stage, CASE WHEN a >= 0 AND b >= 0 THEN a WHEN uy > 0 AND uy * uy / uu >= GREATEST(vy, 0) * vy / vv THEN uy / uu ELSE 0 END AS a,
CASE WHEN a >= 0 AND b >= 0 THEN b WHEN uy > 0 AND uy * uy / uu >= GREATEST(vy, 0) * vy / vv THEN 0 ELSE GREATEST(vy / vv, 0) END AS b
FROM (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b
FROM (SELECT stage, {sums} FROM (SELECT stage, CAST({u} AS DOUBLE) AS u, CAST({v} AS DOUBLE) / 1048576 AS v, {y} AS y FROM ({log}) l) p GROUP BY stage) s) f"""


@query(f"""SELECT r.stage, ROUND(r.a, 6) AS read_request_s, ROUND(r.b, 6) AS read_mb_s, ROUND(w.a, 6) AS write_request_s, ROUND(w.b, 6) AS write_mb_s, ROUND(row_s, 9) AS row_s, disp
FROM ({_pair.format(sums=_sums, u="req_in", v="bytes_in", y="t_read", log=LOG)}) r JOIN ({_pair.format(sums=_sums, u="req_out", v="bytes_out", y="t_write", log=LOG)}) w ON r.stage = w.stage
JOIN (SELECT stage, SUM(t_comp * rows_in) / SUM(CAST(rows_in AS DOUBLE) * rows_in) AS row_s, QUANTILE_DISC(disp, 0.5) AS disp FROM ({LOG}) l GROUP BY stage) c ON r.stage = c.stage""")
def calibrate_rates(spark, sf):
    r = costs.rates(log(spark, sf)).drop("points", "mbps_p95")
    return r.withColumns({c: F.round(c, 9 if c == "row_s" else 6) for c in r.columns if c not in ("stage", "disp")})


_billed = f"SELECT run, stage, COUNT(*) AS p, SUM(t_total) AS billed, MAX(t_total) AS longest, GREATEST(MAX(t_total), SUM(t_total) / LEAST(COUNT(*), 8)) AS time FROM ({LOG}) l GROUP BY run, stage"
_exact = "CAST(0.0 AS DOUBLE)"


def exact_constants(spark, sf) -> DataFrame:
    """Constants by which a task's bytes are its seconds: the oracle can then say what the model predicts."""
    return log(spark, sf).select("stage").distinct().withColumn("slope", F.lit(1 / 65536)).withColumn("intercept", F.lit(0.5)).withColumn("disp", F.lit(0.25))


_modelled = f"SELECT run, stage, COUNT(*) AS p, MAX(bytes_in / 65536 + 0.75) AS longest, SUM(bytes_in / 65536 + 0.75) AS billed FROM ({LOG}) l GROUP BY run, stage"


@query(f"SELECT run, stage, p, longest, billed, CAST(CEIL(p / 8.0) AS BIGINT) AS waves, GREATEST(longest, billed / LEAST(p, 8)) AS time FROM ({_modelled}) m")
def predict(spark, sf):
    return costs.predict(log(spark, sf), exact_constants(spark, sf), 8)


@query(f"""SELECT run, stage, ROUND(GREATEST(longest * 1.25, billed / LEAST(p, 8), mb / LEAST(LEAST(p, 8) * 40.0, 250.0 / (1 + 0.02 * LEAST(p, 8)))), 6) AS time FROM (
SELECT run, stage, p, mb, MAX(bytes_in / 65536 * SQRT(LEAST(p, 8)) + 0.75) AS longest, SUM(bytes_in / 65536 * SQRT(LEAST(p, 8)) + 0.75) AS billed
FROM (SELECT *, COUNT(*) OVER (PARTITION BY run, stage) AS p, CAST(SUM(bytes_in) OVER (PARTITION BY run, stage) AS DOUBLE) / 1048576 AS mb FROM ({LOG}) l) t GROUP BY run, stage, p, mb) m""")
def predict_store(spark, sf):
    """With tasks that slow each other down, a lagging last task, and a store that all readers share."""
    constants = exact_constants(spark, sf).withColumn("tail", F.lit(0.25))
    return costs.predict(log(spark, sf), constants, 8, 0.5, (40.0, 250.0, 0.02)).select("run", "stage", F.round("time", 6).alias("time"))


@query()
def predict_waves(spark, sf):
    return costs.waves(log(spark, sf), exact_constants(spark, sf), 8)


@query(f"""SELECT m.run, ROUND(AVG(ABS(100 * (GREATEST(m.longest, m.billed / LEAST(m.p, 8)) - d.d_fn) / d.d_fn)), 6) AS mape
FROM ({_modelled}) m JOIN ({_measure}) d ON m.run = d.run AND m.stage = d.stage GROUP BY m.run""")
def accuracy(spark, sf):
    l = log(spark, sf)
    return costs.accuracy(costs.predict(l, exact_constants(spark, sf), 8), costs.measure(l)).withColumn("mape", F.round("mape", 6))


@query(f"""SELECT m.run, m.stage, ROUND(100 * (GREATEST(m.longest, m.billed / LEAST(m.p, 8)) - d.d_fn) / d.d_fn, 6) AS error
FROM ({_modelled}) m JOIN ({_measure}) d ON m.run = d.run AND m.stage = d.stage""")
def cost_eval(spark, sf):
    l = log(spark, sf)
    j = costs.predict(l, exact_constants(spark, sf), 8).select("run", "stage", "time").join(costs.measure(l), ["run", "stage"])
    return j.select("run", "stage", F.round(costs.error_percent(F.col("time"), F.col("d_fn")), 6).alias("error"))


_summary = f"""SELECT run, COUNT(*) AS tasks, SUM(t_total) AS task_s, MAX(end_s) - MIN(start_s) AS wall_s, SUM(bytes_in) / 1048576 AS mb_in, SUM(bytes_out) / 1048576 AS mb_out,
MIN(t_total) AS least_s, MAX(t_total) AS most_s FROM ({LOG}) l GROUP BY run"""
query(_summary, "run_summary")(lambda spark, sf: costs.summary(log(spark, sf)))
query(f"{_summary} ORDER BY task_s, run LIMIT 2", "run_cheapest")(lambda spark, sf: costs.cheapest(costs.summary(log(spark, sf)), 2))
query(f"SELECT run, stage, COUNT(*) AS calls, SUM(bytes_in) / 1048576 AS mb_in, MIN(t_total) AS least_s, ROUND(AVG(t_total), 6) AS mean_s, MAX(t_total) AS most_s FROM ({LOG}) l GROUP BY run, stage", "run_export")(
    lambda spark, sf: costs.export(log(spark, sf)).withColumn("mean_s", F.round("mean_s", 6)))

PLANS = f"SELECT stage AS query, CAST(size_mb AS VARCHAR(9)) || '/' || CAST(run AS VARCHAR(9)) AS plan, SUM(t_total) AS time, CAST(SUM(bytes_in) AS DOUBLE) / 65536 AS cost FROM ({LOG}) l GROUP BY 1, 2"


def plans(spark, sf) -> DataFrame:
    register(spark, sf, ["events"])
    return spark.sql(PLANS.replace("GROUP BY 1, 2", "GROUP BY stage, size_mb, run"))


_beaten = "SELECT 1 FROM ({p}) b WHERE b.query = a.query AND (b.time < a.time AND b.cost <= a.cost OR b.time = a.time AND b.cost < a.cost OR b.time = a.time AND b.cost = a.cost AND b.plan < a.plan)".replace("{p}", PLANS)
query(f"SELECT DISTINCT query, time, cost FROM ({PLANS}) a WHERE NOT EXISTS ({_beaten})", "plan_pareto")(lambda spark, sf: costs.pareto(plans(spark, sf), by=["query"]).select("query", "time", "cost"))
query(f"""WITH f AS (SELECT DISTINCT query, time, cost FROM ({PLANS}) a WHERE NOT EXISTS ({_beaten})), d AS (SELECT query, time, cost, SQRT(POW(time / MIN(time) OVER (PARTITION BY query) - 1, 2) + POW(cost / MIN(cost) OVER (PARTITION BY query) - 1, 2)) AS x FROM f)
SELECT query, time, cost FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY ROUND(x, 9), time) AS r FROM d) t WHERE r = 1""", "plan_knee")(
    lambda spark, sf: costs.knee(costs.pareto(plans(spark, sf), by=["query"]), by=["query"]).select("query", "time", "cost"))

CURVES = f"SELECT stage, size_mb, SUM(t_total) AS time, CAST(SUM(bytes_in) AS DOUBLE) / 65536 AS cost FROM ({LOG}) l GROUP BY stage, size_mb"


@query(f"""WITH c AS ({CURVES}), w AS (SELECT SUM(time) AS t0, SUM(cost) AS c0 FROM c WHERE size_mb = 50), l AS (SELECT UNNEST([0.0, 0.5, 1.0]) AS lam),
s AS (SELECT CAST(lam AS DOUBLE) AS lam, stage, size_mb, lam * time / t0 + (1 - lam) * cost / c0 AS score FROM c, w, l),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lam, stage ORDER BY score, size_mb) AS r, MAX(CASE WHEN size_mb = 50 THEN score END) OVER (PARTITION BY lam, stage) AS own FROM s)
SELECT lam, stage, CASE WHEN own <= score * 1.05 THEN CAST(50 AS DOUBLE) ELSE size_mb END AS size_mb FROM r WHERE r = 1""")
def plan_sweep(spark, sf):
    register(spark, sf, ["events"])
    return costs.sweep(spark.sql(CURVES), [0.0, 0.5, 1.0])


@query(f"""WITH m AS (SELECT query, plan, MEDIAN(time) AS time, MEDIAN(cost) AS cost FROM (SELECT query, SPLIT_PART(plan, '/', 1) AS plan, time, cost FROM ({PLANS}) p) q GROUP BY 1, 2)
SELECT m.query, m.plan, m.time, m.cost, ROUND(b.time / m.time, 6) AS speedup, ROUND(100 * (1 - m.cost / b.cost), 6) AS saving FROM m JOIN m b ON m.query = b.query AND b.plan = '50.0'""")
def plan_compare(spark, sf):
    p = plans(spark, sf).withColumn("plan", F.split_part("plan", F.lit("/"), F.lit(1)))
    return costs.compare(p, "50.0").withColumn("speedup", F.round("speedup", 6)).withColumn("saving", F.round("saving", 6))


GRID = f"SELECT run AS parallel, size_mb, MAX(t_total) + AVG(disp) AS wall, COUNT(*) AS p, AVG(t_read) AS t_read FROM ({LOG}) l GROUP BY run, size_mb"


@query(f"""WITH g AS ({GRID}), w AS (SELECT parallel, MEDIAN(wall) AS wall, AVG(p * t_read) AS rd FROM g GROUP BY parallel),
b AS (SELECT parallel FROM w WHERE wall <= (SELECT MIN(wall) FROM w) * 1.05 ORDER BY rd, parallel LIMIT 1), o AS (SELECT g.* FROM g JOIN b ON g.parallel = b.parallel)
SELECT parallel, size_mb FROM o WHERE wall <= (SELECT MIN(wall) FROM o) * 1.05 ORDER BY p * t_read, size_mb LIMIT 1""")
def s3_scenarios(spark, sf):
    register(spark, sf, ["events"])
    return costs.pick_scenario(spark.sql(GRID))


@query("SELECT CAST(40 AS DOUBLE) AS b1, CAST(900 AS DOUBLE) AS peak, CAST(0.01 AS DOUBLE) AS gamma FROM (SELECT 1) t")
def s3_model_fit(spark, sf):
    points = spark.range(1, 67).select(F.col("id").cast("double").alias("readers")).withColumn("mbps", costs.bandwidth(F.col("readers"), F.lit(40.0), F.lit(900.0), F.lit(0.01)))
    grid = spark.createDataFrame([(b, p, g) for b in (30.0, 40.0, 50.0) for p in (800.0, 900.0, 1000.0) for g in (0.0, 0.01, 0.02)], "b1 double, peak double, gamma double")
    return costs.fit_bandwidth(points, grid).select("b1", "peak", "gamma")


@query(f"SELECT DISTINCT event_type AS stage, CAST(0.5 AS DOUBLE) AS g, CAST(2.0 AS DOUBLE) AS slope, CAST(1.0 AS DOUBLE) AS intercept FROM events")
def size_fit(spark, sf):
    l = log(spark, sf).withColumn("k", F.col("task") % 9 + 1)
    l = l.withColumn("t_total", 1.0 + 2.0 * F.col("bytes_in") / 1048576 * F.sqrt("k"))
    return costs.fit_size(l, (0.0, 0.25, 0.5, 0.75, 1.0)).select("stage", "g", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"SELECT run AS parallel, size_mb, MEDIAN(t_read) AS read_s, QUANTILE_CONT(t_read, 0.95) AS read_p95, COUNT(*) AS p FROM ({LOG}) l GROUP BY run, size_mb")
def s3_sweep(spark, sf):
    return costs.read_grid(log(spark, sf).withColumnRenamed("run", "parallel"))


@query("SELECT event_type AS query, CAST(user_id % 2 AS BIGINT) AS sizing, 100.0 * SUM(event_id % 7) / SUM(event_id % 100) AS fpr_percent FROM events GROUP BY 1, 2".replace("100.0 * SUM(event_id % 7) / SUM(event_id % 100)", "ROUND(100 * CAST(SUM(event_id % 7) AS DOUBLE) / SUM(event_id % 100), 6)"))
def fpr_grouped(spark, sf):
    e = scan(spark, path(sf, "events"), select=["event_type AS query", "CAST(user_id % 2 AS BIGINT) AS sizing", "event_id % 7 AS false_positives", "event_id % 100 AS negatives"])
    return costs.pooled_rate(e).withColumn("fpr_percent", F.round("fpr_percent", 6))


_func = "CASE event_type WHEN 'click' THEN 'scan' WHEN 'view' THEN 'aggregate' WHEN 'purchase' THEN 'broadcast_join' WHEN 'error' THEN 'merge_bf' ELSE 'summary_clean' END"
STEPS = f"SELECT CAST(user_id % 3 AS BIGINT) AS run, {_func} AS func, CAST(0.25 * (event_id % 9) AS DOUBLE) AS time_s, event_id % 2 = 0 AS builds_bloom, event_id % 5 = 0 AS final_agg, event_id % 3 = 0 AS base_scan FROM events"


@query(f"""SELECT run, ROUND(SUM(CASE WHEN func = 'scan' AND NOT base_scan OR func = 'aggregate' AND final_agg OR func = 'summary_clean' THEN time_s ELSE 0 END), 6) AS fixed_s,
ROUND(SUM(CASE WHEN func = 'scan' AND base_scan OR func = 'broadcast_join' OR func = 'aggregate' AND NOT final_agg AND NOT builds_bloom THEN time_s WHEN func = 'aggregate' AND NOT final_agg THEN 0.8 * time_s ELSE 0 END), 6) AS optimizable_s,
ROUND(SUM(CASE WHEN func = 'merge_bf' THEN time_s WHEN func = 'aggregate' AND NOT final_agg AND builds_bloom THEN 0.2 * time_s ELSE 0 END), 6) AS bloom_s, SUM(time_s) AS total_s FROM ({STEPS}) s GROUP BY run""")
def amdahl(spark, sf):
    register(spark, sf, ["events"])
    return costs.amdahl(spark.sql(STEPS)).withColumns({c: F.round(c, 6) for c in ("fixed_s", "optimizable_s", "bloom_s")})




@query(f"""SELECT kind, COUNT(*) AS steps FROM (SELECT CASE WHEN func = 'merge_bf' THEN 'bloom' WHEN func = 'aggregate' AND NOT final_agg AND builds_bloom THEN 'both'
WHEN func = 'aggregate' AND NOT final_agg OR func = 'scan' AND base_scan OR func = 'broadcast_join' THEN 'optimizable' ELSE 'fixed' END AS kind FROM ({STEPS}) s) t GROUP BY kind""")
def step_classify(spark, sf):
    register(spark, sf, ["events"])
    return costs.classify(spark.sql(STEPS)).groupBy("kind").agg(F.count("*").alias("steps"))


GRAPH = [costs.Stage("scan1"), costs.Stage("scan2"), costs.Stage("build", ("scan1",), "aggregate"), costs.Stage("filtered", ("build",)), costs.Stage("join", ("scan2", "filtered"), "broadcast_join")]


@query(f"""WITH d AS (SELECT n_regionkey AS k, CAST(SUM(n_nationkey) AS DOUBLE) AS t FROM nation GROUP BY n_regionkey)
SELECT MAX(CASE WHEN k = 0 THEN t END) + MAX(CASE WHEN k = 2 THEN t END) + MAX(CASE WHEN k = 3 THEN t END) + MAX(CASE WHEN k = 4 THEN t END) AS parallel, SUM(t) AS serial FROM d""")
def critical_path(spark, sf):
    n = {r["k"]: float(r["t"]) for r in agg.aggregate(scan(spark, path(sf, "nation")), [F.col("n_regionkey").alias("k")], t=F.sum("n_nationkey")).collect()}
    duration = {s.name: n[k] for k, s in enumerate(GRAPH)}
    return spark.createDataFrame([(costs.critical_path(GRAPH, duration)[0], costs.critical_path(GRAPH, duration, True)[0])], "parallel double, serial double")


#: Three filters, one for each of three stages of the log, with the share of rows that they pass.
FILTERS = f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY stage) - 1 AS BIGINT) AS bit, stage, CAST(SUM(rows_out) AS DOUBLE) / SUM(rows_in) AS phi, SUM(bytes_out) AS bytes FROM ({LOG}) l GROUP BY stage"
PROBES = f"SELECT stage, SUM(rows_in) AS rows FROM ({LOG}) l GROUP BY stage"


@query(f"""WITH f AS ({FILTERS}), p AS ({PROBES}), s AS (SELECT UNNEST(range(CAST(POW(2, (SELECT COUNT(*) FROM f)) AS BIGINT))) AS subset)
SELECT subset, ROUND(SUM(rows * CASE WHEN (subset // CAST(POW(2, bit) AS BIGINT)) % 2 = 1 THEN phi ELSE 1 END), 3) AS demand, CAST(SUM(CASE WHEN (subset // CAST(POW(2, bit) AS BIGINT)) % 2 = 1 THEN bytes ELSE 0 END) AS BIGINT) AS moved
FROM s, f JOIN p ON f.stage = p.stage GROUP BY subset""")
def plan_bf_subset(spark, sf):
    register(spark, sf, ["events"])
    return costs.subset_demand(spark.sql(FILTERS), spark.sql(PROBES)).withColumn("demand", F.round("demand", 3))


@query(f"""WITH c AS (SELECT COUNT(*) AS n FROM orders WHERE {_rich}), j AS (SELECT COUNT(*) AS rows, COUNT(o_orderkey) AS joined FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE {_rich}) o ON l_orderkey = o_orderkey)
SELECT CAST(36 AS BIGINT) AS requests, ROUND(CAST(joined AS DOUBLE) / rows, 9) AS sigma, ROUND(CAST(joined AS DOUBLE) / rows + (1 - CAST(joined AS DOUBLE) / rows) * POW(1 - EXP(-10 * CAST(n AS DOUBLE) / 200000), 10), 9) AS phi FROM c, j""")
def bf_report(spark, sf):
    orders = rich(spark, sf)
    sigma = costs.semijoin_sigma(scan(spark, path(sf, "lineitem"), select=["l_orderkey"]), "l_orderkey", orders, "o_orderkey").first()["sigma"]
    r = costs.bloom_report(5, 25, 200_000, orders.count(), sigma)
    return spark.createDataFrame([(r["requests"], round(sigma, 9), round(r["phi"], 9))], "requests long, sigma double, phi double")


@query(f"SELECT l_returnflag, COUNT(*) AS rows, COUNT(o_orderkey) AS joined, ROUND(CAST(COUNT(o_orderkey) AS DOUBLE) / COUNT(*), 9) AS sigma FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE {_rich}) o ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def semijoin_sigma(spark, sf):
    l = scan(spark, path(sf, "lineitem"), select=["l_orderkey", "l_returnflag"])
    return costs.semijoin_sigma(l, "l_orderkey", rich(spark, sf), "o_orderkey", ["l_returnflag"]).withColumn("sigma", F.round("sigma", 9))


@query(f"""SELECT run, stage, CAST(GREATEST(1, CEIL(mb / GREATEST(1e-9, LEAST(mb / p, 50.0) * 0.5))) AS BIGINT) AS tasks
FROM (SELECT run, stage, CAST(SUM(bytes_in) AS DOUBLE) / 1048576 AS mb, COUNT(*) AS p FROM ({LOG}) l GROUP BY run, stage) m""")
def plan_resize(spark, sf):
    m = costs.measure(log(spark, sf)).select("run", "stage", (F.col("bytes_in").cast("double") / 1048576).alias("mb"), "p")
    return costs.resize_stages(m, 50, 25).select("run", "stage", "tasks")


@query(f"""WITH c AS ({CURVES}), s AS (SELECT stage, size_mb, 0.5 * time / (SELECT SUM(time) FROM c WHERE size_mb = 50) + 0.5 * cost / (SELECT SUM(cost) FROM c WHERE size_mb = 50) AS score FROM c)
SELECT stage, size_mb FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY score, CASE WHEN size_mb = 50 THEN 0 ELSE 1 END, size_mb) AS r FROM s) t WHERE r = 1""")
def plan_search(spark, sf):
    register(spark, sf, ["events"])
    at = {(r["stage"], r["size_mb"]): (r["time"], r["cost"]) for r in spark.sql(CURVES).collect()}
    names, sizes = sorted({s for s, _ in at}), sorted({m for _, m in at})
    score = lambda plan: tuple(sum(at[n, plan[n]][k] for n in names) for k in (0, 1))
    found = costs.search(dict.fromkeys(names, 50.0), {n: sizes for n in names}, score, 0.5)
    return spark.createDataFrame(sorted(found.items()), "stage string, size_mb double")


# ---------------------------------------------------------------- pipelines

_pipe = """
- {name: scan-orders, func: scan, input: orders, params: {select: "SELECT o_orderkey, o_custkey", sql_clauses: "WHERE o_totalprice > $price", output_file: o}}
- {name: orders, func: aggregate, from_previous_task: scan-orders, params: {output_file: a, bf_column: o_orderkey, est_elements: 5000, error_rate: 0.01}}
- {name: merge, func: merge_bf, from_previous_task: orders, params: {file_output: m, error_rate: 0.01}}
- {name: scan-lines, func: scan, input: lineitem, from_previous_task: merge, params: {select: "SELECT l_orderkey, l_quantity", sql_clauses: "WHERE l_discount > 0.05", bf_column: l_orderkey, filter_by_bf: true, output_file: l}}
- {name: join, func: FUNC, from_previous_task: [orders, scan-lines], params: {probe_select: "SELECT l_orderkey, o_custkey, l_quantity", join_condition: "l_orderkey = o_orderkey", output_file: j KEYS}}
- {name: result, func: aggregate, from_previous_task: join, params: {select: "SELECT o_custkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS qty", sql_clauses: "GROUP BY o_custkey", output_file: r}}
- {name: clean, func: summary_clean, from_previous_task: result, params: {is_delete: "false"}}
"""


def pipeline(func: str = "broadcast_join") -> str:
    keys = ", build_key: o_orderkey, probe_key: l_orderkey" if func in ("broadcast_join_pushdown", "range_join", "adaptive_join") else ""
    return _pipe.replace("FUNC", func).replace(" KEYS", keys)


def run_pipeline(spark, sf, func: str = "broadcast_join", filters: bool = True, exact: bool = True, plan: dict | None = None) -> DataFrame:
    read = steps.read_pipeline(pipeline(func), price=200000)
    return steps.compile_pipeline(spark, steps.replan(read, **plan) if plan else read, lambda n: table(spark, sf, n), filters, exact).result


_piped = "SELECT o_custkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 200000 AND l_discount > 0.05 GROUP BY o_custkey"
for _f in ("broadcast_join", "hash_join", "broadcast_join_pushdown", "range_join", "adaptive_join"):
    query(_piped, f"steps_{_f}")(functools.partial(run_pipeline, func=_f))
query(_piped, "steps_without_filters")(functools.partial(run_pipeline, filters=False))
query(_piped, "steps_bitmap_filters")(functools.partial(run_pipeline, exact=False))
query(_piped, "plan_apply")(functools.partial(run_pipeline, plan={"bf_off": ["merge"], "max_size_mb": {"join": 100}, "max_parallel": {"join": 10}}))


for _q in tpch.QUERIES:
    query(tpch.render(_q), f"dag_{_q}")(functools.partial(dags.run, name=_q))


@query(_piped)
def steps_outputs(spark, sf):
    """The steps' outputs written: buckets of a hash, one file, and a clean-up that spares one."""
    text_ = pipeline().replace("output_file: o}", "output_file: o, sort_by: o_orderkey}").replace("output_file: r}", "output_file: r, single_file: true}").replace('is_delete: "false"', 'is_delete: "true", exclude_patterns: "/r$"')
    read = steps.read_pipeline(text_, price=200000)
    written = steps.write_outputs(steps.compile_pipeline(spark, read, lambda n: table(spark, sf, n)), read, scratch(spark))
    assert list(written) == ["result"], written
    return scan(spark, written["result"])


@query(_piped)
def bloom_estimates(spark, sf):
    """Filters sized by what those of an earlier run held, kept as a file between the two."""
    read, out = steps.read_pipeline(pipeline(), price=200000), scratch(spark)
    tables = lambda n: table(spark, sf, n)
    steps.filter_estimates(steps.compile_pipeline(spark, read, tables)).write.json(out)
    kept = {r["task"]: r["est_elements"] for r in spark.read.json(out).collect()}
    assert set(kept) == {"orders", "merge"}, kept
    return steps.compile_pipeline(spark, steps.with_estimates(read, kept), tables, exact=False).result


@query(" UNION ALL ".join(f"SELECT '{n}' AS scenario, t.* FROM ({_piped}) t" for n in ("p10-s25", "p10-s50", "p20-s25", "p20-s50")))
def scenario_templates(spark, sf):
    made = steps.scenarios(steps.read_pipeline(pipeline(), price=200000), (10, 20), (25, 50))
    runs = [steps.compile_pipeline(spark, steps.read_pipeline(x), lambda n: table(spark, sf, n)).result.select(F.lit(n).alias("scenario"), "*") for n, x in made.items()]
    return agg.combine(*runs)


@query(" UNION ALL ".join(f"SELECT '{q}' AS query, 'OK' AS status, COUNT(*) AS rows FROM ({tpch.render(q)}) t" for q in ("q1", "q6")))
def result_sinks(spark, sf):
    """Two queries of the suite written by the sinks, told by the appended timings and the written rows."""
    out = scratch(spark)
    results.run_all(spark, {q: functools.partial(tpch.run, spark, sf, name=q) for q in ("q1", "q6")}, out)
    told = spark.read.option("header", "true").csv(f"{out}/timings")
    rows = agg.combine(*(agg.aggregate(scan(spark, f"{out}/results/{q}"), rows=F.count("*")).withColumn("q", F.lit(q)) for q in ("q1", "q6")))
    return told.join(rows, F.col("query") == F.col("q")).select("query", "status", "rows")


@query("SELECT * FROM (VALUES ('q14', 'date', '1996-09-01'), ('q3', 'date', '1998-03-15'), ('q3', 'segment', 'BUILDING')) t(query, name, value)")
def param_extract(spark, sf):
    rows = [(q, k, v) for q in ("q3", "q14") for k, v in sqltext.parameters_of(q, tpch.render(q)).items()]
    return spark.createDataFrame(rows, "query string, name string, value string")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def sql_transpile(spark, sf):
    register(spark, sf, ["orders"])
    return spark.sql(sqltext.transpile("create view v (st, n) as select o_orderstatus, count(*) from orders group by o_orderstatus;\nselect st as o_orderstatus, n from v order by n desc, st;\ndrop view v;\n:n 2"))


# ---------------------------------------------------------------- tables by DDL, and streams


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def external_table(spark, sf):
    name = f"nation_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{path(sf, 'nation')}')")
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT DATE_TRUNC('day', ts) AS start, event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS value FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    out = scratch(spark)
    return windows.run_once(spark, path(sf, "events"), f"{out}/windows", f"{out}/checkpoint").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- all of them

for _q in tpch.QUERIES:
    query(tpch.render(_q), f"tpch_{_q}")(functools.partial(tpch.run, name=_q))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
