"""The TPC-H-style suite as pipelines of steps: YAML templates with conditions and loops, compiled to one lazy plan each.

``enable_bf`` adds the steps that build, merge and read a filter. Parameters are those of ``tpch.PARAMETERS``; columns and
results are those of the SQL of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import steps, tpch

R = tpch.REVENUE
#: Text that several templates share.
PARTS = {
    "partsupp": """
- {name: shipped, func: scan, input: lineitem, params: {select: "SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice", output_file: shipped}}
- {name: partsupp, func: hash_aggregate, from_previous_task: shipped, params: {hash_column: ps_partkey, num_buckets: 8, output_file: partsupp,
    select: "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS ps_availqty, CAST(MIN(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS ps_supplycost", sql_clauses: "GROUP BY l_partkey, l_suppkey"}}
""",
    "region": """
- {name: region, func: scan, input: region, params: {select: "SELECT r_regionkey", sql_clauses: "WHERE r_name = '{{ region }}'", output_file: region}}
- {name: all-nations, func: scan, input: nation, params: {select: "SELECT n_nationkey, n_name, n_regionkey", output_file: nations}}
- {name: nation, func: broadcast_join, from_previous_task: [region, all-nations], params: {probe_select: "SELECT n_nationkey, n_name", join_condition: "n_regionkey = r_regionkey", output_file: nation}}
""",
}


def scan(name: str, of: str, columns: str, where: str = "") -> str:
    clauses = f', sql_clauses: "WHERE {where}"' if where else ""
    return f'- {{name: {name}, func: scan, input: {of}, params: {{select: "SELECT {columns}"{clauses}, output_file: {name}}}}}\n'


def join(name: str, build: str, probe: str, columns: str, on: str, how: str = "inner", func: str = "broadcast_join", keys: str = "") -> str:
    return f'- {{name: {name}, func: {func}, from_previous_task: [{build}, {probe}], params: {{probe_select: "SELECT {columns}", join_condition: "{on}", join_type: {how}, output_file: {name}{keys}}}}}\n'


def group(name: str, of: str, columns: str, clauses: str = "") -> str:
    return f'- {{name: {name}, func: aggregate, from_previous_task: {of}, params: {{select: "SELECT {columns}", sql_clauses: "{clauses}", output_file: {name}}}}}\n'


def filtered(name: str, of: str, columns: str, key: str, build: str, build_key: str, where: str = "") -> str:
    """A scan that a filter of another step's keys goes before, if filters are enabled."""
    clauses = f', sql_clauses: "WHERE {where}"' if where else ""
    return (f'{{% if enable_bf %}}\n- {{name: {name}-keys, func: create_bf, from_previous_task: {build}, params: {{bf_column: {build_key}, est_elements: 10000, error_rate: 0.001}}}}\n'
            f'- {{name: {name}-filter, func: merge_bf, from_previous_task: {name}-keys, params: {{file_output: {name}, error_rate: 0.001}}}}\n'
            f'- {{name: {name}, func: scan, input: {of}, from_previous_task: {name}-filter, params: {{select: "SELECT {columns}"{clauses}, bf_column: {key}, filter_by_bf: true, output_file: {name}}}}}\n'
            f"{{% else %}}\n{scan(name, of, columns, where)}{{% endif %}}\n")


YEAR = "CAST(YEAR({}) AS BIGINT)"
RANGE = "{0} >= DATE '{{{{ date }}}}' AND {0} < DATE '{{{{ date }}}}' + INTERVAL '{1}' {2}"
SUM4 = "CAST(SUM({}) AS DECIMAL(38,4))"
LINE = "l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate"

TEMPLATES: dict[str, str] = {
    "q1": scan("lines", "lineitem", "l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax", "l_shipdate <= DATE '{{ date }}' - INTERVAL '90' DAY")
    + group("result", "lines", f"l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS sum_base_price, "
            f"{SUM4.format(R)} AS sum_disc_price, CAST(SUM(CAST({R} AS DECIMAL(20,4)) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DECIMAL(38,6)) AS sum_charge, "
            "ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS count_order", "GROUP BY l_returnflag, l_linestatus"),
    "q2": PARTS["region"] + scan("part", "part", "p_partkey, p_brand", "p_size <= {{ size }} AND p_type LIKE '%{{ type }}'") + PARTS["partsupp"]
    + scan("all-suppliers", "supplier", "s_suppkey, s_name, s_nationkey, s_acctbal") + join("supplier", "nation", "all-suppliers", "s_suppkey, s_name, s_acctbal, n_name", "s_nationkey = n_nationkey")
    + join("of-part", "part", "partsupp", "ps_partkey, ps_suppkey, ps_supplycost, p_brand", "ps_partkey = p_partkey") + join("offers", "supplier", "of-part", "s_acctbal, s_name, n_name, ps_partkey, p_brand, ps_supplycost", "ps_suppkey = s_suppkey")
    + group("least", "offers", "ps_partkey AS k, MIN(ps_supplycost) AS cost", "GROUP BY ps_partkey") + join("best", "least", "offers", "s_acctbal, s_name, n_name, ps_partkey AS p_partkey, p_brand, ps_supplycost", "ps_partkey = k AND ps_supplycost = cost")
    + group("result", "best", "*", "ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"),
    "q3": scan("customer", "customer", "c_custkey", "c_mktsegment = '{{ segment }}'") + filtered("orders", "orders", "o_orderkey, o_custkey, o_orderdate", "o_custkey", "customer", "c_custkey", "o_orderdate < DATE '{{ date }}'")
    + join("own", "customer", "orders", "o_orderkey, o_orderdate", "o_custkey = c_custkey") + filtered("lines", "lineitem", "l_orderkey, l_extendedprice, l_discount", "l_orderkey", "own", "o_orderkey", "l_shipdate > DATE '{{ date }}'")
    + join("met", "own", "lines", "l_orderkey, o_orderdate, l_extendedprice, l_discount", "l_orderkey = o_orderkey", func="adaptive_join", keys=", build_key: o_orderkey, probe_key: l_orderkey")
    + group("result", "met", f"l_orderkey, {SUM4.format(R)} AS revenue, o_orderdate", "GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"),
    "q4": scan("orders", "orders", "o_orderkey, o_orderdate, o_orderpriority", RANGE.format("o_orderdate", 3, "MONTH")) + scan("lines", "lineitem", "l_orderkey, l_shipdate")
    + join("late", "lines", "orders", "o_orderpriority", "o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY", "left_semi", "hash_join") + group("result", "late", "o_orderpriority, COUNT(*) AS order_count", "GROUP BY o_orderpriority"),
    "q5": PARTS["region"] + scan("all-suppliers", "supplier", "s_suppkey, s_nationkey") + join("supplier", "nation", "all-suppliers", "s_suppkey, s_nationkey, n_name", "s_nationkey = n_nationkey")
    + scan("customer", "customer", "c_custkey, c_nationkey") + scan("orders", "orders", "o_orderkey, o_custkey", RANGE.format("o_orderdate", 1, "YEAR")) + join("own", "customer", "orders", "o_orderkey, c_nationkey", "o_custkey = c_custkey")
    + filtered("lines", "lineitem", "l_orderkey, l_suppkey, l_extendedprice, l_discount", "l_suppkey", "supplier", "s_suppkey") + join("sold", "own", "lines", "l_suppkey, l_extendedprice, l_discount, c_nationkey", "l_orderkey = o_orderkey", func="hash_join")
    + join("met", "supplier", "sold", "n_name, l_extendedprice, l_discount", "l_suppkey = s_suppkey AND c_nationkey = s_nationkey") + group("result", "met", f"n_name, {SUM4.format(R)} AS revenue", "GROUP BY n_name"),
    "q6": scan("lines", "lineitem", "l_extendedprice, l_discount", RANGE.format("l_shipdate", 1, "YEAR") + " AND CAST(l_discount AS DECIMAL(12,2)) BETWEEN {{ discount }} - 0.01 AND {{ discount }} + 0.01 AND l_quantity < {{ quantity }}")
    + group("result", "lines", SUM4.format("CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2))") + " AS revenue"),
    "q7": "{% for side in ['s', 'c'] %}\n"
    + scan("{{ side }}-nation", "nation", "n_nationkey, n_name", "n_name IN ('{{ nation1 }}', '{{ nation2 }}')") + "{% endfor %}\n"
    + scan("all-suppliers", "supplier", "s_suppkey, s_nationkey") + join("supplier", "s-nation", "all-suppliers", "s_suppkey, n_name AS supp_nation", "s_nationkey = n_nationkey")
    + scan("all-customers", "customer", "c_custkey, c_nationkey") + join("customer", "c-nation", "all-customers", "c_custkey, n_name AS cust_nation", "c_nationkey = n_nationkey")
    + scan("all-orders", "orders", "o_orderkey, o_custkey") + join("orders", "customer", "all-orders", "o_orderkey, cust_nation", "o_custkey = c_custkey")
    + filtered("lines", "lineitem", LINE, "l_suppkey", "supplier", "s_suppkey", "l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'")
    + join("sold", "supplier", "lines", "l_orderkey, l_shipdate, l_extendedprice, l_discount, supp_nation", "l_suppkey = s_suppkey") + join("met", "orders", "sold", "*", "l_orderkey = o_orderkey AND supp_nation <> cust_nation", func="hash_join")
    + group("result", "met", f"supp_nation, cust_nation, {YEAR.format('l_shipdate')} AS l_year, {SUM4.format(R)} AS revenue", f"GROUP BY supp_nation, cust_nation, {YEAR.format('l_shipdate')}"),
    "q8": PARTS["region"] + scan("part", "part", "p_partkey", "p_type = '{{ type }}'") + filtered("lines", "lineitem", LINE, "l_partkey", "part", "p_partkey") + join("of-part", "part", "lines", LINE, "l_partkey = p_partkey")
    + scan("all-customers", "customer", "c_custkey, c_nationkey") + join("customer", "nation", "all-customers", "c_custkey", "c_nationkey = n_nationkey", "left_semi")
    + scan("all-orders", "orders", "o_orderkey, o_custkey, o_orderdate", "o_orderdate BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'") + join("orders", "customer", "all-orders", "o_orderkey, o_orderdate", "o_custkey = c_custkey", "left_semi")
    + join("sold", "orders", "of-part", "l_suppkey, l_extendedprice, l_discount, o_orderdate", "l_orderkey = o_orderkey", func="broadcast_join_pushdown", keys=", build_key: o_orderkey, probe_key: l_orderkey")
    + scan("suppliers", "supplier", "s_suppkey, s_nationkey") + join("supplier", "all-nations", "suppliers", "s_suppkey, n_name", "s_nationkey = n_nationkey") + join("met", "supplier", "sold", "o_orderdate, l_extendedprice, l_discount, n_name", "l_suppkey = s_suppkey")
    + group("sums", "met", f"{YEAR.format('o_orderdate')} AS o_year, {SUM4.format(f'CASE WHEN n_name = {chr(39)}{{{{ nation }}}}{chr(39)} THEN {R} ELSE 0 END')} AS nation_volume, {SUM4.format(R)} AS volume", f"GROUP BY {YEAR.format('o_orderdate')}")
    + group("result", "sums", "*, ROUND(CAST(nation_volume AS DOUBLE) / CAST(volume AS DOUBLE), 6) AS mkt_share"),
    "q9": PARTS["partsupp"] + scan("part", "part", "p_partkey", "p_name LIKE '%{{ color }}%'") + filtered("lines", "lineitem", LINE, "l_partkey", "part", "p_partkey") + join("of-part", "part", "lines", LINE, "l_partkey = p_partkey", "left_semi")
    + join("costed", "partsupp", "of-part", "l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, ps_supplycost", "ps_suppkey = l_suppkey AND ps_partkey = l_partkey", func="hash_join")
    + scan("nation", "nation", "n_nationkey, n_name") + scan("suppliers", "supplier", "s_suppkey, s_nationkey") + join("supplier", "nation", "suppliers", "s_suppkey, n_name", "s_nationkey = n_nationkey")
    + join("sold", "supplier", "costed", "l_orderkey, l_quantity, l_extendedprice, l_discount, ps_supplycost, n_name AS nation", "l_suppkey = s_suppkey")
    + scan("orders", "orders", "o_orderkey, o_orderdate") + join("met", "orders", "sold", "*", "l_orderkey = o_orderkey", func="range_join", keys=", build_key: o_orderkey, probe_key: l_orderkey")
    + group("result", "met", f"nation, {YEAR.format('o_orderdate')} AS o_year, {SUM4.format(f'{R} - CAST(ps_supplycost AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(12,2))')} AS sum_profit", f"GROUP BY nation, {YEAR.format('o_orderdate')}"),
    "q10": scan("orders", "orders", "o_orderkey, o_custkey", RANGE.format("o_orderdate", 3, "MONTH")) + filtered("lines", "lineitem", "l_orderkey, l_extendedprice, l_discount", "l_orderkey", "orders", "o_orderkey", "l_returnflag = 'R'")
    + join("returned", "orders", "lines", "o_custkey, l_extendedprice, l_discount", "l_orderkey = o_orderkey") + group("sums", "returned", f"o_custkey, {SUM4.format(R)} AS revenue", "GROUP BY o_custkey")
    + scan("nation", "nation", "n_nationkey, n_name") + scan("customers", "customer", "c_custkey, c_name, c_acctbal, c_nationkey") + join("customer", "nation", "customers", "c_custkey, c_name, c_acctbal, n_name", "c_nationkey = n_nationkey")
    + join("met", "sums", "customer", "c_custkey, c_name, revenue, c_acctbal, n_name", "c_custkey = o_custkey") + group("result", "met", "*", "ORDER BY revenue DESC, c_custkey LIMIT 20"),
    "q11": PARTS["partsupp"] + scan("nation", "nation", "n_nationkey", "n_name = '{{ nation }}'") + scan("suppliers", "supplier", "s_suppkey, s_nationkey") + join("supplier", "nation", "suppliers", "s_suppkey", "s_nationkey = n_nationkey", "left_semi")
    + join("own", "supplier", "partsupp", "ps_partkey, ps_supplycost, ps_availqty", "ps_suppkey = s_suppkey", "left_semi") + group("held", "own", f"ps_partkey, {SUM4.format('ps_supplycost * ps_availqty')} AS value", "GROUP BY ps_partkey")
    + group("whole", "held", "CAST(SUM(value) AS DOUBLE) * {{ fraction }} AS least") + join("result", "whole", "held", "ps_partkey, value", "CAST(value AS DOUBLE) > least"),
    "q12": scan("lines", "lineitem", "l_orderkey, l_linestatus, l_shipdate", RANGE.format("l_shipdate", 1, "YEAR")) + scan("orders", "orders", "o_orderkey, o_orderdate, o_orderpriority")
    + join("met", "lines", "orders", "l_linestatus, o_orderpriority", "o_orderkey = l_orderkey AND o_orderdate < l_shipdate", func="hash_join")
    + group("result", "met", "l_linestatus, {% for kind in ['high', 'low'] %}CAST(SUM(CASE WHEN o_orderpriority {% if kind == 'low' %}NOT {% endif %}IN ('{{ priority1 }}', '{{ priority2 }}') THEN 1 ELSE 0 END) AS BIGINT) AS {{ kind }}_line_count{% if kind == 'high' %}, {% endif %}{% endfor %}", "GROUP BY l_linestatus"),
    "q13": scan("customer", "customer", "c_custkey") + scan("orders", "orders", "o_orderkey, o_custkey", "o_orderpriority NOT LIKE '%{{ word }}%' AND o_orderdate >= DATE '{{ date }}'")
    + join("met", "orders", "customer", "c_custkey, o_orderkey", "c_custkey = o_custkey", "left", "hash_join") + group("counts", "met", "c_custkey, COUNT(o_orderkey) AS c_count", "GROUP BY c_custkey") + group("result", "counts", "c_count, COUNT(*) AS custdist", "GROUP BY c_count"),
    "q14": scan("part", "part", "p_partkey, p_type") + filtered("lines", "lineitem", "l_partkey, l_extendedprice, l_discount", "l_partkey", "part", "p_partkey", RANGE.format("l_shipdate", 1, "MONTH")) + join("met", "part", "lines", "p_type, l_extendedprice, l_discount", "l_partkey = p_partkey")
    + group("result", "met", f"ROUND(100.00 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {R} ELSE 0 END) AS DOUBLE) / CAST(SUM({R}) AS DOUBLE), 6) AS promo_revenue"),
    "q15": scan("lines", "lineitem", "l_suppkey, l_extendedprice, l_discount", RANGE.format("l_shipdate", 3, "MONTH")) + group("revenue", "lines", f"l_suppkey AS supplier_no, {SUM4.format(R)} AS total_revenue", "GROUP BY l_suppkey")
    + group("most", "revenue", "MAX(total_revenue) AS most") + join("best", "most", "revenue", "supplier_no, total_revenue", "total_revenue = most") + scan("supplier", "supplier", "s_suppkey, s_name") + join("result", "best", "supplier", "s_suppkey, s_name, total_revenue", "s_suppkey = supplier_no"),
    "q16": PARTS["partsupp"] + scan("part", "part", "p_partkey, p_brand, p_type, p_size", "p_brand <> '{{ brand }}' AND p_type NOT LIKE '{{ type }}%' AND p_size IN ({{ sizes }})") + scan("overdrawn", "supplier", "s_suppkey", "s_acctbal < 0")
    + join("good", "overdrawn", "partsupp", "ps_partkey, ps_suppkey", "ps_suppkey = s_suppkey", "left_anti") + join("met", "part", "good", "p_brand, p_type, p_size, ps_suppkey", "ps_partkey = p_partkey")
    + group("result", "met", "p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt", "GROUP BY p_brand, p_type, p_size"),
    "q17": scan("part", "part", "p_partkey", "p_brand = '{{ brand }}' AND p_size <= {{ size }}") + filtered("lines", "lineitem", LINE, "l_partkey", "part", "p_partkey") + join("own", "part", "lines", "l_partkey, l_quantity, l_extendedprice", "l_partkey = p_partkey", "left_semi")
    + group("means", "own", "l_partkey AS k, 0.5 * AVG(l_quantity) AS few", "GROUP BY l_partkey") + join("small", "means", "own", "l_extendedprice", "l_partkey = k AND l_quantity < few")
    + group("result", "small", "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS price, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / 7.0, 6) AS avg_yearly"),
    "q18": scan("lines", "lineitem", "l_orderkey, l_quantity") + group("large", "lines", "l_orderkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS sum_qty", "GROUP BY l_orderkey HAVING SUM(CAST(l_quantity AS DECIMAL(12,2))) > {{ quantity }}")
    + scan("orders", "orders", "o_orderkey, o_custkey, o_orderdate, o_totalprice") + join("sold", "large", "orders", "o_orderkey, o_custkey, o_orderdate, o_totalprice, sum_qty", "o_orderkey = l_orderkey") + scan("customer", "customer", "c_custkey, c_name")
    + join("met", "customer", "sold", "c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum_qty", "o_custkey = c_custkey", func="hash_join") + group("result", "met", "*", "ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"),
    "q19": scan("part", "part", "p_partkey, p_brand, p_size", "p_size BETWEEN 1 AND 35") + scan("lines", "lineitem", "l_partkey, l_quantity, l_extendedprice, l_discount")
    + join("met", "part", "lines", "l_extendedprice, l_discount", "l_partkey = p_partkey AND ({% for b in [[brand1, quantity1, 15], [brand2, quantity2, 25], [brand3, quantity3, 35]] %}p_brand = '{{ b[0] }}' AND l_quantity BETWEEN {{ b[1] }} AND {{ b[1] }} + 10 AND p_size BETWEEN 1 AND {{ b[2] }}{% if b[2] < 35 %} OR {% endif %}{% endfor %})")
    + group("result", "met", f"{SUM4.format(R)} AS revenue"),
    "q20": PARTS["partsupp"] + scan("part", "part", "p_partkey", "p_name LIKE '{{ color }}%'") + join("of-part", "part", "partsupp", "ps_partkey, ps_suppkey, ps_availqty", "ps_partkey = p_partkey", "left_semi")
    + scan("lines", "lineitem", "l_partkey, l_suppkey, l_quantity", RANGE.format("l_shipdate", 1, "YEAR")) + group("sums", "lines", "l_partkey, l_suppkey, 0.5 * SUM(CAST(l_quantity AS DECIMAL(12,2))) AS half", "GROUP BY l_partkey, l_suppkey")
    + join("excess", "sums", "of-part", "ps_suppkey", "l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND ps_availqty > half", func="hash_join") + scan("nation", "nation", "n_nationkey", "n_name = '{{ nation }}'")
    + scan("suppliers", "supplier", "s_suppkey, s_name, s_nationkey") + join("supplier", "nation", "suppliers", "s_name, s_suppkey", "s_nationkey = n_nationkey", "left_semi") + join("result", "excess", "supplier", "s_name, s_suppkey", "s_suppkey = ps_suppkey", "left_semi"),
    "q21": scan("orders", "orders", "o_orderkey, o_orderdate", "o_orderstatus = 'F'") + scan("lines", "lineitem", "l_orderkey, l_suppkey, l_shipdate") + join("late", "orders", "lines", "l_orderkey, l_suppkey", "l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '90' DAY", func="hash_join")
    + scan("nation", "nation", "n_nationkey", "n_name = '{{ nation }}'") + scan("suppliers", "supplier", "s_suppkey, s_name, s_nationkey") + join("supplier", "nation", "suppliers", "s_suppkey, s_name", "s_nationkey = n_nationkey", "left_semi")
    + join("own", "supplier", "late", "s_name, l_orderkey, l_suppkey", "l_suppkey = s_suppkey")
    + "{% for other in [['lines', 'left_semi', 'shared'], ['late', 'left_anti', 'alone']] %}\n"
    + join("{{ other[2] }}", "{{ other[0] }}", "{% if other[2] == 'alone' %}shared{% else %}own{% endif %}", "s_name, probe_table.l_orderkey, probe_table.l_suppkey", "probe_table.l_orderkey = build_table.l_orderkey AND probe_table.l_suppkey <> build_table.l_suppkey", "{{ other[1] }}", "hash_join")
    + "{% endfor %}\n" + group("result", "alone", "s_name, COUNT(*) AS numwait", "GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100"),
    "q22": scan("customer", "customer", "c_custkey, c_nationkey, c_acctbal", "c_nationkey IN ({{ codes }})") + group("mean", "customer", "AVG(c_acctbal) AS mean", "WHERE c_acctbal > 0.00")
    + join("rich", "mean", "customer", "c_custkey, c_nationkey, c_acctbal", "c_acctbal > mean") + scan("orders", "orders", "o_custkey", "o_orderdate >= DATE '{{ date }}'") + join("idle", "orders", "rich", "c_nationkey, c_acctbal", "c_custkey = o_custkey", "left_anti", "hash_join")
    + group("result", "idle", "SUBSTRING(CAST(100 + c_nationkey AS VARCHAR(3)), 2, 2) AS cntrycode, COUNT(*) AS numcust, CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS totacctbal", "GROUP BY SUBSTRING(CAST(100 + c_nationkey AS VARCHAR(3)), 2, 2)"),
}


def pipeline(name: str, enable_bf: bool = True, **parameters: str) -> list[steps.Step]:
    """The checked steps of a query with its parameters; unknown ones are refused."""
    known = tpch.PARAMETERS[name]
    if extra := set(parameters) - set(known):
        raise ValueError(f"{name} has no parameters {sorted(extra)}")
    return steps.read_pipeline(TEMPLATES[name], enable_bf=enable_bf, **{**known, **parameters})


def run(spark: SparkSession, sf_dir: str, name: str, enable_bf: bool = True, **parameters: str) -> DataFrame:
    return steps.compile_pipeline(spark, pipeline(name, enable_bf, **parameters), lambda t: table(spark, sf_dir, t)).result
