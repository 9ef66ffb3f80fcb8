"""Queries of the guarded SQL surface over the star schema, and of the calculator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import calculator, sqlguard
from lectern.plans.registry import ORACLES, QUERIES, query
from lectern.plans.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Queries that run as they are in both engines.
SQL = {
    "sql_join_inner": "select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA' group by n_name",
    "sql_join_left": "select c_custkey, count(o_orderkey) as orders_made from customer left join orders on c_custkey = o_custkey group by c_custkey",
    "sql_join_full": "select coalesce(a.k, b.k) as k, a.n as suppliers, b.n as customers from (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by s_nationkey) a full join (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by c_nationkey) b on a.k = b.k",
    "sql_join_comma": "select r_name, count(*) as nations from region, nation where r_regionkey = n_regionkey group by r_name",
    "sql_join_using": "select a.l_orderkey, sum(a.l_quantity) as quantity from lineitem a join (select o_orderkey as l_orderkey from orders where o_orderstatus = 'F') b using (l_orderkey) group by a.l_orderkey",
    "sql_semi": "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)",
    "sql_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)",
    "sql_group_having": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity, round(avg(l_discount), 6) as discount from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    "sql_window": "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 2) as running from orders",
    "sql_union": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "sql_union_all": "select c_nationkey as k, 'c' as kind from customer union all select s_nationkey, 's' from supplier",
    "sql_intersect": "select c_nationkey as k from customer where c_acctbal > 9900 intersect select s_nationkey from supplier",
    "sql_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 8000",
    "sql_correlated": "select p_partkey, p_retailprice from part p where p_retailprice > (select avg(q.p_retailprice) from part q where q.p_brand = p.p_brand)",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)",
    "sql_cube": "select l_returnflag, l_linestatus, sum(l_quantity) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "sql_distinct_agg": "select o_orderstatus, count(distinct o_custkey) as customers, count(*) as n from orders group by o_orderstatus",
    "sql_case": "select case when l_discount > 0.05 then 'high' when l_discount > 0 then 'low' else 'none' end as band, count(*) as n from lineitem group by 1",
    "sql_subquery_from": "select k, max(n) as most from (select o_custkey % 10 as k, o_custkey, count(*) as n from orders group by o_custkey) t group by k",
    "sql_order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
}


def _guarded(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sqlguard.admitted(spark, SQL[name], {t: table(spark, d, t) for t in TABLES})

    run.__name__ = name
    return run


for _name, _sql in SQL.items():
    QUERIES[_name], ORACLES[_name] = _guarded(_name), _sql


@query("select count(*) > 50 as truncated, least(count(*), 50) as row_count from orders where o_totalprice > 1000")
def sql_cap_truncate(spark: SparkSession, d: str) -> DataFrame:
    told = sqlguard.run(spark, "select o_orderkey from orders where o_totalprice > 1000", {t: table(spark, d, t) for t in TABLES})
    return spark.createDataFrame([(told["truncated"], told["row_count"])], "truncated boolean, row_count long")


#: (query, why it is refused).  Fixed test cases.
ADMISSION = (
    ("select o_orderkey from orders", None),
    ("-- note\nSELECT o_orderkey FROM orders o, customer c", None),
    ("with t as (select 1) select * from t", "only SELECT statements are allowed"),
    ("drop table orders", "only SELECT statements are allowed"),
    ("select 1; select 2", "semicolons are not allowed; send one statement"),
    ("select * from secrets", "table 'secrets' is outside the allowlist"),
    ("select * from orders join secrets on true", "table 'secrets' is outside the allowlist"),
    ("select * from orders where exists (select 1 from secrets)", "table 'secrets' is outside the allowlist"),
    ("select (select max(code) from secrets) as c", "table 'secrets' is outside the allowlist"),
    ("select java_method('java.lang.System', 'getenv') as c from orders", "function 'java_method' is not allowed"),
    ("select 1 as x union select code from secrets", "table 'secrets' is outside the allowlist"),
)


@query("with v(id, problem) as (values " + ", ".join(f"({i}, {'null' if why is None else chr(39) + why.replace(chr(39), chr(39) * 2) + chr(39)})" for i, (_, why) in enumerate(ADMISSION)) + ") select * from v")
def sql_admission(spark: SparkSession, d: str) -> DataFrame:
    found = [(i, sqlguard.problem(sql, list(TABLES), spark)) for i, (sql, _) in enumerate(ADMISSION)]
    return spark.createDataFrame(found, "id int, problem string")


#: Statements that are priced, and the pairs that they compare, as SQL.
PRICED = (
    ("select count(*) from lineitem a, lineitem b", "(select count(*) from lineitem) ** 2"),
    ("select n_name, r_name from nation cross join region", "(select count(*) from nation) * (select count(*) from region)"),
    ("select c_name, o_totalprice from customer join orders on c_custkey = o_custkey", "0"),
    ("select count(*) from events a join events b on a.value < b.value", "(select count(*) from events) ** 2"),
    ("select c_name from (select max(o_totalprice) as most from orders) cross join customer", "(select count(*) from customer)"),
    ("select count(*) from (select * from lineitem limit 10) a, orders", "10 * (select count(*) from orders)"),
    ("select c_custkey from customer where exists (select 1 from orders where o_totalprice > c_acctbal * 50)", "(select count(*) from customer) * (select count(*) from orders)"),
    ("select count(*) from (select s_suppkey from supplier union all select p_partkey from part) a, nation", "((select count(*) from supplier) + (select count(*) from part)) * (select count(*) from nation)"),
    ("select r_name, (select count(*) from nation a, nation b) as n from region", "(select count(*) from nation) ** 2"),
)


@query(f"select id, pairs, pairs <= {sqlguard.Budget().pairs} as admitted from (" + " union all ".join(f"select {i} as id, ({pairs})::double as pairs" for i, (_, pairs) in enumerate(PRICED)) + ")")
def sql_cost(spark: SparkSession, d: str) -> DataFrame:
    """The price of statements over the tables, and whether it is within the usual budget; none of them is run."""
    views = {t: table(spark, d, t) for t in TABLES}
    found = []
    for i, (statement, _) in enumerate(PRICED):
        price = sqlguard.cost(sqlguard.admitted(spark, statement, views, sqlguard.Budget(pairs=1 << 100)))
        try:
            sqlguard.admitted(spark, statement, views)
            found.append((i, float(price.pairs), True))
        except sqlguard.Refused:
            found.append((i, float(price.pairs), False))
    return spark.createDataFrame(found, "id int, pairs double, admitted boolean")


@query("select l_orderkey, l_linenumber, (l_orderkey * 3 - l_partkey)::varchar as result from lineitem where l_orderkey % 50 = 1")
def tools_calc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_orderkey % 50 = 1").select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit(" * 3 - "), F.col("l_partkey").cast("string")).alias("expression"))
    return calculator.calculated(rows, "expression").select("l_orderkey", "l_linenumber", "result")


@query("select l_orderkey, l_linenumber, (l_orderkey * 3 - l_partkey)::varchar as result from lineitem")
def tools_calc_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit(" * 3 - "), F.col("l_partkey").cast("string")).alias("expression"))
    return calculator.calculated(rows, "expression").select("l_orderkey", "l_linenumber", "result")
