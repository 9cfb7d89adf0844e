"""The query catalogue: one entry per operator, with DuckDB SQL of the same result.

Queries are texts of the modelling language over the model below. Each SQL is
written for itself; both sides round sums of doubles, whose order differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.model import Model

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MODEL = """
source: region is t.table('region') extend { primary_key: r_regionkey }
source: nation is t.table('nation') extend { primary_key: n_nationkey  join_one: region with n_regionkey }
source: customer is t.table('customer') extend {
  primary_key: c_custkey
  join_one: nation with c_nationkey
  measure: n_customers is count(), balance is c_acctbal.sum()
}
source: supplier is t.table('supplier') extend { primary_key: s_suppkey  join_one: nation with s_nationkey }
source: part is t.table('part') extend { primary_key: p_partkey }
source: lines is t.table('lineitem')
source: orders is t.table('orders') extend {
  primary_key: o_orderkey
  join_one: customer with o_custkey
  join_many: li is lines on o_orderkey = li.l_orderkey
  dimension: big is o_totalprice > 200000
  measure: n_orders is count(), total is round(o_totalprice.sum(), 2)
  view: by_status is { group_by: o_orderstatus  aggregate: n_orders, total }
  view: urgent is { where: o_orderpriority = '1-URGENT'  group_by: o_orderstatus  aggregate: n_orders }
}
source: li is t.table('lineitem') extend {
  join_one: o is orders on l_orderkey = o.o_orderkey
  join_one: supplier with l_suppkey
  join_one: part with l_partkey
  dimension: revenue is l_extendedprice * (1 - l_discount)
  measure: n is count(), rev is revenue.sum(), qty is l_quantity.sum()
}
source: events is t.table('events') extend { measure: n is count() }
source: pages is t.table('pages')
source: emb is t.table('embeddings')
source: people is t.table('customer') extend {
  dimension: maybe is nullif(c_mktsegment, 'BUILDING'), half is nullif(c_acctbal > 0, true), low is pick null when c_acctbal < 0 else c_acctbal
}
"""

#: name: (query, SQL)
CATALOGUE: dict[str, tuple[str, str]] = {}


def q(name: str, text: str, sql: str) -> None:
    CATALOGUE[name] = (text, sql)


# --- flagship and projections --------------------------------------------------
q("revenue_by_nation", "run: li -> { group_by: o.customer.nation.n_name aggregate: n, revenue is round(rev, 2) }",
  "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
q("scan_select_star", "run: t.table('customer') -> { select: * }", "SELECT * FROM customer")
q("select_expr", "run: orders -> { select: o_orderkey, cents is round(o_totalprice * 100, 0), customer.c_name, o_orderdate.month where: big }",
  "SELECT o_orderkey, round(o_totalprice * 100, 0) AS cents, c_name, date_trunc('month', o_orderdate) AS o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
q("select_except", "run: t.table('part') -> { select: * {except: p_name, p_retailprice} }", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
q("select_join_star", "run: nation -> { select: n_name, region.* }", "SELECT n_name, r_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
q("distinct_group_by", "run: li -> { group_by: l_returnflag, l_linestatus }", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
# --- predicates ----------------------------------------------------------------
q("where_and_or", "run: orders -> { select: o_orderkey where: (o_orderstatus = 'O' and o_totalprice > 300000) or o_orderpriority = '5-LOW' }", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 300000) OR o_orderpriority = '5-LOW'")
q("where_alternation_in", "run: orders -> { aggregate: n_orders where: o_orderstatus = 'O' | 'F' }", "SELECT count(*) AS n_orders FROM orders WHERE o_orderstatus IN ('O', 'F')")
q("where_alternation_not_in", "run: people -> { aggregate: n is count() where: maybe != 'MACHINERY' | 'FURNITURE' }", "SELECT count(*) AS n FROM customer WHERE nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', 'FURNITURE')")
q("where_apply_and", "run: orders -> { aggregate: n_orders where: o_totalprice ? > 1000 & < 50000 }", "SELECT count(*) AS n_orders FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 50000")
q("where_not_equal_null", "run: people -> { aggregate: n is count() where: maybe != 'MACHINERY' }", "SELECT count(*) AS n FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY', true)")
q("where_not_null_safe", "run: people -> { aggregate: n is count() where: not half }", "SELECT count(*) AS n FROM customer WHERE coalesce(NOT nullif(c_acctbal > 0, true), true)")
q("where_is_null", "run: people -> { aggregate: a is count() { where: maybe is null }, b is count() { where: maybe is not null }, c is count() { where: maybe = null } }", "SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_mktsegment <> 'BUILDING') AS b, count(*) FILTER (c_mktsegment = 'BUILDING') AS c FROM customer")
q("where_like", "run: part -> { group_by: p_type aggregate: n is count() where: p_name ~ '%1%' & !~ '%2%' }", "SELECT p_type, count(*) AS n FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%2%' GROUP BY 1")
q("where_like_alternatives", "run: part -> { aggregate: n is count() where: p_name ~ '%1' | '%2' }", "SELECT count(*) AS n FROM part WHERE p_name LIKE '%1' OR p_name LIKE '%2'")
q("where_regex", "run: customer -> { aggregate: n is count() where: c_name ~ r'[13]$' }", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '[13]$')")
q("where_in_list", "run: nation -> { select: n_name where: n_nationkey in (1, 3, 5) }", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
q("range_half_open", "run: orders -> { aggregate: n_orders, m is count() { where: o_totalprice != 1000 to 200000 } where: o_orderkey = 100 to 5000 }", "SELECT count(*) AS n_orders, count(*) FILTER (o_totalprice < 1000 OR o_totalprice >= 200000) AS m FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
q("pick_case", "run: orders -> { group_by: size is o_totalprice ? pick 'small' when < 50000 pick 'middle' when < 200000 else 'large', s is case o_orderstatus when 'O' then 'open' else 'other' end aggregate: n_orders }",
  "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS size, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n_orders FROM orders GROUP BY 1, 2")
q("coalesce_op", "run: people -> { group_by: m is maybe ?? 'none' aggregate: n is count() }", "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS m, count(*) AS n FROM customer GROUP BY 1")
q("casts", "run: customer -> { select: c_custkey, s is c_nationkey::string, f is c_custkey::float, bad is c_name:::number, i is c_acctbal::'int' }",
  "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS f, TRY_CAST(c_name AS DOUBLE) AS bad, CAST(trunc(c_acctbal) AS INTEGER) AS i FROM customer")
q("arithmetic", "run: orders -> { select: o_orderkey, a is o_orderkey / 7, b is o_orderkey % 7, c is -o_orderkey + 2 * 3 }", "SELECT o_orderkey, o_orderkey / 7 AS a, o_orderkey % 7 AS b, -o_orderkey + 6 AS c FROM orders")
# --- aggregates ----------------------------------------------------------------
q("agg_basic", "run: orders -> { group_by: o_orderstatus aggregate: n is count(), s is round(sum(o_totalprice), 2), a is round(avg(o_totalprice), 4), lo is min(o_totalprice), hi is max(o_orderdate) }",
  "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
q("agg_filtered", "run: li -> { group_by: l_linestatus aggregate: r is round(l_quantity.sum() { where: l_returnflag = 'R' }, 2), c is count() { where: l_discount > 0.05, l_tax < 0.05 } }",
  "SELECT l_linestatus, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2), 0) AS r, count(*) FILTER (l_discount > 0.05 AND l_tax < 0.05) AS c FROM lineitem GROUP BY 1")
q("agg_count_distinct", "run: li -> { group_by: l_returnflag aggregate: p is count(l_partkey), s is count(l_suppkey) }", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1")
q("agg_stddev", "run: orders -> { group_by: o_orderpriority aggregate: d is round(stddev(o_totalprice), 4), v is round(variance(o_orderkey), 1) }", "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS d, round(var_samp(o_orderkey), 1) AS v FROM orders GROUP BY 1")
q("agg_sum_empty_is_zero", "run: orders -> { aggregate: s is sum(o_totalprice), a is avg(o_totalprice), n is count() where: o_orderkey < 0 }", "SELECT CAST(0 AS DOUBLE) AS s, avg(o_totalprice) AS a, count(*) AS n FROM orders WHERE o_orderkey < 0")
q("agg_string_agg_ordered", "run: nation -> { group_by: region.r_name aggregate: names is string_agg(n_name, '; ') { order_by: n_name desc }, two is string_agg(n_name) { order_by: n_nationkey limit: 2 } }",
  "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, array_to_string(list(n_name ORDER BY n_nationkey)[1:2], ',') AS two FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("agg_max_by", "run: orders -> { group_by: o_orderstatus aggregate: k is max_by(o_orderkey, o_totalprice), j is min_by(o_orderkey, o_totalprice) }", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS k, arg_min(o_orderkey, o_totalprice) AS j FROM orders GROUP BY 1")
q("agg_bool_bit", "run: orders -> { group_by: o_orderstatus aggregate: a is bool_and(o_totalprice > 0), o is bool_or(big), x is bitwise_xor_agg(o_orderkey), b is bitwise_or_agg(o_custkey) }",
  "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS a, bool_or(o_totalprice > 200000) AS o, bit_xor(o_orderkey) AS x, bit_or(o_custkey) AS b FROM orders GROUP BY 1")
q("agg_corr", "run: li -> { group_by: l_returnflag aggregate: c is round(corr(l_extendedprice, l_quantity), 6) }", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c FROM lineitem GROUP BY 1")
q("agg_path_reference", "run: orders -> { group_by: o_orderstatus aggregate: customer.c_acctbal.sum() }", "SELECT o_orderstatus, sum(b) AS c_acctbal FROM (SELECT DISTINCT o_orderstatus, c_custkey, c_acctbal AS b FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
# --- joins ---------------------------------------------------------------------
q("join_one_chain", "run: orders -> { group_by: customer.nation.region.r_name aggregate: n_orders, total }", "SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("join_with_pk", "run: nation -> { group_by: region.r_name aggregate: n is count() }", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("join_many", "run: orders -> { group_by: o_orderstatus aggregate: lines is li.count(), q is li.l_quantity.sum() }", "SELECT o_orderstatus, count(l_orderkey) AS lines, sum(l_quantity) AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
q("join_cross", "run: region extend { join_cross: n is t.table('nation') } -> { aggregate: pairs is n.count(), rows is count(), k is sum(r_regionkey) }", "SELECT CAST(25 AS BIGINT) AS pairs, CAST(5 AS BIGINT) AS rows, CAST(10 AS BIGINT) AS k")
q("join_inner", "run: nation extend { join_many: c is t.table('customer') inner on n_nationkey = c.c_nationkey and c.c_acctbal > 9000 } -> { group_by: n_name aggregate: k is c.count() }", "SELECT n_name, count(*) AS k FROM nation JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1")
q("join_right", "run: t.table('nation') extend { where: n_nationkey < 0 or n_name is null  join_one: r is t.table('region') right on n_regionkey = r.r_regionkey and n_nationkey < 0 } -> { group_by: r.r_name aggregate: n is count(), k is r.count() }", "SELECT r_name, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS k FROM region")
q("join_full", "run: t.table('region') extend { primary_key: r_regionkey  join_many: n is t.table('nation') full on r_regionkey = n.n_regionkey and n.n_nationkey < 3 } -> { group_by: n.n_name aggregate: k is sum(r_regionkey) }",
  "SELECT n_name, CAST(coalesce(sum(r_regionkey), 0) AS BIGINT) AS k FROM (SELECT DISTINCT n_name, r_regionkey FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 3) GROUP BY 1")
q("join_theta_range", "run: t.table('part') extend { join_many: p is t.table('part') on p_size > p.p_size and p.p_partkey < 20 } -> { group_by: p_brand aggregate: c is p.count() }", "SELECT a.p_brand, count(b.p_partkey) AS c FROM part a LEFT JOIN part b ON a.p_size > b.p_size AND b.p_partkey < 20 GROUP BY 1")
q("join_source_filter_on", "run: t.table('nation') extend { join_many: c is t.table('customer') extend { where: c_acctbal > 5000 } on n_nationkey = c.c_nationkey } -> { group_by: n_name aggregate: k is c.count() }", "SELECT n_name, count(c_custkey) AS k FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY 1")
q("join_pruned", "run: orders -> { aggregate: n_orders }", "SELECT count(*) AS n_orders FROM orders")
q("join_query_source", "run: customer extend { join_one: f is t.table('orders') -> { group_by: o_custkey aggregate: k is count() } on c_custkey = f.o_custkey } -> { group_by: f.k aggregate: n_customers }", "SELECT k, count(*) AS n_customers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) f ON c_custkey = f.o_custkey GROUP BY 1")
q("join_in_stage", "run: nation -> { join_one: r is t.table('region') on n_regionkey = r.r_regionkey group_by: r.r_name aggregate: n is count() }", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
# --- symmetric aggregates --------------------------------------------------------
q("sym_sum_parent", "run: li -> { group_by: l_returnflag aggregate: s is round(o.o_totalprice.sum(), 2), k is o.count() }", "SELECT l_returnflag, round(sum(p), 2) AS s, count(*) AS k FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
q("sym_avg_parent", "run: orders -> { group_by: o_orderstatus aggregate: a is round(avg(o_totalprice), 4), q is li.l_quantity.sum() }", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS a, sum(q) AS q FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders) GROUP BY 1")
q("sym_count_parent", "run: orders -> { group_by: li.l_linestatus aggregate: k is count(), m is li.count() }", "SELECT l_linestatus, count(DISTINCT o_orderkey) AS k, count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
q("sym_leaf_count_unmatched", "run: orders -> { aggregate: lines is li.count(), k is count(), none is count() { where: li.l_orderkey is null } }", "SELECT count(l_orderkey) AS lines, count(DISTINCT o_orderkey) AS k, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS none FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
q("sym_two_branches", "run: nation extend { join_many: c is t.table('customer') extend { primary_key: c_custkey } on n_nationkey = c.c_nationkey  join_many: s is t.table('supplier') extend { primary_key: s_suppkey } on n_nationkey = s.s_nationkey } -> { group_by: n_name aggregate: nc is c.count(), ns is s.count(), b is round(c.c_acctbal.sum(), 2), a is round(s.s_acctbal.sum(), 2) }",
  "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS nc, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS ns, round(coalesce((SELECT sum(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), 0), 2) AS b, round(coalesce((SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), 0), 2) AS a FROM nation")
q("sym_filtered", "run: orders -> { aggregate: a is round(o_totalprice.sum() { where: o_orderstatus = 'O' }, 2), b is li.l_quantity.sum() { where: o_orderstatus = 'O' } }", "SELECT (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'O') AS a, (SELECT sum(l_quantity) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O') AS b")
q("sym_source_grain", "run: orders -> { group_by: o_orderstatus aggregate: k is source.count(), d is count(li.l_partkey), mx is li.l_quantity.max() }", "SELECT o_orderstatus, count(DISTINCT o_orderkey) AS k, count(DISTINCT l_partkey) AS d, max(l_quantity) AS mx FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
# --- ungrouped aggregates ----------------------------------------------------------
q("ungroup_all", "run: orders -> { group_by: o_orderstatus aggregate: n_orders, everything is all(n_orders) }", "SELECT o_orderstatus, count(*) AS n_orders, (SELECT count(*) FROM orders) AS everything FROM orders GROUP BY 1")
q("ungroup_all_fields", "run: orders -> { group_by: o_orderstatus, o_orderpriority aggregate: n_orders, s is all(n_orders, o_orderstatus) }", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS s FROM orders GROUP BY 1, 2")
q("ungroup_exclude", "run: orders -> { group_by: o_orderstatus, o_orderpriority aggregate: n_orders, s is exclude(n_orders, o_orderstatus) }", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS s FROM orders GROUP BY 1, 2")
q("percent_of_total", "run: li -> { group_by: l_returnflag aggregate: p is round(100 * n / all(n), 4) }", "SELECT l_returnflag, round(100 * count(*) / (SELECT count(*) FROM lineitem), 4) AS p FROM lineitem GROUP BY 1")
# --- windows -----------------------------------------------------------------------
q("win_row_number", "run: orders -> { group_by: o_orderpriority aggregate: n_orders calculate: r is row_number() { order_by: o_orderpriority desc } }", "SELECT o_orderpriority, count(*) AS n_orders, row_number() OVER (ORDER BY o_orderpriority DESC) AS r FROM orders GROUP BY 1")
q("win_rank_dense", "run: li -> { group_by: l_linenumber, l_returnflag aggregate: d is count(l_returnflag) calculate: r is rank() { order_by: l_linenumber }, e is dense_rank() { order_by: l_linenumber } }", "SELECT l_linenumber, l_returnflag, CAST(1 AS BIGINT) AS d, rank() OVER (ORDER BY l_linenumber) AS r, dense_rank() OVER (ORDER BY l_linenumber) AS e FROM lineitem GROUP BY 1, 2")
q("win_lag_lead_default", "run: orders -> { group_by: y is year(o_orderdate) aggregate: n_orders calculate: p is lag(n_orders, 1, 0), l is lead(n_orders, 2), q is lag(n_orders) order_by: y }", "SELECT year(o_orderdate) AS y, count(*) AS n_orders, lag(count(*), 1, 0) OVER (ORDER BY year(o_orderdate)) AS p, lead(count(*), 2) OVER (ORDER BY year(o_orderdate)) AS l, lag(count(*)) OVER (ORDER BY year(o_orderdate)) AS q FROM orders GROUP BY 1")
q("win_first_last", "run: orders -> { group_by: o_orderpriority aggregate: n_orders calculate: f is first_value(o_orderpriority), l is last_value(o_orderpriority) order_by: o_orderpriority }", "SELECT o_orderpriority, count(*) AS n_orders, min(o_orderpriority) OVER () AS f, max(o_orderpriority) OVER () AS l FROM orders GROUP BY 1")
q("win_cumulative", "run: orders -> { group_by: y is year(o_orderdate) aggregate: n_orders calculate: s is sum_cumulative(n_orders), lo is min_cumulative(n_orders), hi is max_cumulative(n_orders), t is sum_window(n_orders) order_by: y }",
  "SELECT y, k AS n_orders, CAST(sum(k) OVER (ORDER BY y) AS BIGINT) AS s, min(k) OVER (ORDER BY y) AS lo, max(k) OVER (ORDER BY y) AS hi, CAST(sum(k) OVER () AS BIGINT) AS t FROM (SELECT year(o_orderdate) AS y, count(*) AS k FROM orders GROUP BY 1)")
q("win_moving_avg", "run: orders -> { group_by: o_orderdate.month aggregate: n_orders calculate: a is round(avg_moving(n_orders, 2), 4) order_by: o_orderdate }", "SELECT m AS o_orderdate, k AS n_orders, round(avg(k) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS a FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS k FROM orders GROUP BY 1)")
q("win_moving_sum_fwd", "run: orders -> { group_by: o_orderdate.month aggregate: n_orders calculate: a is sum_moving(n_orders, 1, 2) order_by: o_orderdate }", "SELECT m AS o_orderdate, k AS n_orders, CAST(sum(k) OVER (ORDER BY m ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS a FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS k FROM orders GROUP BY 1)")
q("win_partition_by", "run: orders -> { group_by: o_orderstatus, o_orderpriority aggregate: n_orders calculate: r is row_number() { partition_by: o_orderstatus order_by: o_orderpriority } }", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r FROM orders GROUP BY 1, 2")
q("win_percent_rank", "run: orders -> { group_by: o_orderpriority aggregate: n_orders calculate: p is percent_rank() { order_by: o_orderpriority } }", "SELECT o_orderpriority, count(*) AS n_orders, percent_rank() OVER (ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1")
q("win_of_calculation", "run: orders -> { group_by: o_orderpriority aggregate: n_orders calculate: r is row_number() { order_by: o_orderpriority }, m is -r order_by: o_orderpriority }", "SELECT o_orderpriority, count(*) AS n_orders, row_number() OVER (ORDER BY o_orderpriority) AS r, -row_number() OVER (ORDER BY o_orderpriority) AS m FROM orders GROUP BY 1")
# --- nests, unnested again so that rows compare ------------------------------------
q("nest_array", "run: orders -> { group_by: o_orderstatus nest: p is { group_by: o_orderpriority aggregate: n_orders } } -> { select: o_orderstatus, p.o_orderpriority, p.n_orders }", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders FROM orders GROUP BY 1, 2")
q("nest_record", "run: orders -> { group_by: o_orderstatus nest: r is { aggregate: n_orders, m is max(o_totalprice) } } -> { select: o_orderstatus, r.n_orders, r.m }", "SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS m FROM orders GROUP BY 1")
q("nest_limit", "run: customer -> { group_by: c_mktsegment nest: top is { group_by: c_nationkey aggregate: hi is max(c_acctbal) limit: 3 } } -> { select: c_mktsegment, top.c_nationkey, top.hi }",
  "SELECT c_mktsegment, c_nationkey, hi FROM (SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS hi FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY hi DESC) <= 3")
q("nest_having", "run: customer -> { group_by: c_mktsegment nest: x is { group_by: c_nationkey aggregate: n_customers having: n_customers > 12 } } -> { group_by: c_mktsegment aggregate: k is x.count() }",
  "SELECT c_mktsegment, count(*) FILTER (k > 12) AS k FROM (SELECT c_mktsegment, c_nationkey, count(*) AS k FROM customer GROUP BY 1, 2) GROUP BY 1")
q("nest_two_levels", "run: orders -> { group_by: o_orderstatus nest: a is { group_by: o_orderpriority nest: b is { group_by: y is year(o_orderdate) aggregate: n_orders } } } -> { select: o_orderstatus, a.o_orderpriority, a.b.y, a.b.n_orders }", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n_orders FROM orders GROUP BY 1, 2, 3")
q("nest_project_limit", "run: customer -> { group_by: c_mktsegment nest: rich is { select: c_custkey, c_acctbal order_by: c_acctbal desc limit: 2 } } -> { select: c_mktsegment, rich.c_custkey, rich.c_acctbal }", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) <= 2")
q("nest_multistage", "run: orders -> { group_by: o_orderstatus nest: x is { group_by: o_orderpriority, y is year(o_orderdate) aggregate: n_orders } -> { group_by: y aggregate: k is count(), s is n_orders.sum() } } -> { select: o_orderstatus, x.y, x.k, x.s }",
  "SELECT o_orderstatus, year(o_orderdate) AS y, count(DISTINCT o_orderpriority) AS k, count(*) AS s FROM orders GROUP BY 1, 2")
q("nest_then_unnest", "run: orders -> { group_by: o_orderstatus aggregate: n_orders nest: x is { group_by: o_orderpriority aggregate: c is n_orders } } -> { aggregate: parents is count(), s is sum(n_orders), t is x.c.sum(), k is x.count() }", "SELECT count(DISTINCT o_orderstatus) AS parents, count(*) AS s, count(*) AS t, count(DISTINCT (o_orderstatus, o_orderpriority)) AS k FROM orders")
q("nest_ungroup", "run: orders -> { group_by: o_orderstatus nest: x is { where: big group_by: o_orderpriority aggregate: n_orders, a is all(n_orders), e is exclude(n_orders, o_orderstatus) } } -> { select: o_orderstatus, x.o_orderpriority, x.n_orders, x.a, x.e }",
  "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, (SELECT count(*) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus) AS a, (SELECT count(*) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority) AS e FROM orders o WHERE o_totalprice > 200000 GROUP BY 1, 2")
q("nest_calculate", "run: orders -> { group_by: o_orderstatus nest: x is { group_by: o_orderpriority aggregate: n_orders calculate: r is row_number() { order_by: o_orderpriority } } } -> { select: o_orderstatus, x.o_orderpriority, x.r }", "SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r FROM orders GROUP BY 1, 2")
q("nest_view", "run: orders -> { group_by: big nest: by_status nest: u is urgent + { limit: 1 } } -> { select: big, by_status.o_orderstatus, by_status.n_orders }", "SELECT o_totalprice > 200000 AS big, o_orderstatus, count(*) AS n_orders FROM orders GROUP BY 1, 2")
# --- order, limit, having ------------------------------------------------------------
q("order_default_measure", "run: customer -> { group_by: c_nationkey aggregate: hi is max(c_acctbal) limit: 5 }", "SELECT c_nationkey, max(c_acctbal) AS hi FROM customer GROUP BY 1 ORDER BY 2 DESC LIMIT 5")
q("order_default_dim", "run: nation -> { group_by: n_name limit: 7 }", "SELECT n_name FROM nation ORDER BY 1 LIMIT 7")
q("order_nulls_last", "run: people -> { group_by: maybe limit: 4 order_by: maybe desc }", "SELECT DISTINCT nullif(c_mktsegment, 'BUILDING') AS maybe FROM customer ORDER BY 1 DESC NULLS LAST LIMIT 4")
q("topk", "run: orders -> { select: o_orderkey, o_totalprice order_by: o_totalprice desc, o_orderkey limit: 20 }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 20")
q("having_simple", "run: orders -> { group_by: o_custkey aggregate: n_orders having: n_orders > 12 }", "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(*) > 12")
# --- pipelines and sources -------------------------------------------------------------
q("pipeline_two_stage", "run: orders -> { group_by: o_custkey aggregate: k is count() } -> { group_by: k aggregate: customers is count() }", "SELECT k, count(*) AS customers FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY 1")
q("refine_view", "run: orders -> by_status + { where: big  aggregate: hi is max(o_totalprice) }", "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS hi FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
q("refine_lens", "run: orders -> by_status + o_orderpriority", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
q("drill_view", "run: orders -> { drill: urgent.o_orderstatus = 'F' aggregate: n_orders }", "SELECT count(*) AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
q("sql_source", 'run: t.sql("""SELECT c_mktsegment AS seg, count(*) AS k FROM customer GROUP BY 1""") -> { select: * }', "SELECT c_mktsegment AS seg, count(*) AS k FROM customer GROUP BY 1")
q("sql_interpolation", 'run: t.sql("""SELECT o_orderstatus, n_orders + 1 AS k FROM %{ orders -> by_status }""") -> { select: * }', "SELECT o_orderstatus, count(*) + 1 AS k FROM orders GROUP BY 1")
q("sql_raw_run", 'run: t.sql("""SELECT r_name FROM region""")', "SELECT r_name FROM region")
q("composite_pick", "source: c2 is compose(t.table('nation'), t.table('customer')) run: c2 -> { group_by: c_mktsegment aggregate: n is count() }", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
q("virtual_source", "run: t.virtual('late') -> { group_by: r_name }", "SELECT r_name FROM region")
q("param_source", "source: over(floor::number is 100, seg::string) is t.table('customer') extend { where: c_acctbal > floor and c_mktsegment = seg } run: over(seg is 'BUILDING', floor is 500) -> { aggregate: n is count() }", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 500 AND c_mktsegment = 'BUILDING'")
q("given_in_array", "given: WANTED :: string[] is ['O', 'P'] given: FLOOR :: number is 1000 run: orders -> { aggregate: n_orders where: o_orderstatus in $WANTED and o_totalprice > $FLOOR }", "SELECT count(*) AS n_orders FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 1000")
q("source_rename_except", "run: t.table('part') extend { rename: label is p_name except: p_type } -> { select: * }", "SELECT p_partkey, p_name AS label, p_brand, p_size, p_retailprice FROM part")
q("source_include", "run: t.table('part') include { public: p_partkey, title is p_name private: p_size } extend { dimension: twice is p_size * 2 } -> { select: p_partkey, title, twice }", "SELECT p_partkey, p_name AS title, p_size * 2 AS twice FROM part")
q("source_typed", "type: Named is { r_name :: string } run: t.table('region')::Named -> { select: * }", "SELECT r_name FROM region")
q("source_where", "run: orders extend { where: o_orderstatus = 'F' } -> { aggregate: n_orders, a is all(n_orders) }", "SELECT count(*) AS n_orders, count(*) AS a FROM orders WHERE o_orderstatus = 'F'")
q("query_as_source", "source: per_day is events -> { group_by: ts.day aggregate: n } run: per_day -> { aggregate: days is count(), busiest is max(n) }", "SELECT count(*) AS days, max(k) AS busiest FROM (SELECT count(*) AS k FROM events GROUP BY date_trunc('day', ts))")
q("stage_extend", "run: orders -> { extend: { dimension: y is year(o_orderdate) measure: hi is max(o_totalprice) } group_by: y aggregate: hi }", "SELECT year(o_orderdate) AS y, max(o_totalprice) AS hi FROM orders GROUP BY 1")
# --- index ------------------------------------------------------------------------------
q("index_fields", "run: nation -> { index: n_name, n_nationkey, region.r_name }",
  "SELECT 'n_name' AS \"fieldName\", 'n_name' AS \"fieldPath\", n_name AS \"fieldValue\", 'string' AS \"fieldType\", count(*) AS weight FROM nation GROUP BY n_name UNION ALL SELECT 'n_nationkey', 'n_nationkey', min(n_nationkey) || ' to ' || max(n_nationkey), 'number', count(*) FROM nation UNION ALL SELECT 'region.r_name', 'region/r_name', r_name, 'string', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
q("index_weighted", "run: orders -> { index: o_orderstatus, o_orderpriority by n_orders }",
  "SELECT 'o_orderstatus' AS \"fieldName\", 'o_orderstatus' AS \"fieldPath\", o_orderstatus AS \"fieldValue\", 'string' AS \"fieldType\", CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', 'o_orderpriority', o_orderpriority, 'string', count(*) FROM orders GROUP BY o_orderpriority")
# --- time --------------------------------------------------------------------------------
for _u in ("second", "minute", "hour", "day", "month", "quarter", "year"):
    q(f"time_trunc_{_u}", f"run: events -> {{ group_by: ts.{_u} aggregate: n }}", f"SELECT date_trunc('{_u}', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
q("time_trunc_week", "run: events -> { group_by: ts.week aggregate: n }", "SELECT date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS ts, count(*) AS n FROM events GROUP BY 1")
for _u, _x in (("year", "year(ts)"), ("quarter", "quarter(ts)"), ("month", "month(ts)"), ("week", "week(ts)"), ("day", "day(ts)"), ("hour", "hour(ts)"), ("minute", "minute(ts)"), ("second", "second(ts)"), ("day_of_week", "dayofweek(ts) + 1"), ("day_of_year", "dayofyear(ts)")):
    q(f"time_extract_{_u}", f"run: events -> {{ group_by: v is {_u}(ts) aggregate: n }}", f"SELECT CAST({_x} AS INTEGER) AS v, count(*) AS n FROM events GROUP BY 1")
q("time_offset", "run: orders -> { select: o_orderkey, a is o_orderdate + 3 days, b is o_orderdate - 2 months, c is o_orderdate + 5 hours, d is o_orderdate + 1 week, e is o_orderdate.month + 1 }",
  "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 5 HOUR AS c, o_orderdate + INTERVAL 7 DAY AS d, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS e FROM orders")
q("time_diff", "run: events -> { select: event_id, d is days(@2024-01-01 00:00:00 to ts), h is hours(@2024-01-01 00:00:00 to ts), s is seconds(ts to @2024-02-01 00:00:00) }", "SELECT event_id, date_sub('day', TIMESTAMP '2024-01-01', ts) AS d, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS h, date_sub('second', ts, TIMESTAMP '2024-02-01') AS s FROM events")
q("time_diff_months", "run: orders -> { select: o_orderkey, m is months(@1995-01-01 to o_orderdate.day::date), y is years(@1995-01-01 to o_orderdate.day::date), w is weeks(@1995-01-01 to o_orderdate.day::date) }",
  "SELECT o_orderkey, date_sub('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS m, date_sub('year', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS y, date_sub('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS w FROM orders")
q("time_granular_eq", "run: events -> { aggregate: a is count() { where: ts ? @2024-01-10 }, b is count() { where: ts > @2024-01-10 }, c is count() { where: ts <= @2024-01-10 }, d is count() { where: ts != @2024-01 }, e is count() { where: ts ? @2024-01-10 10 } }",
  "SELECT count(*) FILTER (ts >= '2024-01-10' AND ts < '2024-01-11') AS a, count(*) FILTER (ts >= '2024-01-11') AS b, count(*) FILTER (ts < '2024-01-11') AS c, count(*) FILTER (ts < '2024-01-01' OR ts >= '2024-02-01') AS d, count(*) FILTER (ts >= '2024-01-10 10:00:00' AND ts < '2024-01-10 11:00:00') AS e FROM events")
q("time_literal_ranges", "run: orders -> { aggregate: a is count() { where: o_orderdate ? @1996-Q2 }, b is count() { where: o_orderdate ? @1996 for 18 months }, c is count() { where: o_orderdate ? @1997-01-05-WK }, d is count() { where: o_orderdate ? @1995-02 to @1996 } }",
  "SELECT count(*) FILTER (o_orderdate >= '1996-04-01' AND o_orderdate < '1996-07-01') AS a, count(*) FILTER (o_orderdate >= '1996-01-01' AND o_orderdate < '1997-07-01') AS b, count(*) FILTER (o_orderdate >= '1997-01-05' AND o_orderdate < '1997-01-12') AS c, count(*) FILTER (o_orderdate >= '1995-02-01' AND o_orderdate < '1996-01-01') AS d FROM orders")
q("time_timezone_trunc", "run: events extend { timezone: 'America/Los_Angeles' } -> { group_by: ts.day, h is hour(ts) aggregate: n }",
  "SELECT date_trunc('day', ts - INTERVAL 8 HOUR) + INTERVAL 8 HOUR AS ts, CAST(hour(ts - INTERVAL 8 HOUR) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY 1, 2")
# --- filter languages -----------------------------------------------------------------------
for _n, _f, _s in (
    ("list", "BUILDING, MACHINERY", "m IN ('BUILDING', 'MACHINERY')"), ("exclude", "-MACHINERY", "m IS NULL OR m <> 'MACHINERY'"), ("starts", "B%, F%", "m LIKE 'B%' OR m LIKE 'F%'"), ("contains", "%UR%", "m LIKE '%UR%'"),
    ("mixed", "%E, -FURNITURE", "m LIKE '%E' AND (m IS NULL OR m <> 'FURNITURE')"), ("null", "null", "m IS NULL"), ("not_null", "-null", "m IS NOT NULL"), ("none", "none", "false"), ("and", "%I%; -%G", "m LIKE '%I%' AND (m IS NULL OR m NOT LIKE '%G')"), ("empty", "-empty", "m IS NOT NULL AND m <> ''"),
):
    q(f"filter_string_{_n}", f"run: people -> {{ aggregate: n is count() where: maybe ~ f'{_f}' }}", f"SELECT count(*) AS n FROM (SELECT nullif(c_mktsegment, 'HOUSEHOLD') AS x, nullif(c_mktsegment, 'BUILDING') AS m FROM customer) WHERE {_s}")
for _n, _f, _s in (
    ("list", "1, 3, 5", "v IN (1, 3, 5)"), ("range", "[3 to 7)", "v >= 3 AND v < 7"), ("compare", "> 20 or < 2", "v > 20 OR v < 2"), ("not", "not 4", "v IS NULL OR v <> 4"), ("unequal", "!= 1, 2", "v IS NULL OR v NOT IN (1, 2)"), ("and", "> 3 and <= 9", "v > 3 AND v <= 9"), ("not_range", "not (3 to 7]", "NOT (v > 3 AND v <= 7)"),
):
    q(f"filter_number_{_n}", f"run: customer -> {{ aggregate: n is count() where: c_nationkey ~ f'{_f}' }}", f"SELECT count(*) AS n FROM (SELECT c_nationkey AS v FROM customer) WHERE {_s}")
for _n, _f, _s in (("true", "true", "coalesce(h, false)"), ("false", "false", "NOT coalesce(h, false)"), ("eq_false", "=false", "NOT h"), ("null", "null", "h IS NULL"), ("not_true", "not true", "NOT coalesce(h, false)")):
    q(f"filter_boolean_{_n}", f"run: people -> {{ aggregate: n is count() where: half ~ f'{_f}' }}", f"SELECT count(*) AS n FROM (SELECT nullif(c_acctbal > 0, true) AS h FROM customer) WHERE {_s}")
for _n, _f, _s in (
    ("before", "before 2024-01-10", "ts < '2024-01-10'"), ("after", "after 2024-01-10", "ts >= '2024-01-11'"), ("starting", "starting 2024-01-10 12:00", "ts >= '2024-01-10 12:00:00'"), ("through", "through 2024-01-10", "ts < '2024-01-11'"), ("day", "2024-01-10", "ts >= '2024-01-10' AND ts < '2024-01-11'"),
    ("month", "2024-01", "ts >= '2024-01-01' AND ts < '2024-02-01'"), ("to", "2024-01-05 to 2024-01-10", "ts >= '2024-01-05' AND ts < '2024-01-10'"), ("for", "2024-01-05 for 3 days", "ts >= '2024-01-05' AND ts < '2024-01-08'"), ("or", "2024-01-05 or after 2024-01-20", "(ts >= '2024-01-05' AND ts < '2024-01-06') OR ts >= '2024-01-21'"), ("not", "not 2024-01-05", "ts < '2024-01-05' OR ts >= '2024-01-06'"),
):
    q(f"filter_temporal_{_n}", f"run: events -> {{ aggregate: n where: ts ~ f'{_f}' }}", f"SELECT count(*) AS n FROM events WHERE {_s}")
# --- functions ---------------------------------------------------------------------------------
q("fn_math", "run: orders -> { select: o_orderkey, a is abs(-o_orderkey), b is ceil(o_totalprice), c is floor(o_totalprice), d is round(o_totalprice, 1), e is trunc(o_totalprice), f is div(o_orderkey, 7), g is sign(-o_orderkey), h is round(sqrt(o_orderkey), 6), i is round(ln(o_orderkey + 1), 6), j is round(log(o_orderkey + 1, 10), 6), k is pow(o_orderkey % 5, 2), l is greatest(o_orderkey, 100), m is least(o_orderkey, 100) }",
  "SELECT o_orderkey, abs(-o_orderkey) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS b, CAST(floor(o_totalprice) AS BIGINT) AS c, round(o_totalprice, 1) AS d, trunc(o_totalprice) AS e, o_orderkey // 7 AS f, CAST(sign(-o_orderkey) AS INTEGER) AS g, round(sqrt(o_orderkey), 6) AS h, round(ln(o_orderkey + 1), 6) AS i, round(log10(o_orderkey + 1), 6) AS j, pow(o_orderkey % 5, 2) AS k, greatest(o_orderkey, 100) AS l, least(o_orderkey, 100) AS m FROM orders")
q("fn_trig", "run: orders -> { select: o_orderkey, a is round(sin(o_orderkey), 8), b is round(cos(o_orderkey), 8), c is round(atan2(o_orderkey, 3), 8), d is round(exp(o_orderkey % 5), 6), e is round(pi(), 6), f is is_nan(o_totalprice), g is is_inf(o_totalprice) }",
  "SELECT o_orderkey, round(sin(o_orderkey), 8) AS a, round(cos(o_orderkey), 8) AS b, round(atan2(o_orderkey, 3), 8) AS c, round(exp(o_orderkey % 5), 6) AS d, round(pi(), 6) AS e, isnan(o_totalprice) AS f, isinf(o_totalprice) AS g FROM orders")
q("fn_string", "run: customer -> { select: c_custkey, a is upper(c_name), b is lower(c_mktsegment), c is length(c_name), d is substr(c_name, 2, 3), e is substr(c_name, -3), f is strpos(c_name, 'r'), g is concat(c_mktsegment, '-', c_custkey), h is replace(c_name, 'u', 'U'), i is reverse(c_name), j is trim('  x '), k is starts_with(c_name, 'C'), l is ends_with(c_name, '1'), m is repeat('ab', 2), n is byte_length(c_name), o is ascii(c_name), p is chr(65) }",
  "SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, CAST(length(c_name) AS INTEGER) AS c, substr(c_name, 2, 3) AS d, substr(c_name, -3) AS e, CAST(strpos(c_name, 'r') AS INTEGER) AS f, c_mktsegment || '-' || c_custkey AS g, replace(c_name, 'u', 'U') AS h, reverse(c_name) AS i, trim('  x ') AS j, starts_with(c_name, 'C') AS k, ends_with(c_name, '1') AS l, repeat('ab', 2) AS m, CAST(strlen(c_name) AS INTEGER) AS n, CAST(ascii(c_name) AS INTEGER) AS o, chr(65) AS p FROM customer")
q("fn_null", "run: people -> { select: c_custkey, a is coalesce(maybe, 'x'), b is ifnull(maybe, 'y'), c is nullif(c_nationkey, 3), d is greatest(c_custkey, nullif(c_nationkey, 3)), e is starts_with(maybe, 'M'), f is concat(maybe, '!') }",
  "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'x') AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'y') AS b, nullif(c_nationkey, 3) AS c, CASE WHEN c_nationkey <> 3 THEN greatest(c_custkey, c_nationkey) END AS d, coalesce(starts_with(nullif(c_mktsegment, 'BUILDING'), 'M'), false) AS e, concat(nullif(c_mktsegment, 'BUILDING'), '!') AS f FROM customer")
q("fn_regex", "run: customer -> { select: c_custkey, a is replace(c_name, r'[0-9]+', '#'), b is regexp_extract(c_name, r'[1-9][0-9]*'), c is regexp_like(c_name, r'1$'), d is replace(c_name, r'^(.)(.)', '\\\\2\\\\1') }",
  "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS a, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS b, regexp_matches(c_name, '1$') AS c, regexp_replace(c_name, '^(.)(.)', '\\2\\1') AS d FROM customer")
q("fn_url", "run: pages -> { select: page_id, h is url_extract_host(url), p is url_extract_protocol(url), r is url_extract_parameter(url, 'page') }",
  "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS p, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS r FROM pages")
q("fn_json", "run: events -> { select: event_id, k is json_extract_scalar(props, '$.k') }", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
q("fn_time_convert", "run: events -> { select: event_id, u is to_unixtime(ts), b is from_unixtime(event_id), d is dayname(ts), f is date_format(ts, '%Y/%m/%d') }", "SELECT event_id, epoch_us(ts) / 1000000 AS u, make_timestamp(event_id * 1000000) AS b, dayname(ts) AS d, strftime(ts, '%Y/%m/%d') AS f FROM events")
q("fn_raw_call", "run: customer -> { select: c_custkey, h is md5!string(c_name), s is sql_number('length(${c_name}) + 1') }", "SELECT c_custkey, md5(c_name) AS h, CAST(length(c_name) + 1 AS INTEGER) AS s FROM customer")
# --- arrays and records ---------------------------------------------------------------------------
q("unnest_embedding", "run: emb -> { select: vec_id, v is embedding.value }", "SELECT vec_id, unnest(embedding) AS v FROM embeddings")
q("unnest_sum", "run: emb -> { group_by: label aggregate: k is embedding.count(), n is count(), s is round(embedding.value.sum(), 4) }", "SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS k, count(*) AS n, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS s FROM embeddings GROUP BY 1")
q("array_literal", "run: region extend { dimension: a is [1, 2, r_regionkey] } -> { group_by: r_name aggregate: s is a.each.sum(), k is a.count() }", "SELECT r_name, 3 + r_regionkey AS s, CAST(3 AS BIGINT) AS k FROM region")
q("record_literal", "run: region extend { dimension: r is { key is r_regionkey, name is r_name } } -> { select: a is r.key, b is r.name }", "SELECT r_regionkey AS a, r_name AS b FROM region")
q("group_by_array", "run: nation extend { dimension: a is [n_regionkey, 1] } -> { group_by: a aggregate: n is count() } -> { select: first is list_extract(a, 1), n }", "SELECT n_regionkey AS first, count(*) AS n FROM nation GROUP BY 1")
q("fn_array_basic", "run: emb -> { select: vec_id, n is cardinality(embedding), hi is array_max(embedding), lo is array_min(embedding), first is element_at(embedding, 1), last is element_at(embedding, -1), p is array_position(embedding, element_at(embedding, 3)), t is cardinality(slice(embedding, 2, 5)) }",
  "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS hi, list_min(embedding) AS lo, embedding[1] AS first, embedding[-1] AS last, CAST(list_position(embedding, embedding[3]) AS BIGINT) AS p, CAST(5 AS INTEGER) AS t FROM embeddings")
q("fn_array_sets", "run: nation extend { dimension: a is [n_regionkey, 2, 2], b is [2, 3] } -> { select: n_nationkey, d is array_join(array_distinct(a)::'array<string>', '-'), i is cardinality(array_intersect(a, b)), u is cardinality(array_union(a, b)), e is cardinality(array_except(a, b)), o is arrays_overlap(a, b), c is contains(a, 4), f is array_has_duplicates(a), s is array_sum(a), m is cardinality(array_remove(a, 2)) }",
  "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN '2' ELSE n_regionkey || '-2' END AS d, CASE WHEN n_regionkey IN (2, 3) THEN 1 + (n_regionkey = 3)::INT ELSE 1 END AS i, CASE WHEN n_regionkey IN (2, 3) THEN 2 ELSE 3 END AS u, CASE WHEN n_regionkey IN (2, 3) THEN 0 ELSE 1 END AS e, true AS o, n_regionkey = 4 AS c, true AS f, CAST(n_regionkey + 4 AS DOUBLE) AS s, CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END AS m FROM nation")
q("fn_array_order", "run: nation extend { dimension: a is [n_regionkey, 9, 5] } -> { select: n_nationkey, s is array_join(array_sort(a)::'array<string>', ','), d is array_join(array_sort_desc(a)::'array<string>', ','), t is array_join(array_top_n(a, 2)::'array<string>', ','), c is array_join(array_cum_sum(a)::'array<int>'::'array<string>', ','), g is cardinality(ngrams(a, 2)), k is cardinality(combinations(a, 2)), h is cardinality(array_split_into_chunks(a, 2)), m is array_average(a) }",
  "SELECT n_nationkey, n_regionkey || ',5,9' AS s, '9,5,' || n_regionkey AS d, '9,5' AS t, n_regionkey || ',' || (n_regionkey + 9) || ',' || (n_regionkey + 14) AS c, CAST(2 AS INTEGER) AS g, CAST(3 AS INTEGER) AS k, CAST(2 AS INTEGER) AS h, (n_regionkey + 14) / 3 AS m FROM nation")
q("fn_array_agg", "run: nation -> { group_by: n_regionkey aggregate: k is array_agg_distinct(n_name), n is count() } -> { select: n_regionkey, names is array_join(k, ','), n }", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1")
q("group_by_expression_measure", "run: li -> { group_by: supplier.nation.n_name, part.p_brand aggregate: qty where: l_shipdate ? @1996 having: qty > 200 }", "SELECT n_name, p_brand, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY 1, 2 HAVING sum(l_quantity) > 200")

# --- functions that have no query above ------------------------------------------------------------
q("fn_trig_inverse", "run: orders -> { select: o_orderkey, a is round(acos(1 / o_orderkey), 8), b is round(asin(1 / o_orderkey), 8), c is round(atan(o_orderkey), 8), d is round(tan(o_orderkey % 7), 6) where: o_orderkey > 0 }",
  "SELECT o_orderkey, round(acos(1.0 / o_orderkey), 8) AS a, round(asin(1.0 / o_orderkey), 8) AS b, round(atan(o_orderkey), 8) AS c, round(tan(o_orderkey % 7), 6) AS d FROM orders WHERE o_orderkey > 0")
q("fn_rand", "run: orders -> { select: o_orderkey, inside is rand() >= 0 and rand() < 1 }", "SELECT o_orderkey, true AS inside FROM orders")
q("fn_bitwise", "run: orders -> { select: o_orderkey, a is bitwise_and(o_orderkey, 12), b is bitwise_or(o_orderkey, 12) }", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS b FROM orders")
q("fn_trim_sides", "run: customer -> { select: c_custkey, a is ltrim('  x '), b is rtrim('  x '), c is ltrim(c_name, 'C'), d is rtrim(c_name, '0123456789'), e is string_repeat(c_mktsegment, 2), f is unicode(c_mktsegment), g is unicode('é') }",
  "SELECT c_custkey, 'x ' AS a, '  x' AS b, ltrim(c_name, 'C') AS c, rtrim(c_name, '0123456789') AS d, repeat(c_mktsegment, 2) AS e, unicode(c_mktsegment) AS f, CAST(233 AS INTEGER) AS g FROM customer")
q("fn_split", "run: pages -> { select: page_id, n is cardinality(split(url, '/')), b is split_part(url, '/', 3), last is element_at(split(url, '.'), -1) }", "SELECT page_id, CAST(len(string_split(url, '/')) AS INTEGER) AS n, split_part(url, '/', 3) AS b, string_split(url, '.')[-1] AS last FROM pages")
q("fn_regexp_replace", "run: customer -> { select: c_custkey, a is regexp_replace(c_name, '[0-9]+', '#'), b is regexp_replace(c_name, '[aeiou]'), c is regexp_extract(c_name, '([a-z]+).([0-9]+)', 2) }",
  "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS a, regexp_replace(c_name, '[aeiou]', '', 'g') AS b, regexp_extract(c_name, '([a-z]+).([0-9]+)', 2) AS c FROM customer")
q("fn_url_parts", "run: pages -> { select: page_id, p is url_extract_path(url), q is coalesce(url_extract_query(url), '-'), f is url_extract_fragment('https://a.b/c#top'), o is url_extract_port('https://a.b:8080/x'), z is url_extract_port(url) }",
  "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, coalesce(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '-') AS q, 'top' AS f, CAST(8080 AS BIGINT) AS o, CAST(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1), '') AS BIGINT) AS z FROM pages")
q("fn_time_from_numbers", "run: events -> { select: event_id, a is to_timestamp(event_id), b is date_from_unix_date(event_id), c is date_part('seconds', to_seconds(event_id)), d is date_part('minute', to_seconds(event_id)), e is date_part('hour', to_seconds(event_id * 10)) }",
  "SELECT event_id, make_timestamp(event_id * 1000000) AS a, DATE '1970-01-01' + CAST(event_id AS INTEGER) AS b, date_part('seconds', to_seconds(event_id)) AS c, date_part('minute', to_seconds(event_id)) AS d, date_part('hour', to_seconds(event_id * 10)) AS e FROM events")
q("fn_date_patterns", "run: events -> { select: event_id, a is date_format(ts, '%Y-%m-%dT%H:%i:%s'), b is date_format(ts, '%e %c %k %y'), c is date_parse(date_format(ts, '%Y%m%d %H%i%S'), '%Y%m%d %H%i%S'), d is date_format(ts, '%j of %Y, %%') }",
  "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS a, strftime(ts, '%-d %-m %-H %y') AS b, date_trunc('second', ts) AS c, strftime(ts, '%j of %Y, %%') AS d FROM events")
q("fn_sql_kinds", "run: customer -> { select: c_custkey, s is sql_string('upper(${c_mktsegment})'), b is sql_boolean('${c_acctbal} > 0'), n is sql_number('${c_custkey} * 2') } ",
  "SELECT c_custkey, upper(c_mktsegment) AS s, c_acctbal > 0 AS b, c_custkey * 2 AS n FROM customer")
q("fn_sql_times", "run: orders -> { select: o_orderkey, d is sql_date('to_date(${o_orderdate})'), t is sql_timestamp(\"${o_orderdate} + interval '1 day'\") }", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderdate + INTERVAL 1 DAY AS t FROM orders")
q("fn_sequence", "run: nation -> { select: n_nationkey, a is cardinality(sequence(0, n_nationkey)), b is array_join(sequence(0, 10, 5)::'array<string>', ','), c is cardinality(sequence(@2024-01-01, @2024-01-10)) }",
  "SELECT n_nationkey, CAST(n_nationkey + 1 AS INTEGER) AS a, '0,5,10' AS b, CAST(10 AS INTEGER) AS c FROM nation")
q("fn_array_more", """run: nation extend { dimension: a is [n_regionkey, 7, null, 7, 9], b is [[1, 2], [n_regionkey]] } -> {
  select: n_nationkey, f is array_join(flatten(b)::'array<string>', ','), s is array_join(array_sort(shuffle([3, 1, 2]))::'array<string>', ','), r is cardinality(remove_nulls(a)), d is array_join(array_duplicates(a)::'array<string>', ','),
  l is array_join(array_least_frequent([n_regionkey + 20, 5, 5])::'array<string>', ','), l2 is array_join(array_least_frequent([8, 5, 5, 7, 7, 7], 2)::'array<string>', ','), t is array_join(trim_array([1, 2, 3], 1)::'array<string>', ','),
  n is round(element_at(array_normalize([3.0, 4.0], 2), 1), 6), k is array_repeat(n_regionkey, 2)::'array<string>', p is array_position([5, 6, 5], 5, 2) }""",
  "SELECT n_nationkey, '1,2,' || n_regionkey AS f, '1,2,3' AS s, CAST(4 AS INTEGER) AS r, '7' AS d, CAST(n_regionkey + 20 AS VARCHAR) AS l, '8,5' AS l2, '1,2' AS t, CAST(0.6 AS DOUBLE) AS n, [CAST(n_regionkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)] AS k, CAST(3 AS INTEGER) AS p FROM nation")
q("fn_combinations", "run: nation -> { select: n_nationkey, a is cardinality(combinations([1, 2, 3, 4, 5, 6, 7], 6)), b is cardinality(combinations([1, 2, 3, 4, 5, 6, 7], 3)), c is cardinality(combinations([1, 2], 3)), d is cardinality(flatten(combinations([1, 2, 3, 4, 5, 6, 7], 7))) }",
  "SELECT n_nationkey, CAST(7 AS INTEGER) AS a, CAST(35 AS INTEGER) AS b, CAST(0 AS INTEGER) AS c, CAST(7 AS INTEGER) AS d FROM nation")
q("win_min_max", "run: orders -> { group_by: o_orderpriority aggregate: n_orders calculate: lo is min_window(n_orders), hi is max_window(n_orders) }", "SELECT o_orderpriority, count(*) AS n_orders, min(count(*)) OVER () AS lo, max(count(*)) OVER () AS hi FROM orders GROUP BY 1")
q("agg_string_agg_distinct", "run: orders -> { group_by: o_orderstatus aggregate: p is string_agg_distinct(o_orderpriority), s is string_agg_distinct(o_orderpriority, ' / ') }", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p, string_agg(DISTINCT o_orderpriority, ' / ' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1")
q("agg_string_agg_fan_out", "run: region extend { join_many: n is t.table('nation') on r_regionkey = n.n_regionkey } -> { aggregate: r is string_agg(r_name, ',') { order_by: r_name }, n is n.n_name.string_agg(',') { order_by: n.n_name } }",
  "SELECT (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS r, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation JOIN region ON n_regionkey = r_regionkey) AS n")
q("agg_arbitrary", "run: nation -> { group_by: n_regionkey aggregate: a is arbitrary(region.r_name), b is bitwise_and_agg(n_nationkey) }", "SELECT n_regionkey, min(r_name) AS a, bit_and(n_nationkey) AS b FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("agg_arrays", "run: nation -> { group_by: n_regionkey aggregate: s is set_agg(n_nationkey % 3), a is array_agg(n_nationkey) { order_by: n_nationkey } } -> { select: n_regionkey, s is array_join(s::'array<string>', ','), a is array_join(array_sort(a)::'array<string>', ',') }",
  "SELECT n_regionkey, (SELECT string_agg(x, ',') FROM (SELECT unnest(list_sort(list(DISTINCT n_nationkey % 3))) AS x)) AS s, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS a FROM nation GROUP BY 1")
q("agg_set_union", "run: nation extend { dimension: a is [n_nationkey % 2, 7] } -> { group_by: n_regionkey aggregate: u is set_union(a) } -> { select: n_regionkey, u is array_join(u::'array<string>', ',') }",
  "SELECT n_regionkey, array_to_string(list_sort(list_distinct(flatten(list([n_nationkey % 2, 7])))), ',') AS u FROM nation GROUP BY 1")
q("source_declare", "source: declared is t.table('orders') extend { declare: cents is o_totalprice * 100, n_all is count(), hi is max(cents) } run: declared -> { group_by: o_orderstatus aggregate: n_all, hi is round(hi, 2) }", "SELECT o_orderstatus, count(*) AS n_all, round(max(o_totalprice * 100), 2) AS hi FROM orders GROUP BY 1")
q("time_now", "run: events -> { aggregate: past is count() { where: ts < now }, later is count() { where: ts > now + 1 day }, n }", "SELECT count(*) FILTER (ts < now()::timestamp) AS past, count(*) FILTER (ts > now()::timestamp + INTERVAL 1 DAY) AS later, count(*) AS n FROM events")
q("deep_unnest", "source: tree is orders -> { group_by: o_orderstatus nest: by_p is { group_by: o_orderpriority nest: by_y is { group_by: y is year(o_orderdate) aggregate: n_orders, t is round(o_totalprice.sum(), 2) } } } run: tree -> { group_by: by_p.by_y.y aggregate: n is by_p.by_y.n_orders.sum(), p is count(by_p.o_orderpriority), hi is by_p.by_y.t.max() }",
  "SELECT y, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT o_orderpriority) AS p, max(t) AS hi FROM (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS k, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1, 2, 3) GROUP BY 1")
q("index_sample", "run: orders -> { index: o_orderstatus, o_orderpriority sample: true }",
  "SELECT 'o_orderstatus' AS \"fieldName\", 'o_orderstatus' AS \"fieldPath\", o_orderstatus AS \"fieldValue\", 'string' AS \"fieldType\", count(*) AS weight FROM orders GROUP BY 3 UNION ALL SELECT 'o_orderpriority', 'o_orderpriority', o_orderpriority, 'string', count(*) FROM orders GROUP BY 3")
q("grouped_by_contract", "source: contract is t.table('orders') extend { measure: per_status is o_totalprice.max() { grouped_by: o_orderstatus } } run: contract -> { group_by: o_orderstatus aggregate: per_status }", "SELECT o_orderstatus, max(o_totalprice) AS per_status FROM orders GROUP BY 1")
# Filters relative to now: the events are moved so that the last of them is today.
_MOVED = 'source: recent is t.sql("""SELECT event_id, ts + make_dt_interval(datediff(to_date(now()), to_date(hi))) AS ts FROM events CROSS JOIN (SELECT max(ts) AS hi FROM events)""") '
_MOVED_SQL = "(SELECT event_id, ts + INTERVAL 1 DAY * date_diff('day', hi, d) AS ts, d FROM events, (SELECT max(ts) AS hi FROM events), (SELECT date_trunc('day', now()::timestamp) AS d))"
for _n, _f, _s in (
    ("last_n", "last 7 days", "ts >= d - INTERVAL 7 DAY AND ts < d"), ("n_units", "7 days", "ts >= d - INTERVAL 6 DAY AND ts < d + INTERVAL 1 DAY"), ("next_n", "next 2 days", "ts >= d + INTERVAL 1 DAY AND ts < d + INTERVAL 3 DAY"), ("last_unit", "last week", "ts >= d - INTERVAL 1 DAY * (dayofweek(d) + 7) AND ts < d - INTERVAL 1 DAY * dayofweek(d)"),
    ("this_unit", "this month", "ts >= date_trunc('month', d) AND ts < date_trunc('month', d) + INTERVAL 1 MONTH"), ("today", "today", "ts >= d AND ts < d + INTERVAL 1 DAY"), ("yesterday", "yesterday", "ts >= d - INTERVAL 1 DAY AND ts < d"), ("ago", "3 days ago", "ts >= d - INTERVAL 3 DAY AND ts < d - INTERVAL 2 DAY"),
    ("before_ago", "before 5 days ago", "ts < d - INTERVAL 5 DAY"), ("weekday", "last monday", "ts >= d - INTERVAL 1 DAY * ((dayofweek(d) + 5) % 7 + 1) AND ts < d - INTERVAL 1 DAY * ((dayofweek(d) + 5) % 7)"), ("not_last", "not last 7 days", "ts < d - INTERVAL 7 DAY OR ts >= d"), ("after_now", "after now", "ts >= now()::timestamp"),
):
    q(f"filter_temporal_{_n}", f"{_MOVED}run: recent -> {{ aggregate: n is count() where: ts ~ f'{_f}' }}", f"SELECT count(*) AS n FROM {_MOVED_SQL} WHERE {_s}")


_MODELS: dict[tuple[str, str], Model] = {}


def model(spark: SparkSession, sf_dir: str) -> Model:
    """The model above over one folder of tables; schemas are read once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS or _MODELS[key].spark is not spark:
        made = Model(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES}, virtual={"late": "region"})
        _MODELS[key] = made.load(MODEL)
    return _MODELS[key]


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: model(spark, sf_dir).run(CATALOGUE[name][0])


# --- entry points beyond one text -----------------------------------------------------------------


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).search("nation", "nation_1").select("fieldName", "fieldValue", "weight")


def partition_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    base = m.sources["orders"].copy()
    base.partition = ("o_orderstatus", {"O": ["o_custkey"], "F": ["o_custkey", "o_totalprice"]})
    m.sources["parted"] = base
    return m.run("run: parted -> { aggregate: n is count(), hi is max(o_totalprice) }")


def approx_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates against what they estimate: within 5 % (ranks: 0.05)."""
    return model(spark, sf_dir).run("""run: li -> { group_by: l_returnflag aggregate:
      a is count_approx(l_partkey), e is count(l_partkey), h is hll_estimate(hll_accumulate(l_partkey)), p is approx_percentile(l_quantity, 0.5),
      under is count(), hx is hll_estimate(hll_import(hll_export(hll_accumulate(l_partkey)))) } -> {
      select: l_returnflag, count_near is abs(a - e) <= 0.05 * e, hll_near is abs(h - e) <= 0.05 * e, same is h = hx, median_near is p >= 24 and p <= 27 }""")


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and HyperLogLog sketches, merged, against exact answers."""
    return model(spark, sf_dir).run("""run: li -> { group_by: l_returnflag, l_linestatus aggregate: d is tdigest_agg(l_extendedprice), h is hll_accumulate(l_partkey) }
      -> { group_by: l_returnflag aggregate: d is merge_tdigest(d), h is hll_combine(h) }
      -> { select: l_returnflag, m is value_at_quantile(d, 0.5), r is quantile_at_value(d, 40000), t is trimmed_mean(d, 0.1, 0.9), n is hll_estimate(h),
           n2 is element_at(values_at_quantiles(merge_tdigest_array([d, scale_tdigest(d, 3)]), [0.5]), 1), lo is value_at_quantile(d, 0), hi is value_at_quantile(d, 1),
           made is value_at_quantile(construct_tdigest([1.0, 2.0, 9.0], [1.0, 1.0, 2.0], 1, 9, 21, 4, 100), 0.9) }""").select(
        "l_returnflag", F.col("m").alias("median"), F.col("r").alias("rank"), F.col("t").alias("trimmed"), F.col("n").alias("parts"), F.abs(F.col("n2") / F.col("m") - 1).alias("moved"), "lo", "hi", "made"
    )


def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests' answers held to error bounds against exact ones."""
    exact = model(spark, sf_dir).run("run: li -> { select: l_returnflag, l_extendedprice, l_partkey }").groupBy("l_returnflag").agg(
        F.percentile("l_extendedprice", F.array(F.lit(0.46), F.lit(0.54))).alias("q"), F.avg(F.when(F.col("l_extendedprice") <= 40000, 1.0).otherwise(0.0)).alias("share"), F.countDistinct("l_partkey").alias("e"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.avg("l_extendedprice").alias("mean"),
    )
    both = sketches(spark, sf_dir).join(exact, "l_returnflag")
    return both.select(
        "l_returnflag",
        F.col("median").between(F.col("q")[0], F.col("q")[1]).alias("median_near"),
        (F.abs(F.col("rank") - F.col("share")) < 0.04).alias("rank_near"),
        (F.abs(F.col("trimmed") / F.col("mean") - 1) < 0.1).alias("trimmed_near"),
        (F.abs(F.col("parts") / F.col("e") - 1) < 0.05).alias("parts_near"),
        (F.col("moved") < 0.1).alias("merged_near"),
        ((F.col("lo") == F.col("least")) & (F.col("hi") == F.col("most"))).alias("ends"),
        "made",
    )


def hll_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of three months, by moving sketches, within 5 %."""
    return model(spark, sf_dir).run("""run: orders -> { group_by: o_orderdate.year aggregate: h is hll_accumulate(o_custkey), n_orders calculate: m is hll_combine_moving(h, 1), k is hll_accumulate_moving(n_orders, 1) order_by: o_orderdate }
      -> { select: o_orderdate, n is hll_estimate(m), k is hll_estimate(k) }""").join(_two_years(spark, sf_dir), "o_orderdate").select(
        "o_orderdate", (F.abs(F.col("n") / F.col("e") - 1) < 0.05).alias("near"), (F.col("k") <= 2).alias("few"))


def _two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("y"), "o_custkey")
    later = o.select(F.add_months("y", 12).cast("timestamp_ntz").alias("y"), "o_custkey")
    years = o.select("y").distinct()
    return o.unionByName(later).join(years, "y", "left_semi").groupBy(F.col("y").alias("o_orderdate")).agg(F.countDistinct("o_custkey").alias("e"))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the executors see."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"quern-{name}-") + "/out"


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source written by its build plan and read from its manifest."""
    text = """
    #@ persist
    source: per_status is t.table('orders') -> { group_by: o_orderstatus aggregate: n is count() }
    run: per_status -> { select: * }
    """
    tables = {"orders": f"{sf_dir}/orders.parquet"}
    manifest = Model(spark, tables).load(text).build(_folder(spark, "persisted"))
    return Model(spark, tables, manifest=manifest).load(text).run()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet by a pattern, and CSV and JSON written from it: the same rows by each."""
    place = _folder(spark, "files")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.coalesce(1).write.option("header", True).csv(f"{place}/nation.csv")
    nation.coalesce(1).write.json(f"{place}/nation.json")
    m = Model(spark, {"a": f"{sf_dir}/natio*.parquet", "b": f"{place}/nation.csv", "c": f"{place}/nation.json"})
    parts = [m.run(f"run: t.table('{t}') -> {{ group_by: n_regionkey aggregate: n is count(), hi is max(n_name) }}").select(F.lit(t).alias("kind"), F.col("n_regionkey").cast("int").alias("n_regionkey"), "n", "hi") for t in "abc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and streamed rows of a nested result."""
    from quern.sources import sinks

    df = model(spark, sf_dir).run("run: orders -> { group_by: o_orderstatus aggregate: n_orders nest: by is { group_by: o_orderpriority aggregate: n_orders } order_by: o_orderstatus }")
    told = [(r["o_orderstatus"], r["n_orders"], sum(x["n_orders"] for x in r["by"]), "rows") for r in sinks.rows(df, tag="told")]
    told += [(r["o_orderstatus"], r["n_orders"], len(r["by"]), "stream") for r in sinks.stream(df)]
    return spark.createDataFrame(told, "o_orderstatus string, n bigint, inner bigint, sink string")


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested result as JSON, read back."""
    from quern.sources import sinks

    place = _folder(spark, "json")
    sinks.write_json(model(spark, sf_dir).run("run: orders -> { group_by: o_orderstatus nest: by is { group_by: o_orderpriority aggregate: n_orders } }"), place)
    return spark.read.json(place).select("o_orderstatus", F.explode("by").alias("x")).select("o_orderstatus", "x.o_orderpriority", F.col("x.n_orders").alias("n"))


def default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).run("run: orders -> { select: o_orderkey, o_totalprice order_by: o_totalprice desc, o_orderkey }", default_limit=10)


def query_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalyst's estimate grows with the columns that are read."""
    from quern.sources import sinks

    m = model(spark, sf_dir)
    few, all_of = (sinks.cost(m.run(t)) for t in ("run: t.table('lineitem') -> { select: l_orderkey }", "run: t.table('lineitem') -> { select: * }"))
    return spark.createDataFrame([(few > 0, few <= all_of)], "counted boolean, ordered boolean")


def built_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query made with the builder."""
    from quern.builder import Q

    q = Q("orders").where("big").group_by("o_orderstatus").aggregate("n_orders").then().select("o_orderstatus", "k is n_orders + 1")
    return q.run(model(spark, sf_dir))


def notebook_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL cell of a notebook over a query of its model cell."""
    from quern.lang import notebook

    m = Model(spark, {"nation": f"{sf_dir}/nation.parquet"})
    text = ">>>markdown\n# Nations\n>>>model\nsource: n is t.table('nation')\n>>>sql\nSELECT n_regionkey, k * 2 AS k FROM %{ n -> { group_by: n_regionkey aggregate: k is count() } }\n"
    return [df for cell, df in notebook.run(m, text) if cell.kind == "sql"][0]


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that imports a source of another file under a new name."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="quern-model-")  # read by the driver alone
    with open(f"{folder}/base.model", "w", encoding="utf-8") as out:
        out.write("source: r is t.table('region') extend { measure: n is count() } source: hidden is t.table('nation') export { r }")
    return Model(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES}, base=folder).load('import { z is r } from "base.model"').run("run: z -> { group_by: r_name aggregate: n }")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one's own: a Column builder and an aggregate."""
    from quern.functions import library

    library.register("doubled", lambda x: x * 2)
    library.register("spread", lambda x: F.max(x) - F.min(x), aggregate=True)
    return model(spark, sf_dir).run("run: orders -> { group_by: o_orderstatus aggregate: s is spread(o_orderkey) } -> { select: o_orderstatus, d is doubled(s) }")


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation tags of a source and its field, as rows."""
    from quern.lang.tags import tags

    m = Model(spark, {"region": f"{sf_dir}/region.parquet"}).load("# percent size=large list=[x, 'y z']\nsource: r is t.table('region') extend {\n # label=key a.b=2\n dimension: k is r_regionkey\n}")
    r = m.sources["r"]
    found = {**tags(r.notes), **{f"k.{k}": v for k, v in tags(r.fields["k"].notes).items()}}
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "tag string, value string")


def nested_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources.sinks import flattened

    return flattened(model(spark, sf_dir).run("run: orders -> { group_by: o_orderstatus nest: by is { group_by: o_orderpriority aggregate: n_orders } }")).select(F.col("o_orderstatus"), F.col("`by.o_orderpriority`").alias("priority"), F.col("`by.n_orders`").alias("n"))


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "search_ranked": (search_ranked, "SELECT 'n_name' AS \"fieldName\", n_name AS \"fieldValue\", count(*) AS weight FROM nation WHERE lower(n_name) LIKE '%nation_1%' GROUP BY 2"),
    "partition_composite": (partition_composite, "SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F'"),
    "approx_functions": (approx_functions, "SELECT DISTINCT l_returnflag, true AS count_near, true AS hll_near, true AS same, true AS median_near FROM lineitem"),
    "sketches": (sketch_bounds, "SELECT DISTINCT l_returnflag, true AS median_near, true AS rank_near, true AS trimmed_near, true AS parts_near, true AS merged_near, true AS ends, CAST(9 AS DOUBLE) AS made FROM lineitem"),
    "hll_moving": (hll_moving, "SELECT DISTINCT date_trunc('year', o_orderdate) AS o_orderdate, true AS near, true AS few FROM orders"),
    "persisted": (persisted, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "scan_files": (files, "SELECT kind, n_regionkey, count(*) AS n, max(n_name) AS hi FROM nation, (SELECT unnest(['a', 'b', 'c']) AS kind) GROUP BY 1, 2"),
    "sink_rows": (sink_rows, "SELECT o_orderstatus, count(*) AS n, count(*) AS inner, 'rows' AS sink FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*), count(DISTINCT o_orderpriority), 'stream' FROM orders GROUP BY 1"),
    "sink_json": (sink_json, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"),
    "default_limit": (default_limit, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "query_cost": (query_cost, "SELECT true AS counted, true AS ordered"),
    "built_query": (built_query, "SELECT o_orderstatus, count(*) + 1 AS k FROM orders WHERE o_totalprice > 200000 GROUP BY 1"),
    "notebook_sql": (notebook_sql, "SELECT n_regionkey, 2 * count(*) AS k FROM nation GROUP BY 1"),
    "imported": (imported, "SELECT r_name, count(*) AS n FROM region GROUP BY 1"),
    "registered": (registered, "SELECT o_orderstatus, 2 * (max(o_orderkey) - min(o_orderkey)) AS d FROM orders GROUP BY 1"),
    "noted": (noted, "SELECT * FROM (VALUES ('percent', 'True'), ('size', 'large'), ('list', '[''x'', ''y z'']'), ('k.label', 'key'), ('k.a', '{''b'': ''2''}')) AS t(tag, value)"),
    "nested_csv": (nested_csv, "SELECT o_orderstatus, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(name) for name in CATALOGUE} | {k: f for k, (f, _) in EXTRA.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in CATALOGUE.items()} | {k: sql for k, (_, sql) in EXTRA.items() if sql}
