"""DuckDB SQL of the source queries."""

from __future__ import annotations

from wardcast.plans.common import sql_dec as dc

ORACLE = {
    "manifest_load": f"""WITH o AS (
  SELECT *, o_orderkey % 97 = 0 AS unparsed, o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 AS incomplete FROM orders)
SELECT 'orders' AS "table", count(*) FILTER (WHERE NOT unparsed AND NOT incomplete) AS good,
  count(*) FILTER (WHERE unparsed OR incomplete) AS bad,
  {dc("sum(o_totalprice) FILTER (WHERE NOT unparsed AND NOT incomplete)", 2)} AS total,
  count(*) FILTER (WHERE unparsed) AS unparsed, count(*) FILTER (WHERE incomplete) AS incomplete, CAST(0 AS BIGINT) AS reloaded FROM o
UNION ALL
SELECT 'customer', count(*), 0, {dc("sum(c_acctbal)", 2)}, 0, 0, 0 FROM customer""",
    "named_datasets": f"""SELECT c_mktsegment, count(*) AS n_orders, {dc("sum(o_totalprice)", 2)} AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
}
