"""Registration of queries, and the evidence tables derived from the supplied tables.

A fixture is one SQL text that Spark and the checking engine both run, so that operator and oracle start from the
same rows. A query is a thin function of ``Tables``; its operator lives elsewhere in the package.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SOURCE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'registry' WHEN '2' THEN 'portal' WHEN '3' THEN 'review' WHEN '4' THEN 'forum' ELSE 'model' END"
_FACT = (
    "SELECT concat('customer:', o_custkey) AS entity_id, '{key}' AS fact_key, '{type}' AS value_type, {text} AS value_text, {number} AS value_number, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, "
    + _SOURCE
    + " AS source_type, concat('https://src.example/', o_orderkey % 7) AS source_url, concat('skill', o_orderkey % 3) AS skill_id, CAST(o_orderkey % 4 AS INT) AS version, CAST(CAST(o_orderdate AS DATE) AS STRING) AS learned_on, o_orderkey * 4 + {no} AS fact_no FROM {{orders}}"
)

FIXTURES: dict[str, str] = {
    "facts": " UNION ALL ".join(
        _FACT.format(key=key, type=kind, text=text, number=number, no=no)
        for no, (key, kind, text, number) in enumerate(
            [
                ("order_total", "numeric", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)", "o_totalprice"),
                ("order_status", "text", "o_orderstatus", "CAST(NULL AS DOUBLE)"),
                ("order_priority", "text", "o_orderpriority", "CAST(NULL AS DOUBLE)"),
            ]
        )
    ),
    "entities": """
        SELECT concat('customer:', c_custkey) AS entity_id, 'customer' AS entity_type, c_name AS name, 'crm' AS root_source, CASE WHEN c_acctbal < 0 THEN 'internal' ELSE 'public' END AS visibility FROM {customer}
        UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', s_name, 'erp', 'public' FROM {supplier}
        UNION ALL SELECT concat('part:', p_partkey), 'part', p_name, 'erp', 'public' FROM {part}
        UNION ALL SELECT concat('nation:', n_nationkey), 'nation', n_name, 'registry', 'public' FROM {nation}
        UNION ALL SELECT concat('region:', r_regionkey), 'region', r_name, 'registry', 'public' FROM {region}""",
    "edges": """
        SELECT concat('customer:', c_custkey) AS src, 'located_in' AS edge_type, concat('nation:', c_nationkey) AS dst, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence FROM {customer}
        UNION ALL SELECT concat('supplier:', s_suppkey), 'located_in', concat('nation:', s_nationkey), CAST(s_suppkey % 10 AS DOUBLE) / 10 FROM {supplier}
        UNION ALL SELECT concat('nation:', n_nationkey), 'part_of', concat('region:', n_regionkey), CAST(1 AS DOUBLE) FROM {nation}
        UNION ALL SELECT DISTINCT concat('part:', l_partkey), 'supplied_by', concat('supplier:', l_suppkey), CAST(l_partkey % 10 AS DOUBLE) / 10 FROM {lineitem}
        UNION ALL SELECT DISTINCT concat('customer:', o_custkey), 'bought', concat('part:', l_partkey), CAST(l_partkey % 10 AS DOUBLE) / 10 FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "subjects": "SELECT concat('customer:', c_custkey) AS id, 12.8 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 2500 AS lat, 77.4 + CAST(c_custkey * 91 % 1009 AS DOUBLE) / 2500 AS lon FROM {customer}",
    "places": "SELECT concat('supplier:', s_suppkey) AS id, concat('kind', s_suppkey % 3) AS category, 12.8 + CAST(s_suppkey * 53 % 997 AS DOUBLE) / 2500 AS lat, 77.4 + CAST(s_suppkey * 67 % 1009 AS DOUBLE) / 2500 AS lon FROM {supplier}",
    "zones": "SELECT concat('zone:', n_nationkey) AS zone_id, 77.4 + CAST(n_nationkey % 5 AS DOUBLE) * 0.08 AS x0, 12.8 + CAST(CAST(floor(n_nationkey / 5) AS INT) AS DOUBLE) * 0.08 AS y0, 77.4 + CAST(n_nationkey % 5 AS DOUBLE) * 0.08 + 0.08 AS x1, 12.8 + CAST(CAST(floor(n_nationkey / 5) AS INT) AS DOUBLE) * 0.08 + 0.08 AS y1 FROM {nation}",
    # Shapes of three kinds in whole units, eight a lattice step, as the boxes that they consist of; lines of a lattice that grows with the customers and suppliers.
    "plot_parts": """
        SELECT concat('plot:', k) AS zone_id, k % 2 AS admin_level, k % 4 AS kind, ox + px0 AS x0, oy + py0 AS y0, ox + px1 AS x1, oy + py1 AS y1
        FROM (SELECT c_custkey AS k, 8 * (c_custkey % 40) AS ox, 8 * CAST(floor(c_custkey / 40) AS BIGINT) AS oy FROM {customer})
        JOIN (VALUES (0, 0, 0, 8, 8), (1, 0, 0, 11, 5), (1, 0, 5, 6, 11), (2, 0, 0, 8, 2), (2, 0, 6, 8, 8), (2, 0, 2, 2, 6), (2, 6, 2, 8, 6), (3, 0, 0, 2, 8), (3, 5, 0, 7, 8), (3, 2, 0, 5, 3)) AS s(part_kind, px0, py0, px1, py1) ON k % 4 = part_kind""",
    "tract_parts": """
        SELECT concat('tract:', k) AS zone_id, k % 2 AS admin_level, k % 2 AS kind, ox + px0 AS x0, oy + py0 AS y0, ox + px1 AS x1, oy + py1 AS y1
        FROM (SELECT s_suppkey AS k, 28 * (s_suppkey % 12) AS ox, 20 * CAST(floor(s_suppkey / 12) AS BIGINT) AS oy FROM {supplier})
        JOIN (VALUES (0, 0, 0, 30, 9), (0, 0, 21, 30, 30), (0, 0, 9, 9, 21), (0, 18, 9, 30, 21), (1, 0, 0, 13, 30), (1, 13, 17, 28, 30)) AS s(part_kind, px0, py0, px1, py1) ON k % 2 = part_kind""",
    "listings": """
        SELECT concat('part:', l_partkey) AS entity_id, concat('listing:', l_orderkey, '-', l_linenumber) AS listing_id, concat('supplier:', l_suppkey) AS seller, l_extendedprice AS price, l_quantity AS area_sqft, CAST(l_quantity AS INT) % 5 AS bhk,
               l_discount AS discount, l_returnflag AS kind, CAST(CAST(l_shipdate AS DATE) AS STRING) AS seen_on FROM {lineitem}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if f"{{{t}}}" in sql]


class Tables:
    """The supplied tables and the fixtures as DataFrames: ``t.orders``, ``t.facts``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            return self.spark.sql(FIXTURES[name], **{t: getattr(self, t) for t in _needs(FIXTURES[name])})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(body: str) -> str:
    """The SQL with the fixtures it names put before it."""
    ctes = []
    for name, sql in FIXTURES.items():
        if re.search(rf"\b{name}\b", body):
            for t in TABLES:
                sql = sql.replace(f"{{{t}}}", t)
            ctes.append(f"{name} AS ({sql})")
    body = body.strip()
    if not ctes:
        return body
    joined = ", ".join(ctes)
    if m := re.match(r"(?i)WITH( RECURSIVE)? ", body):
        return f"WITH{m[1] or ''} {joined}, {body[m.end():]}"
    return f"WITH {joined} {body}"


def query(sql: str | None = None):
    """Registers a function of Tables as a query under its own name; ``sql`` states the same for the oracle."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register
