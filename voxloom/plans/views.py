"""Derived views on the driver tables: one SQL text each, the same for Spark and for the SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxloom.session import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: In ``voxels`` 15,000 orders make one slab of 25 places along x, so that the volume grows with the tables.
VIEWS = {
    "synapses": """
        SELECT CAST((l_orderkey * 8 + l_linenumber) * 16 + ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS syn_id,
               l_suppkey AS cell_1, o_custkey + 1000 AS cell_2,
               l_discount * 10 AS syn_prob, l_quantity / 10 AS mesh_area,
               CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS syn_sign,
               CASE WHEN l_partkey % 50 = 0 THEN -1 ELSE l_linenumber % 5 END AS ax_1,
               CASE WHEN l_partkey % 70 = 0 THEN -1 ELSE l_partkey % 5 END AS ax_2,
               s_nationkey % 7 AS ct_1, c_nationkey % 7 AS ct_2,
               l_orderkey % 4 AS sp_1, CASE WHEN l_partkey % 90 = 0 THEN -1 ELSE l_partkey % 4 END AS sp_2,
               l_partkey % 500 AS x, l_orderkey % 400 AS y, l_linenumber * 20 AS z,
               l_partkey % 500 AS latent_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey""",
    "voxels": """
        SELECT x, y, z,
               CASE WHEN q < 3 THEN 0 ELSE 1 + CAST(floor(x % 25 / 5) AS BIGINT) + 5 * CAST(floor(y / 8) AS BIGINT) + 25 * CAST(floor(x / 25) AS BIGINT) END AS sv_id,
               CASE WHEN q > 20 THEN 0 ELSE 1 + CAST(floor(x % 25 / 4) AS BIGINT) + 7 * CAST(floor(y / 7) AS BIGINT) + 50 * CAST(floor(x / 25) AS BIGINT) END AS mi_id,
               CASE WHEN (x + y + z) % 3 = 0 THEN 1 ELSE 0 END AS sj,
               CASE WHEN (x * 7 + y) % 5 = 0 THEN 1 ELSE 0 END AS sym,
               CASE WHEN (x + y * 3) % 4 = 0 THEN 1 ELSE 0 END AS asym, p,
               CAST(floor(x / 10) AS BIGINT) AS block_x, CAST(floor(y / 10) AS BIGINT) AS block_y
        FROM (SELECT x, y, z, min(q) AS q, avg(d) * 10 AS p
              FROM (SELECT l_suppkey % 25 + 25 * CAST(floor(l_orderkey / 15000) AS BIGINT) AS x, l_partkey % 40 AS y, CAST(l_linenumber AS BIGINT) AS z, l_quantity AS q, l_discount AS d
                    FROM lineitem) placed GROUP BY x, y, z) cells""",
    "edges": """
        SELECT DISTINCT o_custkey AS src, CAST(floor(o_custkey / 16) AS BIGINT) * 16 + (o_orderkey * 7 + o_custkey) % (1 + CAST(floor(o_custkey / 16) AS BIGINT) % 16) AS dst
        FROM orders""",
    "sv": """
        SELECT c_custkey AS sv_id, 100 + c_custkey % 900 AS size,
               c_custkey % 100 AS min_x, (c_custkey * 7) % 100 AS min_y, (c_custkey * 13) % 100 AS min_z,
               c_custkey % 100 + 10 AS max_x, (c_custkey * 7) % 100 + 10 AS max_y, (c_custkey * 13) % 100 + 10 AS max_z,
               (c_acctbal + 1000) / 11000 AS glia_p
        FROM customer""",
    "overlap": """
        SELECT CASE WHEN p_size % 3 = 0 THEN 'mi' WHEN p_size % 3 = 1 THEN 'vc' ELSE 'sj' END AS obj_type,
               l_partkey AS obj_id, o_custkey AS sv_id, COUNT(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY p_size % 3, l_partkey, o_custkey""",
    "skel_nodes": """
        SELECT user_id AS cell_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS node_id,
               value AS x, event_id % 100 AS y, event_id % 30 AS z, event_id % 50 AS diameter,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS axoness
        FROM events""",
    "samples": "SELECT vec_id AS sample_id, vec_id % 50 AS cell_id, label AS truth, embedding AS logits FROM embeddings",
    "vertices": """
        SELECT p_partkey AS vid, p_partkey % 20 AS obj_id, p_retailprice / 10 AS x, p_size AS y, p_partkey % 37 AS z, p_size % 4 AS label
        FROM part""",
    "votes": "SELECT l_partkey AS vertex_id, l_linenumber % 4 AS label, l_suppkey % 4 AS truth FROM lineitem",
    # views that are made of views
    "skel_edges": """
        SELECT a.cell_id, a.node_id AS src, a.node_id + 1 AS dst
        FROM (SELECT user_id AS cell_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS node_id,
                     COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) a WHERE a.node_id < a.n - 1""",
    "sv_cell": "SELECT c_custkey AS sv_id, CAST(c_custkey % 97 + 1 AS BIGINT) AS cell_id FROM customer WHERE c_custkey % 11 <> 0",
    "objects": """
        SELECT CASE WHEN p_size % 3 = 0 THEN 'mi' WHEN p_size % 3 = 1 THEN 'vc' ELSE 'sj' END AS obj_type,
               p_partkey AS obj_id, CAST(20 + p_partkey % 400 AS BIGINT) AS size,
               CAST(floor(p_retailprice / 10) AS BIGINT) AS x, CAST(p_size AS BIGINT) AS y, p_partkey % 37 AS z
        FROM part""",
    "fragments": """
        SELECT l_orderkey * 10 + l_linenumber AS syn_id, l_suppkey AS sv_1, o_custkey AS sv_2, CAST(l_quantity AS BIGINT) AS size,
               l_discount AS sym_share, l_tax AS asym_share, l_partkey % 50 AS x, l_orderkey % 40 AS y, CAST(l_linenumber AS BIGINT) AS z
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "faces": """
        SELECT obj_id, CAST(floor((rn - 1) / 3) AS BIGINT) AS fid,
               max(CASE WHEN (rn - 1) % 3 = 0 THEN vid END) AS a, max(CASE WHEN (rn - 1) % 3 = 1 THEN vid END) AS b, max(CASE WHEN (rn - 1) % 3 = 2 THEN vid END) AS c
        FROM (SELECT p_partkey AS vid, p_partkey % 20 AS obj_id, ROW_NUMBER() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS rn FROM part) v
        GROUP BY obj_id, CAST(floor((rn - 1) / 3) AS BIGINT) HAVING count(*) = 3""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the Parquet tables of ``sf_dir``."""
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} {t}", text)
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """``sql`` with the views it names as common table expressions in front."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        return f"WITH {m[1] or ''}{ctes}, {body[m.end():]}"
    return f"WITH {ctes} {body}"
