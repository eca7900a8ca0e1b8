"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6, r6_plain
from voxloom.operators import graph as G
from voxloom.operators import walks
from voxloom.operators.clusters import clusters
from voxloom.operators.components import graph_components
from voxloom.operators.spatial import close_pairs, nearest_anywhere, nearest_by_window, nearest_in_group, radius_graph
from voxloom.plans.registry import query
from voxloom.plans.views import view

RAG = """rag AS (SELECT src, dst FROM edges WHERE src <> 0 AND dst <> 0 UNION ALL
    SELECT sv_id, sv_id FROM sv WHERE sv_id <> 0 AND sv_id NOT IN (SELECT src FROM edges WHERE src <> 0 AND dst <> 0 UNION SELECT dst FROM edges WHERE src <> 0 AND dst <> 0))"""


def comps(source: str, name: str = "comp") -> str:
    """Components of an edge table by a recursive closure."""
    return f"""{name}_e AS (SELECT src AS u, dst AS v FROM {source} UNION SELECT dst, src FROM {source}),
    {name}_r(u, v) AS (SELECT u, u FROM {name}_e UNION SELECT r.u, e.v FROM {name}_r r JOIN {name}_e e ON r.v = e.u),
    {name} AS (SELECT u AS node, min(v) AS component FROM {name}_r GROUP BY u)"""


def extents(comp: str, name: str = "ext") -> str:
    return f"""{name} AS (SELECT component, count(*) AS n, count(min_x) AS n_boxes,
    sqrt(pow((max(max_x) - min(min_x)) * 10.0, 2) + pow((max(max_y) - min(min_y)) * 10.0, 2) + pow((max(max_z) - min(min_z)) * 20.0, 2)) AS extent
    FROM {comp} LEFT JOIN sv ON node = sv_id GROUP BY component)"""


SCALE = (10.0, 10.0, 20.0)


def _rag(spark, d):
    return G.with_singletons(view(spark, d, "edges"), view(spark, d, "sv"))


def _components(spark, d):
    return graph_components(_rag(spark, d))


@query(f"WITH RECURSIVE {RAG}, {comps('rag')} SELECT node, component FROM comp")
def g1_components(spark, d):
    return _components(spark, d)


@query(f"WITH {RAG} SELECT src, dst FROM rag")
def g2_singletons(spark, d):
    return _rag(spark, d)


@query(f"WITH RECURSIVE {RAG}, {comps('rag')}, {extents('comp')} SELECT component, n, n_boxes, round(extent, 6) AS extent FROM ext")
def g3_extents(spark, d):
    return G.component_extent(_components(spark, d), view(spark, d, "sv"), SCALE).withColumn("extent", r6("extent"))


@query(f"WITH RECURSIVE {RAG}, {comps('rag')}, {extents('comp')} SELECT node, component FROM comp JOIN ext USING (component) WHERE extent > 300")
def g4_prune(spark, d):
    comp = _components(spark, d)
    return G.prune_components(comp, G.component_extent(comp, view(spark, d, "sv"), SCALE), 300.0, False)


@query(f"WITH RECURSIVE {RAG}, {comps('rag')}, {extents('comp')} SELECT node AS sv_id, component AS cell_id FROM comp JOIN ext USING (component) WHERE extent >= 300")
def g5_agglomeration(spark, d):
    comp = _components(spark, d)
    kept = G.prune_components(comp, G.component_extent(comp, view(spark, d, "sv"), SCALE), 300.0, True)
    return kept.select(F.col("node").alias("sv_id"), F.col("component").alias("cell_id"))


@query("SELECT sv.sv_id, coalesce(cell_id, 0) AS cell_id FROM sv LEFT JOIN sv_cell ON sv.sv_id = sv_cell.sv_id")
def g6_lookup(spark, d):
    return G.lookup(view(spark, d, "sv").select("sv_id"), view(spark, d, "sv_cell"), True).select("sv_id", "cell_id")


@query("SELECT cell_id, string_agg(CAST(sv_id AS VARCHAR), ',' ORDER BY sv_id) AS sv_ids FROM sv_cell GROUP BY cell_id")
def g7_members(spark, d):
    return G.members(view(spark, d, "sv_cell")).select("cell_id", F.array_join("sv_ids", ",").alias("sv_ids"))


@query("""SELECT cell_id, count(*) AS n_sv, CAST(sum(size) AS BIGINT) AS size, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z,
    arg_min(min_x, sv_id) AS rep_x, arg_min(min_y, sv_id) AS rep_y, arg_min(min_z, sv_id) AS rep_z FROM (SELECT sv.*, cell_id FROM sv JOIN sv_cell ON sv.sv_id = sv_cell.sv_id) j GROUP BY cell_id""")
def g8_cell_rollup(spark, d):
    return G.cell_rollup(view(spark, d, "sv"), view(spark, d, "sv_cell"))


@query("SELECT round(sum(size) * 2000.0 / 1e18 * 1e12, 6) AS volume_mm3_e12 FROM sv WHERE glia_p > 0.5")
def g9_volume(spark, d):
    sv = view(spark, d, "sv")
    return G.volume_mm3(sv, SCALE, sv.where("glia_p > 0.5")).select(r6(F.col("volume_mm3") * 1e12).alias("volume_mm3_e12"))


@query("""SELECT sv_id, round(avg(p), 6) AS mean_p, avg(p) > 0.45 AND sum(CASE WHEN p > 0.45 THEN 1 ELSE 0 END) > floor(0.7 * count(*)) AS astrocyte
    FROM (SELECT x * 100 + y AS sv_id, round(p, 6) AS p FROM voxels) v GROUP BY sv_id""")
def g10_astrocyte_call(spark, d):
    votes = view(spark, d, "voxels").select((F.col("x") * 100 + F.col("y")).alias("sv_id"), r6("p").alias("p"))
    return G.astrocyte_call(votes, 0.45).withColumn("mean_p", r6("mean_p"))


GLIA = f"""{RAG}, {comps('rag')}, glia AS (SELECT sv_id AS node FROM sv WHERE glia_p > 0.55),
    flag AS (SELECT node, component, node IN (SELECT node FROM glia) AS g FROM comp),
    mix AS (SELECT component, sum(CASE WHEN g THEN 1 ELSE 0 END) AS ng, count(*) AS n FROM flag GROUP BY component),
    opn AS (SELECT node, g FROM flag JOIN mix USING (component) WHERE ng > 0 AND ng < n),
    fe AS (SELECT src, dst FROM rag WHERE src IN (SELECT node FROM opn WHERE g) AND dst IN (SELECT node FROM opn WHERE g) UNION ALL SELECT node, node FROM opn WHERE g),
    {comps('fe', 'fc')}, {extents('fc', 'fx')},
    big AS (SELECT node FROM fc JOIN fx USING (component) WHERE extent >= 400),
    ne AS (SELECT src, dst FROM rag WHERE src IN (SELECT node FROM opn) AND dst IN (SELECT node FROM opn) AND src NOT IN (SELECT node FROM big) AND dst NOT IN (SELECT node FROM big)
        UNION ALL SELECT node, node FROM opn WHERE node NOT IN (SELECT node FROM big)),
    {comps('ne', 'nc')}, {extents('nc', 'nx')},
    kept AS (SELECT node FROM nc JOIN nx USING (component) WHERE extent >= 400),
    split AS (SELECT node, CASE WHEN ng = 0 THEN 'neuron' ELSE 'astrocyte' END AS kind FROM flag JOIN mix USING (component) WHERE ng = 0 OR ng = n
        UNION ALL SELECT node, CASE WHEN node IN (SELECT node FROM kept) THEN 'neuron' ELSE 'astrocyte' END FROM opn)"""


def _split(spark, d):
    sv = view(spark, d, "sv")
    return G.split_astrocytes(_rag(spark, d), sv.where("glia_p > 0.55").select(F.col("sv_id").alias("node")), sv, 400.0, SCALE)


@query(f"WITH RECURSIVE {GLIA} SELECT node, kind FROM split")
def g11_split_astrocytes(spark, d):
    return _split(spark, d)


@query(f"WITH RECURSIVE {GLIA} SELECT sv_id, CASE WHEN sv_id % 17 = 0 THEN 'pruned' ELSE coalesce(kind, 'pruned') END AS kind FROM sv LEFT JOIN split ON sv_id = node")
def g12_sv_sets(spark, d):
    split = _split(spark, d).withColumnRenamed("node", "sv_id").where("sv_id % 17 <> 0")
    return G.sv_sets(view(spark, d, "sv"), split.where("kind = 'neuron'"), split.where("kind = 'astrocyte'"))


SUB = f"""{RAG}, pick AS (SELECT sv_id AS node FROM sv WHERE glia_p <= 0.55),
    se AS (SELECT src, dst FROM rag WHERE src IN (SELECT node FROM pick) AND dst IN (SELECT node FROM pick) UNION ALL SELECT node, node FROM pick),
    {comps('se', 'sc')}, {extents('sc', 'sx')}, kept AS (SELECT node FROM sc JOIN sx USING (component) WHERE extent >= 300),
    ind AS (SELECT src, dst FROM rag WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))"""


@query(f"WITH RECURSIVE {SUB} SELECT src, dst FROM ind UNION ALL SELECT node, node FROM kept WHERE node NOT IN (SELECT src FROM ind UNION SELECT dst FROM ind)")
def g13_sized_graph(spark, d):
    sv = view(spark, d, "sv")
    return G.sized_graph(_rag(spark, d), sv.where("glia_p <= 0.55").select(F.col("sv_id").alias("node")), sv, 300.0, SCALE)


@query(f"WITH {RAG} SELECT src, dst FROM rag WHERE src NOT IN (SELECT sv_id FROM sv WHERE size > 700) AND dst NOT IN (SELECT sv_id FROM sv WHERE size > 700)")
def g14_induced(spark, d):
    return G.induced(_rag(spark, d), view(spark, d, "sv").where("size > 700").select(F.col("sv_id").alias("node")), keep=False)


@query(f"""WITH {RAG}, r AS (SELECT CASE WHEN src % 100 < 20 THEN 999999 ELSE src END AS a, CASE WHEN dst % 100 < 20 THEN 999999 ELSE dst END AS b FROM rag)
    SELECT DISTINCT CAST(least(a, b) AS BIGINT) AS src, CAST(greatest(a, b) AS BIGINT) AS dst FROM r WHERE a <> b""")
def g15_merge_nodes(spark, d):
    rag = _rag(spark, d)
    nodes = rag.select(F.explode(F.array("src", "dst")).alias("node")).where("node % 100 < 20").distinct()
    return G.merge_nodes(rag, nodes, 999999)


#: Components of the edges, their neighbour lists, and the first nodes of a breadth-first walk from each node.
WALKS = """sym AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
    span(u, w) AS (SELECT a, a FROM sym UNION SELECT u, b FROM span JOIN sym ON w = a), comp AS (SELECT u AS node, min(w) AS component FROM span GROUP BY u),
    nb AS (SELECT component, a, list(b ORDER BY b) AS l FROM sym JOIN comp ON node = a GROUP BY component, a),
    walk(component, node, q, i) AS (SELECT component, a, [a], 1 FROM nb
        UNION ALL SELECT w.component, node, list_concat(q, list_filter(l, lambda x: NOT list_contains(q, x))), i + 1 FROM walk w JOIN nb ON a = q[i] WHERE i <= len(q) AND len(q) < {0}),
    first AS (SELECT component, node, max_by(q, i) AS q FROM walk GROUP BY component, node),
    members AS (SELECT component, node, k - 1 AS place, q[k] AS member FROM (SELECT *, unnest(range(1, least(len(q), {0}) + 1)) AS k FROM first) u)"""


def _component_edges(spark, d):
    e = view(spark, d, "edges").where("src <> dst")
    comp = graph_components(e).select(F.col("node").alias("src"), "component")
    return e.join(comp, "src").select("component", "src", "dst")


@query(f"WITH RECURSIVE {WALKS.format(7)} SELECT component, node, CAST(place AS INTEGER) AS place, member FROM members")
def g16_bfs_neighbourhoods(spark, d):
    return walks.bfs_neighbourhoods(_component_edges(spark, d), 7)


@query(f"""WITH RECURSIVE {WALKS.format(3)},
    r AS (SELECT component, a, b, row_number() OVER (PARTITION BY component ORDER BY a, b) AS n FROM sym JOIN comp ON node = a WHERE a < b),
    two AS (SELECT component, a, b, n FROM r UNION ALL SELECT component, b, a, n FROM r),
    reach(component, n, goal, here) AS (SELECT component, n, b, a FROM r UNION SELECT reach.component, reach.n, goal, two.b FROM reach JOIN two ON two.component = reach.component AND two.a = here AND two.n < reach.n),
    tree AS (SELECT component, n FROM r WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.component = r.component AND reach.n = r.n AND here = goal)),
    arcs AS (SELECT two.component, a, b FROM two JOIN tree USING (component, n)),
    dfs(component, node, path, place) AS (SELECT DISTINCT component, component, [component], [0] FROM arcs
        UNION ALL SELECT dfs.component, b, list_append(path, b), list_append(place, CASE WHEN len(path) > 1 AND b < path[len(path) - 1] THEN 1000000000 + b ELSE b END)
        FROM dfs JOIN arcs ON arcs.component = dfs.component AND a = node AND NOT list_contains(path, b)),
    core AS (SELECT component, node, CAST(floor((row_number() OVER (PARTITION BY component ORDER BY place) - 1) / 5) AS INTEGER) AS chunk FROM dfs)
    SELECT component, chunk, node, true AS core FROM core
    UNION ALL SELECT * FROM (SELECT DISTINCT m.component, c.chunk, m.member AS node, false FROM members m JOIN core c ON c.component = m.component AND c.node = m.node WHERE place > 0) x
        WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.component = x.component AND c.chunk = x.chunk AND c.node = x.node)""")
def g17_dfs_chunks(spark, d):
    return walks.dfs_chunks(_component_edges(spark, d), 5, 2)


def _points(spark, d):
    return view(spark, d, "vertices").select(F.col("vid").alias("id"), "obj_id", "x", "y", "z", "label")


@query("""SELECT a.obj_id, a.vid AS src, b.vid AS dst, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS weight
    FROM vertices a JOIN vertices b ON a.obj_id = b.obj_id AND a.vid < b.vid AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 9.5""")
def g18_radius_graph(spark, d):
    return radius_graph(_points(spark, d), 9.5, on=["obj_id"]).withColumn("weight", r6_plain("weight"))


#: An edge is in the forest unless lighter ones (ties by the ends) join its ends already.
@query("""WITH RECURSIVE w AS (SELECT CAST(floor(src / 16) AS BIGINT) AS cell_id, src, dst, CAST((src * 7919 + dst * 104729) % 97 AS DOUBLE) AS weight FROM edges WHERE src <> dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY weight, src, dst) AS n FROM w),
    sym AS (SELECT cell_id, src AS u, dst AS v, n FROM r UNION ALL SELECT cell_id, dst, src, n FROM r),
    reach(cell_id, n, goal, here) AS (SELECT cell_id, n, dst, src FROM r UNION SELECT reach.cell_id, reach.n, goal, v FROM reach JOIN sym ON sym.cell_id = reach.cell_id AND u = here AND sym.n < reach.n)
    SELECT cell_id, src, dst, weight FROM r WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.cell_id = r.cell_id AND reach.n = r.n AND here = goal)""")
def g20_spanning_tree(spark, d):
    e = view(spark, d, "edges").selectExpr("src div 16 AS cell_id", "src", "dst", "CAST((src * 7919 + dst * 104729) % 97 AS DOUBLE) AS weight")
    return G.spanning_tree(e)


@query("SELECT cell_id, src, dst, src % 10 = 9 AS added FROM skel_edges")
def g19_stitch(spark, d):
    nodes = view(spark, d, "skel_nodes").select("cell_id", "node_id", F.col("node_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    full = G.stitch(nodes, view(spark, d, "skel_edges").where("src % 10 <> 9"))
    return full.select("cell_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "added")


@query("""WITH RECURSIVE n AS (SELECT cell_id, node_id, axoness AS label FROM skel_nodes), c AS (SELECT cell_id, max(node_id) AS last FROM n GROUP BY cell_id),
    w AS (SELECT n.cell_id, n.node_id, greatest(0, least(n.node_id - 1, last - 2)) AS lo, least(last, greatest(n.node_id + 1, 2)) AS hi FROM n JOIN c USING (cell_id)),
    v AS (SELECT w.cell_id, w.node_id, m.label, count(*) AS k FROM w JOIN n m ON m.cell_id = w.cell_id AND m.node_id BETWEEN lo AND hi GROUP BY w.cell_id, w.node_id, m.label)
    SELECT cell_id, node_id, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, node_id ORDER BY k DESC, label) AS rn FROM v) r WHERE rn = 1""")
def g21_smooth_labels(spark, d):
    nodes = view(spark, d, "skel_nodes").select("cell_id", "node_id", F.col("axoness").cast("long").alias("label"))
    return G.smooth_labels(nodes, view(spark, d, "skel_edges"), 3)


@query("SELECT sv_id, CASE WHEN cell_id = 5 AND sv_id IN (4, 101) THEN 98 ELSE cell_id END AS cell_id FROM sv_cell")
def g22_split_cell(spark, d):
    return G.split_cell(view(spark, d, "sv_cell"), 5, [4, 101])


@query("""WITH RECURSIVE v AS (SELECT vid, obj_id, x, y, z FROM vertices),
    e AS (SELECT a.vid AS src, b.vid AS dst FROM v a JOIN v b ON a.obj_id = b.obj_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 12),""" + comps("e") + ", s AS (SELECT obj_id, component, count(*) AS n FROM comp JOIN v ON vid = node GROUP BY obj_id, component) SELECT obj_id, component, n FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, component) AS rn FROM s) r WHERE rn = 1")
def g23_largest_cloud(spark, d):
    """The largest cloud of each object."""
    named = clusters(_points(spark, d).select("obj_id", "id", "x", "y", "z"), 12.0, ["obj_id"], strict=False)
    sizes = named.groupBy("obj_id", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("obj_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "component", "n")).alias("b"))
    return best.select("obj_id", "b.component", "b.n")


NEAR = """near AS (SELECT q.vid AS query_id, p.vid AS id, q.obj_id, p.label, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)) AS dist FROM vertices q JOIN vertices p ON q.obj_id = p.obj_id AND p.label <> 0 WHERE q.label = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY obj_id, query_id ORDER BY dist, id) AS rank FROM near)"""


def _queries(spark, d):
    p = _points(spark, d)
    return p.where("label = 0").withColumnRenamed("id", "query_id"), p.where("label <> 0")


@query(f"WITH {NEAR} SELECT obj_id, query_id, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 5")
def j1_nearest_in_group(spark, d):
    q, p = _queries(spark, d)
    return nearest_in_group(q, p, "obj_id", 5).withColumn("dist", r6("dist"))


@query(f"WITH {NEAR} SELECT obj_id, query_id, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 3")
def j1_nearest_by_window(spark, d):
    q, p = _queries(spark, d)
    return nearest_by_window(q, p, "obj_id", 3).withColumn("dist", r6("dist"))


@query("""SELECT a.vid AS id_a, b.vid AS id_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS dist
    FROM vertices a JOIN vertices b ON a.label = 0 AND b.label = 1 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 7.25""")
def j2_pairs_within(spark, d):
    p = _points(spark, d)
    return close_pairs(p.where("label = 0"), p.where("label = 1"), 7.25).select("id_a", "id_b", r6_plain("dist").alias("dist"))


@query("""SELECT query_id, id, round(dist, 6) AS dist FROM (SELECT a.vid AS query_id, b.vid AS id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist,
    row_number() OVER (PARTITION BY a.vid ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), b.vid) AS rn FROM vertices a JOIN vertices b ON a.label = 2 AND b.label = 3) r WHERE rn = 1""")
def j3_nearest_anywhere(spark, d):
    p = _points(spark, d)
    return nearest_anywhere(p.where("label = 2").withColumnRenamed("id", "query_id"), p.where("label = 3"), 2.0).withColumn("dist", r6("dist"))
