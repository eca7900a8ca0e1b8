"""Queries of the skeleton and surface operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.modes import r6
from voxloom.operators import graph as G
from voxloom.operators import skeleton as K
from voxloom.operators.spatial import radius_graph
from voxloom.plans.registry import query
from voxloom.plans.views import view

EDGE = """w AS (SELECT e.cell_id, e.src, e.dst, sqrt(pow((a.x - b.x) * 10, 2) + pow((a.y - b.y) * 10, 2) + pow((a.z - b.z) * 20, 2)) AS length, a.axoness AS ax_a, b.axoness AS ax_b
    FROM skel_edges e JOIN skel_nodes a ON a.cell_id = e.cell_id AND a.node_id = e.src JOIN skel_nodes b ON b.cell_id = e.cell_id AND b.node_id = e.dst)"""
SCALE = (10.0, 10.0, 20.0)
CUM = f"{EDGE}, cum AS (SELECT n.cell_id, n.node_id, n.axoness, coalesce(sum(w.length) OVER (PARTITION BY n.cell_id ORDER BY n.node_id), 0) AS c FROM skel_nodes n LEFT JOIN w ON w.cell_id = n.cell_id AND w.dst = n.node_id)"


def _nodes(spark, d):
    return view(spark, d, "skel_nodes")


def _weighted(spark, d):
    return K.weighted_edges(_nodes(spark, d), view(spark, d, "skel_edges"), SCALE, ("axoness",))


@query(f"WITH {EDGE} SELECT cell_id, src, dst, round(length, 6) AS length FROM w")
def k1_weighted_edges(spark, d):
    return _weighted(spark, d).select("cell_id", "src", "dst", r6("length").alias("length"))


@query(f"WITH {EDGE} SELECT cell_id, round(sum(length), 4) AS length, round(sum(CASE WHEN ax_a IN (1, 3, 4) AND ax_b IN (1, 3, 4) THEN length ELSE 0 END), 4) AS axon FROM w GROUP BY cell_id")
def k2_path_lengths(spark, d):
    w = _weighted(spark, d)
    axon = K.path_lengths(w, [1, 3, 4]).withColumnRenamed("length", "axon")
    return K.path_lengths(w).join(axon, "cell_id").select("cell_id", F.round("length", 4).alias("length"), F.round("axon", 4).alias("axon"))


@query(f"WITH {EDGE} SELECT cell_id FROM w GROUP BY cell_id HAVING sum(length) / 1000 >= 40")
def k3_long_cells(spark, d):
    return K.long_cells(K.path_lengths(_weighted(spark, d)), 40.0)


@query(f"WITH {EDGE}, l AS (SELECT cell_id, sum(length) AS length FROM w GROUP BY cell_id), v AS (SELECT obj_id % 200 AS cell_id, sum(size) * 2000.0 / 1e9 AS volume FROM objects GROUP BY obj_id % 200) SELECT cell_id, round(CASE WHEN length > 0 THEN coalesce(volume, 0) / (length / 1000) ELSE 0 END * 1000, 6) AS density FROM l LEFT JOIN v USING (cell_id)")
def k4_path_density(spark, d):
    objs = view(spark, d, "objects").select((F.col("obj_id") % 200).alias("cell_id"), "size")
    return K.path_density(objs, K.path_lengths(_weighted(spark, d)), SCALE).select("cell_id", r6(F.col("density") * 1000).alias("density"))


def _window_sql(values: str = "axoness") -> str:
    return f"""WITH {CUM}, v AS (SELECT a.cell_id, a.node_id, b.{values} AS label, count(*) AS n FROM cum a JOIN cum b ON a.cell_id = b.cell_id AND abs(a.c - b.c) <= 1500 GROUP BY a.cell_id, a.node_id, b.{values})
    SELECT cell_id, node_id, CAST(label AS BIGINT) AS axoness FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, node_id ORDER BY n DESC, label) AS rn FROM v) r WHERE rn = 1"""


@query(_window_sql())
def k5_window_majority(spark, d):
    return K.window_majority(_nodes(spark, d), _weighted(spark, d), "axoness", 1500.0)


COMPART = """n AS (SELECT cell_id, node_id, CASE WHEN axoness IN (3, 4) THEN 1 ELSE axoness END AS ax FROM skel_nodes),
    s AS (SELECT *, sum(CASE WHEN ax = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY node_id) AS run FROM n),
    c AS (SELECT cell_id, run, avg(CASE WHEN ax = 1 THEN 1.0 ELSE 0 END) AS share FROM s WHERE ax <> 2 GROUP BY cell_id, run)"""


@query(f"WITH {COMPART} SELECT s.cell_id, node_id, CASE WHEN ax = 2 THEN 2 WHEN share >= 0.66 THEN 1 ELSE 0 END AS axoness FROM s LEFT JOIN c ON s.cell_id = c.cell_id AND s.run = c.run")
def k6_component_compartments(spark, d):
    n = _nodes(spark, d).withColumn("axoness", F.when(F.col("axoness").isin(3, 4), 1).otherwise(F.col("axoness")))
    return K.component_compartments(n, view(spark, d, "skel_edges"))


@query(f"""WITH {CUM}, f AS (SELECT cell_id, node_id, c, CASE WHEN axoness IN (3, 4) THEN 1 ELSE axoness END AS ax FROM cum),
    v AS (SELECT a.cell_id, a.node_id, b.ax, count(*) AS n FROM f a JOIN f b ON a.cell_id = b.cell_id AND abs(a.c - b.c) <= 1500 GROUP BY a.cell_id, a.node_id, b.ax),
    m AS (SELECT cell_id, node_id, ax FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, node_id ORDER BY n DESC, ax) AS rn FROM v) r WHERE rn = 1),
    s AS (SELECT *, sum(CASE WHEN ax = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY node_id) AS run FROM m),
    k AS (SELECT cell_id, run, avg(CASE WHEN ax = 1 THEN 1.0 ELSE 0 END) AS share FROM s WHERE ax <> 2 GROUP BY cell_id, run),
    u AS (SELECT s.cell_id, s.node_id, CASE WHEN ax = 2 THEN 2 WHEN share >= 0.66 THEN 1 ELSE 0 END AS ruled FROM s LEFT JOIN k ON s.cell_id = k.cell_id AND s.run = k.run)
    SELECT u.cell_id, u.node_id, CASE WHEN ruled = 1 AND n.axoness IN (3, 4) THEN n.axoness ELSE ruled END AS axoness FROM u JOIN skel_nodes n ON n.cell_id = u.cell_id AND n.node_id = u.node_id""")
def k7_smooth_compartments(spark, d):
    return K.smooth_compartments(_nodes(spark, d), _weighted(spark, d), view(spark, d, "skel_edges"), 1500.0)


COORDS = "q AS (SELECT event_id AS query_id, user_id AS cell_id, value + 1 AS x, event_id % 90 AS y, event_id % 25 AS z FROM events)"


def _coords(spark, d):
    from voxloom.session import read_table

    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("cell_id"), F.col("event_id").alias("query_id"), (F.col("value") + 1).alias("x"), (F.col("event_id") % 90).alias("y"), (F.col("event_id") % 25).alias("z"))


DIST = "sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2) + pow(q.z - n.z, 2))"


@query(f"""WITH {COORDS}, a AS (SELECT q.cell_id, q.query_id, n.axoness, {DIST} AS dist, row_number() OVER (PARTITION BY q.query_id ORDER BY {DIST}, n.node_id) AS rn FROM q JOIN skel_nodes n ON q.cell_id = n.cell_id),
    v AS (SELECT query_id, axoness, count(*) AS k FROM a WHERE dist <= 25 GROUP BY query_id, axoness), m AS (SELECT query_id, axoness AS vote FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, axoness) AS rn FROM v) r WHERE rn = 1)
    SELECT cell_id, query_id, coalesce(vote, axoness) AS axoness FROM a LEFT JOIN m USING (query_id) WHERE rn = 1""")
def k8_attribute_at(spark, d):
    return K.attribute_at(_coords(spark, d), _nodes(spark, d), "axoness", 25.0)


LABELS = """near AS (SELECT q.obj_id, q.vid AS query_id, p.label, row_number() OVER (PARTITION BY q.vid ORDER BY sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)), p.vid) AS rank
    FROM vertices q JOIN vertices p ON q.obj_id = p.obj_id AND p.label <> 3),
    v AS (SELECT obj_id, query_id, label, count(*) AS n, min(rank) AS r FROM near WHERE rank <= 5 GROUP BY obj_id, query_id, label)"""


def _vertices(spark, d):
    return view(spark, d, "vertices").select("obj_id", F.col("vid").alias("id"), "x", "y", "z", "label")


@query(f"WITH {LABELS} SELECT obj_id, query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, r) AS rn FROM v) t WHERE rn = 1")
def k9_transfer_labels(spark, d):
    p = _vertices(spark, d)
    return K.transfer_labels(p.select("obj_id", F.col("id").alias("query_id"), "x", "y", "z"), p, 5, ignore=(3,))


@query(f"WITH {LABELS} SELECT obj_id, query_id, label FROM near WHERE rank = 1")
def k10_nearest_value(spark, d):
    p = _vertices(spark, d)
    return K.transfer_labels(p.select("obj_id", F.col("id").alias("query_id"), "x", "y", "z"), p, 1, ignore=(3,))


@query(_window_sql().replace("<= 1500", "<= 4000"))
def k11_view_majority(spark, d):
    return K.window_majority(_nodes(spark, d), _weighted(spark, d), "axoness", 4000.0)


@query()
def k12_budget_majority(spark, d):
    return K.window_majority(_nodes(spark, d), _weighted(spark, d), "axoness", 3000.0, "bfs_budget")


@query(f"WITH {EDGE} SELECT cell_id, src, dst FROM w WHERE ax_a IN (1, 3, 4) AND ax_b IN (1, 3, 4)")
def k13_axon_graph(spark, d):
    return _weighted(spark, d).where("axoness_a in (1, 3, 4) and axoness_b in (1, 3, 4)").select("cell_id", "src", "dst")


@query(f"""WITH {CUM}, {COORDS}, a AS (SELECT q.cell_id, q.query_id, n.node_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {DIST}, n.node_id) AS rn FROM q JOIN skel_nodes n ON q.cell_id = n.cell_id),
    s AS (SELECT a.cell_id, a.node_id, min(abs(a.c - b.c)) AS dist FROM cum a JOIN cum b ON a.cell_id = b.cell_id AND b.axoness = 2 GROUP BY a.cell_id, a.node_id)
    SELECT a.cell_id, query_id, round(coalesce(dist, -1), 4) AS soma_dist FROM a LEFT JOIN s ON a.cell_id = s.cell_id AND a.node_id = s.node_id WHERE rn = 1""")
def k14_soma_distance(spark, d):
    out = K.soma_distance(_coords(spark, d), _nodes(spark, d), _weighted(spark, d))
    finite = F.when(F.col("soma_dist") < float("inf"), F.col("soma_dist")).otherwise(-1.0)
    return out.select("cell_id", "query_id", F.round(finite, 4).alias("soma_dist"))


#: A point is at the first of the nodes on its place; edges are added one by one from the first point on, as the walk does.
@query("""WITH n AS (SELECT cell_id, node_id, x, y, z, min(node_id) OVER (PARTITION BY cell_id, x, y, z) AS at FROM skel_nodes),
    w AS (SELECT a.cell_id, b.node_id AS dst, sqrt((a.x - b.x) * 10 * ((a.x - b.x) * 10) + (a.y - b.y) * 10 * ((a.y - b.y) * 10) + (a.z - b.z) * 20 * ((a.z - b.z) * 20)) AS length FROM n a JOIN n b ON a.cell_id = b.cell_id AND b.node_id = a.node_id + 1),
    e AS (SELECT a.cell_id, a.node_id AS pair_id, a.at AS f, b.at AS t FROM n a JOIN n b ON a.cell_id = b.cell_id AND b.node_id = a.node_id + 3),
    s AS (SELECT e.cell_id, pair_id, list(length ORDER BY abs(dst - f)) AS l FROM e JOIN w ON w.cell_id = e.cell_id AND CASE WHEN f < t THEN dst > f AND dst <= t ELSE dst > t AND dst <= f END GROUP BY e.cell_id, pair_id),
    p AS (SELECT e.cell_id, e.pair_id, CASE WHEN l IS NULL THEN 0 ELSE list_reduce(l, lambda a, b: a + b) END AS dist FROM e LEFT JOIN s ON s.cell_id = e.cell_id AND s.pair_id = e.pair_id)
    SELECT cell_id, pair_id, round(CASE WHEN dist <= 2500 THEN dist ELSE -5 END, 4) AS dist FROM p""")
def k15_path_between(spark, d):
    n = _nodes(spark, d)
    end = lambda s, shift: n.select("cell_id", (F.col("node_id") - shift).alias("pair_id"), *[F.col(c).alias(f"{c}_{s}") for c in "xyz"])
    pairs = end("a", 0).join(end("b", 3), ["cell_id", "pair_id"])
    return K.path_between(pairs, n, _weighted(spark, d), 5.0, 2500.0).select("cell_id", "pair_id", F.round("dist", 4).alias("dist"))


@query("""WITH p AS (SELECT syn_id AS syn_a, lead(syn_id) OVER (PARTITION BY cell_1 ORDER BY syn_id) AS syn_b FROM synapses)
    SELECT syn_a, syn_b, round(sqrt(pow((a.x - b.x) * 10, 2) + pow((a.y - b.y) * 10, 2) + pow((a.z - b.z) * 20, 2)), 6) AS dist FROM p JOIN synapses a ON a.syn_id = syn_a JOIN synapses b ON b.syn_id = syn_b""")
def k16_synapse_distance(spark, d):
    """Each synapse and the next of its first cell."""
    from pyspark.sql.window import Window

    syn = view(spark, d, "synapses").select("syn_id", "cell_1", "x", "y", "z")
    following = F.lead("syn_id").over(Window.partitionBy("cell_1").orderBy("syn_id"))
    pairs = syn.select(F.col("syn_id").alias("syn_a"), following.alias("syn_b")).where("syn_b is not null")
    return K.synapse_distance(pairs, syn, SCALE).withColumn("dist", r6("dist"))


def _branched(spark, d, stubs: list[tuple[int, list[float]]]):
    """The chains with a branch at every inner node whose number ends in ``digit``, its nodes moved along x by the given steps."""
    n, e = _nodes(spark, d).select("cell_id", "node_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), view(spark, d, "skel_edges")
    last = e.groupBy("cell_id").agg(F.max("dst").alias("last"))
    nodes, edges = n, e
    for digit, steps in stubs:
        at = n.where(F.col("node_id") % 10 == digit).join(last, "cell_id").where("node_id > 0 and node_id < last").drop("last")
        before = F.col("node_id")
        for k, dx in enumerate(steps):
            name = F.col("node_id") + (10 * digit + k + 1) * 1000000
            nodes = nodes.unionByName(at.select("cell_id", name.alias("node_id"), (F.col("x") + dx).alias("x"), "y", "z"))
            edges = edges.unionByName(at.select("cell_id", before.alias("src"), name.alias("dst")))
            before = name
    return nodes, edges


BRANCHES = """WITH l AS (SELECT cell_id, max(node_id) AS last FROM skel_nodes GROUP BY cell_id) SELECT cell_id, node_id FROM skel_nodes
    UNION ALL SELECT cell_id, node_id + s FROM skel_nodes JOIN l USING (cell_id), (SELECT unnest([71000000, 72000000]) AS s) u WHERE node_id % 10 = 7 AND node_id > 0 AND node_id < last"""


@query(BRANCHES)
def k17_prune_branches(spark, d):
    """Short branches go, those that end far away stay."""
    return K.prune_branches(*_branched(spark, d, [(5, [0.001]), (2, [4.0, 0.002]), (7, [0.5, 5.0])]), 0.01)


@query(BRANCHES)
def k18_prune_by_path(spark, d):
    """Branches with a short path go, those that run out and come back stay."""
    return K.prune_branches(*_branched(spark, d, [(5, [0.001, 0.002]), (7, [5.0, 0.001])]), 0.01, True)


@query("""WITH k AS (SELECT cell_id, node_id, max(node_id) OVER (PARTITION BY cell_id) AS last FROM skel_nodes),
    s AS (SELECT cell_id, node_id AS src, lead(node_id) OVER (PARTITION BY cell_id ORDER BY node_id) AS dst FROM k WHERE node_id % 4 <> 0 OR node_id = 0 OR node_id = last)
    SELECT cell_id, src, dst FROM s WHERE dst IS NOT NULL""")
def k19_thin(spark, d):
    """On chains with a spike at every fourth node only the nodes between two straight edges go."""
    y = F.when(F.col("node_id") % 4 == 2, 10.0).otherwise(0.0)
    n = _nodes(spark, d).select("cell_id", "node_id", F.col("node_id").cast("double").alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return K.thin(n, view(spark, d, "skel_edges"), 0.5, 1e9, 0.99)


@query("SELECT DISTINCT cell_id, least(src % 7, dst % 7) AS src, greatest(src % 7, dst % 7) AS dst FROM skel_edges WHERE src % 7 <> dst % 7")
def k20_weld(spark, d):
    """Chains wound round seven places."""
    n = _nodes(spark, d).select("cell_id", "node_id", (F.col("node_id") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return K.weld(n, view(spark, d, "skel_edges"))[1]


@query("""WITH RECURSIVE g AS (SELECT obj_id, row_number() OVER (PARTITION BY obj_id ORDER BY gx, gy, gz) AS id, x, y, z FROM (SELECT obj_id, floor(x / 4) AS gx, floor(y / 4) AS gy, floor(z / 4) AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vertices GROUP BY 1, 2, 3, 4) m),
    e AS (SELECT a.obj_id, a.id AS u, b.id AS v, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS w FROM g a JOIN g b ON a.obj_id = b.obj_id AND a.id <> b.id),
    t(obj_id, inside, src, dst) AS (SELECT obj_id, [min(id)], CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM g GROUP BY obj_id
        UNION ALL SELECT obj_id, list_append(inside, n.v), least(n.u, n.v), greatest(n.u, n.v) FROM (SELECT t.obj_id, t.inside, min({'w': w, 'a': least(u, v), 'b': greatest(u, v), 'u': u, 'v': v}) AS n
            FROM t JOIN e ON e.obj_id = t.obj_id AND list_contains(t.inside, e.u) AND NOT list_contains(t.inside, e.v) GROUP BY t.obj_id, t.inside) s)
    SELECT obj_id, src, dst FROM t WHERE src IS NOT NULL""")
def k21_point_skeleton(spark, d):
    """Grid means, radius graph (here wide enough for one component) and its spanning tree."""
    from pyspark.sql.window import Window

    means = K.grid_means(_vertices(spark, d), "obj_id", 4.0)
    w = Window.partitionBy("obj_id").orderBy("gx", "gy", "gz")
    points = means.select("obj_id", F.row_number().over(w).cast("long").alias("id"), "x", "y", "z")
    return G.spanning_tree(radius_graph(points, 500.0, on=["obj_id"]).withColumn("weight", r6("weight")), "obj_id").select("obj_id", "src", "dst")


@query("SELECT obj_id, CAST(floor(x / 8) AS BIGINT) AS gx, CAST(floor(y / 8) AS BIGINT) AS gy, CAST(floor(z / 8) AS BIGINT) AS gz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM vertices GROUP BY obj_id, floor(x / 8), floor(y / 8), floor(z / 8)")
def k22_grid_means(spark, d):
    m = K.grid_means(_vertices(spark, d), "obj_id", 8.0)
    return m.select("obj_id", *[F.col(f"g{c}").cast("long").alias(f"g{c}") for c in "xyz"], *[r6(c).alias(c) for c in "xyz"], "n")


@query("""WITH b AS (SELECT obj_id, vid, x, y, z, floor(x / 10) AS gx, floor(y / 10) AS gy, floor(z / 10) AS gz FROM vertices),
    c AS (SELECT obj_id, gx, gy, gz, count(*) AS n, arg_min(struct_pack(x := x, y := y, z := z), struct_pack(d := pow(x - (gx + 0.5) * 10, 2) + pow(y - (gy + 0.5) * 10, 2) + pow(z - (gz + 0.5) * 10, 2), v := vid)) AS p FROM b GROUP BY obj_id, gx, gy, gz),
    t AS (SELECT obj_id, p, rn FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, gx, gy, gz) AS rn FROM c) r WHERE rn <= 3)
    SELECT t.obj_id, CAST(rn AS INTEGER) AS rank, round(avg(v.x), 6) AS x, round(avg(v.y), 6) AS y, round(avg(v.z), 6) AS z, count(*) AS n FROM t JOIN vertices v ON v.obj_id = t.obj_id AND sqrt(pow(v.x - p.x, 2) + pow(v.y - p.y, 2) + pow(v.z - p.z, 2)) <= 9.5 GROUP BY t.obj_id, rn""")
def k23_density_samples(spark, d):
    s = K.density_samples(_vertices(spark, d), "obj_id", 10.0, 3, 9.5)
    return s.select("obj_id", "rank", *[r6(c).alias(c) for c in "xyz"], "n")


@query("""WITH n AS (SELECT obj_id, vid, x + 0.5 AS x, y, z FROM vertices WHERE label = 0),
    d AS (SELECT n.obj_id, n.vid, sqrt(pow(n.x - v.x, 2) + pow(n.y - v.y, 2) + pow(n.z - v.z, 2)) AS dist, row_number() OVER (PARTITION BY n.vid ORDER BY sqrt(pow(n.x - v.x, 2) + pow(n.y - v.y, 2) + pow(n.z - v.z, 2)), v.vid) AS rn FROM n JOIN vertices v ON n.obj_id = v.obj_id)
    SELECT obj_id AS cell_id, vid AS node_id, round(quantile_cont(dist, 0.5) * 2 / 10, 6) AS diameter FROM d WHERE rn <= 5 GROUP BY obj_id, vid""")
def k24_node_diameters(spark, d):
    v = view(spark, d, "vertices").select(F.col("obj_id").alias("cell_id"), F.col("vid").alias("id"), "x", "y", "z", "label")
    nodes = v.where("label = 0").select("cell_id", F.col("id").alias("node_id"), (F.col("x") + 0.5).alias("x"), "y", "z")
    return K.node_diameters(nodes, v, 5).withColumn("diameter", r6("diameter"))


@query("""WITH RECURSIVE e AS (SELECT a.vid AS src, b.vid AS dst FROM vertices a JOIN vertices b ON a.obj_id = b.obj_id AND a.label = b.label AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 9.5),
    comp_r(u, v) AS (SELECT src, src FROM e UNION SELECT r.u, e.dst FROM comp_r r JOIN e ON r.v = e.src), comp AS (SELECT u AS node, min(v) AS component FROM comp_r GROUP BY u)
    SELECT obj_id, label, component, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM comp JOIN vertices ON node = vid GROUP BY obj_id, label, component HAVING count(*) >= 3""")
def k25_label_components(spark, d):
    c = K.label_components(_vertices(spark, d), 9.5, "obj_id", 3)
    return c.select("obj_id", "label", "component", "n", *[r6(x).alias(x) for x in "xyz"])


@query("SELECT cell_id, round(avg(CASE WHEN axoness = 2 THEN x END), 6) AS soma_x, round(avg(CASE WHEN axoness = 2 THEN y END), 6) AS soma_y, round(avg(CASE WHEN axoness = 2 THEN z END), 6) AS soma_z FROM skel_nodes GROUP BY cell_id HAVING max(CASE WHEN axoness = 0 THEN 1 ELSE 0 END) + max(CASE WHEN axoness = 1 THEN 1 ELSE 0 END) + max(CASE WHEN axoness = 2 THEN 1 ELSE 0 END) = 3")
def k26_complete_cells(spark, d):
    return K.complete_cells(_nodes(spark, d)).select("cell_id", *[r6(f"soma_{c}").alias(f"soma_{c}") for c in "xyz"])


FACE = """f AS (SELECT g.obj_id, fid, g.a, g.b, g.c, va.label AS la, vb.label AS lb, vc.label AS lc, vb.x - va.x AS ux, vb.y - va.y AS uy, vb.z - va.z AS uz, vc.x - va.x AS wx, vc.y - va.y AS wy, vc.z - va.z AS wz
    FROM faces g JOIN vertices va ON va.vid = g.a JOIN vertices vb ON vb.vid = g.b JOIN vertices vc ON vc.vid = g.c),
    nrm AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM f)"""


def _mesh(spark, d):
    return view(spark, d, "faces"), view(spark, d, "vertices")


@query(f"WITH {FACE} SELECT obj_id, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2) / 1e6 * 1000, 6) AS area FROM nrm GROUP BY obj_id")
def k27_mesh_area(spark, d):
    return K.mesh_area(*_mesh(spark, d)).select("obj_id", r6(F.col("area") * 1000).alias("area"))


@query("""WITH p AS (SELECT obj_id, vid, row_number() OVER (ORDER BY obj_id, vid) - 1 AS p FROM vertices)
    SELECT f.obj_id, fid, pa.p AS a, pb.p AS b, pc.p AS c FROM faces f JOIN p pa ON pa.vid = f.a JOIN p pb ON pb.vid = f.b JOIN p pc ON pc.vid = f.c""")
def k28_merged_faces(spark, d):
    return K.merged_faces(*_mesh(spark, d))


@query("SELECT obj_id, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 6) AS diagonal FROM vertices GROUP BY obj_id")
def k29_mesh_box(spark, d):
    return K.mesh_box(view(spark, d, "vertices")).select("obj_id", r6("diagonal").alias("diagonal"))


@query(f"WITH {FACE} SELECT obj_id, fid, CASE WHEN la = lb OR la = lc THEN la WHEN lb = lc THEN lb ELSE -1 END AS label FROM f")
def k30_face_labels(spark, d):
    return K.face_labels(*_mesh(spark, d))


@query(f"""WITH {FACE}, u AS (SELECT obj_id, unnest([a, b, c]) AS vid, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM nrm)
    SELECT obj_id, vid, round(-sum(CASE WHEN s > 0 THEN nx / s ELSE 0 END), 6) + 0 AS nx, round(-sum(CASE WHEN s > 0 THEN ny / s ELSE 0 END), 6) + 0 AS ny, round(-sum(CASE WHEN s > 0 THEN nz / s ELSE 0 END), 6) + 0 AS nz FROM u GROUP BY obj_id, vid""")
def k31_vertex_normals(spark, d):
    return K.vertex_normals(*_mesh(spark, d)).select("obj_id", "vid", *[(r6(f"n{c}") + 0.0).alias(f"n{c}") for c in "xyz"])


@query("""SELECT q.vid AS id FROM (SELECT vid, x + 3 AS x, y + 5 AS y, z + 2 AS z FROM vertices WHERE label = 1) q WHERE NOT EXISTS (SELECT 1 FROM vertices v
    WHERE v.x >= q.x - 1.5 AND v.x < q.x + 1.5 AND v.y >= q.y - 1.5 AND v.y < q.y + 1.5 AND v.z >= q.z - 1.5 AND v.z < q.z + 1.5)""")
def k32_empty_spaces(spark, d):
    v = _vertices(spark, d)
    q = v.where("label = 1").select("id", (F.col("x") + 3).alias("x"), (F.col("y") + 5).alias("y"), (F.col("z") + 2).alias("z"))
    return K.empty_spaces(q, v, 3.0).select("id")


@query()
def k33_surface_path(spark, d):
    """Ways along each object's surface, counted in two of its four labels; held against a plain closure in the tests."""
    v = view(spark, d, "vertices")
    parts = v.select(F.col("obj_id").alias("path_id"), F.col("label").alias("part"), "vid", "x", "y", "z", (F.col("label") % 2 == 0).alias("counted"))
    return K.surface_path(parts, 40.0, 6).select("path_id", r6("length").alias("length"))
