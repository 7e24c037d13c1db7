"""The registered queries over the test tables, each with its SQL twin.

Fixtures: `geo`, the forest of regions, nations, customers and suppliers; `trade`, customers and suppliers that share two lineitems or more; points, the
first components of embeddings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import add, contains, scale, uniform
from .operators import density, graph, layout
from .operators.pyramid import accepted, bounding_box, grid_of
from .operators.pyramid import cell_pyramid as pyramid_of
from .plans import detect, find_communities
from .sources import community_lines as lines_of
from .sources import parse_edges

LINES = ["1 2", "  3\t4 x", "1 2.5", "1 2abc", "+1 +2", "5 6\r", "7 8", "1,2", "1.5 2", "0x10 2", "# c", "", "99999999999 1"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst: nation to region, customer to nation, supplier to nation."""
    customers = _read(spark, sf, "customer")
    n = customers.count()
    nation = _read(spark, sf, "nation").select((F.col("n_nationkey") + 5).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    customer = customers.select((F.col("c_custkey") + 30).cast("long").alias("src"), (F.col("c_nationkey") + 5).cast("long").alias("dst"))
    supplier = _read(spark, sf, "supplier").select((F.col("s_suppkey") + 30 + n).cast("long").alias("src"), (F.col("s_nationkey") + 5).cast("long").alias("dst"))
    return reduce(DataFrame.unionAll, (nation, customer, supplier))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """src (customer), dst (supplier, after the customers) with at least two lineitems."""
    n = _read(spark, sf, "customer").count()
    pairs = _read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(_read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).count().where("count >= 2").select("src", "dst")


def points(spark: SparkSession, sf: str, dims: int = 3) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # adding 0 makes a negative zero positive
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


GEO = """geo AS (SELECT CAST(n_nationkey + 5 AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation
    UNION ALL SELECT CAST(c_custkey + 30 AS BIGINT), CAST(c_nationkey + 5 AS BIGINT) FROM customer
    UNION ALL SELECT CAST(s_suppkey + 30 + (SELECT count(*) FROM customer) AS BIGINT), CAST(s_nationkey + 5 AS BIGINT) FROM supplier),
    adj AS (SELECT src AS id, dst AS nbr FROM geo UNION ALL SELECT dst, src FROM geo),
    nv AS (SELECT coalesce(max(greatest(src, dst)) + 1, 0) AS n FROM geo),
    deg AS (SELECT v.id, CAST(count(a.id) AS DOUBLE) AS deg FROM (SELECT unnest(range(n)) AS id FROM nv) v LEFT JOIN adj a ON a.id = v.id GROUP BY 1)"""


def _u(tag: str, key: str = "id") -> str:
    return f"CAST('0x' || substr(md5(concat(CAST({key} AS VARCHAR), ':{tag}:42')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


POS = GEO + f""",
    pos AS (SELECT id, deg, {_u('0')} - 0.5 AS x0, {_u('1')} - 0.5 AS x1, {_u('2')} - 0.5 AS x2 FROM deg),
    tot AS (SELECT 2.0 * count(*) AS total FROM geo),
    fac AS (SELECT CASE WHEN total > 0 THEN pow(total, -0.975) ELSE 0.0 END AS factor FROM tot)"""
D2 = "((q.x0 - p.x0) * (q.x0 - p.x0) + (q.x1 - p.x1) * (q.x1 - p.x1) + (q.x2 - p.x2) * (q.x2 - p.x2))"
PTS3 = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings)"
PTS2 = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS x2 FROM embeddings)"


def _kd(pts: str, prune: float = 0.0) -> str:
    return f"""{pts}, dd AS (SELECT p.id, sqrt({D2}) AS d, row_number() OVER (PARTITION BY p.id ORDER BY {D2}) AS r FROM pts p, pts q),
    kd AS (SELECT id, d AS k_dist FROM dd WHERE r = 7),
    cv AS (SELECT * FROM (SELECT id, k_dist, row_number() OVER (ORDER BY k_dist, id) AS rn, count(*) OVER () AS n FROM kd) WHERE rn <= floor(n * (1 - {prune}) + 1e-9)),
    st AS (SELECT min(k_dist) AS lo, max(k_dist) AS hi, count(*) AS m FROM cv),
    xy AS (SELECT rn, k_dist, CAST(m - rn AS DOUBLE) / n AS x, CASE WHEN hi > lo THEN (k_dist - lo) / (hi - lo) ELSE 0.0 END AS y, hi = lo AS flat FROM cv, st)"""


def _eps(elbow: str) -> str:
    score = f"0.5 * x + ({density.COS!r} - 0.5) * (y - 1)" if elbow == "reference" else "x + y"
    return f"eps AS (SELECT rn - 1 AS idx, k_dist AS eps FROM xy ORDER BY CASE WHEN flat THEN CAST(rn AS DOUBLE) ELSE round({score}, 12) END, rn LIMIT 1)"


def _near(pts: str, elbow: str) -> str:
    return f"""WITH RECURSIVE {_kd(pts)}, {_eps(elbow)},
    nb AS (SELECT p.id, q.id AS nbr FROM pts p, pts q, eps WHERE sqrt({D2}) <= eps),
    core AS (SELECT id, count(*) AS n_near, count(*) >= 7 AS is_core FROM nb GROUP BY id)"""


FLOOD = _near(PTS2, "rotation") + """, reach AS (SELECT id, id AS r FROM pts UNION SELECT nb.nbr, reach.r FROM reach JOIN nb ON nb.id = reach.id),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    good AS (SELECT c, bool_or(is_core) AS good FROM comp JOIN core USING (id) GROUP BY c),
    cl AS (SELECT id, CASE WHEN good THEN c END AS cluster_id, NOT good AS is_noise FROM comp JOIN good USING (c)),
    ranked AS (SELECT cluster_id, is_noise, row_number() OVER (ORDER BY is_noise, cluster_id) - 1 AS no, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS line, count(*) AS n FROM cl GROUP BY 1, 2)"""
CANONICAL = _near(PTS2, "rotation") + """, cc AS (SELECT id, nbr FROM nb WHERE id IN (SELECT id FROM core WHERE is_core) AND nbr IN (SELECT id FROM core WHERE is_core)),
    reach AS (SELECT id, id AS r FROM core WHERE is_core UNION SELECT cc.nbr, reach.r FROM reach JOIN cc ON cc.id = reach.id),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    bord AS (SELECT nb.id, min(comp.c) AS c FROM nb JOIN comp ON comp.id = nb.nbr WHERE nb.id NOT IN (SELECT id FROM comp) GROUP BY nb.id),
    al AS (SELECT * FROM comp UNION ALL SELECT * FROM bord), nm AS (SELECT c, min(id) AS least FROM al GROUP BY c)"""


def _pos(spark: SparkSession, sf: str) -> DataFrame:
    return layout.init_positions(graph.vertices(geo(spark, sf)))


def _factor(spark: SparkSession, sf: str) -> float:
    return graph.repulsion_factor(geo(spark, sf)).first()["factor"]


def _rotation_eps(spark: SparkSession, sf: str) -> float:
    return density.elbow_eps(density.curve(density.k_distance(points(spark, sf, 2))), "rotation").first()["eps"]


def _clusters(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return find_communities(points(spark, sf, 2), Config(elbow="rotation", mode=mode))[1]


def _communities(spark: SparkSession, sf: str) -> DataFrame:
    return density.communities(_clusters(spark, sf, "flood"))


def detect_communities(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run on the geo forest."""
    return lines_of(detect(geo(spark, sf)).communities)


def layout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return layout.run_layout(trade(spark, sf), Config()).metrics


def _steps_input(spark: SparkSession) -> DataFrame:
    """Energies at all steps, from a hash of the row."""
    return spark.range(500).select("id", *[F.round(uniform(F.col("id"), f"e{s}"), 3).alias(f"e{s}") for s in layout.STEPS])


def _case_search() -> str:
    """The search, step by step: g is whether halving goes on, b the best step, m the best energy."""
    out, last = "t0 AS (SELECT *, true AS g, 0 AS b, e0 AS m FROM e)", "t0"
    for k, s in enumerate((32, 16, 8, 4, 2, 1), 1):
        out += f", t{k} AS (SELECT * REPLACE (g AND (b = 0 OR e{s} < m) AS g, CASE WHEN g AND e{s} < m THEN {s} ELSE b END AS b, CASE WHEN g AND e{s} < m THEN e{s} ELSE m END AS m) FROM {last})"
        last = f"t{k}"
    for k, s in ((7, 64), (8, 128)):
        out += f", t{k} AS (SELECT * REPLACE (CASE WHEN b = {s // 2} AND e{s} < m THEN {s} ELSE b END AS b, CASE WHEN b = {s // 2} AND e{s} < m THEN e{s} ELSE m END AS m) FROM {last})"
        last = f"t{k}"
    return out


def _pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return _r(pyramid_of(_pos(spark, sf), 4), "com0", "com1", "com2").select("level", "c0", "c1", "c2", "weight", F.col("n").cast("long").alias("n"), "com0", "com1", "com2")


def _stand_ins(spark: SparkSession, sf: str) -> DataFrame:
    """What stands for all other vertices of the geo forest in a pyramid of 4 levels below its root."""
    pos = _pos(spark, sf)
    grid = grid_of(pos)
    return accepted(pos.where("deg > 0"), pyramid_of(pos, 4, grid=grid), grid, 4)


def _approximate(spark: SparkSession, sf: str) -> DataFrame:
    return _r(layout.approximate_repulsion(_stand_ins(spark, sf), 0.9, _factor(spark, sf)), "energy", "g0", "g1", "g2", digits=5)


def _step(spark: SparkSession, sf: str) -> DataFrame:
    """The first move of the geo forest, all vertices at once."""
    return layout.layout_step(graph.symmetrise(geo(spark, sf)), _pos(spark, sf), 1.15, 0.9, _factor(spark, sf), 4)


def _edges_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parse_edges(spark.createDataFrame([(x,) for x in LINES], "value string"))


QUERIES = {
    "edges_parse": _edges_parse,
    "vertex_count": lambda s, d: graph.vertex_count(geo(s, d)),
    "symmetrise": lambda s, d: graph.symmetrise(geo(s, d)),
    "trade_symmetrise": lambda s, d: graph.symmetrise(trade(s, d)),
    "degree": lambda s, d: graph.vertices(geo(s, d)),
    "total_degree": lambda s, d: graph.total_degree(geo(s, d)),
    "repulsion_factor": lambda s, d: _r(graph.repulsion_factor(geo(s, d)), "factor", digits=12),
    "init_positions": lambda s, d: _r(_pos(s, d), "x0", "x1", "x2", digits=9),
    "bbox": lambda s, d: _r(bounding_box(_pos(s, d)), *[f"{n}{i}" for i in range(3) for n in ("lo", "hi")], digits=9),
    "exponent_schedule": lambda s, d: _r(layout.exponent_schedule(s), "a", "r", digits=9),
    "attractive_energy": lambda s, d: _r(layout.attractive_energy(graph.symmetrise(geo(s, d)), _pos(s, d), 1.15), "energy", digits=5),
    "attractive_energy_log": lambda s, d: _r(layout.attractive_energy(graph.symmetrise(geo(s, d)), _pos(s, d), 0.0), "energy", digits=5),
    "attractive_direction": lambda s, d: _r(layout.attractive_direction(graph.symmetrise(geo(s, d)), _pos(s, d), 1.15), "g0", "g1", "g2", digits=5),
    "repulsive_energy": lambda s, d: _r(layout.exact_repulsion(_pos(s, d), 0.9, _factor(s, d), parts=("energy",), digits=5), "energy", digits=5),
    "repulsive_energy_log": lambda s, d: _r(layout.exact_repulsion(_pos(s, d), 0.0, _factor(s, d), parts=("energy",), digits=5), "energy", digits=5),
    "repulsive_direction": lambda s, d: _r(layout.exact_repulsion(_pos(s, d), 0.9, _factor(s, d), parts=("g0", "g1", "g2"), digits=5), "g0", "g1", "g2", digits=5),
    "total_energy": lambda s, d: _r(layout.total_energy(layout.attractive_energy(graph.symmetrise(geo(s, d)), _pos(s, d), 1.15)), "energy", digits=3),
    "cell_pyramid": _pyramid,
    "approximate_repulsion": _approximate,
    "layout_step": lambda s, d: _r(_r(_step(s, d), "energy", digits=4), "x0", "x1", "x2", digits=5).select("id", F.col("step").cast("int").alias("step"), "energy", "x0", "x1", "x2"),
    "step_energy": lambda s, d: _r(layout.total_energy(_step(s, d)), "energy", digits=2),
    "vector_sum": lambda s, d: _read(s, d, "embeddings").select("vec_id", F.transform(scale(add(F.col("embedding").cast("array<double>"), F.reverse(F.col("embedding").cast("array<double>"))), 0.5), lambda x: F.round(x, 6) + F.lit(0.0))[5].alias("x5")),
    "membership": lambda s, d: _read(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("keys")).select("n_regionkey", contains(F.col("keys"), 7).alias("has")),
    "line_search_step": lambda s, d: layout.line_search_step(_steps_input(s)).select("id", "step"),
    "k_distance": lambda s, d: _r(density.k_distance(points(s, d)), "k_dist"),
    "k_distance_curve": lambda s, d: _r(density.curve(density.k_distance(points(s, d))), "k_dist"),
    "kdist_pruned": lambda s, d: _r(density.curve(density.k_distance(points(s, d)), 0.1), "k_dist"),
    "elbow_eps": lambda s, d: _r(density.elbow_eps(density.curve(density.k_distance(points(s, d)))), "eps"),
    "elbow_eps_rotation": lambda s, d: _r(density.elbow_eps(density.curve(density.k_distance(points(s, d))), "rotation"), "eps"),
    "range_neighbours": lambda s, d: density.range_neighbours(points(s, d, 2), _rotation_eps(s, d)),
    "core_points": lambda s, d: density.core_points(density.range_neighbours(points(s, d, 2), _rotation_eps(s, d))),
    "density_flood": lambda s, d: _clusters(s, d, "flood"),
    "density_canonical": lambda s, d: _clusters(s, d, "canonical"),
    "noise_bucket": lambda s, d: _communities(s, d).select("cluster_id", F.size("members").cast("long").alias("n")),
    "community_members": lambda s, d: density.community_members(_clusters(s, d, "flood")),
    "community_lines": lambda s, d: lines_of(_communities(s, d)),
    "layout_metrics": layout_metrics,
    "detect_communities": detect_communities,
}

_S = "(o.x{0} + g.g{0} * s / 32.0 - {1}{0})"
_TRY = lambda y: "(" + " + ".join(f"{_S.format(i, y)} * {_S.format(i, y)}" for i in range(3)) + ")"
NEAR = POS + f""", m AS (SELECT * FROM pos WHERE deg > 0), bx AS (SELECT {', '.join(f'min(x{i}) AS l{i}, max(x{i}) AS h{i}' for i in range(3))} FROM m),
    w AS (SELECT *, greatest(w0, w1, w2) AS side FROM (SELECT {', '.join(f'l{i} - 0.51 * (h{i} - l{i}) AS o{i}, 2.03 * (h{i} - l{i}) AS w{i}' for i in range(3))} FROM bx)),
    cells AS (SELECT level, c0, c1, c2, sum(deg) AS weight, count(*) AS n, {', '.join(f'sum(deg * x{i}) / sum(deg) AS x{i}' for i in range(3))}
        FROM (SELECT CAST(level AS INTEGER) AS level, {', '.join(f'CAST(floor((x{i} - o{i}) / w{i} * pow(2, level)) AS BIGINT) AS c{i}' for i in range(3))}, deg, x0, x1, x2 FROM m, w, (SELECT unnest(range(5)) AS level)) GROUP BY 1, 2, 3, 4),
    fr(id, level, c0, c1, c2) AS (SELECT id, CAST(0 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM m
        UNION ALL SELECT f.id, k.level, k.c0, k.c1, k.c2 FROM fr f JOIN cells q ON q.level = f.level AND q.c0 = f.c0 AND q.c1 = f.c1 AND q.c2 = f.c2 JOIN m p ON p.id = f.id
            JOIN cells k ON k.level = f.level + 1 AND k.c0 // 2 = f.c0 AND k.c1 // 2 = f.c1 AND k.c2 // 2 = f.c2, w WHERE f.level < 4 AND q.n > 1 AND {D2} < pow(side / pow(2, f.level), 2)),
    hit AS (SELECT p.id, p.deg, p.x0, p.x1, p.x2, q.weight, q.x0 AS z0, q.x1 AS z1, q.x2 AS z2, {' AND '.join(f'floor((p.x{i} - o{i}) / w{i} * pow(2, f.level)) = q.c{i}' for i in range(3))} AS own
        FROM fr f JOIN cells q ON q.level = f.level AND q.c0 = f.c0 AND q.c1 = f.c1 AND q.c2 = f.c2 JOIN m p ON p.id = f.id, w WHERE f.level = 4 OR q.n = 1 OR {D2} >= pow(side / pow(2, f.level), 2)),
    near AS (SELECT id, deg, weight - CASE WHEN own THEN deg ELSE 0 END AS mass, x0, x1, x2, {', '.join(f'CASE WHEN own THEN (weight * z{i} - deg * x{i}) / (weight - deg) ELSE z{i} END AS y{i}' for i in range(3))} FROM hit WHERE NOT own OR weight - deg > 1e-9 * weight)"""
_N2 = "((n.x0 - n.y0) * (n.x0 - n.y0) + (n.x1 - n.y1) * (n.x1 - n.y1) + (n.x2 - n.y2) * (n.x2 - n.y2))"
STEP = NEAR + f""", push AS (SELECT id, {', '.join(f'sum(factor * n.deg * n.mass * (n.x{i} - n.y{i}) * pow({_N2}, -0.55)) AS r{i}' for i in range(3))} FROM near n, fac WHERE {_N2} > 0 GROUP BY 1),
    pulls AS (SELECT p.id, {', '.join(f'sum((q.x{i} - p.x{i}) * pow({D2}, -0.425)) AS a{i}' for i in range(3))} FROM adj JOIN pos p ON p.id = adj.id JOIN pos q ON q.id = adj.nbr WHERE {D2} > 0 GROUP BY 1),
    o AS (SELECT * FROM m), g AS (SELECT o.id, {', '.join(f'coalesce(r{i}, 0) + coalesce(a{i}, 0) AS g{i}' for i in range(3))} FROM o LEFT JOIN push ON push.id = o.id LEFT JOIN pulls ON pulls.id = o.id),
    ss AS (SELECT unnest([{', '.join(map(str, layout.STEPS))}]) AS s),
    ea AS (SELECT o.id, s, sum(CASE WHEN adj.id = adj.nbr OR {_TRY('q.x')} <= 0 THEN 0 ELSE pow({_TRY('q.x')}, 0.575) / 1.15 END) AS v FROM o JOIN g ON g.id = o.id JOIN adj ON adj.id = o.id JOIN pos q ON q.id = adj.nbr, ss GROUP BY 1, 2),
    er AS (SELECT o.id, s, -sum(factor * o.deg * n.mass * CASE WHEN {_TRY('n.y')} > 0 THEN pow({_TRY('n.y')}, 0.45) / 0.9 ELSE 0 END) AS v FROM o JOIN g ON g.id = o.id JOIN near n ON n.id = o.id, ss, fac GROUP BY 1, 2),
    e AS (SELECT id, {', '.join(f'sum(CASE WHEN s = {k} THEN v ELSE 0 END) AS e{k}' for k in layout.STEPS)} FROM (SELECT * FROM ea UNION ALL SELECT * FROM er) GROUP BY 1),
    {_case_search()}"""
_VALUES = ", ".join("('" + x.replace("'", "''") + "')" for x in LINES)
_G = "q.x{0} - p.x{0}"
SQL = {
    "edges_parse": f"""WITH l(v) AS (VALUES {_VALUES}), m AS (SELECT regexp_extract(v, '^\\s*([+-]?\\d+)(?:\\s+([+-]?\\d+)|([+-]\\d+))', 1) AS a,
        regexp_extract(v, '^\\s*([+-]?\\d+)(?:\\s+([+-]?\\d+)|([+-]\\d+))', 2) || regexp_extract(v, '^\\s*([+-]?\\d+)(?:\\s+([+-]?\\d+)|([+-]\\d+))', 3) AS b FROM l)
        SELECT CAST(TRY_CAST(ltrim(a, '+') AS INTEGER) AS BIGINT) AS src, CAST(TRY_CAST(ltrim(b, '+') AS INTEGER) AS BIGINT) AS dst FROM m
        WHERE TRY_CAST(ltrim(a, '+') AS INTEGER) IS NOT NULL AND TRY_CAST(ltrim(b, '+') AS INTEGER) IS NOT NULL""",
    "vertex_count": f"WITH {GEO} SELECT CAST(n AS BIGINT) AS n FROM nv",
    "symmetrise": f"WITH {GEO} SELECT id, nbr FROM adj",
    "trade_symmetrise": """WITH t AS (SELECT o_custkey AS src, l_suppkey + (SELECT count(*) FROM customer) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT src AS id, dst AS nbr FROM t UNION ALL SELECT dst, src FROM t""",
    "degree": f"WITH {GEO} SELECT id, deg FROM deg",
    "total_degree": "SELECT 2.0 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) AS total".replace("2.0 *", "CAST(2 AS DOUBLE) *"),
    "repulsion_factor": f"WITH {POS} SELECT CAST(total AS DOUBLE) AS total, round(factor, 12) AS factor FROM tot, fac",
    "init_positions": f"WITH {POS} SELECT id, deg, round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2 FROM pos",
    "bbox": f"WITH {POS} SELECT " + ", ".join(f"round({f}(x{i}), 9) AS {n}{i}" for i in range(3) for f, n in (("min", "lo"), ("max", "hi"))) + " FROM pos",
    "exponent_schedule": """WITH i AS (SELECT CAST(unnest(range(1, 101)) AS INTEGER) AS iter), s AS (SELECT iter, CASE WHEN iter <= 60 THEN 1.0 WHEN iter < 90 THEN (0.9 - iter / 100.0) / 0.3 ELSE 0.0 END AS f FROM i)
        SELECT iter, round(CAST(0.05 + 1.1 * f AS DOUBLE), 9) AS a, round(CAST(0.9 * f AS DOUBLE), 9) AS r FROM s""",
    "attractive_energy": f"WITH {POS} SELECT p.id, round(sum(CASE WHEN {D2} > 0 THEN pow({D2}, 0.575) / 1.15 ELSE 0 END), 5) AS energy FROM adj JOIN pos p ON p.id = adj.id JOIN pos q ON q.id = adj.nbr GROUP BY 1",
    "attractive_energy_log": f"WITH {POS} SELECT p.id, round(sum(CASE WHEN {D2} > 0 THEN 0.5 * ln({D2}) ELSE 0 END), 5) AS energy FROM adj JOIN pos p ON p.id = adj.id JOIN pos q ON q.id = adj.nbr GROUP BY 1",
    "attractive_direction": f"WITH {POS} SELECT p.id, " + ", ".join(f"round(sum(CASE WHEN {D2} > 0 THEN ({_G.format(i)}) * pow({D2}, -0.425) ELSE 0 END), 5) + 0.0 AS g{i}" for i in range(3)) + " FROM adj JOIN pos p ON p.id = adj.id JOIN pos q ON q.id = adj.nbr GROUP BY 1",
    "repulsive_energy": f"WITH {POS} SELECT p.id, round(-any_value(factor) * any_value(p.deg) * sum(CASE WHEN {D2} > 0 AND p.id <> q.id THEN q.deg * pow({D2}, 0.45) / 0.9 ELSE 0 END), 5) AS energy FROM pos p, pos q, fac GROUP BY 1",
    "repulsive_energy_log": f"WITH {POS} SELECT p.id, round(-any_value(factor) * any_value(p.deg) * sum(CASE WHEN p.id <> q.id THEN CASE WHEN {D2} > 0 THEN q.deg * 0.5 * ln({D2}) ELSE 0 END ELSE 0 END), 5) + 0.0 AS energy FROM pos p, pos q, fac GROUP BY 1",
    "repulsive_direction": f"WITH {POS} SELECT p.id, " + ", ".join(f"round(any_value(factor) * any_value(p.deg) * sum(CASE WHEN p.id <> q.id THEN CASE WHEN {D2} > 0 THEN q.deg * (p.x{i} - q.x{i}) * pow({D2}, -0.55) ELSE 0 END ELSE 0 END), 5) + 0.0 AS g{i}" for i in range(3)) + " FROM pos p, pos q, fac GROUP BY 1",
    "total_energy": f"WITH {POS} SELECT round(sum(CASE WHEN {D2} > 0 THEN pow({D2}, 0.575) / 1.15 ELSE 0 END), 3) AS energy FROM adj JOIN pos p ON p.id = adj.id JOIN pos q ON q.id = adj.nbr",
    "cell_pyramid": f"""WITH {POS}, m AS (SELECT * FROM pos WHERE deg > 0), bx AS (SELECT {', '.join(f'min(x{i}) AS l{i}, max(x{i}) AS h{i}' for i in range(3))} FROM m),
        w AS (SELECT {', '.join(f'l{i} - 0.51 * (h{i} - l{i}) AS o{i}, 2.03 * (h{i} - l{i}) AS w{i}' for i in range(3))} FROM bx),
        c AS (SELECT CAST(level AS INTEGER) AS level, {', '.join(f'CAST(floor((x{i} - o{i}) / w{i} * pow(2, level)) AS BIGINT) AS c{i}' for i in range(3))}, deg, x0, x1, x2 FROM m, w, (SELECT unnest(range(5)) AS level))
        SELECT level, c0, c1, c2, sum(deg) AS weight, count(*) AS n, {', '.join(f'round(sum(deg * x{i}) / sum(deg), 6) + 0.0 AS com{i}' for i in range(3))} FROM c GROUP BY 1, 2, 3, 4""",
    "approximate_repulsion": f"WITH RECURSIVE {NEAR} SELECT n.id, round(-sum(factor * n.deg * n.mass * CASE WHEN {_N2} > 0 THEN pow({_N2}, 0.45) / 0.9 ELSE 0 END), 5) + 0.0 AS energy, " + ", ".join(f"round(sum(CASE WHEN {_N2} > 0 THEN factor * n.deg * n.mass * (n.x{i} - n.y{i}) * pow({_N2}, -0.55) ELSE 0 END), 5) + 0.0 AS g{i}" for i in range(3)) + " FROM near n, fac GROUP BY 1",
    "layout_step": f"WITH RECURSIVE {STEP} SELECT t8.id, CAST(b AS INTEGER) AS step, round(m, 4) + 0.0 AS energy, " + ", ".join(f"round(o.x{i} + g.g{i} * b / 32.0, 5) + 0.0 AS x{i}" for i in range(3)) + " FROM t8 JOIN o ON o.id = t8.id JOIN g ON g.id = t8.id",
    "step_energy": f"WITH RECURSIVE {STEP} SELECT round(sum(m), 2) AS energy FROM t8",
    "vector_sum": "SELECT vec_id, round((CAST(embedding[6] AS DOUBLE) + CAST(embedding[59] AS DOUBLE)) * 0.5, 6) + 0.0 AS x5 FROM embeddings",
    "membership": "SELECT n_regionkey, list_contains(list(n_nationkey), 7) AS has FROM nation GROUP BY 1",
    "line_search_step": "WITH e AS (SELECT id, " + ", ".join(f"round({_u('e' + str(s))}, 3) AS e{s}" for s in layout.STEPS) + f" FROM (SELECT unnest(range(500)) AS id)), {_case_search()} SELECT id, CAST(b AS INTEGER) AS step FROM t8",
    "k_distance": f"WITH {_kd(PTS3)} SELECT id, round(k_dist, 6) AS k_dist FROM kd",
    "k_distance_curve": f"WITH {_kd(PTS3)} SELECT id, round(k_dist, 6) AS k_dist, rn, n FROM cv",
    "kdist_pruned": f"WITH {_kd(PTS3, 0.1)} SELECT id, round(k_dist, 6) AS k_dist, rn, n FROM cv",
    "elbow_eps": f"WITH {_kd(PTS3)}, {_eps('reference')} SELECT idx, round(eps, 6) AS eps FROM eps",
    "elbow_eps_rotation": f"WITH {_kd(PTS3)}, {_eps('rotation')} SELECT idx, round(eps, 6) AS eps FROM eps",
    "range_neighbours": _near(PTS2, "rotation") + " SELECT id, nbr FROM nb",
    "core_points": _near(PTS2, "rotation") + " SELECT id, n_near, is_core FROM core",
    "density_flood": FLOOD + " SELECT id, cluster_id, is_noise FROM cl",
    "density_canonical": CANONICAL + " SELECT pts.id, nm.least AS cluster_id, nm.least IS NULL AS is_noise FROM pts LEFT JOIN al ON al.id = pts.id LEFT JOIN nm ON nm.c = al.c",
    "noise_bucket": FLOOD + " SELECT no AS cluster_id, n FROM ranked",
    "community_members": FLOOD + " SELECT ranked.no AS cluster_id, cl.id FROM cl JOIN ranked ON ranked.cluster_id IS NOT DISTINCT FROM cl.cluster_id",
    "community_lines": FLOOD + " SELECT no AS cluster_id, line FROM ranked",
}
