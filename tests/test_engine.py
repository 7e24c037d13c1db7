"""Parsing, schedule, line search, layout and clusters on small inputs."""

import numpy as np
import pytest

from tessera.config import Config
from tessera.functions import exponents
from tessera.operators import density, graph, layout
from tessera.operators.pyramid import Tree
from tessera.plans import detect
from tessera.sources import parse_edges, read_edge_list, write_communities


def test_parse(spark):
    kept = ["1 2", "  3\t4 x", "1 2.5", "1 2abc", "+1 +2", "5 6\r"]
    lines = [*kept, "1,2", "1.5 2", "0x10 2", "# c", "", "99999999999 1"]
    got = parse_edges(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 2), (3, 4), (1, 2), (1, 2), (1, 2), (5, 6)])
    with pytest.raises(Exception, match="negative vertex id"):
        parse_edges(spark.createDataFrame([("1-2",)], "value string")).collect()


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.vertex_count(none).first()["n"] == 0
    assert detect(none, Config(iterations=2)).communities.count() == 0


def test_loops_and_gaps(spark):
    e = spark.createDataFrame([(0, 0), (0, 3), (0, 3)], "src long, dst long")
    assert sorted(map(tuple, graph.vertices(e).collect())) == [(0, 4.0), (1, 0.0), (2, 0.0), (3, 2.0)]


def test_schedule():
    got = {i: tuple(round(x, 5) for x in exponents(i)) for i in (1, 60, 61, 75, 89, 90, 91, 100)}
    assert got == {1: (1.15, 0.9), 60: (1.15, 0.9), 61: (1.11333, 0.87), 75: (0.6, 0.45), 89: (0.08667, 0.03), 90: (0.05, 0.0), 91: (0.05, 0.0), 100: (0.05, 0.0)}
    assert exponents(1, 49) == (0.05, 0.0)


def search(e0, e):
    """The line search, one trial after the other."""
    best, at = e0, 0
    for s in (32, 16, 8, 4, 2, 1):
        if at and at != 2 * s:
            break
        if e[s] < best:
            best, at = e[s], s
    for s in (64, 128):
        if at == s // 2 and e[s] < best:
            best, at = e[s], s
    return at


def test_line_search(spark):
    rng = np.random.default_rng(0)
    rows = [[float(x) for x in rng.integers(0, 6, len(layout.STEPS))] for _ in range(400)]
    want = [search(r[0], dict(zip(layout.STEPS[1:], r[1:], strict=True))) for r in rows]
    assert layout.choose(np.array(rows)).tolist() == want
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"e{s} double" for s in layout.STEPS))
    assert [r["step"] for r in layout.line_search_step(df).orderBy("id").collect()] == want


def test_pyramid_against_pairs():
    rng = np.random.default_rng(1)
    x, w = rng.standard_normal((400, 3)), rng.integers(1, 9, 400).astype(float)
    ids = np.arange(400)
    row, mass, centre = Tree(x, w, 9).masses(x, ids, w)
    total = np.bincount(row, mass, minlength=400)
    assert np.allclose(total, w.sum() - w)
    d = np.sqrt(((x[row] - centre) ** 2).sum(1))
    near = np.bincount(row, mass * d, minlength=400)
    exact = (w[None] * np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))).sum(1)
    assert np.allclose(near, exact, rtol=0.05)


def test_cells_shared_by_neighbours():
    """Cells taken for groups of neighbours and for single points are together those of each point alone: equal points, points without mass and an incomplete group too."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.standard_normal((400, 3)), rng.random((300, 3)) * 0.01, np.repeat(rng.random((5, 3)), 9, 0)])
    w = np.where(rng.random(len(x)) < 0.1, 0.0, 1.0 + rng.integers(0, 40, len(x)))
    for depth in (2, 9):
        tree = Tree(x, w, depth)
        ids = tree.members[rng.random(len(tree.members)) < 0.4]
        alone = {(int(i), int(c)) for i, c in zip(*tree.cells(x[ids]), strict=True)}
        group, cell, row, open_ = tree.shared(x[ids], ids, 16)
        row, rest = tree.cells(x[ids], row, open_)
        pairs = [(i, int(c)) for g, c in zip(group.tolist(), cell, strict=True) for i in range(16 * g, min(16 * g + 16, len(ids)))] + [(int(i), int(c)) for i, c in zip(row, rest, strict=True)]
        assert len(group) and len(pairs) == len(set(pairs)) and set(pairs) == alone


def test_equal_k_distances_and_few_points(spark):
    same = spark.createDataFrame([(i, 0.0, 0.0) for i in range(10)], "id long, x0 double, x1 double")
    row = density.elbow_eps(density.curve(density.k_distance(same))).first()
    assert (row["idx"], row["eps"]) == (0, 0.0)
    few = same.where("id < 3")
    assert density.k_distance(few).count() == 0
    assert density.cluster(few, None).where("is_noise").count() == 3


def test_null_ends_and_coordinates(spark):
    """An edge with a null end is none; a point with a null or NaN coordinate is noise."""
    e = spark.createDataFrame([(0, 1), (None, 1), (1, None), (None, None)], "src long, dst long")
    assert sorted(map(tuple, graph.vertices(e).collect())) == [(0, 1.0), (1, 1.0)]
    assert detect(e, Config(iterations=1)).clusters.count() == 2
    rows = [(i, 0.1 * i, 0.0) for i in range(20)] + [(20, None, 0.0), (21, 0.0, float("nan"))]
    got = {r["id"]: r["is_noise"] for r in density.cluster(spark.createDataFrame(rows, "id long, x0 double, x1 double"), 0.5).collect()}
    assert len(got) == 22 and got[20] and got[21] and not any(got[i] for i in range(20))


def test_blocked_k_distance(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x0 double, x1 double")
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 6]
    for block in (64, 5):  # blocks of fewer than k points too
        got = {r["id"]: r["k_dist"] for r in density.k_distance(df, 7, block=block).collect()}
        assert np.allclose([got[i] for i in range(300)], d)


def plain_components(x, eps):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    out = np.full(len(x), -1)
    for i in range(len(x)):
        if out[i] < 0:
            stack, out[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & (out < 0)):
                    out[j] = i
                    stack.append(j)
    return out.tolist()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_linked_cells(spark, dims):
    """Components by cells are those by points: sparse ones, a crowded cell, equal points, and cells that only inner points link."""
    rng = np.random.default_rng(dims)
    x = np.concatenate((rng.random((150, dims)) * 8 ** (1 / dims) * 2, 3 + 0.05 * rng.standard_normal((150, dims)), np.repeat(rng.random((5, dims)), 4, 0)))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"x{i} double" for i in range(dims)))
    for eps in (0.0, 0.02, 0.2, 0.35):
        got = {r["id"]: r["component"] for r in density.linked_cells(df, eps).collect()}
        assert [got[i] for i in range(len(x))] == plain_components(x, eps)


def planted(n=240, k=4, seed=0):
    rng = np.random.default_rng(seed)
    own = np.arange(n) % k
    p = np.where(own[:, None] == own[None], 0.3, 0.002)
    s, t = np.nonzero(np.triu(rng.random((n, n)) < p, 1))
    return [(int(a), int(b)) for a, b in zip(s, t, strict=True)], own


def test_recovery(spark, tmp_path):
    edges, own = planted()
    df = spark.createDataFrame(edges, "src long, dst long")
    r = detect(df)
    x = np.array([[q["x0"], q["x1"], q["x2"]] for q in r.positions.orderBy("id").collect()])
    centre = np.stack([x[own == k].mean(0) for k in range(4)])
    nearest = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    assert (nearest == own).mean() > 0.95
    members = [m for row in r.communities.collect() for m in row["members"]]
    assert sorted(members) == list(range(240))
    write_communities(r.communities, str(tmp_path / "out"))
    assert sorted(int(v) for q in spark.read.text(str(tmp_path / "out")).collect() for v in q[0].split(",")) == list(range(240))
    assert r.metrics.count() == 100


def test_distributed_layout(spark):
    edges, _ = planted(60, 2)
    df = spark.createDataFrame(edges, "src long, dst long")
    config = Config(iterations=2, blocks=2, depth=6, snapshots=1)
    one = layout.run_layout(df, config)
    many = layout.run_layout(df, config, most_vertices=1)
    a, b = ({r["id"]: (r["x0"], r["x1"], r["x2"]) for r in q.positions.collect()} for q in (one, many))
    assert a.keys() == b.keys() and many.metrics.columns == one.metrics.columns
    # joins and numpy give one layout
    assert np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-6)
    for x, y in zip(one.metrics.orderBy("iter").collect(), many.metrics.orderBy("iter").collect(), strict=True):
        assert np.allclose(x[:4], y[:4])
    assert sorted(r["iter"] for r in one.snapshots.select("iter").distinct().collect()) == [1, 2]
    for r in (one, many):
        last = {q["id"]: (q["x0"], q["x1"], q["x2"]) for q in r.snapshots.where("iter = 2").collect()}
        assert last == {q["id"]: (q["x0"], q["x1"], q["x2"]) for q in r.positions.collect()}


def test_layout_by_several_tasks(spark):
    """Tasks that move a share each give what one gives, and there may be more of them than vertices to move."""
    for edges in (planted(60, 2)[0], [(0, 1), (1, 2), (2, 2)]):
        df = spark.createDataFrame(edges, "src long, dst long")
        config = Config(iterations=3, snapshots=2)
        one = layout.run_layout(df, config, share=1_000)
        many = layout.run_layout(df, config, share=1)
        assert many.positions.orderBy("id").collect() == one.positions.orderBy("id").collect() and one.positions.count() == len({v for e in edges for v in e})
        assert many.snapshots.orderBy("id").collect() == one.snapshots.orderBy("id").collect()
        assert many.metrics.drop("ms").orderBy("iter").collect() == one.metrics.drop("ms").orderBy("iter").collect()


def test_edge_file_and_stream(spark, tmp_path):
    from tessera.streaming import edge_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0 1\nx\n1 2\n")
    assert read_edge_list(spark, str(tmp_path / "in")).count() == 2
    q = edge_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("edges_seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from edges_seen").count() == 2


def test_exact_repulsion_of_any_size(spark):
    """Over 20,000 vertices too, and the same from many blocks as from one."""
    from pyspark.sql import functions as F

    pos = layout.init_positions(spark.range(20_500).select("id", F.when(F.col("id") < 300, F.col("id") % 5 + 1.0).otherwise(0.0).alias("deg")))
    few = {r["id"]: r[1:] for r in layout.exact_repulsion(pos.where("id < 300"), 0.9, 0.01).collect()}
    blocks = {r["id"]: r[1:] for r in layout.exact_repulsion(pos.where("id < 300"), 0.9, 0.01, block=70).collect()}
    # vertices without edges weigh nothing
    many = {r["id"]: r[1:] for r in layout.exact_repulsion(pos, 0.9, 0.01).collect()}
    assert len(many) == 20_500 and few.keys() == blocks.keys()
    for i, x in few.items():
        assert np.allclose(x, blocks[i]) and np.allclose(x, many[i])


def test_repulsion_by_cells(spark):
    """Expansions and neighbours give what pairs give: even and crowded cells, equal points, a hub, vertices without edges, and to the decimals asked for."""
    from pyspark.sql import functions as F

    n = 1500
    pos = layout.init_positions(spark.range(n).select("id", F.when(F.col("id") == 7, 9000.0).when(F.col("id") % 11 == 0, 0.0).otherwise(F.col("id") % 3 + 1.0).alias("deg")))
    crowded = F.col("id") >= 1100
    pos = pos.withColumns({c: F.when(crowded, 0.2 + F.col(c) / 40).otherwise(F.when(F.col("id") % 50 == 1, 0.25).otherwise(F.col(c))) for c in ("x0", "x1", "x2")}).localCheckpoint()
    for r, parts in ((0.9, None), (0.0, ("energy",)), (0.9, ("g0", "g1", "g2"))):
        want = {q["id"]: q[1:] for q in layout.exact_repulsion(pos, r, 0.01, parts=parts).collect()}
        got = {q["id"]: q[1:] for q in layout.exact_repulsion(pos, r, 0.01, parts=parts, most=10, block=100).collect()}
        assert want.keys() == got.keys() and len(got) == n
        scale = max(abs(v) for x in want.values() for v in x)
        assert max(abs(v - w) for i, x in want.items() for v, w in zip(x, got[i], strict=True)) < 1e-8 * scale
        fixed = {q["id"]: q[1:] for q in layout.exact_repulsion(pos, r, 0.01, parts=parts, most=10, block=100, digits=5).collect()}
        assert all(round(v, 5) == round(w, 5) for i, x in want.items() for v, w in zip(x, fixed[i], strict=True))
