"""Force-directed layout: attraction along edges, degree-weighted repulsion between all vertices, and a line search for each vertex.

The operators below are DataFrame expressions; layout_step() is one move of some vertices. run_layout() iterates: a graph within stated bounds is laid out in
numpy, by tasks that each move a share of the vertices, a larger one by layout_step() again and again. Both follow the same rules and give the same layout but for rounding.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import DOWN, UP, coordinates, exponents, line_search, potential, pull, repulsion_factor, squared_distance, uniform
from . import expansion, graph, group
from .group import Alone
from .pyramid import Tree, accepted, cell_pyramid, grid_of
from .store import cut, drop

STEPS = (0, *DOWN, *UP)


def init_positions(vertices: DataFrame, dims: int = 3, seed: int = 42) -> DataFrame:
    """Adds x0..: each in [-0.5, 0.5), from the id alone."""
    return vertices.withColumns({c: uniform(F.col("id"), str(i), seed) - 0.5 for i, c in enumerate(coordinates(dims))})


def exponent_schedule(spark, iterations: int = 100) -> DataFrame:
    """iter, a, r of each iteration."""
    rows = [(i, *exponents(i, iterations)) for i in range(1, iterations + 1)]
    return spark.createDataFrame(rows, "iter int, a double, r double")


def _pairs(adj: DataFrame, pos: DataFrame, dims: int, moved: DataFrame | None = None) -> DataFrame:
    """A row per neighbour: id, its x0.. (and what `moved` adds), the neighbour's y0.."""
    names = coordinates(dims)
    other = pos.select(F.col("id").alias("nbr"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(names)])
    return adj.join(other, "nbr").join(moved if moved is not None else pos.select("id", *names), "id")


def _xy(dims: int) -> tuple[list[Column], list[Column]]:
    return [F.col(c) for c in coordinates(dims)], [F.col(f"y{i}") for i in range(dims)]


def attractive_energy(adj: DataFrame, pos: DataFrame, a: float, dims: int = 3) -> DataFrame:
    """id, energy: sum over neighbours of d^a / a. Repeated edges count each time."""
    x, y = _xy(dims)
    return _pairs(adj, pos, dims).groupBy("id").agg(F.sum(potential(squared_distance(x, y), a)).alias("energy"))


def attractive_direction(adj: DataFrame, pos: DataFrame, a: float, dims: int = 3) -> DataFrame:
    """id, g0..: sum over neighbours of (y - x) * d^(a - 2); a neighbour at distance 0 adds nothing."""
    x, y = _xy(dims)
    f = pull(squared_distance(x, y), a)
    return _pairs(adj, pos, dims).groupBy("id").agg(*[F.sum((y[i] - x[i]) * f).alias(f"g{i}") for i in range(dims)])


def exact_repulsion(pos: DataFrame, r: float, factor: float, dims: int = 3, block: int = 4096, parts: tuple[str, ...] | None = None, digits: int | None = None, most: int = 30_000) -> DataFrame:
    """id, energy, g0.. (or which of them `parts` names): repulsion by all other vertices.

    Up to `most` vertices are compared pair by pair. Beyond that only those in neighbouring cells are, and expansions stand for the rest (see expansion.py), so that the work grows with the
    vertices while they are spread out and there are some thousands a cell at most; a crowded cell is still compared pair by pair. The error is measured on 256 vertices. With `digits`, results round to the
    same decimals as sums over pairs do: rows that are nearer to where rounding turns than 20 times that error are summed up pair by pair. Vertices of very large degree count pair by pair.
    """
    names = coordinates(dims)
    parts = parts or ("energy", *[f"g{i}" for i in range(dims)])
    pos = cut(pos.select("id", "deg", *names))
    n = pos.count()
    if n <= most or dims > 3:
        return _by_pairs(pos, pos, r, factor, dims, block, parts)
    found = cut(_by_cells(pos, n, r, factor, dims, block, parts))
    if digits is None:
        return found.select("id", *parts)
    some = cut(_by_pairs(pos.where("deg > 0").orderBy(F.xxhash64("id"), "id").limit(256), pos, r, factor, dims, block, parts).select("id", *[F.col(c).alias(f"_{c}") for c in parts]))
    unit = F.col("deg") * factor
    seen = found.join(F.broadcast(some), "id").agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"_{c}")) / unit for c in parts]))).first()[0] or 0.0
    turn = [F.abs(F.col(c) * 10.0**digits - F.floor(F.col(c) * 10.0**digits) - 0.5) <= unit * (20 * seen * 10.0**digits) for c in parts]
    again = _by_pairs(found.where(F.col("deg") > 0).where(reduce(Column.__or__, turn)).select(pos.columns), pos, r, factor, dims, block, parts)
    again = again.select("id", *[F.col(c).alias(f"_{c}") for c in parts])
    return found.join(again, "id", "left").select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in parts])


def _by_pairs(own: DataFrame, pos: DataFrame, r: float, factor: float, dims: int, block: int, parts: tuple[str, ...]) -> DataFrame:
    """exact_repulsion() of some vertices by all, pair by pair: each block of the former meets each of the latter, so the work grows with their product, a task's memory does not."""
    names, spark = coordinates(dims), pos.sparkSession

    def blob(key, table):
        data = np.stack([table.column(c).to_numpy() for c in ("deg", *names)], 1)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary()), "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary())})

    def dealt(rows):
        rows = cut(rows)
        b = max(1, -(-rows.count() // block))
        return b, cut(rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).groupBy("b").applyInArrow(blob, "b int, data binary, ids binary"))

    # a block is a row of bounded size
    b, other = dealt(pos)
    m, mine = (b, other) if own is pos else dealt(own)
    other = other.select(F.col("b").alias("b2"), F.col("data").alias("data2"))
    pairs = mine.withColumn("b2", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).repartition(min(m * b, 64 * spark.sparkContext.defaultParallelism), "b", "b2").join(other, "b2")

    def run(batches):
        for batch in batches:
            for data, ids, data2 in zip(*[batch.column(c).to_pylist() for c in ("data", "ids", "data2")], strict=True):
                p, q, ids = np.frombuffer(data).reshape(-1, dims + 1), np.frombuffer(data2).reshape(-1, dims + 1), np.frombuffer(ids, np.int64)
                out = _sums(p[:, 1:], q, r, parts) * (factor * p[:, :1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(out[:, i]) for i in range(len(parts))]], names=["id", *parts])

    sums = pairs.select("data", "ids", "data2").mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in parts))
    return sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in parts])


def _terms(diff: list[np.ndarray], d2: np.ndarray, r: float, parts: tuple[str, ...]) -> list[np.ndarray]:
    """Pair terms by part: of energy (d^r / r, or ln d, negated) and of force (the difference times d^(r - 2))."""
    force = d2 ** (0.5 * r - 1) if set(parts) - {"energy"} else None
    return [(-0.5 * np.log(d2) if r == 0 else d2 ** (0.5 * r) / -r) if c == "energy" else diff[int(c[1:])] * force for c in parts]


def _sums(p: np.ndarray, q: np.ndarray, r: float, parts: tuple[str, ...]) -> np.ndarray:
    """Sums of _terms() for places p, by q (weight and place); 0 at distance 0, so a vertex never repels itself."""
    out, step, w = np.zeros((len(p), len(parts))), max(1, (1 << 16) // max(1, len(q))), np.ascontiguousarray(q[:, 0])
    y = [np.ascontiguousarray(q[:, i + 1]) for i in range(p.shape[1])]
    for k in range(0, len(p), step):
        diff = [p[k : k + step, i, None] - y[i][None] for i in range(p.shape[1])]
        d2 = sum(x * x for x in diff)
        same = d2 == 0
        twins = same.any()
        if twins:
            d2[same] = 1.0
        for j, t in enumerate(_terms(diff, d2, r, parts)):
            if twins:
                t[same] = 0.0
            out[k : k + step, j] = t @ w
    return out


def _by_cells(pos: DataFrame, n: int, r: float, factor: float, dims: int, block: int, parts: tuple[str, ...]) -> DataFrame:
    """exact_repulsion() by expansions, with deg and x0...

    The driver holds the masses of up to 4096 cells (24 MB), and so does each task that works on cells; points are in tasks only, those of one cell and its neighbours at a time.
    """
    names, spark = coordinates(dims), pos.sparkSession
    levels, order = (4 if n >= 200_000 else 3) if dims == 3 else 6, 8 if parts == ("energy",) else 9
    box = pos.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))], F.sum("deg").alias("total")).first()
    low = np.array([box[f"lo{i}"] for i in range(dims)])
    side = max(box[f"hi{i}"] - box[f"lo{i}"] for i in range(dims)) or 1.0
    top = pos.where(F.col("deg") > 64 * box["total"] / n).orderBy(F.desc("deg"), "id").limit(513).toArrow()
    heavy = np.stack([top.column(c).to_numpy() for c in ("deg", *names)], 1)
    most = 64 * box["total"] / n if len(heavy) <= 512 else heavy[512, 0]
    heavy = heavy[heavy[:, 0] > most]
    last = (1 << levels) - 1
    place = [F.least(F.floor((F.col(c) - F.lit(float(low[i]))) / F.lit(side) * F.lit(float(last + 1))), F.lit(last)).cast("int") for i, c in enumerate(names)]
    dealt = pos.withColumn("cell", reduce(lambda a, b: a * (last + 1) + b, place))
    counts = dealt.groupBy("cell").count().toArrow().to_pydict()  # a row per cell
    split = dict(zip(counts["cell"], [-(-c // block) for c in counts["count"]], strict=True))
    dealt = dealt.join(F.broadcast(spark.createDataFrame(list(split.items()), "cell int, split int")), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), "split").cast("int"))

    def inside(cell, x):
        """Places within a cell, from -0.5 to 0.5."""
        return (x - low) / side * (last + 1) - np.array([cell >> (levels * (dims - 1 - i)) & last for i in range(dims)]) - 0.5

    def blob(key, table):
        deg, x = table.column("deg").to_numpy(), np.stack([table.column(c).to_numpy() for c in names], 1)
        light, masses = np.where(deg > most, 0.0, deg), np.zeros(order**dims)
        for k in range(0, len(x), 256):
            masses += light[k : k + 256] @ expansion.products(inside(key[0].as_py(), x[k : k + 256]), order)
        row = {"cell": key[0].as_py(), "sub": key[1].as_py(), "ids": table.column("id").to_numpy().astype(np.int64).tobytes(), "deg": deg.tobytes(), "data": np.column_stack((light, x)).tobytes(), "masses": masses.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("cell", pa.int32()), ("sub", pa.int32()), *[(c, pa.binary()) for c in ("ids", "deg", "data", "masses")]]))

    blocks = cut(dealt.groupBy("cell", "sub").applyInArrow(blob, "cell int, sub int, ids binary, deg binary, data binary, masses binary"))
    masses = np.zeros(((last + 1) ** dims, order**dims))
    for batch in blocks.select("cell", "masses").toArrow().to_batches():
        for cell, m in zip(batch.column("cell").to_pylist(), batch.column("masses"), strict=True):
            masses[cell] += np.frombuffer(m.as_buffer())
    masses = spark.sparkContext.broadcast(expansion.upward(masses, levels, dims, order))
    tasks = max(1, min(4**dims, spark.sparkContext.defaultParallelism))

    def kernel(diff):
        return _terms(diff, sum(x * x for x in diff), r, parts)

    def unit(level):
        h = side / (1 << level)  # energies and forces differ by a length
        return np.array([h**r if c == "energy" else h ** (r - 1) for c in parts])[:, None], -np.log(h) if r == 0 and "energy" in parts else 0.0

    def far(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                tops = np.stack(np.unravel_index(np.arange(k, 4**dims, tasks), (4,) * dims), 1)
                cells, values = expansion.downward(masses.value, tops, kernel, len(parts), unit, dims, order)
                ids = expansion.number(cells, levels)
                for a in range(0, len(ids), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 64], pa.int32()), pa.array([v.tobytes() for v in values[a : a + 64]], pa.binary())], names=["cell", "far"])

    values = cut(spark.range(0, tasks, 1, tasks).mapInArrow(far, "cell int, far binary"))
    # every block meets those of its cell and of the cells beside it
    at = {c: np.array(np.unravel_index(c, (last + 1,) * dims)) for c in split}
    beside = [(int(other), c, sub) for c, k in split.items() for o in product((-1, 0, 1), repeat=dims) if ((q := at[c] + o) >= 0).all() and (q <= last).all() and (other := np.ravel_multi_index(q, (last + 1,) * dims)) in split for sub in range(k)]
    beside = spark.createDataFrame(pa.table({k: pa.array(v, pa.int32()) for k, v in zip(("from_", "cell", "sub"), zip(*beside, strict=True), strict=True)}))
    none = F.lit(None).cast("binary")
    others = blocks.select(F.col("cell").alias("from_"), "data").join(F.broadcast(beside), "from_").select("cell", "sub", none.alias("ids"), none.alias("deg"), "data", none.alias("far"))
    both = blocks.join(values, "cell").select("cell", "sub", "ids", "deg", "data", "far").unionByName(others)

    def near(key, table):
        rows = table.select(["ids", "deg", "data", "far"]).to_pylist()
        own = next(x for x in rows if x["ids"] is not None)
        x, deg = np.frombuffer(own["data"]).reshape(-1, dims + 1)[:, 1:], np.frombuffer(own["deg"])
        out, local = _sums(x, heavy, r, parts), np.frombuffer(own["far"]).reshape(len(parts), -1)
        for k in range(0, len(x), 256):
            out[k : k + 256] += expansion.products(inside(key[0].as_py(), x[k : k + 256]), order) @ local.T
        for row in rows:
            if row["ids"] is None:
                out += _sums(x, np.frombuffer(row["data"]).reshape(-1, dims + 1), r, parts)
        out *= factor * deg[:, None]
        return pa.table({"id": np.frombuffer(own["ids"], np.int64), "deg": deg, **{c: x[:, i] for i, c in enumerate(names)}, **{c: out[:, i] for i, c in enumerate(parts)}})

    return both.groupBy("cell", "sub").applyInArrow(near, "id long, " + ", ".join(f"{c} double" for c in ("deg", *names, *parts)))


def approximate_repulsion(near: DataFrame, r: float, factor: float, dims: int = 3) -> DataFrame:
    """id, energy, g0..: repulsion by cells that stand for all other vertices. near: rows of pyramid.accepted()."""
    x, y = _xy(dims)
    d2, scale = squared_distance(x, y), factor * F.col("deg") * F.col("mass")
    sums = [F.sum(scale * (x[i] - y[i]) * pull(d2, r)).alias(f"g{i}") for i in range(dims)]
    return near.groupBy("id").agg((-F.sum(scale * potential(d2, r))).alias("energy"), *sums)


def layout_step(adj: DataFrame, pos: DataFrame, a: float, r: float, factor: float, depth: int, dims: int = 3, movers: Column | None = None) -> DataFrame:
    """id, x0.. (new), step, energy of each mover: its direction, the energies at all steps along it, and the step that the line search takes.

    pos: id, x0.., deg; movers (a condition on pos; by default all) with edges move, and see all vertices where they are in pos. energy is a mover's at its
    new place. A vertex doesn't attract itself.
    """
    names, grid = coordinates(dims), grid_of(pos, dims)
    own = pos.where((F.col("deg") > 0) & (F.lit(True) if movers is None else movers)).select("id", *names, "deg")
    cells = cut(cell_pyramid(pos, depth, dims, grid))
    near = cut(accepted(own, cells, grid, depth, dims))
    push = approximate_repulsion(near, r, factor, dims).select("id", *[F.col(f"g{i}").alias(f"r{i}") for i in range(dims)])
    mine = adj.join(own.select("id"), "id", "left_semi")
    pulls = attractive_direction(mine, pos, a, dims)
    total = [(F.coalesce(f"g{i}", F.lit(0.0)) + F.coalesce(f"r{i}", F.lit(0.0))).alias(f"g{i}") for i in range(dims)]
    moved = cut(own.join(push, "id", "left").join(pulls, "id", "left").select("id", *names, *total))
    x, y = _xy(dims)
    trial = {s: [c + F.col(f"g{i}") * (s / 32) for i, c in enumerate(x)] for s in STEPS}
    loop = F.col("id") == F.col("nbr")
    attract = _pairs(mine, pos, dims, moved).groupBy("id").agg(*[F.sum(F.when(loop, 0.0).otherwise(potential(squared_distance(trial[s], y), a))).alias(f"a{s}") for s in STEPS])
    scale = -factor * F.col("deg") * F.col("mass")
    repel = near.drop(*names).join(moved, "id").groupBy("id").agg(*[F.sum(scale * potential(squared_distance(trial[s], y), r)).alias(f"r{s}") for s in STEPS])
    both = moved.join(attract, "id", "left").join(repel, "id", "left")
    both = line_search_step(both.select("id", *names, *[f"g{i}" for i in range(dims)], *[(F.coalesce(f"a{s}", F.lit(0.0)) + F.coalesce(f"r{s}", F.lit(0.0))).alias(f"e{s}") for s in STEPS]))
    best = reduce(F.coalesce, [F.when(F.col("step") == s, F.col(f"e{s}")) for s in STEPS])
    return both.select("id", *[(F.col(c) + F.col(f"g{i}") * F.col("step") / 32).alias(c) for i, c in enumerate(names)], "step", best.alias("energy"))


def line_search_step(energies: DataFrame) -> DataFrame:
    """Adds step (in 32nds) to rows with e0, e32, e16, ..., e128."""
    return energies.withColumn("step", line_search(F.col("e0"), {s: F.col(f"e{s}") for s in STEPS[1:]}))


def total_energy(energies: DataFrame) -> DataFrame:
    return energies.agg(F.sum("energy").alias("energy"))


def search(e0: np.ndarray, energy) -> tuple[np.ndarray, np.ndarray]:
    """line_search() on arrays: steps and their energies. energy(rows, s) gives some rows' energies at a step, and is asked only for rows whose search goes on."""
    best, step, rows = e0.copy(), np.zeros(len(e0)), np.arange(len(e0))
    for s in DOWN:
        if not len(rows):
            break
        e = energy(rows, s)
        better = e < best[rows]
        rest = better | (step[rows] == 0)
        best[rows[better]], step[rows[better]] = e[better], s
        rows = rows[rest]
    for s in UP:
        rows = np.flatnonzero(step == s // 2)
        if len(rows):
            e = energy(rows, s)
            better = e < best[rows]
            best[rows[better]], step[rows[better]] = e[better], s
    return step, best


def choose(e: np.ndarray) -> np.ndarray:
    """The steps for rows of energies in the order of STEPS."""
    return search(e[:, 0], lambda rows, s: e[rows, STEPS.index(s)])[0]


class Layout:
    """The iteration in one process, or in several that hold the same places and move a share of each block each. Vertices move in blocks, each seeing the moves of those before it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, src: np.ndarray, dst: np.ndarray, config: Config, block: np.ndarray, peers=None):
        self.x, self.c, self.peers = x.copy(), config, peers or Alone()
        order = np.argsort(src, kind="stable")
        src, self.dst = src[order], dst[order]
        self.w = np.bincount(src, minlength=len(ids)).astype(float)
        self.begin = np.searchsorted(src, np.arange(len(ids) + 1))
        self.factor = repulsion_factor(self.w.sum(), config.attraction, config.repulsion)
        self.blocks = [(block == b) & (self.w > 0) for b in range(config.blocks)]

    def step(self, block: np.ndarray, a: float, r: float, size: int = 32, chunk: int = 512) -> float:
        """One block's moves, all by the places before them; its energy.

        Vertices move in the tree's order: `size` neighbours are a group that shares most of its cells, and groups are dealt out to the peers. A few groups at a time, so that
        their pairs stay in the processor's cache.
        """
        if not block.any():
            return 0.0
        tree = Tree(self.x, self.w, self.c.depth)
        movers = tree.members[block[tree.members]]
        turn = np.arange(len(movers)) // size % self.peers.size
        own = movers[turn == self.peers.rank]
        found, best = np.zeros((len(own), self.x.shape[1])), np.zeros(len(own))
        for k in range(0, len(own), chunk):
            found[k : k + chunk], best[k : k + chunk] = self.move(tree, own[k : k + chunk], a, r, size)
        energy = np.zeros(len(movers))
        for k, data in enumerate(self.peers.gather(np.column_stack((found, best)).tobytes())):
            part = np.frombuffer(data).reshape(-1, self.x.shape[1] + 1)
            self.x[movers[turn == k]], energy[turn == k] = part[:, :-1], part[:, -1]
        return float(energy.sum())

    def move(self, tree: Tree, own: np.ndarray, a: float, r: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Some vertices' new places and energies; they are in the tree's order, `size` to a group."""
        n, x, w = len(own), self.x[own], self.w[own]
        group, cell, row, open_ = tree.shared(x, own, size)
        at, mass, centre = tree.masses(x, own, w, row, open_)
        count = self.begin[own + 1] - self.begin[own]
        row = np.repeat(np.arange(n), count)
        dst = self.dst[np.arange(len(row)) + np.repeat(self.begin[own] - (np.cumsum(count) - count), count)]
        keep = own[row] != dst
        row, y = row[keep], self.x[dst[keep]]
        cut_ = np.searchsorted(group, np.arange(-(-n // size) + 1))
        groups = [(slice(k * size, min(n, k * size + size)), tree.com[cell[i:j]], tree.weight[cell[i:j]]) for k, (i, j) in enumerate(zip(cut_, cut_[1:], strict=False)) if i < j]

        def value(d2, e):  # the potential by squared distance; nothing lies at distance 0 but by chance
            near = d2.size and d2.min() < 1e-260
            out = np.log(np.maximum(d2, 1e-300) if near else d2)
            out *= 0.5 * e or 0.5
            if e:
                np.exp(out, out=out)
                out /= e
            if near:
                out[d2 < 1e-260] = 0
            return out

        def strength(d2, v, e):  # distance to the power of e - 2, given the potential
            return np.where(d2 < 1e-260, 0, (v * e if e else 1) / np.maximum(d2, 1e-300))

        def away(p, at, q):
            diff = np.take(p, at, 0)
            diff -= q
            return diff

        def total(at, v):
            return np.bincount(at, v, minlength=n).astype(float, copy=False)  # of no pairs they are integers

        square = lambda v: np.einsum("ij,ij->i", v, v)
        diff, edge = away(x, at, centre), away(x, row, y)
        cell2, edge2 = square(diff), square(edge)
        rep, att = value(cell2, r), value(edge2, a)
        push, pulls = strength(cell2, rep, r) * mass, strength(edge2, att, a)
        e_rep, e_att = total(at, mass * rep), total(row, att)
        g = np.stack([self.factor * w * total(at, diff[:, i] * push) - total(row, edge[:, i] * pulls) for i in range(x.shape[1])], 1)
        far = []
        for rows, com, m in groups:
            middle = x[rows].mean(0)
            p, q = x[rows] - middle, com - middle
            d2 = np.zeros((len(p), len(q)))
            for i in range(p.shape[1]):
                step = p[:, i, None] - q[:, i]
                step *= step
                d2 += step
            v = value(d2, r)
            e_rep[rows] += v @ m
            f = strength(d2, v, r) * m
            g[rows] += (self.factor * w[rows])[:, None] * (p * f.sum(1)[:, None] - f @ q)
            far.append((rows, p, q, m, d2))
        e0 = e_att - self.factor * w * e_rep
        # squared distances along the direction are polynomials of the step
        length = square(g)
        slope = 2 * np.einsum("ij,ij->i", diff, np.take(g, at, 0))
        far = [(rows, p, q, m, d2, 2 * (np.einsum("ij,ij->i", p, g[rows])[:, None] - g[rows] @ q.T)) for rows, p, q, m, d2 in far]
        pairs = (at, mass, cell2, slope, diff)

        def energy(wanted_rows, s):
            t = s / 32
            wanted = np.zeros(n, bool)
            wanted[wanted_rows] = True
            at, m, d2, b, first = pairs if wanted.all() else [v[wanted[pairs[0]]] for v in pairs]
            now = d2 + t * (b + t * length[at])
            lost = np.flatnonzero(now < 1e-6 * d2)  # too little is left of the digits
            now[lost] = square(first[lost] + t * g[at[lost]])
            e = total(at, m * value(now, r))
            for rows, p, q, m, d2, b in far:
                mine = np.flatnonzero(wanted[rows])
                if not len(mine):
                    continue
                if len(mine) < len(p):
                    d2, b = d2[mine], b[mine]
                now = b + (t * length[rows][mine])[:, None]
                now *= t
                now += d2
                lost = now < 1e-6 * d2
                if lost.any():
                    i, j = np.nonzero(lost)
                    now[i, j] = square(p[mine[i]] + t * g[rows][mine[i]] - q[j])
                e[rows.start + mine] += value(now, r) @ m
            some = wanted[row]
            pull_ = total(row[some], value(square(away(x + g * t, row[some], y[some])), a))
            return (pull_ - self.factor * w * e)[wanted_rows]

        step, best = search(e0, energy)
        return x + g * (step / 32)[:, None], best

    def run(self):
        """After each iteration: its number, energy, exponents and milliseconds."""
        for i in range(1, self.c.iterations + 1):
            began = time.perf_counter()
            a, r = exponents(i, self.c.iterations, self.c.attraction, self.c.repulsion)
            yield i, sum(self.step(b, a, r) for b in self.blocks), a, r, int(1000 * (time.perf_counter() - began))


@dataclass
class Layouts:
    """positions: id, x0.., deg after all iterations; metrics: iter, energy, a, r, ms; snapshots: iter, id, x0.. of the iterations kept."""

    positions: DataFrame
    metrics: DataFrame
    snapshots: DataFrame


def run_layout(edges: DataFrame, config: Config = Config(), most_vertices: int = 200_000, most_edges: int = 2_000_000, most_shared: int = 2_000_000, share: int = 2_000) -> Layouts:
    """The layout after config.iterations, and after every config.snapshots-th of them (0: of none).

    energy is the sum of the vertices' energies at the places they moved to, each at its own move. Vertices without edges keep their first position. A graph of at most most_vertices and most_edges is laid out
    by a task for each `share` vertices, as many as run at once; one of up to most_shared vertices too, if its tasks are several. Each holds the whole graph, so these bounds bound its memory; the result is the same. Edges with a null end are left out; no edges give no rows.
    """
    spark, names = edges.sparkSession, coordinates(config.dims)
    adj = cut(graph.symmetrise(edges))
    start = cut(init_positions(graph.vertices(edges), config.dims, config.seed).withColumn("block", F.floor(uniform(F.col("id"), "block", config.seed) * config.blocks).cast("int")))
    n, tasks = start.count(), 1
    if n <= max(most_vertices, most_shared) and adj.count() <= 2 * most_edges:
        tasks = group.tasks(spark, 1 + n // share)
    if n <= (most_vertices if tasks == 1 else max(most_vertices, most_shared)) and adj.count() <= 2 * most_edges:
        return _in_tasks(adj, start, config, tasks)
    return _distributed(spark, adj, start, config, names)


def _in_tasks(adj: DataFrame, start: DataFrame, config: Config, tasks: int) -> Layouts:
    names = coordinates(config.dims)
    both = start.select(F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("nbr"), "block", *names).unionByName(adj.select(F.lit(1).alias("kind"), "id", "nbr", F.lit(0).alias("block"), *[F.lit(0.0).alias(c) for c in names]))

    key = group.key()

    def run(batches):
        batches = [x for x in batches if len(x)]
        peers = group.Group(key) if tasks > 1 else group.Alone()
        columns = {c: np.concatenate([x.column(c).to_numpy(zero_copy_only=False).astype(t) for x in batches] or [np.zeros(0, t)]) for c, t in types.items()}
        batches.clear()
        for c, t in types.items():  # each task had some rows, and gets all
            columns[c] = np.concatenate([np.frombuffer(data, t) for data in peers.gather(columns[c].tobytes())])
        v = columns["kind"] == 0
        ids, block = columns["id"][v], columns["block"][v]
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        x = np.stack([columns[c][v][order] for c in names], 1)
        src, dst = columns["id"][~v], columns["nbr"][~v]
        columns.clear()
        sort = np.lexsort((dst, src))  # sums don't depend on the order of arrival
        layout = Layout(ids[order], x, src[sort], dst[sort], config, block[order], peers)
        mine = slice(peers.rank, None, peers.size)
        own = pa.array(ids[order][mine])
        n = len(own)

        def places(i):
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), own, pa.array(layout.w[mine]), *[pa.array(layout.x[mine, k].copy()) for k in range(len(names))], *[pa.nulls(n, pa.float64())] * 4], names=fields)

        for i, *found in layout.run():
            if peers.rank == 0:
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([-1]), pa.array([0.0]), *[pa.array([0.0])] * len(names), *[pa.array([float(q)]) for q in found]], names=fields)
            if config.snapshots and i % config.snapshots == 0:
                yield places(i)
        yield places(0)

    types = {"kind": np.int8, "id": np.int64, "nbr": np.int64, "block": np.int32, **dict.fromkeys(names, np.float64)}
    fields = ["iter", "id", "deg", *names, "energy", "a", "r", "ms"]
    dealt = both.repartition(tasks) if tasks > 1 else both.coalesce(1)
    out = cut(dealt.mapInArrow(run, "iter long, id long, deg double, " + ", ".join(f"{c} double" for c in (*names, "energy", "a", "r", "ms")), barrier=tasks > 1))
    metrics = out.where("id < 0").select(F.col("iter").cast("int").alias("iter"), "energy", "a", "r", F.col("ms").cast("long").alias("ms"))
    return Layouts(out.where("id >= 0 and iter = 0").select("id", *names, "deg"), metrics, out.where("id >= 0 and iter > 0").select(F.col("iter").cast("int").alias("iter"), "id", *names))


def _distributed(spark, adj: DataFrame, start: DataFrame, config: Config, names: list[str]) -> Layouts:
    """layout_step() for each block in turn; positions are stored after each."""
    total = start.agg(F.sum("deg")).first()[0] or 0.0
    factor, pos, last, metrics, kept = repulsion_factor(total, config.attraction, config.repulsion), start, None, [], []
    for i in range(1, config.iterations + 1):
        began, (a, r) = time.perf_counter(), exponents(i, config.iterations, config.attraction, config.repulsion)
        energy = 0.0
        for b in range(config.blocks):
            moved = layout_step(adj, pos, a, r, factor, config.depth, config.dims, F.col("block") == b)
            new = moved.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in names], "energy")
            after = cut(pos.join(new, pos["id"] == F.col("_id"), "left").select("id", "deg", "block", *[F.coalesce(f"_{c}", c).alias(c) for c in names], "energy"))
            energy += after.agg(F.sum("energy")).first()[0] or 0.0
            if last is not None and not any(last is k for _, k in kept):
                drop(last)
            last, pos = after, after.drop("energy")
        metrics.append((i, energy, a, r, int(1000 * (time.perf_counter() - began))))
        if config.snapshots and i % config.snapshots == 0:
            kept.append((i, last))
    shots = [df.select(F.lit(i).alias("iter"), "id", *names) for i, df in kept] or [pos.select(F.lit(0).alias("iter"), "id", *names).where("false")]
    return Layouts(pos.select("id", *names, "deg"), spark.createDataFrame(metrics, "iter int, energy double, a double, r double, ms long"), reduce(DataFrame.unionByName, shots))
