"""Column functions and scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, tag: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from the md5 of key, tag and seed: the same on any partitioning and any engine."""
    tag = F.lit(tag) if isinstance(tag, str) else tag.cast("string")
    text = F.concat(key.cast("string"), F.lit(":"), tag, F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def coordinates(dims: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (y - x) * (y - x)
    return out


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def add(a: Column, b: Column) -> Column:
    """Sum of two vectors (arrays)."""
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column | float) -> Column:
    """A vector (array) times a number."""
    return F.transform(a, lambda x: x * by)


def contains(a: Column, value: Column | object) -> Column:
    """Whether an array holds a value."""
    return F.array_contains(a, value)


def potential(d2: Column, exponent: float) -> Column:
    """Energy of a pair by squared distance: d^e / e, or ln d for e = 0; 0 where d is 0 and the term has no value."""
    if exponent == 0:
        return F.when(d2 > 0, 0.5 * F.log(d2)).otherwise(F.lit(0.0))
    return F.when(d2 > 0, F.pow(d2, F.lit(0.5 * exponent)) / exponent).otherwise(F.lit(0.0))


def pull(d2: Column, exponent: float) -> Column:
    """Factor of a pair's difference vector in the force: d^(e-2); 0 where d is 0."""
    return F.when(d2 > 0, F.pow(d2, F.lit(0.5 * exponent - 1.0))).otherwise(F.lit(0.0))


def exponents(i: int, iterations: int = 100, attraction: float = 0.05, repulsion: float = 0.0) -> tuple[float, float]:
    """Attraction and repulsion exponents of iteration i (from 1): high for 60 % of the run, falling linearly until 90 %, then final.

    Under 50 iterations, or with a final repulsion of 1 or more, they are final throughout.
    """
    if iterations < 50 or repulsion >= 1:
        return attraction, repulsion
    # thousandths: i = 0.6 and 0.9 of the run are exact bounds
    if 10 * i <= 6 * iterations:
        share = 1.0
    elif 10 * i < 9 * iterations:
        share = (0.9 - i / iterations) / 0.3
    else:
        share = 0.0
    return attraction + 1.1 * (1 - repulsion) * share, repulsion + 0.9 * (1 - repulsion) * share


#: Multipliers of the direction that a line search tries, in the order of trial: down from 1, then up.
DOWN, UP = (32, 16, 8, 4, 2, 1), (64, 128)


def line_search(e0: Column, e: dict[int, Column]) -> Column:
    """The step (0, 1, 2, ..., 128, in 32nds) that trials choose, given the energy at no step and at each.

    Steps are halved from 32; once one improves, halving goes on only while each is strictly better than the best. If 32 is the best, 64 is tried, and
    128 if 64 was better. No improvement gives 0.
    """
    best_step, best_energy, go = F.lit(0), e0, F.lit(True)
    for s in DOWN:
        tried = go
        better = tried & (e[s] < best_energy)
        # after a first success a failure ends the search
        go = tried & ((best_step == 0) | better)
        best_energy = F.when(better, e[s]).otherwise(best_energy)
        best_step = F.when(better, F.lit(s)).otherwise(best_step)
    for s in UP:
        better = (best_step == s // 2) & (e[s] < best_energy)
        best_energy = F.when(better, e[s]).otherwise(best_energy)
        best_step = F.when(better, F.lit(s)).otherwise(best_step)
    return best_step


def repulsion_factor(total_degree: float, attraction: float = 0.05, repulsion: float = 0.0) -> float:
    return 0.0 if total_degree <= 0 else total_degree ** (0.5 * (attraction - repulsion) - 1)
