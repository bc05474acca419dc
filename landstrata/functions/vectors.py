"""Array-of-double expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_distance(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2_distance(a, b) -> Column:
    return F.sqrt(sq_distance(a, b))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def linear_map(x, matrix, offset=None, bias=None) -> Column:
    """``matrix @ (x - offset) + bias`` with a small literal matrix (rows = outputs)."""
    x = _c(x)
    if offset is not None:
        x = F.zip_with(x, literal_vector(offset), lambda v, o: v - o)
    out = F.transform(F.array(*[literal_vector(row) for row in matrix]), lambda row: dot(row, x))
    if bias is not None:
        out = F.zip_with(out, literal_vector(bias), lambda v, b: v + b)
    return out


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def row_normalise(x, eps: float = 1e-12) -> Column:
    x = _c(x)
    n = F.greatest(norm(x), F.lit(eps))
    return F.transform(x, lambda v: v / n)


def scale(x, factor) -> Column:
    return F.transform(_c(x), lambda v: v * factor)


def weighted_concat(a, b, weight) -> Column:
    """First block followed by the weighted second block."""
    return F.concat(_c(a), scale(b, weight))


def design_matrix(t, p, kind: str) -> Column:
    """full = [1, type, phase, type x phase (row-major)], additive, type_only or phase_only."""
    t, p = _c(t), _c(p)
    one = F.array(F.lit(1.0))
    if kind == "type_only":
        return F.concat(one, t)
    if kind == "phase_only":
        return F.concat(one, p)
    if kind == "additive":
        return F.concat(one, t, p)
    if kind == "full":
        return F.concat(one, t, p, F.flatten(F.transform(t, lambda x: F.transform(p, lambda y: x * y))))
    raise ValueError(f"unknown design {kind!r}")


def expand(x, prefix: str, n: int) -> list[Column]:
    """Vector to columns prefix_0 .. prefix_{n-1}."""
    x = _c(x)
    return [x[i].alias(f"{prefix}_{i}") for i in range(n)]


def contract(prefix: str, n: int, out: str) -> Column:
    """Columns prefix_0 .. prefix_{n-1} to one vector."""
    return F.array(*[F.col(f"{prefix}_{i}").cast("double") for i in range(n)]).alias(out)
