"""Vector functions over arrays, as built-in higher-order expressions in double precision.

Nulls give null; lengths that differ are an error of the caller (the missing element is null, and so is the result).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row; inside a lambda over elements it would be computed for each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def axpy(weight: Column, v: Column, out: Column) -> Column:
    """out + weight * v"""
    return F.zip_with(out, v, lambda o, x: o + weight * x)


def rms_norm(v: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + eps)
    return let(scale, lambda s: F.transform(v, lambda x: x / s) if weight is None else F.zip_with(v, weight, lambda x, w: x / s * w))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: silu(g) * u)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / temperature)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def rope(v: Column, position: Column, base: float = 10000.0, scale: float = 1.0, dim: int = 64) -> Column:
    """Adjacent pairs (2i, 2i + 1) turned by position / scale * base^(-2i / dim); ``dim`` must be even and the length of v."""
    if dim % 2:
        raise ValueError("rotary dimension must be even")
    out = []
    for i in range(dim // 2):
        angle = position / scale * (base ** (-2 * i / dim))
        a, b = F.get(v, F.lit(2 * i)), F.get(v, F.lit(2 * i + 1))
        out += [a * F.cos(angle) - b * F.sin(angle), a * F.sin(angle) + b * F.cos(angle)]
    return F.array(*out)


def q8_scales(v: Column, block: int = 32) -> Column:
    """Scale of each whole block: largest magnitude over 127; a rest shorter than a block is left out."""
    starts = F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int") - 1)
    return F.when(F.size(v) >= block, F.transform(starts, lambda b: F.array_max(F.transform(F.slice(v, b * block + 1, block), lambda x: F.abs(x))) / 127)).otherwise(F.array().cast("array<double>"))


def q8_quants(v: Column, block: int = 32) -> Column:
    """Rounded (half away from zero) and clamped quotients by the block's scale; 0 where the scale is 0."""
    def quotients(scales: Column) -> Column:
        def quotient(x: Column, i: Column) -> Column:
            d = F.get(scales, F.floor(i / block).cast("int"))
            return F.when(d == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / d).cast("int"))))

        return F.transform(F.slice(v, 1, F.size(scales) * block), quotient)

    return let(q8_scales(v, block), quotients)


def argmax(v: Column) -> Column:
    """0-based place of the first maximum; null for null and empty arrays."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def nucleus(v: Column, top_p: float, temperature: float = 1.0, cap: int = 200) -> Column:
    """Ids, most probable first (ties: lesser id), up to the one that brings the mass to ``top_p``, at most ``cap``."""
    p = softmax(v, temperature)
    ranked = F.slice(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))), 1, cap)
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("ids"))

    def take(state: Column, item: Column) -> Column:
        more = state["s"] < top_p
        return F.struct((state["s"] - F.when(more, item["m"]).otherwise(0.0)).alias("s"), F.when(more, F.concat(state["ids"], F.array(item["i"]))).otherwise(state["ids"]).alias("ids"))

    return F.aggregate(ranked, start, take)["ids"]


def draw(ids: Column, probabilities: Column, u: Column) -> Column:
    """First id whose cumulated probability reaches u times the mass; the first id if none does."""
    mass = total(probabilities)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("id"))
    pairs = F.arrays_zip(ids.alias("a"), probabilities.alias("b"))

    def step(state: Column, item: Column) -> Column:
        s = state["s"] + item["b"]
        return F.struct(s.alias("s"), F.when(state["id"].isNull() & (s >= u * mass), item["a"]).otherwise(state["id"]).alias("id"))

    return F.coalesce(F.aggregate(pairs, start, step)["id"], F.get(ids, F.lit(0)))


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    lse = let(F.array_max(logits), lambda top: top + F.log(total(F.transform(logits, lambda x: F.exp(x - top)))))
    nll = lse - F.get(logits, target)
    return nll if not smoothing else (1 - smoothing) * nll + smoothing * (lse - total(logits) / F.size(logits))


def kl_divergence(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """KL(teacher || student) of the softmaxes, times the squared temperature."""
    p, q = softmax(teacher, temperature), softmax(student, temperature)
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(0.0))) * temperature**2


def pair_permutation(n: int, rope_dim: int) -> list[int]:
    """Source row of each row when halves become adjacent pairs; rows behind ``rope_dim`` stay."""
    if rope_dim % 2:
        raise ValueError("rotary dimension must be even")
    half = rope_dim // 2
    return [i // 2 + half * (i % 2) if i < rope_dim else i for i in range(n)]


def fixed_matrix(rows: int, columns: int) -> list[list[float]]:
    """A deterministic weight matrix for demonstrations: rounded cosines."""
    return [[round(math.cos(r * columns + c), 6) for c in range(columns)] for r in range(rows)]


def sum_of(vector: Column, weight: Column, dim: int) -> Column:
    """Aggregate: the sum of ``weight`` times ``vector`` over a group's rows, place by place."""
    return F.array(*[F.sum(weight * F.get(vector, F.lit(i))) for i in range(dim)])
