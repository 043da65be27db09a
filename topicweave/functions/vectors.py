"""SQL text for arithmetic on arrays with one value per topic.

A factor row holds one ``array<double>``. Up to ``UNROLL`` topics the arithmetic is
written out element by element, which keeps it inside generated code; beyond that
it is a higher-order function, because generated methods have a size limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL = 32

Element = Callable[[str], str]  # index (number or variable) -> SQL of one element


def _balanced(terms: list[str]) -> str:
    while len(terms) > 1:
        terms = [
            f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i]
            for i in range(0, len(terms), 2)
        ]
    return terms[0]


def total(k: int, element: Element) -> str:
    """``element(0) + ... + element(k-1)``"""
    if k <= UNROLL:
        return _balanced([element(str(z)) for z in range(k)])
    values = f"transform(sequence(0, {k - 1}), z -> {element('z')})"
    return f"aggregate({values}, 0D, (x, y) -> x + y)"


def dot(a: str, b: str, k: int) -> str:
    return total(k, lambda z: f"{a}[{z}] * {b}[{z}]")


def build(k: int, element: Element) -> Column:
    """``array(element(0), ..., element(k-1))``"""
    if k <= UNROLL:
        return F.expr("array(" + ", ".join(element(str(z)) for z in range(k)) + ")")
    return F.expr(f"transform(sequence(0, {k - 1}), z -> {element('z')})")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half up; ``F.round`` goes through a decimal per value, which probabilities
    (0 to 1) don't need: up to 15 digits their multiples are exact integers.
    """
    scale = F.lit(10.0**digits)
    plain = F.floor(value * scale + F.lit(0.5)) / scale
    return F.when(value.between(0.0, 1.0), plain).otherwise(F.round(value, digits))


def _packed(width: int) -> Column:
    return F.expr("array(" + ", ".join(f"s{z}" for z in range(width)) + ")")


def _sums(width: int, element: Element) -> list[Column]:
    return [F.expr(f"sum({element(str(z))}) AS s{z}") for z in range(width)]


def slabs(k: int) -> tuple[int, int]:
    """Number of slabs and topics per slab, for k topics in slabs that are unrolled."""
    count = -(-k // UNROLL)
    return count, -(-k // count)


def slab_sums(k: int, element: Element) -> list[Column]:
    """Sums of a row's slab; the last slab may be shorter and repeats the last topic."""
    _, width = slabs(k)
    return [
        F.expr(f"sum({element(f'least(slab * {width} + {z}, {k - 1})')}) AS s{z}")
        for z in range(width)
    ]


def with_slabs(rows: DataFrame, k: int) -> DataFrame:
    """A row once per slab of topics."""
    return rows.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs(k)[0] - 1))))


def joined_slabs(k: int) -> Column:
    """The slabs' sums of a key as one array ``s``."""
    width = slabs(k)[1]
    parts = F.array_sort(F.collect_list(F.struct("slab", _packed(width).alias("s"))))
    return F.slice(F.flatten(F.transform(parts, lambda p: p["s"])), 1, k).alias("s")


def grouped_sums(rows: DataFrame, keys: list[str], k: int, element: Element) -> DataFrame:
    """``(keys, s)`` with ``s[z] = sum element(z)`` per group.

    With many topics a row is repeated for each slab of topics, not for each topic,
    and the slabs of a key are put together after the sums.
    """
    if k <= UNROLL:
        return rows.groupBy(*keys).agg(*_sums(k, element)).select(*keys, _packed(k).alias("s"))
    summed = with_slabs(rows, k).groupBy(*keys, "slab").agg(*slab_sums(k, element))
    return summed.groupBy(*keys).agg(joined_slabs(k))


def column_sums(factor: DataFrame, name: str, k: int) -> DataFrame:
    """One row with the array ``m`` of per-topic sums."""
    if k <= UNROLL:
        return factor.agg(*_sums(k, lambda z: f"{name}[{z}]")).select(_packed(k).alias("m"))
    by_topic = factor.select(F.posexplode(name).alias("z", "x")).groupBy("z").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("z", "x")))
    return by_topic.agg(F.transform(ordered, lambda t: t["x"]).alias("m"))
