"""Array arithmetic as column expressions; arrays are ``array<double>`` unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def total(a: Column) -> Column:
    """Sum of an array, 0.0 of an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of logits divided by a temperature, shifted by the maximum."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    shifted = let(F.struct(logits.alias("z"), F.array_max(logits).alias("m")), lambda s: F.transform(s["z"], lambda x: F.exp((x - s["m"]) / t)))
    return let(shifted, lambda e: let(F.struct(e.alias("e"), total(e).alias("s")), lambda q: F.transform(q["e"], lambda x: x / q["s"])))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(index: Column, k: Column | int) -> Column:
    """A one at ``index`` among ``k``; null where the index is outside."""
    n = F.lit(k) if isinstance(k, int) else k
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == index).cast("double"))
    return F.when((index >= 0) & (index < n), made)


def cumulative(a: Column) -> Column:
    """Running sums."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(a, F.lit(1), i)))


def entropy(p: Column) -> Column:
    """Natural entropy, probabilities floored inside the logarithm."""
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(FLOOR)))))


def l2(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(a, a))


def linf(a: Column, b: Column) -> Column:
    """Largest difference."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def expected_index(p: Column) -> Column:
    """Mean position under ``p``."""
    return total(F.transform(p, lambda x, i: x * i))


def valid_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Finite, and summing to one."""
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def normalize(p: Column, tolerance: float = 1e-4) -> Column:
    """``p`` divided by its sum; null if it is empty, has a negative part or sums to something else than one."""
    sound = (F.size(p) > 0) & (F.array_min(p) >= 0) & (F.abs(total(p) - 1) <= tolerance)
    return F.when(sound, let(F.struct(p.alias("p"), total(p).alias("s")), lambda q: F.transform(q["p"], lambda x: x / q["s"])))
