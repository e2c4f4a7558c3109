"""Semirings as builders of Column expressions: everything stays in the JVM.

A semiring gives the type of a weight, its zero and one, plus and times of two columns, and plus as an aggregate with
partial sums. Divisible ones add divide; naturally ordered ones say which of two weights is better (a is no worse than b
iff a plus b = a); starred ones add star.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidOperation

INF = float("inf")


@dataclass(frozen=True)
class Semiring:
    name: str
    type: str
    zero_of: Callable[[], Column] = field(compare=False)
    one_of: Callable[[], Column] = field(compare=False)
    plus: Callable[[Column, Column], Column] = field(compare=False)
    times: Callable[[Column, Column], Column] = field(compare=False)
    plus_agg: Callable[[Column], Column] = field(compare=False)
    divide: Callable[[Column, Column], Column] | None = field(default=None, compare=False)
    star: Callable[[Column], Column] | None = field(default=None, compare=False)
    #: A key whose ascending order is best first; None without a natural order.
    order: Callable[[Column], Column] | None = field(default=None, compare=False)
    idempotent: bool = True
    commutative: bool = True
    #: The numeric size of a weight's difference, for convergence of sums.
    size: Callable[[Column], Column] | None = field(default=None, compare=False)
    #: Weights of equal value as one key (for grouping); the weight itself unless floats need rounding.
    parts: tuple = field(default=(), compare=False)

    @property
    def zero(self) -> Column:
        return self.zero_of()

    @property
    def one(self) -> Column:
        return self.one_of()

    @property
    def path(self) -> bool:
        return self.order is not None

    def cast(self, c: Column) -> Column:
        return c.cast(self.type)

    def is_zero(self, c: Column) -> Column:
        return c.eqNullSafe(self.cast(self.zero))

    def is_one(self, c: Column) -> Column:
        return c.eqNullSafe(self.cast(self.one))

    def need(self, what: str) -> Callable:
        found = getattr(self, what)
        if found is None:
            raise InvalidOperation(f"the {self.name} semiring has no {what}")
        return found

    def approx_eq(self, a: Column, b: Column, delta: float = 1e-6) -> Column:
        return a.eqNullSafe(b) if self.size is None else a.eqNullSafe(b) | (F.abs(a.cast("double") - b.cast("double")) <= delta)


def _lift(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


TROPICAL = Semiring(
    "tropical", "float", lambda: F.lit(INF).cast("float"), lambda: F.lit(0.0).cast("float"), F.least, lambda a, b: (a + b).cast("float"), F.min,
    divide=lambda a, b: F.when(a == INF, F.lit(INF)).otherwise(a - b).cast("float"), star=lambda a: F.when(a >= 0, F.lit(0.0)).cast("float"), order=lambda a: a, size=lambda a: a,
)


def _log_plus(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == INF, low).otherwise(low - F.log1p(F.exp(low - high)))


def _log_sum(c: Column) -> Column:
    """-ln(sum(exp(-w))): the sum is kept as is, so that partial sums merge; weights are near 0 in practice."""
    total = F.sum(F.exp(-c))
    return F.when(total > 0, -F.ln(total)).otherwise(F.lit(INF))


LOG = Semiring(
    "log", "double", lambda: F.lit(INF), lambda: F.lit(0.0), _log_plus, lambda a, b: a + b, _log_sum,
    divide=lambda a, b: F.when(a == INF, F.lit(INF)).otherwise(a - b), star=lambda a: F.when(a > 0, F.ln(1 - F.exp(-a))), idempotent=False, size=lambda a: a,
)
PROBABILITY = Semiring(
    "probability", "double", lambda: F.lit(0.0), lambda: F.lit(1.0), lambda a, b: a + b, lambda a, b: a * b, F.sum,
    divide=lambda a, b: F.try_divide(a, b), star=lambda a: F.when(a >= 1, F.lit(INF)).otherwise(1 / (1 - a)), idempotent=False, size=lambda a: a,
)
REAL = Semiring(
    "real", "double", lambda: F.lit(0.0), lambda: F.lit(1.0), lambda a, b: a + b, lambda a, b: a * b, F.sum,
    divide=lambda a, b: F.try_divide(a, b), star=lambda a: F.try_divide(F.lit(1.0), 1 - a), idempotent=False, size=lambda a: a,
)
#: Sums and products that leave 64 bits raise, as ANSI mode has it; they never wrap silently.
INTEGER = Semiring("integer", "bigint", lambda: F.lit(0).cast("bigint"), lambda: F.lit(1).cast("bigint"), lambda a, b: a + b, lambda a, b: a * b, F.sum, idempotent=False, size=lambda a: a)
BOOLEAN = Semiring("boolean", "boolean", lambda: F.lit(False), lambda: F.lit(True), lambda a, b: a | b, lambda a, b: a & b, F.bool_or, star=lambda a: F.lit(True), order=lambda a: ~a)
MIN = Semiring("min", "float", lambda: F.lit(INF).cast("float"), lambda: F.lit(-INF).cast("float"), F.least, F.greatest, F.min, star=lambda a: F.lit(-INF).cast("float"), order=lambda a: a, size=lambda a: a)
MAX = Semiring("max", "float", lambda: F.lit(-INF).cast("float"), lambda: F.lit(INF).cast("float"), F.greatest, F.least, F.max, star=lambda a: F.lit(INF).cast("float"), order=lambda a: -a, size=lambda a: a)


# -- strings -------------------------------------------------------------------------------------
#: The zero of the string semiring: a byte that no UTF-8 text holds.
STRING_ZERO = b"\xff"


def _binary_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two binaries."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(acc))
    return F.substring(a, F.lit(1), same)


def _string_plus(a: Column, b: Column) -> Column:
    zero = F.lit(STRING_ZERO)
    return F.when(a == zero, b).when(b == zero, a).otherwise(_binary_prefix(a, b))


def _string_agg(c: Column) -> Column:
    """The common prefix of a group is that of its least and greatest member."""
    real = F.when(c != F.lit(STRING_ZERO), c)
    return F.coalesce(_binary_prefix(F.min(real), F.max(real)), F.lit(STRING_ZERO))


STRING = Semiring("string", "binary", lambda: F.lit(STRING_ZERO), lambda: F.lit(b""), _string_plus, lambda a, b: F.when((a == F.lit(STRING_ZERO)) | (b == F.lit(STRING_ZERO)), F.lit(STRING_ZERO)).otherwise(F.concat(a, b)), _string_agg, commutative=False)


# -- compound weights ----------------------------------------------------------------------------
def product(first: Semiring, second: Semiring) -> Semiring:
    """Pairs (w1, w2), component by component; ordered lexicographically if both are."""
    pair = lambda a, b: F.struct(a.alias("w1"), b.alias("w2"))
    both = lambda f: lambda a, b: pair(getattr(first, f)(a["w1"], b["w1"]), getattr(second, f)(a["w2"], b["w2"]))
    return Semiring(
        f"product<{first.name},{second.name}>", f"struct<w1:{first.type},w2:{second.type}>", lambda: pair(first.zero, second.zero), lambda: pair(first.one, second.one), both("plus"), both("times"),
        lambda c: pair(first.plus_agg(c["w1"]), second.plus_agg(c["w2"])),
        divide=both("divide") if first.divide and second.divide else None,
        star=(lambda a: pair(first.star(a["w1"]), second.star(a["w2"]))) if first.star and second.star else None,
        order=(lambda a: F.struct(first.order(a["w1"]), second.order(a["w2"]))) if first.order and second.order else None,
        idempotent=first.idempotent and second.idempotent, commutative=first.commutative and second.commutative, parts=(first, second),
    )


def _array_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, eq: F.struct((acc["n"] + F.when(acc["on"] & eq, 1).otherwise(0)).alias("n"), (acc["on"] & eq).alias("on")))
    return F.slice(a, F.lit(1), same["n"])


def gallic(weight: Semiring, variant: str = "union") -> Semiring:
    """Label strings with a weight. variant: left, right, min, restrict or union (the same as left).

    Zero is the identity of plus. `restrict` gives zero for different labels, so its plus is only meant for functional
    machines, where it never meets any."""
    of = lambda labels, w: F.struct(labels.alias("labels"), w.alias("w"))
    none = F.array().cast("array<bigint>")
    zero, one = of(none, weight.zero), of(none, weight.one)
    is_zero = lambda a: weight.is_zero(a["w"]) & (F.size(a["labels"]) == 0)
    real = lambda c: F.when(~is_zero(c), c)
    suffix = lambda a, b: F.reverse(_array_prefix(F.reverse(a), F.reverse(b)))
    reversed_labels = lambda c: F.reverse(real(c)["labels"])
    if variant in ("left", "union"):
        plus = lambda a, b: of(_array_prefix(a["labels"], b["labels"]), weight.plus(a["w"], b["w"]))
        agg = lambda c: of(_array_prefix(F.min(real(c)["labels"]), F.max(real(c)["labels"])), weight.plus_agg(real(c)["w"]))
    elif variant == "right":
        plus = lambda a, b: of(suffix(a["labels"], b["labels"]), weight.plus(a["w"], b["w"]))
        agg = lambda c: of(F.reverse(_array_prefix(F.min(reversed_labels(c)), F.max(reversed_labels(c)))), weight.plus_agg(real(c)["w"]))
    elif variant == "min":
        key = weight.need("order")
        plus = lambda a, b: F.when(key(b["w"]) < key(a["w"]), b).otherwise(a)
        agg = lambda c: F.min_by(real(c), F.struct(key(real(c)["w"]), real(c)["labels"]))
    elif variant == "restrict":
        plus = lambda a, b: F.when(a["labels"] == b["labels"], of(a["labels"], weight.plus(a["w"], b["w"]))).otherwise(zero)
        agg = lambda c: F.when(F.min(real(c)["labels"]) == F.max(real(c)["labels"]), of(F.min(real(c)["labels"]), weight.plus_agg(real(c)["w"])))
    else:
        raise InvalidOperation(f"no gallic variant {variant}")

    def strip(a: Column, b: Column) -> Column:
        """labels of a without the suffix that b's labels are."""
        kept = F.size(a["labels"]) - F.size(b["labels"])
        return F.when((kept >= 0) & (F.slice(a["labels"], F.greatest(kept, F.lit(0)) + 1, F.size(b["labels"])) == b["labels"]), F.slice(a["labels"], F.lit(1), F.greatest(kept, F.lit(0))))

    return Semiring(
        f"gallic<{variant},{weight.name}>", f"struct<labels:array<bigint>,w:{weight.type}>", lambda: zero, lambda: one,
        lambda a, b: F.when(is_zero(a), b).when(is_zero(b), a).otherwise(plus(a, b)), lambda a, b: F.when(is_zero(a) | is_zero(b), zero).otherwise(of(F.concat(a["labels"], b["labels"]), weight.times(a["w"], b["w"]))),
        lambda c: F.coalesce(agg(c), zero), divide=(lambda a, b: of(strip(a, b), weight.divide(a["w"], b["w"]))) if weight.divide else None,
        order=(lambda a: F.struct(weight.order(a["w"]), a["labels"])) if variant == "min" else None, idempotent=weight.idempotent, commutative=False, parts=(weight,),
    )


SEMIRINGS = {s.name: s for s in (TROPICAL, LOG, PROBABILITY, REAL, INTEGER, BOOLEAN, MIN, MAX, STRING)}


def semiring(name: str) -> Semiring:
    try:
        return SEMIRINGS[name]
    except KeyError:
        raise InvalidOperation(f"no semiring {name}") from None


# -- scalar functions ----------------------------------------------------------------------------
def log_from_probability(p: Column) -> Column:
    return F.when(p > 0, -F.ln(p)).otherwise(F.lit(INF))


def log_to_probability(w: Column) -> Column:
    return F.exp(-w)


def real_from_fraction(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def inverse(a: Column) -> Column:
    """The inverse of a real weight; null for zero."""
    return F.try_divide(F.lit(1.0), a)


def parse_weight(text: Column, s: Semiring) -> Column:
    """A weight from text; null where it cannot be read. Both spellings of infinity are understood."""
    plain = F.regexp_replace(F.trim(text), "∞", "Infinity")
    if s.type in ("float", "double"):
        return plain.try_cast(s.type)
    if s.type == "boolean":
        return F.when(F.lower(plain).isin("true", "1"), F.lit(True)).when(F.lower(plain).isin("false", "0"), F.lit(False))
    if s.type == "bigint":
        return plain.try_cast("bigint")
    raise InvalidOperation(f"weights of {s.name} cannot be read from text")


def code_points(text: Column) -> Column:
    """The Unicode code points of a text, as labels."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"))


def quantize(w: Column, mode: str, low: float, high: float, levels: int) -> Column:
    """A weight on the nearest of `levels` steps between low and high, linear or logarithmic (low above 0)."""
    top = levels - 1
    inside = F.least(F.greatest(w.cast("double"), F.lit(low)), F.lit(high))
    if mode == "linear":
        step = F.round((inside - low) / (high - low) * top)
        return low + step / top * (high - low)
    if mode == "log":
        span = F.ln(F.lit(high)) - F.ln(F.lit(low))
        step = F.round((F.ln(inside) - F.ln(F.lit(low))) / span * top)
        return F.exp(F.ln(F.lit(low)) + step / top * span)
    raise InvalidOperation(f"no quantization {mode}")
