"""Vector expressions, in double precision, on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pearson_unit(a: str | Column, b: str | Column) -> Column:
    """Correlation of two histograms mapped from [-1, 1] to [0, 1]; 0 where one is constant."""

    def centred(v: str | Column) -> Column:
        # The mean is bound once, as the element of an outer array; inside the lambda it would be worked out for each component.
        total = F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double"))
        return F.transform(F.array(F.try_divide(total, F.size(_c(v)).cast("double"))), lambda m: F.transform(_c(v), lambda x: x.cast("double") - m))[0]

    both = F.array(F.struct(centred(a).alias("x"), centred(b).alias("y")))
    sums = F.transform(both, lambda t: F.try_divide(dot(t["x"], t["y"]), norm(t["x"]) * norm(t["y"])))[0]
    return F.greatest(F.lit(0.0), F.coalesce((sums + 1) / 2, F.lit(0.0)))


def scaled(a: str | Column) -> Column:
    """a at unit length; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def sign_bits(a: str | Column) -> Column:
    """64 sign bits of the first 64 components, the first one highest."""
    v = F.slice(_c(a), 1, 64)
    return F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))
