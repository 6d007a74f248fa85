"""Scalar column functions that Spark lacks."""

from __future__ import annotations

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that give erfc to 14 digits.
_TERMS = 30


def _scaled_erfc(y: np.ndarray) -> np.ndarray:
    """log(erfc(x)) + x * x - log(t) with t = 2 / (2 + x) and y = 2 t - 1, by the continued fraction for large x."""
    import math

    out = []
    for v in y:
        t = (v + 1) / 2
        x = 2 / t - 2 if t > 0 else math.inf
        if x < 6:
            out.append(math.log(math.erfc(x)) + x * x - math.log(t))
            continue
        if x == math.inf:
            out.append(math.log(1 / (2 * math.sqrt(math.pi))))
            continue
        f = x
        for k in range(60, 0, -1):
            f = x + k / 2 / f
        out.append(-math.log(f * math.sqrt(math.pi)) - math.log(t))
    return np.array(out)


#: Chebyshev coefficients of that function of y, fitted once.
_COEFFICIENTS = chebyshev.chebinterpolate(_scaled_erfc, _TERMS - 1).tolist()


def erfc(x: Column) -> Column:
    """The complementary error function of a non-negative column, to 13 digits; null stays."""
    t = 2.0 / (2.0 + x)
    y = 2.0 * t - 1.0
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    # Clenshaw's recursion from the last coefficient down to the second.
    run = F.aggregate(F.array(*[F.lit(c) for c in _COEFFICIENTS[:0:-1]]), start, lambda s, c: F.struct((2.0 * y * s["a"] - s["b"] + c).alias("a"), s["a"].alias("b")))
    return F.when(x.isNotNull(), t * F.exp(-x * x + F.lit(_COEFFICIENTS[0]) + y * run["a"] - run["b"]))


def title_case(text: Column) -> Column:
    """Each run of letters (digits and apostrophes inside words don't break it) with a capital first, the rest small."""
    parts = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")
