"""Distribution functions as column expressions, without Python workers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _each(values: list[Column], f) -> Column:
    """``f`` of the values, each computed once per row."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])), lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series eight steps up."""

    def at(z: Column) -> Column:
        product = z
        for i in range(1, 8):
            product = product * (z + i)
        w = z + 8
        series = sum((F.lit(c) / F.pow(w, F.lit(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
        return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(product)

    return _each([z], at)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """P(X <= x) for a beta distribution: the regularised incomplete beta function.

    Lentz's evaluation of its continued fraction; the number of steps grows with the square root of
    the larger parameter. Null where an argument is null or a parameter is not positive.
    """

    def at(x: Column, a: Column, b: Column) -> Column:
        mirrored = x > (a + 1) / (a + b + 2)

        def body(x: Column, a: Column, b: Column) -> Column:
            tiny = F.lit(1e-300)

            def guard(v: Column) -> Column:
                return F.when(F.abs(v) < tiny, tiny).otherwise(v)

            def half(s: Column, term: Column) -> Column:
                d = F.lit(1.0) / guard(term * s["d"] + 1)
                c = guard(term / s["c"] + 1)
                return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

            def step(s: Column, m: Column) -> Column:
                even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                first = F.transform(F.array(s), lambda t: half(t, even))
                return F.transform(first, lambda t: half(t, odd))[0]

            d0 = F.lit(1.0) / guard(1 - (a + b) * x / (a + 1))
            start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
            steps = F.transform(F.sequence(F.lit(1), (15 + 5 * F.sqrt(F.greatest(a, b))).cast("int")), lambda m: m.cast("double"))
            fraction = F.aggregate(steps, start, step, lambda s: s["h"])
            front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)
            return F.exp(front) * fraction / a

        direct = _each(
            [F.when(mirrored, 1 - x).otherwise(x), F.when(mirrored, b).otherwise(a), F.when(mirrored, a).otherwise(b)], body
        )
        inside = F.when(mirrored, 1 - direct).otherwise(direct)
        p = F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)
        return F.when(x.isNotNull() & (a > 0) & (b > 0), p)

    return _each([x, a, b], at)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's distribution; null without degrees of freedom."""
    square = t * t
    return F.when(t.isNotNull() & (df > 0), beta_cdf(df / (df + square), df / 2, F.lit(0.5)))
