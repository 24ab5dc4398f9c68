"""The scalar functions of the detectors, as column expressions where they have a closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the two polynomial branches of the two-sided normal tail, highest power first.
NEAR = (0.000124818987, -0.001075204047, 0.005198775019, -0.019198292004, 0.059054035642, -0.151968751364, 0.319152932694, -0.5319230073, 0.797884560593)
FAR = (
    -0.000045255659,
    0.00015252929,
    -0.000019538132,
    -0.000676904986,
    0.001390604284,
    -0.00079462082,
    -0.002034254874,
    0.006549791214,
    -0.010557625006,
    0.011630447319,
    -0.009279453341,
    0.005353579108,
    -0.002141268741,
    0.000535310849,
    0.999936657524,
)


def _poly(coefficients, x):
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution; geometric beyond six."""
    y = F.abs(z) * 0.5
    inner = F.when(y >= 3.0, F.lit(1.0)).when(y < 1.0, _poly(NEAR, y * y) * y * 2.0).otherwise(_poly(FAR, y - 2.0))
    near = F.least(inner + 1.0, F.lit(1.0) - inner)
    return F.when(z == 0, 0.0).when(F.abs(z) < 5.9999999, near).otherwise(F.lit(1e-9) / F.pow(F.lit(1.6), (F.abs(z) - 5.999999) * 10.0))


def chi_p(chi: Column) -> Column:
    """P-value of a chi-square with one degree of freedom."""
    p = normal_tail(-F.sqrt(chi))
    return F.when(chi > 0, F.least(F.greatest(F.when(p == 0, F.lit(1e-10) / (chi - 34.0)).otherwise(p), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def chi_square(h: Column, left: Column, right: Column) -> Column:
    """2 x 2 chi-square of matches in two halves of h sites; 0 where a margin is 0."""
    a, c, n = left.cast("double"), right.cast("double"), h.cast("double")
    b, d = n - a, n - c
    cross = a * d - b * c
    return F.when((a + c > 0) & (b + d > 0), cross * cross * 2.0 / (n * (a + c) * (b + d))).otherwise(0.0)


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def sidak(p: Column, tests: Column) -> Column:
    """1 - (1 - p) ** tests above 1e-15, else the product."""
    return F.when(p > 1e-15, -F.expm1(tests * F.log1p(-F.least(p, F.lit(1 - 1e-16))))).otherwise(F.least(F.lit(1.0), p * tests))


def jukes_cantor(valid: Column, differences: Column) -> Column:
    """Distance, saturating at 10."""
    identity = (valid - differences) / valid
    return F.when(valid == 0, 10.0).when(differences == 0, 0.0).when(identity <= 0.25, 10.0).otherwise(F.lit(-0.75) * F.ln((F.lit(4.0) * identity - 1.0) / 3.0))


def pinned_descent(plus, minus, drop, exp, tail):
    """Siegmund's approximation of the chance that a walk of so many ups and downs in random order falls by drop at least
    from a maximum: one minus the chance of no event at the mean rate nu ** 2 (1 + 2 (2 b - x) (b - x) / n) exp(-2 b (b - x) /
    n), with n steps, x = minus - plus and b = drop less half a step. nu is the correction for overshooting, by its usual
    rational form in the normal distribution and density. Numbers or columns, as exp and tail (of both sides) are."""
    n, x, b = plus + minus, minus - plus, drop - 0.5
    h = (2 * b - x) / n
    beyond = tail(h)
    density = exp(h * h / -2.0) * 0.3989422804014327  # 1 / sqrt(2 pi)
    nu = (1 - beyond) / (2 * h * (h * (1 - beyond / 2) + density))
    rate = nu * nu * (1 + 2 * h * (b - x)) * exp(-2 * b * (b - x) / n)
    return 1 - exp(rate * -1.0)


def siegmund(plus: Column, minus: Column, drop: Column) -> Column:
    """pinned_descent of columns; 1 where the walk falls by drop in any case, 0 without steps."""
    p, m, d = (c.cast("double") for c in (plus, minus, drop))
    return F.when(p + m <= 0, 0.0).when(d <= m - p, 1.0).otherwise(pinned_descent(p, m, d, F.exp, normal_tail))


def half_even(x: Column) -> Column:
    """Rounds to the nearest whole number, halves to the even one."""
    return F.bround(x, 0)


def population_z(observed: Column, mean: Column, deviation: Column) -> Column:
    return F.when((observed == 0) | (deviation <= 0), 0.0).otherwise((observed - mean) / deviation)


def in_tract(pos: Column, begin: Column, end: Column) -> Column:
    """Membership in a circular tract, ends included; begin = end is the whole sequence."""
    return F.when(begin < end, (pos >= begin) & (pos <= end)).otherwise((pos >= begin) | (pos <= end))


def tract_span(begin: Column, end: Column, length: Column) -> Column:
    """Sites of a tract; a tract that begins after its end goes through the origin."""
    return F.when(begin <= end, end - begin + 1).otherwise(length - begin + 1 + end)


def segments(begin: Column, end: Column, length: Column) -> Column:
    """A tract as one or two ranges that do not wrap."""
    s = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    one = F.lit(1).cast("int")
    return F.when(begin <= end, F.array(s(begin, end))).otherwise(F.array(s(begin, length), s(one, end)))


def overlap(b1: Column, e1: Column, b2: Column, e2: Column, length: Column) -> Column:
    """2 * common sites / sum of both spans."""
    pair = lambda x, y: F.greatest(F.lit(0), F.least(x["hi"], y["hi"]) - F.greatest(x["lo"], y["lo"]) + 1)
    first, second = segments(b1, e1, length), segments(b2, e2, length)
    common = F.aggregate(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: pair(x, y)))), F.lit(0), lambda acc, n: acc + n)
    return F.lit(2.0) * common / (tract_span(b1, e1, length) + tract_span(b2, e2, length))
