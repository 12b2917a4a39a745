"""Special functions: on columns as expressions, on numbers directly.

An argument stands many times in its expression: give a column rather than a long expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factorials that doubles hold, from 0 to 170.
_FACTORIALS = [float(math.factorial(n)) for n in range(171)]
#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)), for odd powers of 1 / x.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: Arguments below this are shifted up before the series is used.
_SHIFT = 10

#: W. J. Cody's rational approximations (1969) of the error function up to 0.46875,
#: of its complement up to 4, and beyond; numerator and denominator, highest power first.
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
#: M. J. Wichura's approximations (1988, AS 241) of the normal quantile about 1/2, in the tails, far out; highest power first.
_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_SIDE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def log_gamma_of(x: float) -> float:
    if not x > 0:
        raise ValueError("log gamma needs a positive argument")
    return math.lgamma(x)


def factorial_of(n: int) -> float:
    """Exact as far as doubles go, then infinite."""
    if n < 0:
        raise ValueError("a factorial needs a number that isn't negative")
    return _FACTORIALS[n] if n < len(_FACTORIALS) else math.inf


def binomial_of(n: int, k: int) -> float:
    if n < 0 or not 0 <= k <= n:
        raise ValueError("a binomial coefficient needs 0 <= k <= n")
    try:
        return float(math.comb(n, k))
    except OverflowError:
        return math.inf


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """By Horner's rule, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def _ratio(x: Column, parts: Sequence[Sequence[float]]) -> Column:
    return _polynomial(x, parts[0]) / _polynomial(x, parts[1])


def _invalid(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: "), value.cast("string"))).cast("double")


def log_gamma(x: Column) -> Column:
    """Stirling's series, upon a shift of small arguments; arguments that aren't positive raise."""
    x = x.cast("double")
    y = F.when(x < _SHIFT, x + _SHIFT).otherwise(x)
    inverse = 1.0 / y
    series = _polynomial(inverse * inverse, _STIRLING[::-1]) * inverse
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + float(k))
    out = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    out = F.when(x < _SHIFT, out - F.log(product)).otherwise(out)
    return F.when(x == math.inf, F.lit(math.inf)).when(x > 0, out).when(x.isNotNull(), _invalid("log gamma needs a positive argument", x))


def factorial(n: Column) -> Column:
    """Exact as far as doubles go, then infinite; negative arguments raise."""
    held = F.element_at(F.array(*map(F.lit, _FACTORIALS)), F.least(n, F.lit(170)).cast("int") + 1)
    return F.when(n < 0, _invalid("a factorial needs a number that isn't negative", n)).when(n > 170, F.lit(math.inf)).otherwise(held)


def binomial(n: Column, k: Column) -> Column:
    """Whole numbers, as near as doubles are; unless 0 <= k <= n it raises."""
    n, k = n.cast("long"), k.cast("long")
    small = F.rint(factorial(F.least(n, F.lit(170))) / factorial(F.least(k, F.lit(170))) / factorial(F.greatest(F.lit(0), F.least(n - k, F.lit(170)))))
    large = F.rint(F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(F.greatest(n - k, F.lit(0)) + 1.0)))
    return F.when((n < 0) | (k < 0) | (k > n), _invalid("a binomial coefficient needs 0 <= k <= n", n)).when(n <= 170, small).otherwise(large)


def erfc(x: Column) -> Column:
    """The complementary error function."""
    y = F.abs(x.cast("double"))
    square = y * y
    middle = F.exp(-square) * _ratio(y, _ERFC)
    inverse = F.try_divide(F.lit(1.0), square)
    far = F.try_divide(F.exp(-square), y) * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, _TAIL))
    tail = F.when(y <= 4, middle).when(y < 27, far).otherwise(F.lit(0.0))
    near = 1.0 - x * _ratio(square, _ERF)
    return F.when(F.isnan(y), F.lit(math.nan)).when(y <= 0.46875, near).when(x < 0, 2.0 - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    return 0.5 * erfc(-z.cast("double") / math.sqrt(2))


def normal_quantile(p: Column) -> Column:
    """Its inverse; infinite at 0 and 1, NaN outside."""
    p = p.cast("double")
    q = p - 0.5
    side = F.when(q < 0, p).otherwise(1.0 - p)
    r = F.sqrt(-F.log(F.when(side > 0, side)))
    tail = F.when(r <= 5, _ratio(r - 1.6, _SIDE)).otherwise(_ratio(r - 5.0, _FAR)) * F.signum(q)
    inside = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, _MIDDLE)).otherwise(tail)
    return F.when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).when((p > 0) & (p < 1), inside).when(p.isNotNull(), F.lit(math.nan))
