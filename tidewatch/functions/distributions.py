"""Distribution functions as column expressions (Spark ships none)."""

import math
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------- fixed values
# Rational approximation of the normal tail (Hart 1968, as printed in West 2005),
# highest power first.
_TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# ------------------------------------------------------------ end fixed values

_SERIES_LIMIT = 2000   # degrees of freedom up to which the finite t series is summed
_TABLE_LIMIT = 64       # degrees of freedom up to which t quantiles are tabulated


def _polynomial(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _normal_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0."""
    near = (F.exp(-x * x / 2) * _polynomial(x, _TAIL_NUMERATOR)
            / _polynomial(x, _TAIL_DENOMINATOR))
    chain = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + F.lit(0.65))
    far = F.exp(-x * x / 2) / chain / math.sqrt(2 * math.pi)
    return F.when(x < 7.07106781186547, near).otherwise(far)


def normal_cdf(x: Column, mu=0.0, sigma=1.0) -> Column:
    z = (x - _column(mu)) / _positive(sigma, 0.01)
    tail = _normal_tail(F.abs(z))
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(x: Column, mu=0.0, sigma=1.0) -> Column:
    sigma = _positive(sigma, 0.01)
    z = (x - _column(mu)) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def exponential_pdf(x: Column, beta) -> Column:
    beta = _positive(beta, 1.0)
    return F.when(x < 0, 0.0).otherwise(F.exp(-x / beta) / beta)


def exponential_cdf(x: Column, beta) -> Column:
    beta = _positive(beta, 1.0)
    return F.when(x < 0, 0.0).otherwise(1.0 - F.exp(-x / beta))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after a shift by eight."""
    shift = reduce(lambda acc, k: acc * (x + float(k)), range(1, 8), x)
    y = x + 8.0
    series = (1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
              + 1 / (1188 * y**9))
    return ((y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series) - F.ln(shift)


def poisson_pmf(k: Column, rate: Column) -> Column:
    k, rate = k.cast("double"), rate.cast("double")
    return (F.when(rate <= 0, (k == 0).cast("double"))
            .otherwise(F.exp(k * F.ln(rate) - rate - log_gamma(k + 1))))


def binomial_pmf(k: Column, n: Column, p) -> Column:
    k, n, p = k.cast("double"), n.cast("double"), _column(p)
    choose = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    return F.exp(choose + k * F.ln(p) + (n - k) * F.ln(1 - p))


def _sum_terms(start: Column, stop: Column, first: Column, ratio) -> Column:
    """first + first*ratio(start+1) + ... up to ``stop``; 0 when the range is empty."""
    steps = F.when(stop > start, F.sequence(start + 1, stop)).otherwise(
        F.array().cast("array<bigint>"))
    zero = F.struct(first.alias("term"), first.alias("total"))

    def step(acc, i):
        term = acc["term"] * ratio(i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, zero, step, lambda acc: acc["total"])
    return F.when(stop < start, 0.0).otherwise(total)


def _support(mean: Column, variance: Column):
    """Whole numbers outside of which less than 1e-30 of the mass lies."""
    reach = F.sqrt(variance) * 14.0 + 40.0
    low = F.greatest(F.lit(0), F.floor(mean - reach)).cast("bigint")
    return low, F.ceil(mean + reach).cast("bigint")


def poisson_cdf(k: Column, rate: Column) -> Column:
    rate = rate.cast("double")
    low, high = _support(rate, rate)
    stop = F.least(k.cast("bigint"), high)
    total = _sum_terms(low, stop, poisson_pmf(low, rate), lambda i: rate / i)
    return F.when(rate <= 0, (k >= 0).cast("double")).otherwise(F.least(F.lit(1.0), total))


def poisson_upper_tail(k: Column, rate: Column) -> Column:
    """P(X >= k), summed from the tail itself so that small values stay exact."""
    rate = rate.cast("double")
    low, high = _support(rate, rate)
    start = F.greatest(k.cast("bigint"), low)
    stop = F.greatest(high, start + 60)
    total = _sum_terms(start, stop, poisson_pmf(start, rate), lambda i: rate / i)
    return (F.when(k <= 0, 1.0).when(rate <= 0, 0.0)
            .otherwise(F.least(F.lit(1.0), total)))


def binomial_cdf(k: Column, n: Column, p) -> Column:
    n, p = n.cast("bigint"), _column(p)
    low, high = _support(n * p, n * p * (1 - p))
    stop = F.least(k.cast("bigint"), high, n)
    odds = p / (1 - p)
    total = _sum_terms(low, stop, binomial_pmf(low, n, p),
                       lambda i: (n - i + 1).cast("double") / i * odds)
    return F.least(F.lit(1.0), total)


def binomial_upper_tail(k: Column, n: Column, p) -> Column:
    """P(X >= k)."""
    n, p = n.cast("bigint"), _column(p)
    low, high = _support(n * p, n * p * (1 - p))
    start = F.greatest(k.cast("bigint"), low)
    stop = F.least(F.greatest(high, start + 60), n)
    odds = p / (1 - p)
    total = _sum_terms(start, stop, binomial_pmf(start, n, p),
                       lambda i: (n - i + 1).cast("double") / i * odds)
    return F.when(k <= 0, 1.0).otherwise(F.least(F.lit(1.0), total))


# -- Student's t ---------------------------------------------------------------

def student_t_cdf(t: Column, df: Column) -> Column:
    """CDF for whole degrees of freedom.

    Finite series of Abramowitz & Stegun 26.7.3/26.7.4; beyond ``_SERIES_LIMIT``
    degrees of freedom Hill's expansion of the equivalent normal deviate (1970), whose
    error is below double precision there: both sides agree at the seam.
    """
    t, nu = t.cast("double"), df.cast("double")
    theta = F.atan(t / F.sqrt(nu))
    cos2 = nu / (nu + t * t)
    sin = t / F.sqrt(nu + t * t)
    odd = df.cast("bigint") % 2 == 1
    count = F.floor((nu - F.when(odd, 1.0).otherwise(0.0)) / 2).cast("bigint")
    count = F.least(count, F.lit(_SERIES_LIMIT // 2 + 1))
    odd_sum = _sum_terms(F.lit(1).cast("bigint"), count, F.lit(1.0),
                         lambda i: cos2 * (2.0 * (i - 1)) / (2.0 * i - 1.0))
    even_sum = _sum_terms(F.lit(1).cast("bigint"), count, F.lit(1.0),
                          lambda i: cos2 * (2.0 * i - 3.0) / (2.0 * (i - 1)))
    series = F.when(odd, 0.5 + (theta + sin * F.sqrt(cos2) * odd_sum) / math.pi) \
              .otherwise(0.5 + 0.5 * sin * even_sum)
    # Bound as a lambda's argument: the deviate is evaluated once, however often the tail names it.
    deviate = F.array(F.signum(t) * _equivalent_deviate(t, nu))
    large = F.element_at(F.transform(deviate, lambda z: normal_cdf(z)), 1)
    finite = F.when(nu > _SERIES_LIMIT, large).otherwise(series)
    return (F.when(t == float("inf"), 1.0).when(t == float("-inf"), 0.0).otherwise(finite))


def _equivalent_deviate(t: Column, nu: Column) -> Column:
    """The z whose two-sided normal tail is that of ``t``, for many degrees of freedom."""
    a = nu - 0.5
    b = 48.0 * a * a
    y = a * F.log1p(t * t / nu)
    inner = (((y * -0.4 - 3.3) * y - 24.0) * y - 85.5) / (y * y * 0.8 + 100.0 + b) + y + 3.0
    return (inner / b + 1.0) * F.sqrt(y)


def _t_cdf(t: float, df: int) -> float:
    """The same series for one number, to tabulate quantiles on the driver."""
    theta, cos2 = math.atan(t / math.sqrt(df)), df / (df + t * t)
    sin = t / math.sqrt(df + t * t)
    odd = df % 2 == 1
    term, total = 1.0, 0.0
    for k in range(1, (df - odd) // 2 + 1):
        if k > 1:
            term *= cos2 * ((2 * k - 2) / (2 * k - 1) if odd else (2 * k - 3) / (2 * k - 2))
        total += term
    if odd:
        return 0.5 + (theta + sin * math.sqrt(cos2) * total) / math.pi
    return 0.5 + 0.5 * sin * total


def _bisect(probability: float, cdf, low: float, high: float) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < probability else (low, middle)
    return (low + high) / 2


@lru_cache(maxsize=None)
def t_quantile(probability: float, df: int) -> float:
    return _bisect(probability, lambda t: _t_cdf(t, df), 0.0, 1e6)


@lru_cache(maxsize=None)
def normal_quantile(probability: float) -> float:
    return _bisect(probability, lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), -40.0, 40.0)


@lru_cache(maxsize=None)
def _quantile_table(probability: float) -> str:
    values = (t_quantile(probability, n) for n in range(1, _TABLE_LIMIT + 1))
    return f"array({', '.join(f'{value!r}D' for value in values)})"


def student_t_quantile(probability: float, df: Column) -> Column:
    """Quantile for a fixed probability above one half.

    A constant table up to ``_TABLE_LIMIT`` degrees of freedom, then the
    expansion of Abramowitz & Stegun 26.7.5, within 1e-8 of it at the seam.
    """
    table = F.expr(_quantile_table(probability))
    z, nu = normal_quantile(probability), df.cast("double")
    expansion = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / nu
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / nu**2
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / nu**3
        + F.lit((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160) / nu**4
    )
    index = df.cast("int")
    return (F.when(index < 1, None)
            .when(index <= _TABLE_LIMIT, F.try_element_at(table, index))
            .otherwise(expansion))


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _positive(value, fallback: float) -> Column:
    value = _column(value)
    return F.when(value <= 0, fallback).otherwise(value)
