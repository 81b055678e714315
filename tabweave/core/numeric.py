"""Column expressions for statistics that must not fail or drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Division that gives null for a zero divisor, also under ANSI mode."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a = F.when(both, x.cast("double"))
    b = F.when(both, y.cast("double"))
    return div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def sample_skewness(x: Column) -> Column:
    """Bias-adjusted skewness (needs three values)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis (needs four values)."""
    n = F.count(x).cast("double")
    raw = (n - 1) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n > 3, div(raw, (n - 2) * (n - 3)))


# Hart's rational approximation of the normal tail, highest power first.
_TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for k in coefficients[1:]:
        total = total * x + F.lit(k)
    return total


# Wichura's algorithm AS 241 for the normal quantile, lowest power first.
_CENTRE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
            45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
           (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
            39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
_FLANK = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
           1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
          (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
           0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_TAIL = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
          0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
         (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
          1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of 0 < p < 1, about 1e-16 relative error."""
    def ratio(x: Column, coefficients) -> Column:
        top, bottom = coefficients
        return _horner(x, top[::-1]) / _horner(x, bottom[::-1])

    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    outer = F.when(r <= 5, ratio(r - F.lit(1.6), _FLANK)).otherwise(ratio(r - F.lit(5.0), _TAIL))
    return F.when(F.abs(q) <= 0.425, q * ratio(F.lit(0.180625) - q * q, _CENTRE)).otherwise(F.signum(q) * outer)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 1e-14 absolute error."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _horner(a, _TAIL_TOP) / _horner(a, _TAIL_BOTTOM)
    fraction = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        fraction = a + F.lit(float(k)) / fraction
    far = bell / fraction / F.lit(2.506628274631)
    tail = F.when(a < 7.07106781186547, near).when(a < 37, far).otherwise(F.lit(0.0))
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)
