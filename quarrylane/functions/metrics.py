"""Market metrics as column expressions. Missing inputs or zero denominators give NULL, never zero or infinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INSUFFICIENT = "insufficient_data"
PRIORITY_WEIGHTS = {
    "rental_income": {"yield": 0.6, "appreciation": 0.1, "liquidity": 0.3},
    "capital_appreciation": {"yield": 0.1, "appreciation": 0.6, "liquidity": 0.3},
    "liquidity": {"yield": 0.2, "appreciation": 0.2, "liquidity": 0.6},
    "balanced": {"yield": 0.34, "appreciation": 0.33, "liquidity": 0.33},
}
RISK_MULTIPLIER = {"low": 1.5, "medium": 1.0, "high": 0.5}
OVERSUPPLY_PENALTY = {"very_high": 40, "high": 20, "moderate": 5, "low": 0, INSUFFICIENT: 0}
DAYS_PER_MONTH = 30.44


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, places: int) -> Column:
    """Half to even, as binary doubles."""
    scale = float(10**places)
    return F.rint(col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL when b is zero or either is missing."""
    b = col(b).cast("double")
    return F.when(b != 0, col(a).cast("double") / b)


def money_sum(c: Column | str) -> Column:
    """Sum in hundredths, so the result does not depend on the order of the rows."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def money_avg(c: Column | str) -> Column:
    return ratio(money_sum(c), F.count(c))


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    cur, prev = col(cur).cast("double"), col(prev).cast("double")
    return rounded(F.when(prev != 0, (cur - prev) / prev * F.lit(100.0)), 2)


def momentum(change: Column | str, band: float = 3.0) -> Column:
    c = col(change)
    return F.when(c.isNull(), INSUFFICIENT).when(c > band, "accelerating").when(c < -band, "slowing").otherwise("stable")


def confidence(n: Column | str, least: int = 5) -> Column:
    return F.when(col(n) >= least, "ok").otherwise(INSUFFICIENT)


def gross_yield(rent: Column | str, price: Column | str) -> Column:
    rent, price = col(rent), col(price)
    return rounded(F.when((rent != 0) & (price != 0), rent / price * F.lit(100.0)), 2)


def market_share(part: Column | str, total: Column | str) -> Column:
    total = col(total).cast("double")
    return rounded(F.when(total != 0, col(part).cast("double") / total * F.lit(100.0)), 2)


def months_span(days: int) -> float:
    return max(1.0, days / DAYS_PER_MONTH)


def consistency(active_months: Column | str, months: float) -> Column:
    return F.least(F.lit(1.0), F.coalesce(col(active_months), F.lit(0)) / F.lit(months))


def liquidity(n: Column | str, months: Column | float, steadiness: Column) -> Column:
    """0 to 100: 70 % monthly count against 50 a month, 30 % steadiness."""
    months = F.lit(float(months)) if isinstance(months, (int, float)) else months
    rate = F.when(months > 0, col(n) / months).otherwise(F.lit(0.0))
    score = (F.least(rate / F.lit(50.0), F.lit(1.0)) * F.lit(0.7) + steadiness * F.lit(0.3)) * F.lit(100.0)
    return F.when(steadiness.isNotNull() & rate.isNotNull(), rounded(score, 1))


def oversupply_ratio(units: Column | str, demand: Column | str) -> Column:
    units, demand = col(units).cast("double"), col(demand).cast("double")
    return rounded(F.when(demand > 0, units / demand), 2)


def oversupply_risk(units: Column | str, demand: Column | str) -> Column:
    units, demand = col(units), col(demand)
    r = oversupply_ratio(units, demand)
    by_ratio = F.when(r < 0.5, "low").when(r < 1.5, "moderate").when(r < 3, "high").otherwise("very_high")
    idle = F.when(units == 0, INSUFFICIENT).otherwise("very_high")
    return F.when(units.isNull() | demand.isNull(), INSUFFICIENT).when(demand <= 0, idle).otherwise(by_ratio)


def weighted_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the parts that are present."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    total = add([F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in parts.items()])
    value = add([F.coalesce(c * F.lit(weights[k]), F.lit(0.0)) for k, c in parts.items()])
    return F.when(total > 0, value / total)


def annualised(n: Column | str, days: int) -> Column:
    return rounded(F.lit(365.0) * col(n) / F.lit(float(days)), 0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def yield_score(pct: Column | str) -> Column:
    return clamp(col(pct) / F.lit(15.0) * F.lit(100.0), 0.0, 100.0)


def appreciation_score(pct: Column | str) -> Column:
    return (clamp(col(pct), -20.0, 20.0) + F.lit(20.0)) / F.lit(40.0) * F.lit(100.0)


def format_aed(value: Column | str) -> Column:
    v = col(value).cast("double")
    size = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    text = (
        F.when(size >= 1e9, F.format_string("%.2fB", size / 1e9)).when(size >= 1e6, F.format_string("%.2fM", size / 1e6))
        .when(size >= 1e3, F.format_string("%.0fK", size / 1e3)).otherwise(F.format_string("%.0f", size))
    )
    return F.when(v.isNull(), "N/A").otherwise(F.concat(sign, F.lit("AED "), text))


def format_number(value: Column | str) -> Column:
    return F.coalesce(F.call_function("format_number", col(value), F.lit("#,###,###,##0.###")), F.lit("N/A"))


def format_pct(value: Column | str, signed: bool = False) -> Column:
    v = col(value).cast("double")
    sign = F.when(v > 0, "+").otherwise("") if signed else F.lit("")
    return F.when(v.isNull(), "N/A").otherwise(F.concat(sign, F.format_string("%.1f%%", v)))


def format_psf(value: Column | str) -> Column:
    v = col(value).cast("double")
    return F.when(v.isNull(), "N/A").otherwise(F.format_string("AED %.0f/sqft", v))
