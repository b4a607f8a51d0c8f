"""Scalar column functions (survey C1-C17).

Every function returns a ``Column`` built from ``pyspark.sql.functions`` only,
so it stays inside whole-stage codegen.  No Python UDF anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's --------------------------
# amount buckets: right-closed intervals (0,10] (10,50] (50,100] (100,500] (500,inf)
AMOUNT_BUCKET_EDGES = [0, 10, 50, 100, 500]
AMOUNT_BUCKET_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]
# weekday names, Monday first (weekday 0 = Monday)
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# label used by the latent-factor reports when a code has no description
UNKNOWN_CATEGORY = "Unknown Category"
UNKNOWN = "Unknown"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col, fmt: str | None = None, lenient: bool = False) -> Column:
    """Text → timestamp.  Strict by default (a bad value fails the job,
    as the reference's parser raises); ``lenient`` yields null instead."""
    c = _c(col)
    if lenient:
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)


def parse_money(col, lenient: bool = False) -> Column:
    """``$1,234.56`` / ``$-77.00`` → double.  ANSI cast raises on junk
    unless ``lenient``."""
    stripped = F.translate(_c(col).cast("string"), "$,", "")
    return stripped.try_cast("double") if lenient else stripped.cast("double")


def format_money(col) -> Column:
    """Inverse of C2, used by the adapters to produce reference-shaped text."""
    return F.concat(F.lit("$"), F.format_number(_c(col), 2))


def clip(col, lo: float, hi: float) -> Column:
    """C4: clip into [lo, hi]; null stays null (``least``/``greatest`` skip nulls)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def fraud_flag(label_col) -> Column:
    """C5: 'Yes' → 1, anything else (unlabelled included) → 0."""
    return F.coalesce(_c(label_col) == F.lit("Yes"), F.lit(False)).cast("int")


def date_parts(col) -> dict[str, Column]:
    """Year, month, day, hour, day_of_week (Monday = 0)."""
    c = _c(col)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "hour": F.hour(c),
        "day_of_week": F.weekday(c),
    }


def amount_category(col) -> Column:
    """Right-closed buckets on |amount|; 0 (and null) → null."""
    a = F.abs(_c(col))
    e, lab = AMOUNT_BUCKET_EDGES, AMOUNT_BUCKET_LABELS
    return (
        F.when(a.isNull() | (a <= F.lit(e[0])), F.lit(None).cast("string"))
        .when(a <= F.lit(e[1]), F.lit(lab[0]))
        .when(a <= F.lit(e[2]), F.lit(lab[1]))
        .when(a <= F.lit(e[3]), F.lit(lab[2]))
        .when(a <= F.lit(e[4]), F.lit(lab[3]))
        .otherwise(F.lit(lab[4]))
    )


def ellipsize(col, n: int) -> Column:
    """First n characters plus '...' when longer than n."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def format_day(col) -> Column:
    """C11: yyyy-MM-dd."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def weekday_name(col) -> Column:
    """0..6 → Mon..Sun."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _c(col).cast("int") + 1)


def month_name(col) -> Column:
    """1..12 → Jan..Dec."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _c(col).cast("int"))


def fixed4_or_na(col) -> Column:
    """C14: 4-decimal text, 'N/A' when missing."""
    c = _c(col)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", c))


def safe_ratio(num, den) -> Column:
    """C17: num/den, 0 when den is 0 or null."""
    n, d = _c(num), _c(den)
    return F.when(d.isNotNull() & (d != 0), n / d).otherwise(F.lit(0.0))


def f1(p, r) -> Column:
    """Harmonic mean with the C17 guard."""
    p, r = _c(p), _c(r)
    return safe_ratio(2 * p * r, p + r)


def money_sum(col) -> Column:
    """Sum of an amount column, exact to ten decimals whatever the order of
    the rows, returned as double."""
    return F.sum(_c(col).cast("decimal(28,10)")).cast("double")


def hash_unit(*cols, salt: str = "") -> Column:
    """Stateless, engine-independent pseudo-random number in [0, 10000):
    the first 8 hex digits of md5("salt:c1:c2...") modulo 10000.  The same
    expression exists in ANSI SQL engines, so splits are reproducible
    anywhere and do not depend on partitioning."""
    parts = [F.lit(salt)] + [_c(c).cast("string") for c in cols]
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(10000))


def hash_key(*cols, salt: str = "") -> Column:
    """Stateless 32-bit ordering key: first 8 hex digits of md5("salt:c1:..."),
    as bigint.  Used to pick holdout items and sample users repeatably."""
    parts = [F.lit(salt)] + [_c(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
