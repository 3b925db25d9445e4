"""Column functions: parsing, cleaning, bands. Built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def parse_period(text: Column, monthly: bool = True) -> Column:
    """A date for `1980`, `Q1 2020`, `2020-Q1`, `2020Q1` and, if monthly, `M01 2020` and `2020-01`; else null.

    A year is its last day, a quarter the first day of its last month, a month its first day.
    """
    s = F.upper(F.trim(text))
    group = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("int")
    year, q_first, q_last = r"^((?:19|20)\d{2})$", r"^Q([1-4]) (\d{4})$", r"^(\d{4})[-_]?Q([1-4])$"
    m_first, m_last = r"^M(0[1-9]|1[0-2]) (\d{4})$", r"^(\d{4})[-_](0[1-9]|1[0-2])$"
    out = F.when(s.rlike(year), F.make_date(group(year, 1), F.lit(12), F.lit(31)))
    out = out.when(s.rlike(q_first), F.make_date(group(q_first, 2), group(q_first, 1) * 3, F.lit(1)))
    out = out.when(s.rlike(q_last), F.make_date(group(q_last, 1), group(q_last, 2) * 3, F.lit(1)))
    if monthly:
        out = out.when(s.rlike(m_first), F.make_date(group(m_first, 2), group(m_first, 1), F.lit(1)))
        out = out.when(s.rlike(m_last), F.make_date(group(m_last, 1), group(m_last, 2), F.lit(1)))
    return out


def key_part(key: Column, part: int) -> Column:
    """A part of a dotted key, `` if the key or part is missing."""
    return F.coalesce(F.get(F.split(key, r"\."), F.lit(part)), F.lit(""))


def clean_number(text: Column) -> Column:
    """A finite double, or null for blanks, nan, na and what is no number."""
    s = F.lower(F.trim(text))
    number = s.try_cast("double")
    return F.when(~s.isin("", "nan", "na") & ~F.isnan(number), number)


def frequency(freq: Column | None, dataset: Column, quarterly: Sequence[str] = (), annual: Sequence[str] = ()) -> Column:
    by_dataset = F.when(dataset.isin(*quarterly), "Q").when(dataset.isin(*annual), "A").otherwise("M")
    return by_dataset if freq is None else F.coalesce(freq, F.lit("Q"))


def unit_class(name: Column) -> Column:
    """The class of an indicator by its name; the first that fits."""
    s = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: F.lit(False) if not words else s.rlike("|".join(words))
    return (
        F.when(has("percent", "%", "ratio to", "share of"), "PERCENT").when(has("us dollar", "domestic currency", "national currency", "euro"), "CURRENCY")
        .when(has("basis point"), "BASIS_POINTS").when(has("number of", "count"), "COUNT").when(has("ratio", "index"), "RATIO").otherwise("UNKNOWN")
    )


def clip(v: Column, lo, hi) -> Column:
    """v between lo and hi; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(F.lit(hi) if not isinstance(hi, Column) else hi, v)))


def tier(score: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The first name whose bound the score doesn't exceed, else the last name."""
    out = None
    for bound, name in zip(bounds, names, strict=False):
        out = F.when(score <= bound, name) if out is None else out.when(score <= bound, name)
    return F.when(score.isNotNull(), out.otherwise(names[-1]))


def tier_from(score: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The first name whose bound the score reaches, else the last name."""
    out = None
    for bound, name in zip(bounds, names, strict=False):
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return F.when(score.isNotNull(), out.otherwise(names[-1]))


def ratio_flag(r: Column) -> Column:
    return F.when(r > 200, "UNUSUAL").when(r < 30, "UNDER_PROVISIONED").otherwise("OK")


def hybrid(score: Column, p: Column, weight: float = 0.1) -> Column:
    """score with a share of the event probability's own score, within 1 to 10."""
    return clip((1 - weight) * score + weight * (1 + 9 * p), 1.0, 10.0)


def hybrid_pillars(econ: Column, industry: Column, p: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    safe = clip(weights[0] * econ + weights[1] * industry + weights[2] * (1 - p) * 100, 0.0, 100.0)
    return 1 + 9 * (1 - safe / 100)


#: Phrases in the names of entities that are groups of others.
AGGREGATES = (
    "Area", "ASEAN", "Euro area", "World", "Advanced", "Emerging", "Sub-Saharan", "Middle East", "Commonwealth", "European Union",
    "OECD", "G7", "G20", "Latin America", " and ", "Western Hemisphere", "Developing", "Low-income", "Heavily indebted",
)


def names_aggregate(name: Column, phrases: Sequence[str] = AGGREGATES) -> Column:
    """Whether a name holds any of the phrases, in any case."""
    return name.rlike("(?i)" + "|".join(re.escape(x) for x in phrases))


def long_years(wide: DataFrame, prefix: str, name: str = "i", value: str = "n") -> DataFrame:
    """A table of one row for each indicator and a column for each year as i (prefixed), t (1 January), value; nulls are left out."""
    years = [x for x in wide.columns if x.isdigit()]
    out = wide.unpivot([name], years, "y", value).where(F.col(value).isNotNull())
    return out.select(F.concat(F.lit(prefix), name).alias(name), F.make_date(F.col("y").cast("int"), F.lit(1), F.lit(1)).alias("t"), value)


#: Inputs of the balance ratios.
BALANCE_INPUTS = ("income", "expenses", "assets", "interbank_deposits", "liabilities", "non_interest", "net_interest", "debt_securities", "provisions", "npl", "large_exposures", "capital", "government_claims", "gross_loans", "deposits")
#: ratio: (input that must not be zero and whose year counts, numerator, denominator).
_BALANCE = {
    "margin": ("income", "income - expenses", "assets"),
    "interbank": ("interbank_deposits", "interbank_deposits", "liabilities"),
    "non_interest_share": ("non_interest", "non_interest", "all_income"),
    "securities": ("debt_securities", "debt_securities", "assets"),
    "provisioning": ("provisions", "provisions", "npl"),
    "concentration": ("large_exposures", "large_exposures", "capital"),
    "sovereign": ("government_claims", "government_claims", "gross_loans"),
    "funding": ("deposits", "deposits", "liabilities"),
}


def balance_sql() -> list[tuple[str, str, str, str]]:
    """(ratio, guarding input, numerator, denominator) of each balance ratio, as SQL."""
    return [(r, a, n if " " not in n else f"({n})", b) for r, (a, n, b) in _BALANCE.items()]


def balance_ratios(wide: DataFrame) -> DataFrame:
    """e and the eight ratios in percent with their numerator's year, from a column for each input and `input_y`; a zero or absent input gives none."""
    x = wide.withColumn("all_income", F.col("non_interest") + F.col("net_interest"))
    out = []
    for ratio, guard, numerator, denominator in balance_sql():
        there = F.expr(f"{guard} <> 0 and {denominator} > 0")
        out += [F.when(there, F.expr(f"{numerator} / {denominator} * 100")).alias(ratio), F.when(there, F.col(guard + "_y")).alias(ratio + "_year")]
    return x.select("e", *out)


def one_decimal(x: Column) -> Column:
    """x with one decimal as text, the exact binary value rounded half to even: 6.25 is 6.2, 0.15 (a little less than that) 0.1.

    Spark's own `%.1f` rounds the shortest decimal form half up. Twenty times the fraction, scaled by 2^57, is exact as a
    long; values without a fraction (2^52 and more) and non-finite ones are left to Spark. Null stays null.
    """
    size = F.abs(x)
    whole = F.floor(size).cast("long")
    scaled = ((size - whole) * float(2**57)).cast("long") * 20
    rest, half = scaled.bitwiseAND(F.lit(2**58 - 1)), F.lit(2**57)
    down = whole * 10 + F.shiftright(scaled, 58)
    tenths = down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(x.isNull(), F.lit(None)).when(size < float(2**52), text).otherwise(F.format_string("%.1f", x))
