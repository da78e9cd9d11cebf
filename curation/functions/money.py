"""Amounts, durations, dates and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curation.functions import vocabulary as V


def _mapped(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


_TUITION = r"([A-Z]{3}|HK\$|US\$|£|RMB)[ \t]*([0-9,]+)"


def tuition_amount(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), _TUITION, 2), ",", "").try_cast("decimal(12,2)")


def tuition_currency(c: Column) -> Column:
    """Code of the first amount; an unknown three-letter code is OTHER."""
    token = F.regexp_extract(F.coalesce(c, F.lit("")), _TUITION, 1)
    return F.when(tuition_amount(c).isNotNull(), _mapped(F.lower(token), V.CURRENCIES, "OTHER"))


def tuition_candidates(line: Column) -> Column:
    """All (currency, amount) of a line."""
    pattern = r"(hk\$|us\$|£|rmb|cny|hkd|usd|gbp)[ \t]*([0-9][0-9,]*(?:\.[0-9]+)?)"
    low = F.lower(F.coalesce(line, F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("c"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("a"))
    return F.transform(pairs, lambda x: F.struct(_mapped(x["c"], V.CURRENCIES, "OTHER").alias("currency"), F.regexp_replace(x["a"], ",", "").try_cast("double").alias("amount")))


def tuition_priority(line: Column, noise: list[str]) -> Column:
    low = F.lower(F.coalesce(line, F.lit("")))
    score = F.when(F.contains(low, F.lit("tuition")), 3).otherwise(0) + F.when(low.rlike("fee|cost"), 2).otherwise(0) + F.when(low.rlike("international|uk |home "), 1).otherwise(0)
    return F.when(low.rlike("|".join(noise)), -1).otherwise(score)


def shorthand_amount(c: Column) -> Column:
    """14k, 1.5m, 350,000 as decimals; null if not a number."""
    t = F.lower(F.regexp_replace(c, "[, ]", ""))
    factor = F.when(F.endswith(t, F.lit("k")), 1000).when(F.endswith(t, F.lit("m")), 1000000).otherwise(1)
    return (F.regexp_replace(t, "[km]$", "").try_cast("decimal(14,4)") * factor).cast("decimal(18,2)")


def study_mode(c: Column) -> Column:
    return _mapped(F.lower(F.trim(F.coalesce(c, F.lit("")))), V.STUDY_MODES, "Unknown")


def duration_months(c: Column) -> Column:
    """Months of the first duration; years count before months, fractions are cut off; null without one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    years = F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)[ \-]*(?:year|yr|年)", 1).try_cast("double")
    months = F.regexp_extract(low, r"([0-9]+)[ \-]*(?:month|mth|个月)", 1).try_cast("int")
    return F.nullif(F.coalesce(F.nullif(F.floor(years * 12).cast("int"), F.lit(0)), months), F.lit(0))


def duration_mode(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("full-time|full time|全日制"), "FullTime").when(low.rlike("part-time|part time|兼读制|非全日制"), "PartTime").otherwise("Unknown")


def applicant_scope(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("all")
    for pattern, scope in reversed(V.SCOPES):
        out = F.when(low.rlike(pattern), scope).otherwise(out)
    return out


def iso_timestamp(c: Column) -> Column:
    """ISO date-times with Z, an offset or nothing (then UTC); null if not one."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


#: Date patterns within a line and the formats that read them; day suffixes are taken off before.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_DATES = [
    (r"(?:^|[^0-9])((?:20[0-9]{2}|2100)-[0-9]{1,2}-[0-9]{1,2})(?:[^0-9]|$)", ["yyyy-M-d"]), (r"(?:^|[^0-9])((?:20[0-9]{2}|2100)/[0-9]{1,2}/[0-9]{1,2})(?:[^0-9]|$)", ["yyyy/M/d"]),
    (rf"(?:^|[^0-9])([0-9]{{1,2}} {_MONTH},? (?:20[0-9]{{2}}|2100))(?:[^0-9]|$)", ["d MMMM yyyy", "d MMM yyyy"]), (rf"({_MONTH} [0-9]{{1,2}},? (?:20[0-9]{{2}}|2100))(?:[^0-9]|$)", ["MMMM d yyyy", "MMM d yyyy"]),
    (r"((?:20[0-9]{2}|2100)年[0-9]{1,2}月[0-9]{1,2})日", ["yyyy年M月d"]),
]


def _reader(form: str):
    return lambda x: F.to_date(F.try_to_timestamp(F.regexp_replace(x, ",", ""), F.lit(form)))


def dates_in(line: Column) -> Column:
    """Dates of a line in common formats, English months in full or short, years 2000 to 2100."""
    plain, found = F.regexp_replace(line, r"([0-9])(?:st|nd|rd|th)\b", "$1"), []
    for pattern, formats in _DATES:
        texts = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))
        found += [F.transform(texts, _reader(f)) for f in formats]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))


def first_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"[0-9,]+(?:\.[0-9]+)?", 0), ",", "").try_cast("decimal(18,2)")


def option_mode(c: Column) -> Column:
    """Study mode of a selected text; online counts as part-time; null if blank."""
    low = F.lower(c)
    return F.when(F.trim(c) == "", None).when(low.rlike("full-time|full time"), "FullTime").when(low.rlike("part-time|part time|online"), "PartTime").otherwise("Unknown")


def option_months(c: Column) -> Column:
    years, months = (F.regexp_extract(F.lower(c), rf"([0-9]+)\s*{unit}", 1).try_cast("int") for unit in ("year", "month"))
    return F.when(F.trim(c) != "", F.coalesce(years * 12, months, F.lit(0)))


def deadline_date(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_extract(c, r"([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})", 1), r"\s+", " ")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("d MMMM yyyy", "d MMM yyyy")])


def backoff_seconds(attempt: Column, cap: int = 30) -> Column:
    return F.least(F.pow(F.lit(2), F.greatest(attempt - 1, F.lit(0))), F.lit(cap)).cast("int")


def as_bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off", ""), False)


def clamped_int(c: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def stage_progress(done: Column, total: Column, low: Column, high: Column) -> Column:
    """Progress within a stage's range, the ratio held between 0 and 1."""
    ratio = F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.floor(low + (high - low) * ratio).cast("int")


def inferred_exam(text: Column) -> Column:
    """(name, family) of the first exam whose token stands alone in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("struct<name:string,family:string>")
    for token, name, family in reversed(V.EXAMS):
        out = F.when(low.rlike(rf"(^|[^a-z0-9_]){token}([^a-z0-9_]|$)"), F.struct(F.lit(name).alias("name"), F.lit(family).alias("family"))).otherwise(out)
    return out
