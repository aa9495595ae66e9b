"""Text, label and array helpers built from Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C


def entity_key(col: Column, strip: str = " _") -> Column:
    """Lookup key of a place name: lower case without blanks and underscores."""
    return F.regexp_replace(F.lower(col), "[" + re.escape(strip) + "]", "")


def title_name(col: Column) -> Column:
    """Trimmed name with each word capitalised."""
    return F.initcap(F.trim(col))


def clean_header(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower case, blanks as underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def month_label(year: Column, month: Column) -> Column:
    """``Jan'24`` style label."""
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMM''yy")


def month_index(year: Column, month: Column) -> Column:
    """Month number on one running axis."""
    return year * 12 + month


def contains_any(text: Column, words: list[str]) -> Column:
    """True where ``text`` holds one of ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def route_intent(text: Column, intents=C.INTENT_KEYWORDS, default: str = C.DEFAULT_INTENT) -> Column:
    """Name of the first keyword list with a hit in the lower-cased text."""
    lowered = F.lower(text)
    choice = F.lit(default)
    for name, words in reversed(list(intents)):
        choice = F.when(contains_any(lowered, words), F.lit(name)).otherwise(choice)
    return choice


def needs_search(text: Column, words=C.SEARCH_KEYWORDS) -> Column:
    """Whether a message asks for a place lookup; keywords are matched as written."""
    return contains_any(F.lower(text), list(words))


def signed_percent(col: Column) -> Column:
    """``+12%`` style text; null stays null."""
    return F.when(col.isNotNull(), F.format_string("%+.0f%%", col))


def whole_text(col: Column) -> Column:
    """Whole number as text; a missing value reads ``nan``."""
    from panelwatch.functions.numeric import half_up, nan_to_null

    return F.coalesce(half_up(nan_to_null(col), 0).cast("long").cast("string"), F.lit("nan"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``{name}`` of ``template`` by the matching column."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def literal_map(values: dict) -> Column:
    """Small fixed lookup as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def first_or(arr: Column, default: Column) -> Column:
    """First element of an array, or ``default`` when the array is empty or null."""
    return F.coalesce(F.try_element_at(arr, F.lit(1)), default)


def array_total(arr: Column, digits: int = 1) -> Column:
    """Sum of the non-null elements."""
    from panelwatch.functions.numeric import half_up

    kept = F.filter(F.coalesce(arr, F.array().cast("array<double>")), lambda x: x.isNotNull())
    return half_up(F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x), digits)


def latest_with_value(times: Column, values: Column) -> Column:
    """Latest of ``times`` whose partner in ``values`` is present."""
    pairs = F.arrays_zip(times.alias("t"), values.alias("v"))
    return F.array_max(F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: p["t"]))
