"""Numbers, units, currencies and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound


def economic_value(value: Column, multiplier: Column) -> Column:
    """Value times its unit; no multiplier, or zero, counts as one."""
    return value * F.coalesce(F.nullif(multiplier, F.lit(0.0)), F.lit(1.0))


#: What a double is cast from; the cast of any other text costs an exception.
_DOUBLE = r"^\s*-?(\d+\.?\d*|\.\d+)\s*$"


def parse_number(raw: Column) -> Column:
    """Brackets mean negative; letters and signs of money are dropped; a lone comma groups thousands where three digits
    follow every comma, else it is the decimal mark; what is left and no number is null."""
    def number(n):
        thousands = n.contains(".") | n.rlike(r"^[^,]*(,[^,]{3})+$")
        plain = F.when(~n.contains(","), n).when(thousands, F.replace(n, F.lit(","), F.lit(""))).otherwise(F.replace(n, F.lit(","), F.lit(".")))
        return bound(F.replace(plain, F.lit(" "), F.lit("")), lambda x: F.when(x.rlike(_DOUBLE), x.try_cast("double")))

    def signed(s):
        n = F.trim(F.regexp_replace(F.btrim(s, F.lit("()")), r"[^0-9,.\-\s]", ""))
        return F.when(s.rlike("[0-9]"), bound(n, number)) * F.when(s.startswith("(") & s.endswith(")"), -1.0).otherwise(1.0)

    plain = F.when(raw.rlike(r"^[0-9 ]*[0-9][0-9 ]*$"), F.replace(raw, F.lit(" "), F.lit("")).try_cast("double"))  # most cells of a report
    return plain.when(raw.rlike("[0-9]"), bound(F.trim(F.translate(raw, "\u2013\u2014\u2212\u00a0", "--- ")), signed))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text.contains(w), F.lit(False))
    return out


def unit_multiplier(text: Column, explicit: Column | None = None) -> Column:
    """An explicit factor first, else by the unit's word, else 1."""
    t = F.lower(text)
    by_word = F.when(contains_any(t, ("billion", "миллиард")), 1e9).when(contains_any(t, ("million", "млн")), 1e6).when(contains_any(t, ("thousand", "тыс")), 1e3).otherwise(1.0)
    return by_word if explicit is None else F.coalesce(F.nullif(explicit, F.lit(0.0)), by_word)


def detect_currency(text: Column) -> Column:
    t = F.lower(text)
    return F.when(contains_any(t, ("rub", "rouble", "руб")), "RUB").when(contains_any(t, ("usd",)), "USD")


def display_value(value: Column, output_format: Column) -> Column:
    """percent 12.3%, currency 1,234 RUB, ratio 1.23x; halves are rounded away from zero, and zero has no sign."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(output_format == "percent", F.format_string("%.1f%%", F.round(value * 100, 1)))
        .when(output_format == "currency", F.concat(F.format_number(F.round(value, 0), 0), F.lit(" RUB")))
        .otherwise(F.format_string("%.2fx", F.round(value, 2)))
    )
