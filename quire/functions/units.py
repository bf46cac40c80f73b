"""Measures of the file format as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import once, trim_ws

TWIPS_PER_CM = 1440 / 2.54


def js_round(x: Column, n: int) -> Column:
    """Halves go up, on binary doubles; F.round works on the decimal text and differs (1.005, -2.5)."""
    f = float(10**n)
    return F.floor(x * f + 0.5) / f


def measure_to_twips(s: Column) -> Column:
    """`12pt`, `2.5cm`, `240` … in twips; other text is null."""
    form = r"^(-?[\d.]+)(pt|cm|mm|in|pc)?\z"

    def twips(t: Column) -> Column:
        n, unit = F.regexp_extract(t, form, 1).try_cast("double"), F.regexp_extract(t, form, 2)
        return (
            F.when(~t.rlike(form), None)
            .when(unit == "pt", n * 20)
            .when(unit == "pc", n * 240)
            .when(unit == "in", n * 1440)
            .when(unit == "cm", F.floor(n * 1440 / 2.54 + 0.5))
            .when(unit == "mm", F.floor(n * 1440 / 25.4 + 0.5))
            .otherwise(n)
            .cast("double")
        ) + 0.0  # no negative zero

    # Files hold dozens of measures in a row: generated code for them all would take each task seconds.
    return F.when(s.isNotNull(), once(trim_ws(s), twips))


def twips_to_pt(x: Column) -> Column:
    return x / 20


def twips_to_cm(x: Column) -> Column:
    return x / TWIPS_PER_CM


def half_points_to_pt(x: Column) -> Column:
    return x / 2


def hundredths_to_chars(x: Column) -> Column:
    return x / 100


def twips_to_chars(x: Column, size_pt: Column) -> Column:
    return F.when(size_pt > 0, x / 20 / size_pt).otherwise(0.0)


def line_spacing(line: Column, rule: Column) -> Column:
    """struct(value, rule, pt, multiple): fixed heights in points, automatic ones as multiples of a line."""
    r = F.coalesce(rule, F.lit("auto"))
    fixed = r.isin("exact", "atLeast")
    value = F.when(fixed, measure_to_twips(line)).otherwise(line.try_cast("double"))
    return once(
        value,
        lambda v: F.when(
            v.isNotNull(),
            F.struct(v.alias("value"), r.alias("rule"), F.when(fixed, v / 20).alias("pt"), F.when(~fixed, v / 240).alias("multiple")),
        ),
    )


def on_off(v: Column) -> Column:
    """A switch attribute: present without value is on."""
    return ~F.lower(v).isin("0", "false", "off")
