"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerance of Pt100 sensors, offset + factor * |T|, by class name.
PT100_TOLERANCE = {
    "Pt100 class 1/3": (0.10, 0.0017),
    "Pt100 class A": (0.15, 0.002),
    "Pt100 class B": (0.30, 0.005),
}


def seconds_of_day(time: Column) -> Column:
    """``HH:MM:SS`` text to seconds; unparsable text becomes NULL."""
    ts = F.try_to_timestamp(time, F.lit("HH:mm:ss"))
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_of_clock(time: Column) -> Column:
    """``HH:MM:SS`` text of a clock that counts its hours on beyond 23, to seconds; unparsable text becomes NULL."""
    parts = F.split(time, ":")
    h, m, s = (F.get(parts, F.lit(i)).try_cast("long") for i in range(3))
    right = (F.size(parts) == 3) & (h >= 0) & m.between(0, 59) & s.between(0, 59)
    return F.when(right, h * 3600 + m * 60 + s)


def normalize_time(time: Column) -> Column:
    """Accept ``HH:MM:SS`` or ``YYYY-MM-DD HH:MM:SS``; return ``HH:MM:SS``, blank and bad text as NULL."""
    text = F.trim(time)
    ts = F.coalesce(
        F.try_to_timestamp(text, F.lit("HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return F.date_format(ts, "HH:mm:ss")


def round_to_second(ts: Column) -> Column:
    """Nearest full second; an exact half goes to the even second."""
    micros = F.unix_micros(ts)
    floor = F.floor(micros / F.lit(1_000_000)).cast("long")
    rest = micros - floor * 1_000_000
    up = (rest > 500_000) | ((rest == 500_000) & (F.pmod(floor, F.lit(2)) == 1))
    return F.timestamp_seconds(floor + F.when(up, 1).otherwise(0))


def seconds_to_time(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"),
                           F.pmod(s, F.lit(60)))


def binary_target(label: Column) -> Column:
    """Label 0 is normal, 2 and 3 are observable anomalies, everything else is left out (NULL)."""
    return F.when(label == 0, F.lit(0)).when(label.isin(2, 3), F.lit(1))


def repair_scale(value: Column, threshold: float, divisor: float = 1000.0, use_abs: bool = False) -> Column:
    """Divide values stored ``divisor`` times too large; NULL stays NULL."""
    test = F.abs(value) if use_abs else value
    return F.when(test > threshold, value / divisor).otherwise(value)


def uncertainty(kind: Column, percent: Column, value: Column) -> Column:
    """Absolute measurement uncertainty: sensor-class formula first, else percent of the reading.

    ``-`` and text that is no number give 0; a missing spec row (``kind`` NULL) stays NULL.
    """
    out = None
    for name, (offset, factor) in PT100_TOLERANCE.items():
        formula = F.lit(offset) + F.lit(factor) * F.abs(value)
        out = F.when(kind == name, formula) if out is None else out.when(kind == name, formula)
    share = percent.try_cast("double") * 0.01
    return (
        out.when(kind.isNull(), F.lit(None).cast("double"))
        .when(share.isNull(), F.lit(0.0))
        .otherwise(share * F.abs(value))
    )


def recode(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Dictionary lookup with a default (the value itself unless given)."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value if default is None else default)


def split_identifier(df: DataFrame, column: str = "identifier") -> DataFrame:
    """``phase/batch/operating_point/experiment_type/experiment`` to five columns."""
    parts = F.split(F.col(column), "/")
    names = ["phase", "batch", "operating_point", "experiment_type", "experiment"]
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def pair_differences(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    return {f"{a}_{b}_diff": F.col(a) - F.col(b) for a, b in pairs}


def ordered_select(df: DataFrame, first: Sequence[str], keep_rest: bool = True) -> DataFrame:
    """Fixed column order, tolerating absent columns."""
    head = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in set(head)] if keep_rest else []
    return df.select(*head, *rest)


def features_except(df: DataFrame, metadata: Sequence[str]) -> list[str]:
    """Feature list by exclusion of metadata columns."""
    skip = set(metadata)
    return [c for c in df.columns if c not in skip]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
