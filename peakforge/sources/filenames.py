"""What names of sample files say: the instrument, its class and the time of acquisition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed forms of the time in a name, in the order in which they are tried: pattern with groups, format of the groups joined by a space, the same for DuckDB
TIMES = [
    (r"([0-9]{4}\.[0-9]{2}\.[0-9]{2}).*?([0-9]{2}h[0-9]{2}m[0-9]{2}s)", "yyyy.MM.dd HH'h'mm'm'ss's'", "%Y.%m.%d %Hh%Mm%Ss"),
    (r"([0-9]{8})_([0-9]{4})_", "yyyyMMdd HHmm", "%Y%m%d %H%M"),
    (r"([0-9]{8})([0-9]{6})", "yyyyMMdd HHmmss", "%Y%m%d %H%M%S"),
    (r"([0-9]{8}).*?([0-9]{6})", "yyyyMMdd HHmmss", "%Y%m%d %H%M%S"),
    (r"([0-9]{8}).*?([0-9]{4})", "yyyyMMdd HHmm", "%Y%m%d %H%M"),
    (r"([0-9]{8})", "yyyyMMdd", "%Y%m%d"),
]


def instrument(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def instrument_class(instrument_: Column) -> Column:
    """orbi or tof by the instrument's name, null for any other."""
    low = F.lower(instrument_)
    return F.when(low.contains("orbi"), "orbi").when(low.contains("tof") | low.contains("api"), "tof")


def acquired(name: Column) -> Column:
    """The time in a name by the first form that gives a time there is; null if none does."""
    found = []
    for pattern, form, _ in TIMES:
        groups = [F.regexp_extract(name, pattern, k + 1) for k in range(pattern.count("("))]
        found.append(F.try_to_timestamp(F.concat_ws(" ", *groups), F.lit(form)))
    return F.coalesce(*found)


def acquired_sql(name: str) -> str:
    """DuckDB SQL of ``acquired``."""
    part = lambda p, k: f"regexp_extract({name}, '{p}', {k + 1})"
    return "coalesce(" + ", ".join(f"try_strptime({' || chr(32) || '.join(part(p, k) for k in range(p.count('(')))}, '{f}')" for p, _, f in TIMES) + ")"
