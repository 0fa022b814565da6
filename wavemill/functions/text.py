"""Column functions for names, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Duration units as the reports print them.
SECONDS, MINUTES, HOURS = "秒", "分钟", "小时"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def one_decimal(x: Column) -> Column:
    """Rounded by the exact binary value, half to even; format_string would round the shortest decimal up."""
    return F.regexp_replace(F.format_number(x.cast("double"), 1), ",", "")


def format_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(one_decimal(seconds), F.lit(SECONDS))).when(seconds < 3600, F.concat(one_decimal(seconds / 60), F.lit(MINUTES))).otherwise(F.concat(one_decimal(seconds / 3600), F.lit(HOURS)))


def safe_filename(name: Column) -> Column:
    """Characters that file systems forbid become _, outer space goes, runs of space become _ and of dots one dot."""
    out = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "_"), r"\.+", ".")
    return F.regexp_replace(out, r"^\.+|\.+$", "")


def format_file_size(size: Column) -> Column:
    out = F.when(size == 0, F.lit("0B"))
    for k, unit in enumerate(SIZE_UNITS):
        text = F.concat(one_decimal(size / float(1024**k)), F.lit(unit))
        out = out.otherwise(text) if k == len(SIZE_UNITS) - 1 else out.when(size < float(1024 ** (k + 1)), text)
    return out


def file_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
