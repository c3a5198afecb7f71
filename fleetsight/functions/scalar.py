"""Scalar expressions used inside the jobs.

Each helper takes a column (name or Column) and returns a Column; all of
them compile to JVM expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

__all__ = [
    "col_of", "int_div", "fold_case", "fmt_seconds", "fmt_hhmmss", "now_text", "to_utc_minute",
    "unquote_name", "file_name", "file_dir", "file_ext", "file_drive", "decode_version",
    "numeric_version", "hex_text", "space_mb", "yes_no", "split_instance_machine",
    "split_instance_name", "text_date_time", "code_text", "ratio_half_up",
]

# Product names by major version prefix, tested in this order
# ("10.5" must be tried before "10.").
VERSION_NAMES = [
    ("14.", "SQL Server 2017"),
    ("13.", "SQL Server 2016"),
    ("12.", "SQL Server 2014"),
    ("11.", "SQL Server 2012"),
    ("10.5", "SQL Server 2008 R2"),
    ("10.", "SQL Server 2008"),
    ("9.", "SQL Server 2005"),
    ("8.", "SQL Server 2000"),
]
VERSION_FALLBACK = "SQL 7 or earlier"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integer division truncating toward zero (T-SQL ``/`` on integers)."""
    return (col_of(a) / col_of(b) if not isinstance(b, int) else col_of(a) / F.lit(b)).cast("bigint")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def fmt_seconds(c) -> Column:
    """Seconds -> "[d.]hh:mm:ss"; the day part only when it is not 0; NULL -> NULL."""
    s = col_of(c).cast("bigint")
    days = int_div(s, 86400)
    day_part = F.when(days != 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit(""))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(day_part, _two(int_div(s, 3600) % 24), F.lit(":"),
                 _two(int_div(s, 60) % 60), F.lit(":"), _two(s % 60)))


def fmt_hhmmss(c) -> Column:
    """Integer written as [h...h]mmss (job durations) -> "[d.]hh:mm:ss"; NULL -> "-"."""
    v = col_of(c).cast("bigint")
    hours = int_div(v, 10000)
    days = int_div(hours, 24)
    day_part = F.when(days != 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit(""))
    text = F.concat(day_part, _two(hours % 24), F.lit(":"), _two(int_div(v, 100) % 100),
                    F.lit(":"), _two(v % 100))
    return F.coalesce(text, F.lit("-"))


def fold_case(c, dtype) -> Column:
    """Text for comparing without case (the reference's collation ignores it);
    other types as they are."""
    return F.lower(col_of(c)) if isinstance(dtype, StringType) else col_of(c)


def now_text(ts) -> Column:
    """Time as yyyyMMddHHmmss (the time is an argument, for repeatable runs)."""
    return F.date_format(col_of(ts), "yyyyMMddHHmmss")


def to_utc_minute(c, tz: str = "UTC") -> Column:
    """Local time in zone ``tz`` -> UTC, rounded to the nearest minute."""
    utc = F.to_utc_timestamp(col_of(c), tz)
    return F.date_trunc("minute", utc + F.expr("INTERVAL 30 SECONDS"))


def unquote_name(c) -> Column:
    """Remove every '[' and ']'."""
    return F.translate(col_of(c), "[]", "")


def file_name(c) -> Column:
    """Text after the last backslash; the whole text when there is none."""
    return F.substring_index(col_of(c), "\\", -1)


def file_dir(c) -> Column:
    """Text up to and including the last backslash; a single backslash when none."""
    p = col_of(c)
    tail = F.substring_index(p, "\\", -1)
    return F.when(F.instr(p, "\\") > 0,
                  F.substring(p, F.lit(1), F.length(p) - F.length(tail))).otherwise(F.lit("\\"))


def file_ext(c) -> Column:
    """Extension with its dot; "" when the name has no dot."""
    p = col_of(c)
    return F.when(F.instr(p, ".") > 0,
                  F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def file_drive(c) -> Column:
    """Up to the first ':' if any, else up to the first backslash, else a backslash."""
    p = col_of(c)
    colon = F.instr(p, ":")
    slash = F.instr(p, "\\")
    return (F.when(colon > 0, F.substring(p, F.lit(1), colon))
             .when(slash > 0, F.substring(p, F.lit(1), slash))
             .otherwise(F.lit("\\")))


def decode_version(c) -> Column:
    """Product version text -> product name."""
    v = col_of(c)
    expr = F.when(v.isNull(), F.lit(None).cast("string"))
    for prefix, name in VERSION_NAMES:
        expr = expr.when(v.startswith(prefix), F.lit(name))
    return expr.otherwise(F.lit(VERSION_FALLBACK))


def numeric_version(c) -> Column:
    """Text up to one digit after the first dot, as decimal(3,1)."""
    v = col_of(c)
    dot = F.instr(v, ".")
    head = F.when(dot > 0, F.substring(v, F.lit(1), dot + 1)).otherwise(F.substring(v, 1, 1))
    return head.try_cast("decimal(3,1)")


def hex_text(c) -> Column:
    """Binary -> '0x' + upper-case hex."""
    return F.concat(F.lit("0x"), F.upper(F.hex(col_of(c))))


def space_mb(rows, nbytes) -> Column:
    """rows * bytes in MB, decimal(10,2) (BIGINT product: no INT overflow)."""
    prod = col_of(rows).cast("bigint") * col_of(nbytes).cast("bigint")
    return ratio_half_up(prod, F.lit(1048576), 2, "decimal(10,2)")


def ratio_half_up(num, den, scale: int, dtype: str) -> Column:
    """``num / den`` rounded half up (away from zero) to ``scale`` decimals,
    exactly: an integral division (``div``) of integers or decimals, with no
    intermediate rounding that could round twice. NULL when ``den`` is 0."""
    n, d = col_of(num), col_of(den)
    f = 10 ** scale
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    # decimal factors widen int/bigint operands, so the products cannot overflow
    two_f, two = F.lit(2 * f).cast("decimal(20,0)"), F.lit(2).cast("decimal(20,0)")
    q = F.call_function("div", F.abs(n) * two_f + F.abs(d), F.nullif(F.abs(d), F.lit(0)) * two)
    return ((sign * q).cast("decimal(38,0)") / F.lit(f)).cast(dtype)


def code_text(c, mapping: dict, default=None) -> Column:
    """Code -> text through a fixed mapping (a CASE ladder); ``default`` for
    other codes (NULL when not given)."""
    v = col_of(c)
    items = list(mapping.items())
    expr = F.when(v == items[0][0], F.lit(items[0][1]))
    for k, text in items[1:]:
        expr = expr.when(v == k, F.lit(text))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def yes_no(c, yes: str = "Yes", no: str = "No") -> Column:
    v = col_of(c)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(v.cast("boolean"), F.lit(yes)).otherwise(F.lit(no))


def split_instance_machine(c) -> Column:
    """"HOST\\INST" -> "HOST"; a name without backslash is its own machine."""
    return F.substring_index(col_of(c), "\\", 1)


def split_instance_name(c) -> Column:
    """"HOST\\INST" -> "INST"; "default" when there is no backslash."""
    v = col_of(c)
    return F.when(F.instr(v, "\\") > 0, F.substring_index(v, "\\", -1)).otherwise(F.lit("default"))


def text_date_time(date_int, time_int) -> Column:
    """yyyymmdd and hhmmss integers -> TIMESTAMP_NTZ (0 or invalid dates -> NULL).
    Built from its parts, so no session time zone is involved."""
    d, t = col_of(date_int).cast("bigint"), col_of(time_int).cast("bigint")
    return F.when(d > 0, F.try_make_timestamp_ntz(
        int_div(d, 10000), int_div(d, 100) % 100, d % 100,
        int_div(t, 10000), int_div(t, 100) % 100, (t % 100).cast("decimal(8,6)")))
