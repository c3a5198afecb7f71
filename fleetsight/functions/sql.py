"""The scalar functions and the day list as SQL functions, for users of ``spark.sql``.

:func:`register_functions` creates them as temporary functions of a session.
Their bodies are SQL expressions, so Catalyst inlines each call and nothing
runs outside the JVM; results equal those of :mod:`fleetsight.functions.scalar`
and :func:`fleetsight.operators.reference.bitmask_names`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetsight.functions.scalar import VERSION_FALLBACK, VERSION_NAMES
from fleetsight.operators.reference import WEEKDAY_BITS

_CLOCK = "lpad(CAST({h} AS STRING), 2, '0') || ':' || lpad(CAST({m} AS STRING), 2, '0') || ':' || " \
         "lpad(CAST({s} AS STRING), 2, '0')"
_DAYS = "CASE WHEN {d} <> 0 THEN CAST({d} AS STRING) || '.' ELSE '' END || "
_LIST = "coalesce(nullif(concat_ws(', ', {items}), ''), 'None')".format(items=", ".join(
    f"CASE WHEN (mask & {bit}) = {bit} THEN '{name}' END" for bit, name, _ in WEEKDAY_BITS))

# name -> (parameters, result, body)
FUNCTIONS = {
    "fmt_seconds": ("seconds BIGINT", "STRING", _DAYS.format(d="seconds div 86400") + _CLOCK.format(
        h="seconds div 3600 % 24", m="seconds div 60 % 60", s="seconds % 60")),
    "fmt_hhmmss": ("duration BIGINT", "STRING", "coalesce(" + _DAYS.format(d="duration div 10000 div 24") + _CLOCK.format(
        h="duration div 10000 % 24", m="duration div 100 % 100", s="duration % 100") + ", '-')"),
    "unquote_name": ("name STRING", "STRING", "translate(name, '[]', '')"),
    "file_name": ("path STRING", "STRING", r"substring_index(path, '\\', -1)"),
    "file_dir": ("path STRING", "STRING", r"CASE WHEN instr(path, '\\') > 0 THEN "
                 r"substring(path, 1, length(path) - length(substring_index(path, '\\', -1))) ELSE '\\' END"),
    "file_ext": ("path STRING", "STRING",
                 "CASE WHEN instr(path, '.') > 0 THEN '.' || substring_index(path, '.', -1) ELSE '' END"),
    "file_drive": ("path STRING", "STRING", r"CASE WHEN instr(path, ':') > 0 THEN substring(path, 1, instr(path, ':')) "
                   r"WHEN instr(path, '\\') > 0 THEN substring(path, 1, instr(path, '\\')) ELSE '\\' END"),
    "decode_version": ("version STRING", "STRING", "CASE WHEN version IS NULL THEN NULL " + " ".join(
        f"WHEN startswith(version, '{prefix}') THEN '{name}'" for prefix, name in VERSION_NAMES)
        + f" ELSE '{VERSION_FALLBACK}' END"),
    "numeric_version": ("version STRING", "DECIMAL(3,1)", "try_cast(CASE WHEN instr(version, '.') > 0 "
                        "THEN substring(version, 1, instr(version, '.') + 1) ELSE substring(version, 1, 1) END "
                        "AS DECIMAL(3,1))"),
    "day_names": ("mask BIGINT", "STRING", _LIST),
    "day_names_list": ("mask BIGINT", "TABLE (day_list STRING)", f"SELECT {_LIST}"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
