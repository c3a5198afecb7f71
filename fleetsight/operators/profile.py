"""Profiling, search and events."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.scalar import ratio_half_up
from fleetsight.functions.sketches import column_sketches, error_bound

# Deprecated column types looked for by find_types.
DEPRECATED_TYPES = ["text", "ntext", "image"]
# Bytes per value for fixed-width types (MB held by NULLs).
TYPE_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
              "date": 3, "timestamp": 8, "timestamp_ntz": 8}
# Shape of an event document: <event timestamp=..><action name=..><value/></action>...
# <data name=..><value/></data>...</event>
EVENT_XML_SCHEMA = ("action ARRAY<STRUCT<_name: STRING, value: STRING>>, "
                    "data ARRAY<STRUCT<_name: STRING, value: STRING>>, _name STRING, _timestamp STRING")
# The event whose data is a deadlock report.
DEADLOCK_EVENT = "xml_deadlock_report"
# Column names that may serve as a key when nothing is declared.
KEY_NAMES = ["id"]


# --------------------------------------------------------------------- G1
def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: NULL and NOT NULL rows, percent NULL (decimal(10,2)) and MB
    held by the NULLs (bytes per value x NULL rows; strings use their
    longest value). One aggregation pass for all columns (count(col) per
    column plus one count(*)), then a narrow unpivot of the one-row result."""
    cols = cols or [f.name for f in df.schema.fields if f.nullable]
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs.append(F.count(F.col(f"`{c}`")).alias("nn__" + c))
        if isinstance(fields[c], (T.StringType, T.BinaryType)):
            aggs.append(F.max(F.length(F.col(f"`{c}`"))).alias("len__" + c))
    one = df.agg(*aggs)
    rows = []
    for c in cols:
        width = F.col("len__" + c) if isinstance(fields[c], (T.StringType, T.BinaryType)) \
            else F.lit(TYPE_BYTES.get(fields[c].simpleString(), 8))
        nulls = F.col("__rows") - F.col("nn__" + c)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(fields[c].simpleString()).alias("data_type"),
                             nulls.alias("null_rows"), F.col("nn__" + c).alias("not_null_rows"),
                             F.coalesce(ratio_half_up(nulls * 100, F.col("__rows"), 2, "decimal(10,2)"),
                                        F.lit(0).cast("decimal(10,2)")).alias("null_percent"),
                             (nulls.cast("double") * F.coalesce(width, F.lit(0)).cast("double") / 1048576.0)
                             .alias("null_mb")))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


# --------------------------------------------------------------------- G2
def find_types(columns: DataFrame, types: list[str] | None = None, type_col: str = "data_type") -> DataFrame:
    """Columns whose type is in ``types`` (default: the deprecated ones)."""
    wanted = [t.lower() for t in (types or DEPRECATED_TYPES)]
    return columns.filter(F.lower(F.col(type_col)).isin(wanted))


def schema_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Estate-wide column list from DataFrame schemas (metadata, no data scan)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, i + 1)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                       "is_nullable boolean, column_id int")


# --------------------------------------------------------------------- G3
def search_text(sources: dict[str, tuple[DataFrame, str, str]], pattern: str, context: int = 40,
                kind_col: str | None = None) -> DataFrame:
    """Case-insensitive substring search over several text sources.

    ``sources``: {kind: (df, id_col, text_col)}. Every source is filtered
    with ``ilike`` (a per-row predicate, so the scan stays parallel) and the
    hits are unioned: kind (the source's name, or a column ``kind_col`` of it),
    id, the first match position and a context snippet around it."""
    pat = pattern.lower()
    like = "%" + pat.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    parts = []
    for kind, (df, idc, txt) in sources.items():
        t = F.col(txt)
        pos = F.instr(F.lower(t), pat)
        hit = df.filter(t.ilike(like)).select(
            (F.col(kind_col) if kind_col else F.lit(kind)).alias("kind"), F.col(idc).cast("string").alias("object_id"),
            pos.alias("match_position"),
            F.substring(t, F.greatest(pos - context, F.lit(1)), len(pattern) + 2 * context).alias("context"))
        parts.append(hit)
    return reduce(DataFrame.unionByName, parts)


def search_indexed(index, pattern: str, context: int = 40) -> DataFrame:
    """:func:`search_text` over a :class:`fleetsight.sources.trigrams.TrigramIndex`: the same hits, read from the
    buckets of the candidates only (for a pattern of fewer than three characters, from all texts)."""
    texts = index.read(pattern)
    if texts is None:
        return index.spark.createDataFrame([], "kind string, object_id string, match_position int, context string")
    return search_text({"": (texts, "object_id", "text")}, pattern, context, kind_col="kind")


# --------------------------------------------------------------------- G4
def key_candidates(tables: dict[str, tuple], identities: dict[str, str] | None = None,
                   sketches: dict[str, DataFrame] | None = None) -> DataFrame:
    """Choose a key per table: the declared key; else the identity column;
    else the first candidate column that is unique and holds no NULLs
    (candidates default to the columns named ``id``); else none, and a new
    key column is needed.

    ``tables``: {name: (df, candidate columns or None, declared key or None)}.
    A sketch per candidate (:func:`fleetsight.functions.sketches.column_sketches`,
    one pass over a table for all of its candidates; or the merged ones kept per snapshot, from
    ``sketches``: {name: sketches}) rules out columns with NULLs or clearly
    fewer values than rows. Only the columns that may be unique are counted
    exactly, value by value. The sketches' numbers (one row per candidate)
    come to the driver to choose them.
    """
    identities, sketches = identities or {}, sketches or {}
    cands = {name: (own or [c for c in df.columns if c.lower() in KEY_NAMES])
             for name, (df, own, declared) in tables.items() if not declared and name not in identities}
    seen = [(sketches[name] if name in sketches else column_sketches(tables[name][0], cols))
            .where(F.col("column_name").isin(cols))
            .select(F.lit(name).alias("table_name"), "column_name", "n_rows", "n_not_null",
                    F.hll_sketch_estimate("sketch").alias("n")) for name, cols in cands.items() if cols]
    possible = {}
    if seen:
        for r in reduce(DataFrame.unionByName, seen).collect():
            full = r["n_not_null"] == r["n_rows"]
            possible[r["table_name"], r["column_name"]] = full and r["n"] >= (1 - error_bound()) * r["n_rows"]
    parts = []
    for name, (df, _, declared) in tables.items():
        fixed = ((declared, "declared key") if declared else
                 (identities[name], "identity column") if name in identities else None)
        one = df.sparkSession.range(1)
        choice, reason = F.lit(None).cast("string"), F.lit("no key: a new key column is needed")
        if fixed:
            choice, reason = F.lit(fixed[0]), F.lit(fixed[1])
        for c in reversed(cands.get(name, [])):
            if possible.get((name, c)):
                most = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
                ok = F.coalesce(most.scalar(), F.lit(1)) == 1
                choice = F.when(ok, F.lit(c)).otherwise(choice)
                reason = F.when(ok, F.lit("unique and not null")).otherwise(reason)
        parts.append(one.select(F.lit(name).alias("table_name"), choice.alias("key_column"), reason.alias("reason")))
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------- G5
def module_inventory(modules: DataFrame, *, name: str = "name", text: str = "definition",
                     kinds: list[str] | None = None, name_like: str | None = None,
                     kind_col: str = "type_desc") -> DataFrame:
    """Modules with their text length, optionally filtered by kind and name."""
    out = modules.withColumn("definition_length", F.length(F.col(text)))
    if kinds:
        out = out.filter(F.col(kind_col).isin(kinds))
    if name_like:
        out = out.filter(F.col(name).ilike(name_like))
    return out


# --------------------------------------------------------------------- G6
def _deadlock(payload: Column) -> Column:
    """The deadlock report of an event, whole and as it stands in the document."""
    found = F.regexp_extract(payload, "(?s)(<deadlock[\\s>/].*</deadlock>)", 1)
    return F.when(found != "", found)


def _xml_value(payload: Column, event_name: Column, value: Column, xml_events: list[str]) -> Column:
    """The value of a data field: of one that holds a deadlock report the report itself, of other events with XML
    content the whole event, else the text."""
    out = F.when((event_name == DEADLOCK_EVENT) & value.contains("<deadlock"), F.coalesce(_deadlock(payload), value))
    return (out.when(event_name.isin(list(xml_events)), payload) if xml_events else out).otherwise(value)


def event_attributes(events: DataFrame, payload: str, fields: list[str], actions: list[str] | None = None,
                     fmt: str = "json", id_col: str = "event_id", xml_events: list[str] = ()) -> DataFrame:
    """One row per event with a column per data field (and per action).

    JSON payloads are parsed to the wanted fields: of a flat object, or, when
    ``actions`` are named, of ``{"name", "timestamp", "data": {..}, "actions":
    {..}}``. XML payloads (``<event name=.. timestamp=..><action
    name=..><value/></action><data name=..><value/></data></event>``) are
    parsed to name and value pairs, of which each wanted name takes its
    greatest value; a field that holds a deadlock report is its XML, and a
    field of one of ``xml_events`` the whole event. With actions (JSON) and
    always in XML the event's own name and time are added.
    This equals pivoting fields and actions separately and full-outer
    joining them on the event, without any shuffle."""
    p = F.col(payload)
    if fmt == "json":
        def texts(names):
            return T.StructType([T.StructField(f, T.StringType()) for f in names])

        if actions is None:
            out = events.withColumn("__m", F.from_json(p, texts(fields)))
            return out.withColumns({f: F.col("__m").getField(f) for f in fields}).drop("__m")
        shape = texts(["name", "timestamp"]).add("data", texts(fields)).add("actions", texts(actions))
        out = events.withColumn("__m", F.from_json(p, shape))
        return out.withColumns({
            "event_name": F.col("__m.name"), "event_time": F.col("__m.timestamp"),
            **{f: F.col("__m.data").getField(f) for f in fields},
            **{"action_" + a: F.col("__m.actions").getField(a) for a in actions}}).drop("__m")

    def greatest(part: str, name: str) -> Column:
        """The greatest value of a name (it may repeat in an event)."""
        pairs = F.coalesce(F.col("__e")[part], F.array())
        return F.array_max(F.transform(F.filter(pairs, lambda e: e["_name"] == name), lambda e: e["value"]))

    def field(name: str) -> Column:
        held = F.exists(F.coalesce(F.col("__e.data"), F.array()), lambda e: e["_name"] == name)
        value = _xml_value(p, F.col("__e._name"), greatest("data", name), xml_events)
        return F.when(held, value)

    # one XML parse per event (from_xml) instead of one xpath walk per field
    out = events.withColumn("__e", F.from_xml(p, EVENT_XML_SCHEMA))
    out = out.withColumns({"event_name": F.col("__e._name"), "event_time": F.col("__e._timestamp"),
                           **{f: field(f) for f in fields},
                           **{"action_" + a: greatest("action", a) for a in actions or []}})
    return out.drop("__e")


def event_values(events: DataFrame, payload: str, id_cols: list[str], fmt: str = "json",
                 xml_events: list[str] = ()) -> DataFrame:
    """Every attribute of every event as a row, whatever its shape:
    (id columns, event_name, event_time, part, attribute, value).

    JSON payloads are parsed once to VARIANT and exploded; members of ``data``
    and ``actions`` are the attributes, of an object without ``data`` all its
    members. Values are texts, nested ones JSON. XML payloads give their data
    and action elements, deadlock reports whole. An event whose payload
    cannot be parsed, or that has no attributes, gives no row.
    """
    ids = [F.col(f"`{c}`") for c in id_cols]
    p = F.col(payload)
    if fmt == "json":
        v = events.select(*ids, F.try_parse_json(p).alias("__v"))
        name, time = (F.try_variant_get("__v", f"$.{k}", "string") for k in ("name", "timestamp"))
        data, acts = (F.try_variant_get("__v", f"$.{k}", "variant") for k in ("data", "actions"))
        nested = F.schema_of_variant(data).startswith("OBJECT")
        v = v.select(*ids, F.when(nested, name).alias("event_name"), F.when(nested, time).alias("event_time"),
                     F.explode(F.array(F.struct(F.lit("data").alias("part"), F.when(nested, data).otherwise(
                         F.col("__v")).alias("o")), F.struct(F.lit("action").alias("part"), F.when(
                             nested, acts).alias("o")))).alias("__p"))
        v = v.select(*[c for c in v.columns if c != "__p"], F.col("__p.part").alias("part"), F.col("__p.o").alias("__o"))
        spark = events.sparkSession
        rows = v.lateralJoin(spark.tvf.variant_explode(F.col("__o").outer()))
        return rows.where(F.col("key").isNotNull()).select(
            *ids, "event_name", "event_time", "part", F.col("key").alias("attribute"),
            F.try_variant_get("value", "$", "string").alias("value"))
    def pairs(part: str) -> Column:
        return F.transform(F.coalesce(F.col("__e")[part], F.array()), lambda x: F.struct(
            F.lit(part).alias("part"), x["_name"].alias("attribute"), x["value"].alias("value")))

    e = events.select(*ids, p.alias("__p"), F.from_xml(p, EVENT_XML_SCHEMA).alias("__e"))
    e = e.select(*ids, F.col("__e._name").alias("event_name"), F.col("__e._timestamp").alias("event_time"), "__p",
                 F.explode(F.concat(pairs("data"), pairs("action"))).alias("a"))
    value = F.when(F.col("a.part") == "data", _xml_value(F.col("__p"), F.col("event_name"), F.col("a.value"), xml_events)) \
        .otherwise(F.col("a.value"))
    return e.select(*ids, "event_name", "event_time", "a.part", "a.attribute", value.alias("value"))


def found_attributes(values: DataFrame, most: int = 1000) -> dict[str, list[str]]:
    """The attribute names of :func:`event_values` by part. A data set with more than ``most`` names is refused
    (its attributes are not columns): use the rows."""
    names = sorted(map(tuple, values.select("part", "attribute").distinct().limit(most + 1).collect()))
    if len(names) > most:
        raise ValueError(f"more than {most} attribute names")
    return {part: [n for p, n in names if p == part] for part in ("data", "action")}


def found_event_attributes(events: DataFrame, payload: str, id_col: str = "event_id", fmt: str = "json",
                           most: int = 1000) -> DataFrame:
    """:func:`event_attributes` with the names taken from the data: one column per attribute that occurs
    (``action_`` before those of actions)."""
    names = found_attributes(event_values(events, payload, [id_col], fmt), most)
    return event_attributes(events, payload, names["data"], names["action"], fmt, id_col)


# --------------------------------------------------------------------- G7
def explode_delimited(df: DataFrame, col: str, sep: str, out: str = "item", keep: list[str] = ()) -> DataFrame:
    """Trimmed, non-empty parts of a delimited text, one per row (the
    separator is taken literally)."""
    parts = F.split(F.col(col), re.escape(sep))
    return df.select(*keep, F.posexplode(parts).alias("position", "__p")) \
             .select(*keep, (F.col("position") + 1).alias("position"), F.trim(F.col("__p")).alias(out)) \
             .filter(F.col(out) != "")


# --------------------------------------------------------------------- G8
def preview(tables: dict[str, DataFrame], name_like: str, n: int = 1000) -> DataFrame:
    """First ``n`` rows (no order) of every table whose name is LIKE
    ``name_like`` (without regard to case), as (table_name, row_json)."""
    like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in name_like),
                      re.IGNORECASE | re.DOTALL)
    parts = [df.limit(n).select(F.lit(name).alias("table_name"), F.to_json(F.struct("*")).alias("row_json"))
             for name, df in tables.items() if like.fullmatch(name)]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------- G9
def desired_vs_actual(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows to change or add: desired EXCEPT ALL actual."""
    return desired.exceptAll(actual.select(*desired.columns))


def missing_members(published: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Members missing from a published list (NOT IN on a non-null key)."""
    return members.join(published.select(*key).filter(F.col(key[0]).isNotNull()), key, "left_anti")


