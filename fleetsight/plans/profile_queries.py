"""Registered queries for profiling, search and events (G)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetsight.operators import profile as G
from fleetsight.plans.registry import ORACLE, query
from fleetsight.plans.snapshot_queries import FEED_SQL, feed
from fleetsight.session import checkpoint_dir
from fleetsight.sources.trigrams import TrigramIndex


@query("g1_null_profile", """
WITH d AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT COUNT(*) AS n, COUNT(doc_id) AS a1, COUNT(lang) AS a2, COUNT(source) AS a3, COUNT(quality) AS a4, COUNT(toxic) AS a5,
             MAX(length(lang)) AS l2, MAX(length(source)) AS l3 FROM d)
SELECT column_name, data_type, n - nn AS null_rows, nn AS not_null_rows,
  CAST(COALESCE(CAST(CAST(n - nn AS DECIMAL(20,0)) * 100 / NULLIF(n, 0) AS DECIMAL(10,2)), 0) AS DECIMAL(10,2)) AS null_percent,
  CAST(n - nn AS DOUBLE) * CAST(COALESCE(w, 0) AS DOUBLE) / 1048576.0 AS null_mb
FROM a, LATERAL (VALUES ('doc_id', 'bigint', a1, 8), ('lang', 'string', a2, l2), ('source', 'string', a3, l3),
                        ('quality', 'int', a4, 4), ('toxic', 'int', a5, 4)) v(column_name, data_type, nn, w)
""")
def g1_null_profile(t):
    """G1: NULL profile of documents left-joined to their labels."""
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return G.null_profile(d)


@query("g3_search_text", """
SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS object_id, CAST(strpos(lower(text), 'license') AS INTEGER) AS match_position,
  substr(text, greatest(strpos(lower(text), 'license') - 40, 1), 87) AS context
FROM documents WHERE text ILIKE '%license%'
UNION ALL
SELECT 'page', CAST(page_id AS VARCHAR), CAST(strpos(lower(html), 'license') AS INTEGER),
  substr(html, greatest(strpos(lower(html), 'license') - 40, 1), 87)
FROM pages WHERE html ILIKE '%license%'
UNION ALL
SELECT 'benchmark', CAST(item_id AS VARCHAR), CAST(strpos(lower(text), 'license') AS INTEGER),
  substr(text, greatest(strpos(lower(text), 'license') - 40, 1), 87)
FROM benchmark WHERE text ILIKE '%license%'
""")
def g3_search_text(t):
    """Case-insensitive search for 'license' over document, page and benchmark texts."""
    return G.search_text({"document": (t.documents, "doc_id", "text"), "page": (t.pages, "page_id", "html"),
                          "benchmark": (t.benchmark, "item_id", "text")}, "license")


_KEY_TABLES = [("region", "r_regionkey", True), ("nation", "n_nationkey", False), ("customer", "c_custkey", False),
               ("supplier", "s_suppkey", False), ("part", "p_partkey", False), ("orders", "o_orderkey", False),
               ("lineitem", "l_orderkey", False), ("events", "event_id", False), ("documents", "doc_id", False),
               ("pages", "page_id", False), ("labels", "doc_id", False), ("conversations", "conv_id", False)]


def _key_sql():
    parts = []
    for name, col, declared in _KEY_TABLES:
        if declared:
            parts.append(f"SELECT '{name}' AS table_name, '{col}' AS key_column, 'declared key' AS reason")
        else:
            ok = f"COUNT(DISTINCT {col}) = COUNT(*) AND COUNT({col}) = COUNT(*)"
            parts.append(f"SELECT '{name}', CASE WHEN {ok} THEN '{col}' END, "
                         f"CASE WHEN {ok} THEN 'unique and not null' ELSE 'no key: a new key column is needed' END FROM {name}")
    return "\nUNION ALL\n".join(parts)


@query("g4_key_candidates", _key_sql())
def g4_key_candidates(t):
    """Key choice for every driver table (first column as candidate; region's declared)."""
    return G.key_candidates({name: (getattr(t, name), [col], col if declared else None)
                             for name, col, declared in _KEY_TABLES})


@query("g5_module_inventory", """
SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) AS name, source AS schema_name, lang AS type_desc, text AS definition,
  CAST(length(text) AS INTEGER) AS definition_length
FROM documents WHERE lang IN ('en', 'de') AND ('doc_' || CAST(doc_id AS VARCHAR)) ILIKE '%7%'
""")
def g5_module_inventory(t):
    """Documents as modules: English and German ones whose name holds a 7, with text length."""
    m = t.documents.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
                           F.col("source").alias("schema_name"), F.col("lang").alias("type_desc"),
                           F.col("text").alias("definition"))
    return G.module_inventory(m, kinds=["en", "de"], name_like="%7%")


@query("g6_event_attributes_json", """
SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events
""")
def g6_event_attributes_json(t):
    """JSON event payload fields as columns."""
    e = t.events.select("event_id", "user_id", "event_type", "props")
    return G.event_attributes(e, "props", ["k"]).drop("props")


@query("g6_event_attributes_xml", """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS action_event_type,
  CAST(user_id AS VARCHAR) AS action_user, event_type AS event_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time
FROM events
""")
def g6_event_attributes_xml(t):
    """Events rendered as XML event documents, read back into data and action columns."""
    e = t.events
    k = F.get_json_object("props", "$.k")
    xml = F.concat(F.lit('<event name="'), F.col("event_type"), F.lit('" timestamp="'),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"><action name="user"><value>'), F.col("user_id").cast("string"),
                   F.lit('</value></action><action name="event_type"><value>'), F.col("event_type"),
                   F.lit('</value></action><data name="k"><value>'), k, F.lit("</value></data></event>"))
    x = e.select("event_id", xml.alias("event_data"))
    out = G.event_attributes(x, "event_data", ["k"], actions=["event_type", "user"], fmt="xml")
    return out.drop("event_data")


@query("g7_explode_delimited", """
SELECT p_partkey, CAST(pos AS INTEGER) AS position, trim(item) AS item FROM (
  SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item, generate_subscripts(string_split(p_name, ' '), 1) AS pos
  FROM part) x WHERE trim(item) <> ''
""")
def g7_explode_delimited(t):
    """Part name words, one per row with their position."""
    return G.explode_delimited(t.part, "p_name", " ", keep=["p_partkey"])


@query("g9_desired_vs_actual", f"""
WITH f AS ({FEED_SQL})
SELECT * FROM f EXCEPT ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
""")
def g9_desired_vs_actual(t):
    """Rows of the desired customer state (the feed) to change or add."""
    return G.desired_vs_actual(feed(t), t.customer)


@query("g9_missing_members", f"""
WITH f AS ({FEED_SQL})
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM f)
""")
def g9_missing_members(t):
    """Customers missing from the published list (the feed)."""
    return G.missing_members(feed(t), t.customer, ["c_custkey"])


@query("g8_preview")
def g8_preview(t):
    """First 5 rows of every table whose name matches 'p%' (no order; rows-only check)."""
    tables = {n: getattr(t, n) for n in ["part", "pages", "orders", "nation"]}
    return G.preview(tables, "p%", 5)


COLUMNS_SQL = """
SELECT p_brand AS database_name, 'dbo' AS schema_name, 'table_' || CAST(p_partkey // 100 AS VARCHAR) AS table_name,
  replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS column_name,
  CASE p_type WHEN 'ECONOMY' THEN 'text' WHEN 'PROMO' THEN 'image' WHEN 'SMALL' THEN 'NTEXT' ELSE 'varchar' END
    AS data_type,
  p_size AS max_length, p_size % 2 = 0 AS is_nullable
FROM part
"""


def columns_table(t):
    """Parts as an estate-wide column list: brand = database, 100 parts per
    table, the part type standing for the column type."""
    p = t.part
    dt = (F.when(F.col("p_type") == "ECONOMY", "text").when(F.col("p_type") == "PROMO", "image")
          .when(F.col("p_type") == "SMALL", "NTEXT").otherwise("varchar"))
    return p.select(F.col("p_brand").alias("database_name"), F.lit("dbo").alias("schema_name"),
                    F.concat(F.lit("table_"), (F.col("p_partkey") / 100).cast("bigint").cast("string")).alias("table_name"),
                    F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
                    .alias("column_name"),
                    dt.alias("data_type"), F.col("p_size").alias("max_length"),
                    (F.col("p_size") % 2 == 0).alias("is_nullable"))


@query("g2_find_types", f"""
SELECT * FROM ({COLUMNS_SQL}) c WHERE lower(data_type) IN ('text', 'ntext', 'image')
""")
def g2_find_types(t):
    """Columns of deprecated types (text, ntext, image; case-insensitive) in the
    part-derived column list."""
    return G.find_types(columns_table(t))


_PREVIEW = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]


@query("g8_preview_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, LEAST(COUNT(*), 7) AS n_rows FROM {n}" for n in _PREVIEW if "r" in n))
def g8_preview_counts(t):
    """Rows shown per table whose name holds an 'r' (at most 7, the preview's size)."""
    return G.preview({n: getattr(t, n) for n in _PREVIEW}, "%r%", 7).groupBy("table_name").agg(
        F.count("*").alias("n_rows"))


@query("scalar_texts", r"""
SELECT p_partkey, '[' || p_brand || '].[' || p_name || ']' AS quoted, replace(p_brand || '.' || p_name, 'x', 'x') AS unquoted,
  CASE WHEN strpos(p_name, ' ') > 0 THEN '.' || split_part(p_name, ' ', -1) ELSE '' END AS ext,
  CASE CAST(8 + p_size % 8 AS VARCHAR) WHEN '14' THEN 'SQL Server 2017' WHEN '13' THEN 'SQL Server 2016' WHEN '12' THEN 'SQL Server 2014'
    WHEN '11' THEN 'SQL Server 2012' WHEN '10' THEN CASE WHEN p_size % 2 = 0 THEN 'SQL Server 2008 R2' ELSE 'SQL Server 2008' END
    WHEN '9' THEN 'SQL Server 2005' WHEN '8' THEN 'SQL Server 2000' ELSE 'SQL 7 or earlier' END AS product,
  CAST(CAST(8 + p_size % 8 AS VARCHAR) || '.' || CASE WHEN p_size % 2 = 0 THEN '5' ELSE '0' END AS DECIMAL(3,1)) AS version,
  '0x' || upper(hex(p_brand)) AS hex_brand,
  CAST(CAST((CAST(p_partkey AS HUGEINT) * p_size * 10000 * 200 + 1048576) // 2097152 AS DECIMAL(38,0)) / 100 AS DECIMAL(10,2)) AS mb
FROM part
""")
def scalar_texts(t):
    """2.2: unquote_name, file_ext, decode_version, numeric_version, hex_text and space_mb over the parts."""
    from fleetsight.functions import scalar as X
    p = t.part
    odd = F.when(F.col("p_size") % 2 == 0, ".51.2000").otherwise(".0.1600")
    version = F.concat((F.lit(8) + F.col("p_size") % 8).cast("string"), odd)
    quoted = F.concat(F.lit("["), F.col("p_brand"), F.lit("].["), F.col("p_name"), F.lit("]"))
    return p.select("p_partkey", quoted.alias("quoted"), X.unquote_name(quoted).alias("unquoted"),
                    X.file_ext(F.regexp_replace("p_name", " ", ".")).alias("ext"),
                    X.decode_version(version).alias("product"), X.numeric_version(version).alias("version"),
                    X.hex_text(F.col("p_brand").cast("binary")).alias("hex_brand"),
                    X.space_mb(F.col("p_partkey") * F.col("p_size"), F.lit(10000)).alias("mb"))


@query("scalar_times", """
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS now_text,
  strftime(date_trunc('minute', ts + INTERVAL 30 SECOND), '%Y-%m-%d %H:%M') AS utc_minute
FROM events
""")
def scalar_times(t):
    """2.2: now_text and to_utc_minute over the event times."""
    from fleetsight.functions import scalar as X
    e = t.events
    return e.select("event_id", X.now_text("ts").alias("now_text"),
                    F.date_format(X.to_utc_minute(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("utc_minute"))


# events of several shapes: errors have a code and a nested detail, clicks no data field of their own
_SHAPES_SQL = """
SELECT event_id, event_type AS event_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time, user_id,
       CASE WHEN event_type <> 'click' THEN json_extract_string(props, '$.k') END AS k,
       CASE WHEN event_type = 'error' THEN CAST(user_id % 7 AS VARCHAR) END AS code,
       CASE WHEN event_type = 'error' THEN '{"at":' || CAST(event_id % 5 AS VARCHAR) || '}' END AS detail
FROM events
"""


def _shaped_events(t):
    e = t.events
    k = F.get_json_object("props", "$.k").cast("int")
    err = F.col("event_type") == "error"
    data = F.struct(F.when(F.col("event_type") != "click", k).alias("k"),
                    F.when(err, F.col("user_id") % 7).alias("code"),
                    F.when(err, F.struct((F.col("event_id") % 5).alias("at"))).alias("detail"))
    doc = F.to_json(F.struct(F.col("event_type").alias("name"),
                             F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), data.alias("data"),
                             F.struct(F.col("user_id").alias("user")).alias("actions")))
    return e.select("event_id", doc.alias("doc"))


@query("g6_event_values", f"""
WITH s AS ({_SHAPES_SQL})
SELECT event_id, event_name, event_time, 'action' AS part, 'user' AS attribute, CAST(user_id AS VARCHAR) AS value FROM s
UNION ALL SELECT event_id, event_name, event_time, 'data', 'k', k FROM s WHERE k IS NOT NULL
UNION ALL SELECT event_id, event_name, event_time, 'data', 'code', code FROM s WHERE code IS NOT NULL
UNION ALL SELECT event_id, event_name, event_time, 'data', 'detail', detail FROM s WHERE detail IS NOT NULL
""")
def g6_event_values(t):
    """Every attribute of events of several shapes, one row each."""
    return G.event_values(_shaped_events(t), "doc", ["event_id"])


@query("g6_event_values_flat", """
SELECT event_id, CAST(NULL AS VARCHAR) AS event_name, CAST(NULL AS VARCHAR) AS event_time, 'data' AS part, attribute,
       json_extract_string(props, '$.' || attribute) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS attribute FROM events) e
""")
def g6_event_values_flat(t):
    """The members of the events' own payload, whatever their names."""
    return G.event_values(t.events, "props", ["event_id"])


@query("g6_found_attributes", f"""
SELECT event_id, event_name, event_time, k, code, detail, CAST(user_id AS VARCHAR) AS action_user FROM ({_SHAPES_SQL}) s
""")
def g6_found_attributes(t):
    """One column per attribute that occurs in the data."""
    return G.found_event_attributes(_shaped_events(t), "doc").drop("doc")


@query("g3_search_indexed", ORACLE["g3_search_text"])
def g3_search_indexed(t):
    """The same search through an index of 3-character runs, built in two loads (the second brings all
    documents, of which those of the first are known)."""
    spark = t.documents.sparkSession
    index = TrigramIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/g3-index-{uuid.uuid4().hex}", 16, 32)
    index.add("document", t.documents.filter(F.col("doc_id") % 2 == 0), "doc_id", "text", 1)
    index.add("document", t.documents, "doc_id", "text", 2)
    index.add("page", t.pages, "page_id", "html", 3)
    index.add("benchmark", t.benchmark, "item_id", "text", 4)
    return G.search_indexed(index, "license")
