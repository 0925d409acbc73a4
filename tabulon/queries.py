"""The engine's queries on the Parquet tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import AnalysisError, GroupLimitError
from tabulon.functions import cells as C
from tabulon.functions import references as R
from tabulon.functions import text as X
from tabulon.operators import evidence as E
from tabulon.operators import relation as S
from tabulon.operators.analyze import analyze, analyze_frame, matched
from tabulon.plans import model as M
from tabulon.streaming.rows import preview

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheet(spark, sf_dir, name, key, **columns) -> S.Sheet:
    """A table as a sheet whose header is row 1; columns: SQL expressions that are added or replaced."""
    df = table(spark, sf_dir, name)
    for c, sql in columns.items():
        df = df.withColumn(c, F.expr(sql))
    return S.from_dataframe(df, F.expr(key) + 2, name)


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def evidence_text(df: DataFrame) -> DataFrame:
    return df.withColumn("source_rows", F.concat_ws(",", F.col("source_rows").cast("array<string>")))


def cents(c: str) -> str:
    return f"cast(round({c} * 100) as bigint)"


n_rows = M.Aggregate("count", "n_rows")

# The flagship: filter, grouping, every aggregate, first-seen order and evidence rows.
FLAGSHIP = M.Plan(
    group_by=("prio",),
    filter=M.all_of(M.compare("o_orderstatus", "eq", "F"), M.any_of(M.compare("prio", "eq", "1-URGENT"), M.compare("prio", "eq", "2-HIGH"), M.is_empty("prio"))),
    aggregates=(n_rows, M.Aggregate("count", "n_prio", "prio"), M.Aggregate("sum", "cents", "cents"), M.Aggregate("average", "avg_cents", "cents"), M.Aggregate("min", "lo", "o_totalprice"), M.Aggregate("max", "last_day", "o_orderdate")),
)


@query(
    "flagship_grouped",
    """
WITH m AS (SELECT *, o_orderkey + 2 AS r, nullif(o_orderpriority, '5-LOW') AS prio, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
     k AS (SELECT *, row_number() OVER (PARTITION BY prio ORDER BY r) AS rn FROM m WHERE o_orderstatus = 'F' AND (prio IN ('1-URGENT', '2-HIGH') OR prio IS NULL))
SELECT prio, count(*) AS n_rows, count(prio) AS n_prio, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(c) AS DOUBLE) / count(c) AS avg_cents, min(o_totalprice) AS lo, max(o_orderdate) AS last_day,
       min(r) AS first_row, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (WHERE rn <= 5) AS source_rows
FROM k GROUP BY prio""",
)
def flagship(spark, sf_dir):
    s = sheet(spark, sf_dir, "orders", "o_orderkey", prio="nullif(o_orderpriority, '5-LOW')", cents=cents("o_totalprice"))
    return evidence_text(analyze_frame(s, FLAGSHIP))


def filtered(name, tab, key, expression: M.Filter, where: str, **columns):
    """How many rows a filter keeps, and which: the sum and ends of their row numbers."""
    extra = "".join(f", {sql} AS {c}" for c, sql in columns.items())

    @query(name, f"WITH s AS (SELECT *{extra}, {key} + 2 AS r FROM {tab}) SELECT count(*) AS n_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS row_sum, min(r) AS first_row, max(r) AS last_row FROM s WHERE {where}")
    def run(spark, sf_dir):
        s = sheet(spark, sf_dir, tab, key, **columns)
        plan = M.Plan((n_rows,), filter=expression)
        return matched(s, plan).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(S.ROW), F.lit(0)).alias("row_sum"), F.min(S.ROW).alias("first_row"), F.max(S.ROW).alias("last_row"))


DAY = dt.datetime(1996, 1, 1)
STATUS = {"st": "nullif(o_orderstatus, 'P')"}
filtered("filter_eq", "orders", "o_orderkey", M.compare("o_orderpriority", "eq", "1-URGENT"), "o_orderpriority = '1-URGENT'")
filtered("filter_not_eq", "orders", "o_orderkey", M.compare("o_orderpriority", "notEq", "1-URGENT"), "o_orderpriority <> '1-URGENT'")
filtered("filter_lt", "part", "p_partkey", M.compare("p_size", "lt", 10), "p_size < 10")
filtered("filter_le", "part", "p_partkey", M.compare("p_size", "le", 10), "p_size <= 10")
filtered("filter_gt", "orders", "o_orderkey", M.compare("o_totalprice", "gt", 150000.5), "o_totalprice > 150000.5")
filtered("filter_ge", "part", "p_partkey", M.compare("p_name", "ge", "m"), "p_name >= 'm'")
filtered("filter_contains", "documents", "doc_id", M.compare("text", "contains", "the"), "contains(text, 'the')")
filtered("filter_is_empty", "orders", "o_orderkey", M.is_empty("st"), "st IS NULL", **STATUS)
filtered("filter_is_not_empty", "orders", "o_orderkey", M.is_not_empty("st"), "st IS NOT NULL", **STATUS)
filtered("filter_not", "orders", "o_orderkey", M.negate(M.compare("st", "eq", "F")), "NOT coalesce(st = 'F', false)", **STATUS)
filtered("filter_nested", "orders", "o_orderkey", M.any_of(M.all_of(M.compare("st", "eq", "F"), M.compare("o_totalprice", "lt", 5000.0)), M.negate(M.any_of(M.is_empty("st"), M.compare("o_custkey", "gt", 10)))), "(coalesce(st = 'F', false) AND o_totalprice < 5000) OR NOT (st IS NULL OR o_custkey > 10)", **STATUS)
filtered("filter_empty_and", "orders", "o_orderkey", M.all_of(), "true")
filtered("filter_empty_or", "orders", "o_orderkey", M.any_of(), "false")
filtered("filter_not_eq_empty", "orders", "o_orderkey", M.compare("st", "notEq", "F"), "st IS DISTINCT FROM 'F'", **STATUS)
filtered("filter_eq_empty_literal", "orders", "o_orderkey", M.compare("st", "eq", None), "st IS NULL", **STATUS)
filtered("filter_le_empty_literal", "orders", "o_orderkey", M.all_of(M.is_empty("st"), M.compare("st", "le", None)), "st IS NULL", **STATUS)
filtered("filter_datetime", "orders", "o_orderkey", M.compare("o_orderdate", "lt", DAY), "o_orderdate < TIMESTAMP '1996-01-01'")
filtered("filter_bool", "labels", "doc_id", M.compare("bad", "eq", True), "bad", bad="toxic = 1")
filtered("filter_int_float", "events", "event_id", M.all_of(M.compare("user_id", "lt", 100.5), M.compare("value", "ge", 10)), "user_id < 100.5 AND value >= 10")
filtered("filter_guarded_order", "orders", "o_orderkey", M.all_of(M.is_not_empty("st"), M.compare("st", "lt", "O")), "st IS NOT NULL AND st < 'O'", **STATUS)


def aggregated(name, tab, key, by, aggregates, sql, where: M.Filter | None = None, limit=None, evidence=0, **columns):
    """The plan's result, without the columns that the SQL doesn't ask for."""

    @query(name, sql)
    def run(spark, sf_dir):
        out = analyze_frame(sheet(spark, sf_dir, tab, key, **columns), M.Plan(tuple(aggregates), tuple(by), where, limit=limit, evidence_rows=evidence))
        return evidence_text(out) if evidence else out.drop("source_rows")


def agg(op, column, alias):
    return M.Aggregate(op, alias, column)


aggregated("agg_count_all", "lineitem", "l_orderkey", ["l_returnflag"], [n_rows], "SELECT l_returnflag, count(*) AS n_rows, min(l_orderkey) + 2 AS first_row FROM lineitem GROUP BY 1")
aggregated("agg_count_col", "orders", "o_orderkey", ["o_orderpriority"], [agg("count", "st", "n_st")], "SELECT o_orderpriority, count(nullif(o_orderstatus, 'P')) AS n_st, min(o_orderkey) + 2 AS first_row FROM orders GROUP BY 1", **STATUS)
aggregated("agg_sum_int", "lineitem", "l_orderkey", ["l_returnflag", "l_linestatus"], [agg("sum", "l_linenumber", "lines"), agg("sum", "c", "cents")], "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_orderkey) + 2 AS first_row FROM lineitem GROUP BY 1, 2", c=cents("l_extendedprice"))
aggregated("agg_sum_float", "lineitem", "l_orderkey", ["l_returnflag"], [agg("sum", "l_quantity", "quantity")], "SELECT l_returnflag, sum(l_quantity) AS quantity, min(l_orderkey) + 2 AS first_row FROM lineitem GROUP BY 1")
aggregated("agg_avg", "lineitem", "l_orderkey", ["l_linestatus"], [agg("average", "l_quantity", "quantity"), agg("average", "l_linenumber", "line")], "SELECT l_linestatus, CAST(sum(l_quantity) AS DOUBLE) / count(l_quantity) AS quantity, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS line, min(l_orderkey) + 2 AS first_row FROM lineitem GROUP BY 1")
aggregated("agg_min_max_number", "part", "p_partkey", ["p_type"], [agg("min", "p_size", "lo"), agg("max", "p_retailprice", "hi")], "SELECT p_type, min(p_size) AS lo, max(p_retailprice) AS hi, min(p_partkey) + 2 AS first_row FROM part GROUP BY 1")
aggregated("agg_min_max_string", "part", "p_partkey", ["p_brand"], [agg("min", "p_name", "lo"), agg("max", "p_name", "hi")], "SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, min(p_partkey) + 2 AS first_row FROM part GROUP BY 1")
aggregated("agg_min_max_datetime", "events", "event_id", ["event_type"], [agg("min", "ts", "lo"), agg("max", "ts", "hi")], "SELECT event_type, min(ts) AS lo, max(ts) AS hi, min(event_id) + 2 AS first_row FROM events GROUP BY 1")
aggregated("agg_min_max_bool", "labels", "doc_id", ["quality"], [agg("min", "bad", "lo"), agg("max", "bad", "hi")], "SELECT quality, min(toxic = 1) AS lo, max(toxic = 1) AS hi, min(doc_id) + 2 AS first_row FROM labels GROUP BY 1", bad="toxic = 1")
aggregated("agg_global", "orders", "o_orderkey", [], [n_rows, agg("max", "o_custkey", "hi")], "SELECT count(*) AS n_rows, max(o_custkey) AS hi, min(o_orderkey) + 2 AS first_row FROM orders")
aggregated("agg_global_no_match", "orders", "o_orderkey", [], [n_rows, agg("sum", "o_custkey", "total"), agg("average", "o_custkey", "mean")], "SELECT count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS total, avg(o_custkey) AS mean, min(o_orderkey) + 2 AS first_row FROM orders WHERE o_orderstatus = 'none'", where=M.compare("o_orderstatus", "eq", "none"))
aggregated("agg_group_no_match", "orders", "o_orderkey", ["o_orderpriority"], [n_rows], "SELECT o_orderpriority, count(*) AS n_rows, min(o_orderkey) + 2 AS first_row FROM orders WHERE o_orderstatus = 'none' GROUP BY 1", where=M.compare("o_orderstatus", "eq", "none"))
aggregated("agg_empty_values", "orders", "o_orderkey", ["o_orderstatus"], [agg("sum", "k", "total"), agg("min", "k", "lo"), agg("average", "k", "mean")], "SELECT o_orderstatus, CAST(sum(k) AS BIGINT) AS total, min(k) AS lo, CAST(sum(k) AS DOUBLE) / nullif(count(k), 0) AS mean, min(o_orderkey) + 2 AS first_row FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS k FROM orders) GROUP BY 1", k="case when o_orderstatus = 'F' then null else o_custkey end")
aggregated("group_empty_key", "orders", "o_orderkey", ["st"], [n_rows], "SELECT nullif(o_orderstatus, 'P') AS st, count(*) AS n_rows, min(o_orderkey) + 2 AS first_row FROM orders GROUP BY 1", **STATUS)
aggregated("group_multi_key", "orders", "o_orderkey", ["st", "o_orderpriority"], [n_rows, agg("min", "o_totalprice", "lo")], "SELECT nullif(o_orderstatus, 'P') AS st, o_orderpriority, count(*) AS n_rows, min(o_totalprice) AS lo, min(o_orderkey) + 2 AS first_row FROM orders GROUP BY 1, 2", **STATUS)
aggregated("group_float_key", "part", "p_partkey", ["half"], [n_rows], "SELECT CAST(p_size AS DOUBLE) / 2 AS half, count(*) AS n_rows, min(p_partkey) + 2 AS first_row FROM part GROUP BY 1", half="cast(p_size as double) / 2")
aggregated("group_first_seen_limit", "events", "event_id", ["event_type"], [n_rows], "SELECT event_type, count(*) AS n_rows, min(event_id) + 2 AS first_row FROM events GROUP BY 1 ORDER BY 3 LIMIT 3", limit=3)
aggregated(
    "group_evidence_rows",
    "events",
    "event_id",
    ["event_type"],
    [n_rows],
    "WITH s AS (SELECT *, event_id + 2 AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) SELECT event_type, count(*) AS n_rows, min(r) AS first_row, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (WHERE rn <= 7) AS source_rows FROM s GROUP BY 1",
    evidence=7,
)


GUARDED = ("c_custkey", "c_nationkey", "c_mktsegment")


@query("group_limit_check", " UNION ALL ".join(f"SELECT '{c}' AS name, n > 1000 AS exceeded, CASE WHEN n <= 1000 THEN n END AS total_groups FROM (SELECT count(DISTINCT {c}) AS n FROM customer)" for c in GUARDED))
def group_limit(spark, sf_dir):
    """Which columns' groups the guard of a thousand lets through, and how many those have."""
    found = []
    for c in GUARDED:
        try:
            r = analyze(sheet(spark, sf_dir, "customer", "c_custkey"), M.Plan((n_rows,), (c,), max_groups=1000, evidence_rows=0))
            found.append((c, False, r.total_groups))
        except GroupLimitError:
            found.append((c, True, None))
    return spark.createDataFrame(found, "name string, exceeded boolean, total_groups long")


STATS_PLAN = M.Plan((n_rows,), ("o_orderpriority",), M.compare("o_orderstatus", "eq", "F"), limit=2, evidence_rows=3)


@query(
    "analysis_stats",
    "WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT count(DISTINCT o_orderpriority) AS n FROM m) SELECT (SELECT count(*) FROM orders) AS seen_rows, (SELECT count(*) FROM m) AS matched_rows, g.n AS total_groups, least(g.n, 2) AS returned_groups, g.n > 2 AS truncated FROM g",
)
def stats(spark, sf_dir):
    r = analyze(sheet(spark, sf_dir, "orders", "o_orderkey"), STATS_PLAN)
    return spark.createDataFrame([(r.seen_rows, r.matched_rows, r.total_groups, r.returned_groups, r.truncated)], "seen_rows long, matched_rows long, total_groups long, returned_groups long, truncated boolean")


@query(
    "analyze_result",
    "WITH m AS (SELECT *, o_orderkey + 2 AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') SELECT o_orderpriority, count(*) AS n_rows, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (WHERE rn <= 3) AS source_rows FROM m GROUP BY 1 ORDER BY min(r) LIMIT 2",
)
def analyze_result(spark, sf_dir):
    """The rows of a guarded analysis, evidence included."""
    return evidence_text(analyze(sheet(spark, sf_dir, "orders", "o_orderkey"), STATS_PLAN).rows)


def first_error(name, sql, plan, cell):
    """Row and column of the first cell that a plan can't use; a column of cells of mixed kinds."""

    @query(name, sql)
    def run(spark, sf_dir):
        s = sheet(spark, sf_dir, "events", "event_id")
        k = s.columns.index("value")
        mixed = S.Sheet(s.df.withColumn(f"c{k}", cell(F.col(f"c{k}"), F.col(S.ROW))), s.names, s.name)
        try:
            analyze(mixed, plan)
            found = (None, None)
        except AnalysisError as e:
            found = (e.row, e.column)
        return spark.createDataFrame([found], "row long, column string")


def error_cells(value, row):
    """Every 97th cell is an error."""
    as_error = F.when(row % 97 == 0, F.struct(F.lit("error").alias("kind"), *[(F.lit("#N/A") if f.name == "s" else F.lit(None)).cast(f.dataType).alias(f.name) for f in C.CELL.fields[1:]]))
    return F.coalesce(as_error, C.lift(value, T.DoubleType()))


first_error("error_in_filter", "SELECT min(r) AS row, 'value' AS column FROM (SELECT event_id + 2 AS r, * FROM events) WHERE r % 97 = 0 AND event_type = 'click'", M.Plan((n_rows,), (), M.all_of(M.compare("event_type", "eq", "click"), M.compare("value", "lt", 10.0))), error_cells)
first_error("error_in_aggregate", "SELECT min(r) AS row, 'value' AS column FROM (SELECT event_id + 2 AS r, * FROM events) WHERE r % 97 = 0", M.Plan((M.Aggregate("sum", "total", "value"),), ("event_type",)), error_cells)


@query("range_select", "SELECT n_nationkey + 2 AS _row, n_name FROM nation WHERE n_nationkey + 2 BETWEEN 5 AND 12")
def range_select(spark, sf_dir):
    return S.select_range(sheet(spark, sf_dir, "nation", "n_nationkey"), "B5", "B12").to_df()


@query("header_letters", 'SELECT n_nationkey + 2 AS _row, n_name AS "B", n_regionkey AS "C" FROM nation')
def header_letters(spark, sf_dir):
    return S.with_letters(S.select_range(sheet(spark, sf_dir, "nation", "n_nationkey"), "B1")).to_df()


@query("drop_empty_rows", "SELECT _row, a, b FROM (SELECT event_id + 2 AS _row, nullif(event_type, 'click') AS a, CASE WHEN value < 200 THEN NULL ELSE value END AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_empty(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.expr("nullif(event_type, 'click')").alias("a"), F.expr("case when value < 200 then null else value end").alias("b"))
    s = S.from_dataframe(df, F.col("event_id") + 2, "events")
    return S.drop_empty_rows(S.Sheet(s.df.drop("c0").withColumnsRenamed({"c1": "c0", "c2": "c1"}), ("a", "b"))).to_df()


@query("row_limit", "SELECT n_nationkey + 2 AS _row, n_nationkey, n_name, n_regionkey FROM nation ORDER BY 1 LIMIT 20")
def row_limit(spark, sf_dir):
    return S.limit_rows(sheet(spark, sf_dir, "nation", "n_nationkey")).to_df()


@query("preview_counts", "SELECT count(*) AS total_rows, least(count(*), 100) AS displayed_rows, count(*) > 100 AS truncated, (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM (SELECT event_id FROM events ORDER BY 1 LIMIT 100)) AS ids FROM events")
def preview_counts(spark, sf_dir):
    p = preview(sheet(spark, sf_dir, "events", "event_id"))
    return spark.createDataFrame([(p["totalRows"], p["displayedRows"], p["truncated"], ",".join(str(r["event_id"]) for r in p["rows"]))], "total_rows long, displayed_rows long, truncated boolean, ids string")


@query("fill_missing_rows", "SELECT g.r AS _row, l.doc_id, l.quality, l.toxic FROM (SELECT unnest(generate_series(1, (SELECT max(doc_id) + 2 FROM labels))) AS r) g LEFT JOIN labels l ON l.doc_id + 2 = g.r")
def fill_rows(spark, sf_dir):
    return S.fill_missing_rows(sheet(spark, sf_dir, "labels", "doc_id")).to_df()


def _dimension_sql(tables):
    return " UNION ALL ".join(f"SELECT '{t}' AS sheet, 'A' || CAST(min({k}) + 2 AS VARCHAR) AS start, '{R.letters(n)}' || CAST(max({k}) + 2 AS VARCHAR) AS \"end\", CAST(max({k}) - min({k}) + 1 AS BIGINT) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {t}" for t, k, n in tables)


DIMENSIONS = [("nation", "n_nationkey", 3), ("orders", "o_orderkey", 6), ("part", "p_partkey", 6), ("events", "event_id", 6), ("documents", "doc_id", 5)]


@query("sheet_dimensions", _dimension_sql(DIMENSIONS))
def sheet_dimensions(spark, sf_dir):
    out = None
    for t, k, _ in DIMENSIONS:
        one = S.dimensions(sheet(spark, sf_dir, t, k)).withColumn("sheet", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query("column_list", "SELECT column_name AS name, CAST(row_number() OVER () AS INTEGER) AS place FROM (DESCRIBE orders)")
def column_list(spark, sf_dir):
    names = S.columns_with_data(sheet(spark, sf_dir, "orders", "o_orderkey"))
    return spark.createDataFrame([(n, k + 1) for k, n in enumerate(names)], "name string, place int")


@query(
    "structured_cells",
    """
WITH s AS (SELECT n_nationkey + 2 AS r, * FROM nation)
SELECT r AS _row, 1 AS "column", 'A' || r AS address, 'int' AS kind, CAST(n_nationkey AS VARCHAR) AS value FROM s
UNION ALL SELECT r, 2, 'B' || r, 'string', n_name FROM s
UNION ALL SELECT r, 3, 'C' || r, 'int', CAST(n_regionkey AS VARCHAR) FROM s WHERE n_regionkey <> 0""",
)
def structured_cells(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey", n_regionkey="nullif(n_regionkey, 0)")
    return S.structured(s).select(S.ROW, "column", R.address(F.col("column"), F.col(S.ROW)).alias("address"), F.col("cell.kind").alias("kind"), C.plain_text(F.col("cell")).alias("value"))


@query(
    "cell_addresses",
    """
WITH n AS (SELECT event_id % 16384 + 1 AS n, event_id + 1 AS r FROM events)
SELECT r, n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(64 + (n - 27) // 26 + 1 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER))
       ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END || CAST(r AS VARCHAR) AS address, n AS back
FROM n""",
)
def cell_addresses(spark, sf_dir):
    n = (F.col("event_id") % 16384 + 1).alias("n")
    df = table(spark, sf_dir, "events").select(n, (F.col("event_id") + 1).alias("r"))
    out = df.withColumn("address", R.address(F.col("n"), F.col("r")))
    return out.withColumn("back", R.column_number(F.regexp_extract("address", "^[A-Z]+", 0)).cast("long"))


@query("typed_rows", "SELECT event_id + 2 AS _row, event_id, CAST(user_id AS DOUBLE) AS user_id, event_type FROM events")
def typed_rows(spark, sf_dir):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.DoubleType()), T.StructField("event_type", T.StringType())])
    return S.typed(sheet(spark, sf_dir, "events", "event_id"), schema)


@query("rows_json", """SELECT n_nationkey + 2 AS _row, '{"n_nationkey":' || n_nationkey || ',"n_name":' || CAST(to_json(n_name) AS VARCHAR) || ',"n_regionkey":' || coalesce(CAST(nullif(n_regionkey, 0) AS VARCHAR), 'null') || '}' AS json FROM nation""")
def rows_json(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey", n_regionkey="nullif(n_regionkey, 0)")
    return s.df.select(S.ROW, E.row_document(s).alias("json"))


@query("rows_json_safe", """SELECT o_orderkey + 2 AS _row, '{"big":' || CASE WHEN big <= 9007199254740991 THEN CAST(big AS VARCHAR) ELSE '"' || CAST(big AS VARCHAR) || '"' END || '}' AS json FROM (SELECT *, 9007199254740000 + o_orderkey AS big FROM orders)""")
def rows_json_safe(spark, sf_dir):
    s = S.from_dataframe(table(spark, sf_dir, "orders").select(F.expr("9007199254740000 + o_orderkey").alias("big")), F.col("big") - 9007199254740000 + 2)
    return s.df.select(S.ROW, E.row_document(s, " ms", True).alias("json"))


def _chunk_rows(spark, sf_dir, options):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("nullif(p_size, 1)").alias("p_size"))
    return E.selected(E.document_rows(S.from_dataframe(df, F.col("p_partkey") + 2, "part")), False, options.max_rows)


CHUNKS = "WITH d AS (SELECT p_partkey + 2 AS r, p_partkey // 25 AS c FROM part)"


@query("rag_chunks", CHUNKS + " SELECT CAST(c AS BIGINT) AS chunk, count(*) AS n_rows, min(r) AS first_row, max(r) AS last_row, 'A' || min(r) || ':C' || max(r) AS data_range FROM d GROUP BY c")
def rag_chunks(spark, sf_dir):
    options = E.ExportOptions()
    data, _, _ = _chunk_rows(spark, sf_dir, options)
    return E.chunks(data, options).select("chunk", F.size("rows").cast("long").alias("n_rows"), "first_row", "last_row", "data_range")


@query("rag_max_rows", "SELECT least(count(*), 60) AS total, CASE WHEN count(*) > 60 THEN 62 END AS continuation_row FROM part")
def rag_max_rows(spark, sf_dir):
    _, _, rest = _chunk_rows(spark, sf_dir, E.ExportOptions(max_rows=60))
    return rest


def _cell_sql(column: int, kind: str, value: str) -> str:
    """SQL for the JSON of a cell of row r."""
    letter = R.letters(column)
    return f"""'{{"row":' || r || ',"column":{column},"address":"{letter}' || r || '","value":{{"type":"{kind}","value":' || {value} || '}},"formula":null,"calculationStatus":"notApplicable","styleId":0,"numberFormat":"General"}}'"""


@query(
    "rag_cells",
    f"""WITH d AS (SELECT p_partkey + 2 AS r, * FROM part)
SELECT r AS _row, '{{"row":' || r || ',"cells":[' || {_cell_sql(1, "int", "p_partkey")} || ',' || {_cell_sql(2, "string", "CAST(to_json(p_name) AS VARCHAR)")} || CASE WHEN p_size = 1 THEN '' ELSE ',' || {_cell_sql(3, "int", "p_size")} END || ']}}' AS document,
       CASE WHEN p_size = 1 THEN 2 ELSE 3 END AS n_cells FROM d""",
)
def rag_cells(spark, sf_dir):
    data, _, _ = _chunk_rows(spark, sf_dir, E.ExportOptions())
    return data.select(S.ROW, E.row_json(F.col(S.ROW), F.col("cells")).alias("document"), F.size("cells").alias("n_cells"))


BACK = "\\"


def _duck_marks(column: str, marks: str) -> str:
    return f"regexp_replace({column}, '([{''.join(BACK + c for c in marks)}])', '{BACK * 2}{BACK}1', 'g')"


def _escape_sql(column: str, marks: str, amp: bool) -> str:
    out = _duck_marks(column, marks)
    if amp:
        out = f"replace({out}, '&', '&amp;')"
    out = f"replace(replace({out}, '<', '&lt;'), '>', '&gt;')"
    return f"regexp_replace({out}, '{BACK}r{BACK}n|{BACK}r|{BACK}n', '<br>', 'g')"


#: Chunks of ten rows of the nations' names, as JSON documents.
NATION_CHUNKS = """
WITH d AS (SELECT n_nationkey + 2 AS r, n_nationkey // 10 AS c, n_name AS s FROM nation),
     j AS (SELECT r, c, s, '{"row":' || r || ',"cells":[{"row":' || r || ',"column":1,"address":"A' || r || '","value":{"type":"string","value":' || CAST(to_json(s) AS VARCHAR) || '},"formula":null,"calculationStatus":"notApplicable","styleId":0,"numberFormat":"General"}]}' AS x FROM d),
     k AS (SELECT c, 'A' || min(r) || ':A' || max(r) AS range, '{"version":"tabulon.rag-chunk/v1","chunkId":"0123456789ab:0:A' || min(r) || ':A' || max(r) || '","sheetName":"nation","sheetIndex":0,"dataRange":"A' || min(r) || ':A' || max(r) || '","header":null,"rows":[' || string_agg(x, ',' ORDER BY r) || ']}' AS doc, string_agg('| ' || r || ' | ' || ESCAPED || ' |' || chr(10), '' ORDER BY r) AS lines FROM j GROUP BY c)
"""


def _nation_export(spark, sf_dir) -> E.Evidence:
    df = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    s = S.from_dataframe(df, F.col("n_nationkey") + 2, "nation")
    return E.export(E.document_rows(S.Sheet(s.df.drop("c1"), ("n_name",))), "nation", "0123456789abcdef", E.ExportOptions(chunk_rows=10), source_name="tpch.xlsx")


@query(
    "rag_chunk_documents",
    NATION_CHUNKS.replace("ESCAPED", _escape_sql("s", X.EVIDENCE_MARKS, True))
    + """SELECT c AS chunk, doc AS json, '<!-- tabulon:chunk-start id="0123456789ab:0:' || range || '" -->' || chr(10) || '## nation - ' || range || chr(10) || chr(10) || '| _row | A |' || chr(10) || '| ---: | --- |' || chr(10) || lines || '<!-- tabulon:chunk-end -->' || chr(10) || chr(10) AS markdown FROM k""",
)
def rag_documents(spark, sf_dir):
    return _nation_export(spark, sf_dir).chunks.select("chunk", "json", "markdown")


@query(
    "rag_manifest_counts",
    NATION_CHUNKS.replace("ESCAPED", "s")
    + """, t AS (SELECT (SELECT count(*) FROM d) AS n, count(*) AS chunks, CAST(sum(strlen(doc) + 1) AS BIGINT) AS bytes FROM k)
SELECT unnest(['version', 'sourceName', 'sourceSha256', 'sheetName', 'sheetIndex', 'sheetVisibility', 'startCell', 'endCell', 'hasHeader', 'chunkRows', 'maxRows', 'emittedRows', 'emittedChunks', 'jsonlUtf8Bytes', 'approximateTokens', 'truncated', 'continuationRow', 'formulaCalculation']) AS field,
       unnest(['"tabulon.rag-manifest/v1"', '"tpch.xlsx"', '"0123456789abcdef"', '"nation"', '0', '"visible"', '"A1"', 'null', 'false', '10', 'null', CAST(n AS VARCHAR), CAST(chunks AS VARCHAR), CAST(bytes AS VARCHAR), CAST(CAST(ceil(bytes / 4.0) AS BIGINT) AS VARCHAR), 'false', 'null', '\""""
    + E.NO_CALCULATION.replace("'", "''")
    + """"']) AS value FROM t""",
)
def rag_manifest(spark, sf_dir):
    m = _nation_export(spark, sf_dir).manifest
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in m.items()], "field string, value string")


@query("rag_stream_ends", "SELECT '<!-- tabulon:stream-end chunks=\"' || count(DISTINCT n_nationkey // 10) || '\" rows=\"' || count(*) || '\" truncated=\"false\" -->' || chr(10) AS line FROM nation")
def rag_stream(spark, sf_dir):
    return spark.createDataFrame([(E.stream_end(_nation_export(spark, sf_dir).manifest),)], "line string")


@query("markdown_escape_evidence", f"SELECT doc_id, md5(regexp_replace({_escape_sql('text', X.EVIDENCE_MARKS, True)}, '[{BACK}x00-{BACK}x09{BACK}x0B{BACK}x0C{BACK}x0E-{BACK}x1F{BACK}x7F]', ' ', 'g')) AS digest FROM documents")
def escape_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_evidence(F.col("text"))).alias("digest"))


@query("markdown_escape_simple", f"SELECT conv_id, turn, md5({_escape_sql('text', X.SIMPLE_MARKS, False)}) AS digest FROM conversations")
def escape_simple(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.escape_simple(F.col("text"))).alias("digest"))


@query("markdown_escape_pages", f"SELECT page_id, md5({_escape_sql('html', X.SIMPLE_MARKS, False)}) AS digest FROM pages")
def escape_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.escape_simple(F.col("html"))).alias("digest"))


@query("markdown_heading", f"SELECT p_partkey, regexp_replace({_duck_marks('p_name || chr(35) || p_type', X.HEADING_MARKS)}, '[{BACK}x00-{BACK}x1F]', ' ', 'g') AS heading FROM part")
def heading(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.escape_heading(F.concat("p_name", F.lit("#"), "p_type")).alias("heading"))


@query("markdown_simple_table", f"SELECT n_nationkey + 2 AS _row, '| ' || n_nationkey || ' | ' || {_escape_sql('n_name', X.SIMPLE_MARKS, False)} || ' | ' || coalesce(CAST(nullif(n_regionkey, 0) AS VARCHAR), '') || ' |' AS line FROM nation UNION ALL SELECT -1, '| n{BACK}_nationkey | n{BACK}_name | n{BACK}_regionkey |' UNION ALL SELECT 0, '| --- | --- | --- |'")
def simple_table(spark, sf_dir):
    return E.simple_markdown(sheet(spark, sf_dir, "nation", "n_nationkey", n_regionkey="nullif(n_regionkey, 0)"))


@query("float_text", "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders")
def float_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.float_text(F.col("o_totalprice")).alias("price"))


@query("date_text", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' WHEN microsecond(ts) % 1000 = 0 THEN '.' || lpad(CAST(microsecond(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS at FROM events")
def date_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.date_text(F.col("ts")).alias("day"), X.datetime_text(F.col("ts")).alias("at"))


@query("time_text", "SELECT event_id, strftime(ts, '%H:%M:%S') AS at FROM events")
def time_text(spark, sf_dir):
    us = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("long") * 1_000_000
    return table(spark, sf_dir, "events").select("event_id", X.time_text(us).alias("at"))


@query("formula_guard", "SELECT p_partkey, CASE WHEN starts_with(x, '=') OR starts_with(x, '$=') THEN '''' || x ELSE x END AS text FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '=' WHEN 1 THEN '$=' ELSE '' END || p_name AS x FROM part)")
def formula_guard(spark, sf_dir):
    x = F.expr("case p_partkey % 3 when 0 then '=' when 1 then '$=' else '' end || p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.formula_guard(x).alias("text"))


@query("table_text", "SELECT conv_id, turn, md5(replace(replace(replace(replace(text, '|', '\\|'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t')) AS digest FROM conversations")
def table_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.table_text(F.col("text"))).alias("digest"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.octet_length("text")).alias("tokens"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sha256(F.col("text")).alias("digest"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_path(F.col("props"), "k").alias("k"))


@query("cell_types", "SELECT kind, preview, count(*) AS n FROM (SELECT unnest([{'kind': 'int', 'preview': 'integer'}, {'kind': 'string', 'preview': 'string'}, {'kind': 'float', 'preview': 'number'}, {'kind': 'dateTime', 'preview': 'datetime'}], recursive := true) FROM orders) GROUP BY 1, 2")
def cell_types(spark, sf_dir):
    s = sheet(spark, sf_dir, "orders", "o_orderkey")
    kept = S.Sheet(s.df.select(S.ROW, "c0", F.col("c2").alias("c1"), F.col("c3").alias("c2"), F.col("c4").alias("c3")), ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    long = S.structured(kept)
    return long.select(C.type_name(F.col("cell"), C.EVIDENCE_TYPES).alias("kind"), C.type_name(F.col("cell"), C.PREVIEW_TYPES).alias("preview")).groupBy("kind", "preview").agg(F.count(F.lit(1)).alias("n"))


@query("cells_as_typed", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'float' END AS kind, count(*) AS n_rows, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 0.5 END) AS DOUBLE) AS total FROM part GROUP BY 1")
def cells_as_typed(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    whole, half = C.lift(F.col("p_size"), T.IntegerType()), C.lift(F.col("p_size").cast("double") + 0.5, T.DoubleType())
    cell = F.when(F.col("p_partkey") % 2 == 0, whole).otherwise(half)
    s = S.Sheet(df.select((F.col("p_partkey") + 2).cast("long").alias(S.ROW), F.expr("case when p_partkey % 2 = 0 then 'int' else 'float' end").alias("c0"), cell.alias("c1")), ("kind", "size"))
    out = analyze_frame(s, M.Plan((n_rows, agg("sum", "size", "total")), ("kind",), evidence_rows=0))
    return out.select("kind", "n_rows", F.coalesce(F.col("total.f"), F.col("total.i").cast("double")).alias("total"))
