"""The compiled plan against a small interpreter, cell by cell, errors included."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import AnalysisError, GroupLimitError, PlanError
from tabulon.functions import cells as C
from tabulon.operators.analyze import CLASSES, analyze, analyze_frame, matched
from tabulon.operators.relation import Sheet, from_dataframe
from tabulon.plans import model as M

FLEET = [("van", "north", True, 4), ("van", "north", True, 6.5), ("bus", "south", False, 9), ("van", "south", True, None), ("bus", "south", True, 30), ("tram", "east", True, 1)]
FLEET_COLUMNS = ["kind", "depot", "runs", "seats"]


def cell_sheet(spark, names, rows, first=2):
    schema = T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(f"c{k}", C.CELL) for k in range(len(names))]])
    return Sheet(spark.createDataFrame([(first + i, *map(C.of_python, r)) for i, r in enumerate(rows)], schema), tuple(names), "Fleet")


def kind_of(v):
    return None if v is None else M.Literal.of(v).type if not isinstance(v, C.ErrorCell) else "error"


class Bad(Exception):
    pass


def look(x, row):
    if x.kind == "and":
        return all(look(p, row) for p in x.expressions)
    if x.kind == "or":
        return any(look(p, row) for p in x.expressions)
    if x.kind == "not":
        return not look(x.expressions[0], row)
    v = row[x.column]
    if x.kind != "compare":
        return (v is None) == (x.kind == "isEmpty")
    w, k = x.value.value, kind_of(v)
    if k == "error" and x.op != "contains":
        raise Bad(x.column)
    if x.op == "contains":
        if k != "string" or x.value.type != "string":
            raise Bad(x.column)
        return w in v
    if v is None or w is None:
        both = v is None and w is None
        if x.op in ("eq", "notEq"):
            return both == (x.op == "eq")
        if not both:
            raise Bad(x.column)
        return x.op in ("le", "ge")
    if CLASSES[k] != CLASSES[x.value.type] or v != v or w != w:
        raise Bad(x.column)
    return {"eq": v == w, "notEq": v != w, "lt": v < w, "le": v <= w, "gt": v > w, "ge": v >= w}[x.op]


def interpret(names, rows, plan, first=2):
    groups, matched = {}, 0
    for i, values in enumerate(rows):
        row, at = dict(zip(names, values, strict=True)), first + i
        try:
            if plan.filter and not look(plan.filter, row):
                continue
            matched += 1
            key = []
            for g in plan.group_by:
                v = row[g]
                if isinstance(v, C.ErrorCell):
                    raise Bad(g)
                key.append((CLASSES.get(kind_of(v)), int(v) if isinstance(v, float) and v.is_integer() else v))
        except Bad as e:
            return ("error", str(e), at)
        if tuple(key) not in groups:
            if len(groups) == plan.max_groups:
                return ("groups", at)
            groups[tuple(key)] = {"first": [row[g] for g in plan.group_by], "values": [[] for _ in plan.aggregates], "rows": []}
        own = groups[tuple(key)]
        own["rows"].append(at)
        for a, seen in zip(plan.aggregates, own["values"], strict=True):
            v = row[a.column] if a.column else 1
            if v is None:
                continue
            k = kind_of(v)
            if a.op in ("sum", "average") and k not in ("int", "float") or a.op in ("min", "max") and (k == "error" or seen and CLASSES[kind_of(seen[0])] != CLASSES[k]):
                return ("error", a.column, at)
            seen.append(v)
    if not plan.group_by and not groups:
        groups[()] = {"first": [], "values": [[] for _ in plan.aggregates], "rows": []}
    out = []
    for own in list(groups.values())[: plan.limit]:
        done = []
        for a, v in zip(plan.aggregates, own["values"], strict=True):
            if a.op == "count":
                done.append(len(v))
            elif not v:
                done.append(None)
            else:
                done.append({"sum": lambda v=v: sum(v), "average": lambda v=v: float(sum(v)) / len(v), "min": lambda v=v: min(v), "max": lambda v=v: max(v)}[a.op]())
        out.append((*own["first"], *done, own["rows"][: plan.evidence_rows]))
    return ("rows", out, matched, len(groups))


def run(sheet, plan):
    try:
        r = analyze(sheet, plan)
    except AnalysisError as e:
        return ("error", e.column, e.row)
    except GroupLimitError as e:
        return ("groups", int(str(e).split()[-1]))
    rows = []
    for row in r.rows.collect():
        rows.append(tuple(C.to_python(v) if isinstance(v, T.Row) else v for v in row))
    return ("rows", rows, r.matched_rows, r.total_groups)


def same(a, b):
    if a[0] != "rows" or b[0] != "rows":
        return a == b
    tidy = lambda rows: [tuple((type(v) is bool, round(v, 6)) if isinstance(v, (int, float)) else v for v in r) for r in rows]
    return tidy(a[1]) == tidy(b[1]) and a[2:] == b[2:]


PLAN = M.Plan(group_by=("kind", "depot"), filter=M.any_of(M.compare("kind", "eq", "ferry"), M.all_of(M.negate(M.compare("depot", "eq", "east")), M.compare("runs", "notEq", False)))).select(
    M.Aggregate("max", "most", "seats"), M.Aggregate("min", "least", "seats"), M.Aggregate("average", "mean", "seats"), M.Aggregate("sum", "all_seats", "seats"), M.Aggregate("count", "known", "seats"), M.Aggregate("count", "n")
)


def test_golden_cells(spark):
    r = analyze(cell_sheet(spark, FLEET_COLUMNS, FLEET), PLAN)
    got = [tuple(C.to_python(v) if isinstance(v, T.Row) else v for v in x) for x in r.rows.collect()]
    assert got == [("van", "north", 6.5, 4, 5.25, 10.5, 2, 2, [2, 3]), ("van", "south", None, None, None, None, 0, 1, [5]), ("bus", "south", 30, 30, 30.0, 30, 1, 1, [6])]
    assert [type(x[5]) for x in got] == [float, type(None), int] and type(got[0][3]) is int
    assert (r.seen_rows, r.matched_rows, r.total_groups, r.returned_groups, r.truncated) == (6, 4, 3, 3, False)


def test_golden_typed(spark):
    df = spark.createDataFrame([(i, c, g, a, None if m is None else float(m)) for i, (c, g, a, m) in enumerate(FLEET)], "n int, kind string, depot string, runs boolean, seats double")
    sheet = from_dataframe(df, F.col("n") + 2)
    assert same(run(sheet, PLAN), interpret(FLEET_COLUMNS, FLEET, PLAN))
    assert analyze_frame(sheet, PLAN).drop("first_row").collect() == analyze(sheet, PLAN).rows.collect()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.5, dt.date(2020, 1, 2)), (2, None, None, None), (3, "abc", -2.0, dt.date(2021, 1, 2))], "n int, s string, x double, d date").write.parquet(f"{tmp_path}/t")
    sheet = from_dataframe(spark.read.parquet(f"{tmp_path}/t"), F.col("n") + 1)
    some = M.all_of(M.compare("n", "gt", 0), M.compare("s", "notEq", "x"))
    for x, pushed in [
        (M.compare("s", "eq", "a"), "EqualTo(s,a)"),
        (M.compare("n", "lt", 3), "LessThan(n,3)"),
        (M.compare("n", "le", 2.5), "LessThan"),
        (M.compare("x", "gt", -3.0), "GreaterThan(x,-3.0)"),
        (M.compare("x", "ge", 1), "GreaterThanOrEqual(x,1.0)"),
        (M.compare("d", "lt", dt.date(2021, 1, 1)), "LessThan(d,2021-01-01)"),
        (M.compare("s", "notEq", "a"), "Or(IsNull(s),Not(EqualTo(s,a)))"),
        (M.compare("s", "contains", "b"), "StringContains(s,b)"),
        (M.is_empty("s"), "IsNull(s)"),
        (M.is_not_empty("s"), "IsNotNull(s)"),
        (M.any_of(M.compare("s", "eq", "a"), M.all_of(M.compare("n", "eq", 3), some)), "Or(EqualTo(s,a)"),
    ]:
        kept = matched(sheet, M.Plan((M.Aggregate("count", "n"),), filter=x))
        plan = kept._jdf.queryExecution().explainString(kept.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert pushed in plan.partition("PushedFilters: ")[2].splitlines()[0], (x, plan)
        rows = [{"n": n, "s": s, "x": f, "d": d} for n, s, f, d in [(1, "a", 1.5, dt.date(2020, 1, 2)), (2, None, None, None), (3, "abc", -2.0, dt.date(2021, 1, 2))]]
        assert [r[0] for r in kept.select("_row").orderBy("_row").collect()] == [r["n"] + 1 for r in rows if totally(x, r)]


def totally(x, row):
    """look, where what can't be compared counts as false."""
    if x.kind in ("and", "or"):
        return (all if x.kind == "and" else any)(totally(p, row) for p in x.expressions)
    try:
        return look(x, row)
    except Bad:
        return False


VALUES = [None, "", "a", "ab", 0, 1, -1, 2.5, 1.0, True, dt.date(2020, 1, 2), dt.datetime(2020, 1, 2), dt.time(1, 2), dt.timedelta(hours=3), C.ErrorCell("#N/A")]
cells = st.one_of(st.sampled_from(VALUES), st.sampled_from([None, "a", 1, 2.5]))
literals = st.sampled_from([M.Literal.of(v) for v in VALUES if not isinstance(v, C.ErrorCell)])
column = st.sampled_from(["p", "q"])
leaf = st.one_of(st.builds(M.compare, column, st.sampled_from(M.COMPARISONS), literals), st.builds(M.is_empty, column), st.builds(M.is_not_empty, column))
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3).map(lambda p: M.all_of(*p)), st.lists(x, max_size=3).map(lambda p: M.any_of(*p)), x.map(M.negate)), max_leaves=5)


@st.composite
def plans(draw):
    by = draw(st.sampled_from([(), ("p",), ("q", "p")]))
    own = [M.Aggregate("count", "n"), M.Aggregate(draw(st.sampled_from(M.AGGREGATES)), "x", draw(column))]
    return M.Plan(tuple(own), by, draw(st.none() | tree), draw(st.sampled_from([1, 3, 100])), draw(st.sampled_from([None, 1, 2])), draw(st.sampled_from([0, 2])))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(cells, cells), max_size=7), plan=plans())
def test_plans_are_the_interpreters(spark, rows, plan):
    assert same(run(cell_sheet(spark, ["p", "q"], rows), plan), interpret(["p", "q"], rows, plan)), (rows, plan)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from([None, "a", "ab", ""]), st.sampled_from([None, 1.0, 2.5, -3.0])), max_size=7), plan=plans())
def test_typed_plans_are_the_interpreters(spark, rows, plan):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, p string, q double")
    sheet = from_dataframe(df, F.col("n") + 2)
    sheet = Sheet(sheet.df.drop("c0").withColumnsRenamed({"c1": "c0", "c2": "c1"}), ("p", "q"))
    got, want = run(sheet, plan), interpret(["p", "q"], rows, plan)
    assert same(got, want), (rows, plan, got, want)


def test_nan_overflow_and_first_error(spark):
    sheet = cell_sheet(spark, ["x"], [(float("nan"),), (1.0,), (2,)])
    for op in ("min", "max"):
        assert run(sheet, M.Plan((M.Aggregate(op, "m", "x"),))) == ("error", "x", 3)
    assert run(cell_sheet(spark, ["x"], [(1,), (float("nan"),)]), M.Plan((M.Aggregate("max", "m", "x"),))) == ("error", "x", 3)
    assert run(sheet, M.Plan((M.Aggregate("count", "m"),), filter=M.compare("x", "lt", 3))) == ("error", "x", 2)
    with pytest.raises(Exception, match="OVERFLOW|CAST"):
        run(cell_sheet(spark, ["x"], [(2**63 - 1,), (1,)]), M.Plan((M.Aggregate("sum", "m", "x"),)))


def test_plan_document_and_validation():
    text = json.dumps(PLAN.to_json())
    assert M.Plan.from_json(text) == PLAN
    plan = M.Plan.from_json({"aggregates": [{"op": "count", "alias": "n"}], "later": 1, "version": "other.query-plan/v1"})
    assert (plan.max_groups, plan.limit, plan.evidence_rows, plan.group_by) == (10_000, None, 5, ())
    plan.validate([])
    for k in M.LITERALS[1:]:
        x = {"type": k, "value": {"bool": True, "int": 3, "float": 2.5, "date": "2020-01-02", "time": "01:02:03", "dateTime": "2020-01-02T03:04:05", "duration": 1500}.get(k, "s")}
        assert M.Literal.from_json(x).to_json() == x
    own = M.Aggregate("count", "n")
    bad = [M.Plan(), M.Plan((own, own)), M.Plan((M.Aggregate("sum", "s"),)), M.Plan((own,), ("n",)), M.Plan((own,), ("a", "a")), M.Plan((own,), ("",)), M.Plan((M.Aggregate("count", ""),)), M.Plan((own,), max_groups=0), M.Plan((own,), limit=0), M.Plan((own,), version="v2"), M.Plan((own,), ("zz", "b"))]
    for plan in bad:
        with pytest.raises(PlanError):
            plan.validate(["a"])
    with pytest.raises(PlanError, match="'b'"):
        bad[-1].validate(["a"])
    for x in ("[]", "{", {"filter": {"kind": "xor"}}, {"filter": {"kind": "compare", "column": "a", "op": "like", "value": {"type": "empty"}}}, {"aggregates": [{"op": "median"}]}, {"filter": {"kind": "compare", "column": "a", "op": "eq", "value": {"type": "int", "value": "1"}}}):
        with pytest.raises(PlanError):
            M.Plan.from_json(x)
    assert M.literal_for("integer", "eq", "12x") == M.Literal("int", 12) and M.literal_for("datetime", "eq", "2020-01-02T00:00") == M.Literal("dateTime", dt.datetime(2020, 1, 2))
    assert M.literal_for("boolean", "eq", "TRUE").value is True and M.literal_for("number", "contains", "1").type == "string"
    with pytest.raises(PlanError):
        M.literal_for("number", "eq", "inf")
