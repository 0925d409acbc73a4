"""Filter, group, aggregate: the plan over a sheet.

Everything is one partial/final hash aggregate over the referenced columns. First-seen order is
``min(_row)``; evidence rows are the first row numbers of a group, cut by a window group limit
before they are shuffled. Errors are expressions, so the first offending cell in sheet order is
found in the same pass, whatever the order in which tasks run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError, GroupLimitError
from tabulon.functions import cells as C
from tabulon.operators.relation import ROW, Sheet
from tabulon.plans.compile import NUMBERS, Input, compile_filter, fail
from tabulon.plans.model import Aggregate, Plan

#: Kinds whose values compare with each other.
CLASSES = {"bool": "bool", "int": "number", "float": "number", "string": "string", "date": "date", "time": "time", "dateTime": "dateTime", "duration": "duration"}
#: The order in which a row's parts are looked at: filter, group keys, the group limit, aggregates.
FILTER, GROUP, LIMIT, AGGREGATE = 0, 1, 2, 3


@dataclass(frozen=True)
class AnalysisResult:
    """rows: group columns, then aliases, then source_rows, in first-seen order."""

    rows: DataFrame
    sheet: str
    plan: Plan
    seen_rows: int
    matched_rows: int
    total_groups: int
    returned_groups: int
    truncated: bool


def _key(c: Input) -> Column:
    """What groups compare by: whole floats join integers, -0.0 joins 0.0, empty is a group."""
    if c.kind:
        return F.when(c.column == 0, F.lit(0.0)).otherwise(c.column) if c.kind == "float" else c.column
    f = c.column["f"]
    whole = (c.column["kind"] == "float") & (f == F.floor(f)) & (F.abs(f) < 2.0**63)
    number = F.when(whole, f.cast("long")).otherwise(c.column["i"])
    parts = [F.when(whole, "int").otherwise(c.column["kind"]).alias("kind"), number.alias("i"), F.when(~whole, f).alias("f")]
    return F.when(c.column.isNotNull(), F.struct(*parts, *[c.column[x].alias(x) for x in ("b", "s", "d", "us", "ts", "dur")]))


def _row_error(c: Input, op: str) -> Column | None:
    """What a single cell can do wrong in an aggregate or as a group key (op "group")."""
    if op == "count":
        return None
    if op in ("sum", "average"):
        if c.kind:
            return None if c.kind in NUMBERS else F.when(c.column.isNotNull(), fail(c.name, f"{op} needs numbers, not {c.kind}"))
        return F.when(c.column.isNotNull() & ~c.column["kind"].isin(*NUMBERS), fail(c.name, F.concat(F.lit(f"{op} needs numbers, not "), c.column["kind"])))
    return None if c.kind else F.when(c.has("error"), fail(c.name, f"an error cell can't be used in {op}"))


def _order(c: Input, *last: Column) -> Column:
    """A struct that orders cells of one class."""
    return F.struct(c.number().alias("n"), *[c.column[x].alias(x) for x in ("b", "s", "d", "us", "ts", "dur")], *last)


def _class(c: Input) -> Column:
    out = F
    for kind, name in CLASSES.items():
        out = out.when(c.column["kind"] == kind, name)
    return out.otherwise(None)


def _number_cell(value: Column, whole: Column | None) -> Column:
    """A cell of a double, or of the integer if given and not null."""
    is_int = whole.isNotNull() if whole is not None else F.lit(False)
    fields = [F.when(is_int, "int").otherwise("float").alias("kind")]
    for f in C.CELL.fields[1:]:
        v = F.when(is_int, whole) if f.name == "i" and whole is not None else F.when(~is_int, value) if f.name == "f" else F.lit(None)
        fields.append(v.cast(f.dataType).alias(f.name))
    return F.when(value.isNotNull() | is_int, F.struct(*fields))


def _aggregate(a: Aggregate, c: Input | None) -> Column:
    if a.op == "count":
        return F.count(F.lit(1)) if c is None else F.count(c.column)
    if c.kind:
        if a.op in ("sum", "average") and c.kind not in NUMBERS:
            return F.lit(None).cast("double")  # only for rows that are all empty; others are an error
        if a.op == "sum":
            return F.sum(c.column.cast("decimal(38,0)")).cast("long") if c.kind == "int" else F.sum(c.column.cast("double"))
        if a.op == "average":
            return F.avg(c.column.cast("double"))
        return F.min(c.column) if a.op == "min" else F.max(c.column)
    if a.op == "sum":
        whole = F.when(F.max(c.has("float").cast("int")) == 1, None).otherwise(F.sum(c.column["i"].cast("decimal(38,0)"))).cast("long")
        return _number_cell(F.sum(c.number()), whole)
    if a.op == "average":
        return F.avg(c.number())
    # of equal values the first
    if a.op == "min":
        return F.min_by(c.column, F.when(c.column.isNotNull(), _order(c, F.col(ROW))))
    return F.max_by(c.column, F.when(c.column.isNotNull(), _order(c, -F.col(ROW))))


def _first_errors(plan: Plan, inputs: dict[str, Input]) -> list[Column]:
    """Per group: (row, order, error) of the first cell that doesn't go with those before it."""
    out = []
    for k, a in enumerate(plan.aggregates):
        if a.op not in ("min", "max"):
            continue
        c = inputs[a.column]
        if c.kind is None:
            # the earliest row of each class: the second of them is where kinds first mix
            firsts = [F.min(F.when(_class(c) == x, F.col(ROW))) for x in dict.fromkeys(CLASSES.values())]
            out.append(F.struct(F.get(F.array_sort(F.array_compact(F.array(*firsts))), F.lit(1)).alias("row"), F.lit(AGGREGATE + k).alias("at"), F.lit(a.column).alias("column"), F.lit(f"{a.op} of values of several kinds").alias("message")))
        if c.kind in (None, "float"):
            number = c.number()
            nan = F.min(F.when(F.isnan(number), F.col(ROW)))
            # alone a NaN compares with nothing: it counts from the second number on
            first = F.min(F.when(number.isNotNull(), F.col(ROW)))
            other = F.min(F.when(number.isNotNull() & ~F.isnan(number), F.col(ROW)))
            last = F.max(F.when(F.isnan(number), F.col(ROW)))
            row = F.when((F.count(number) > 1) & nan.isNotNull(), F.when(nan > first, nan).otherwise(F.coalesce(other, last)))
            out.append(F.struct(row.alias("row"), F.lit(AGGREGATE + k).alias("at"), F.lit(a.column).alias("column"), F.lit(f"{a.op} of NaN").alias("message")))
    return out


def _prepared(sheet: Sheet, plan: Plan) -> tuple[DataFrame, dict[str, Input], Column | None, list[Column]]:
    """The referenced columns, the filter's value and error, and the errors of matched rows in order."""
    plan.validate(sheet.columns)
    inputs = {n: sheet.input(n) for n in sheet.columns if n in plan.columns()}
    return sheet.df, inputs, compile_filter(plan.filter, inputs) if plan.filter else None, [
        F.when(e.isNotNull(), F.struct(F.col(ROW).alias("row"), F.lit(at).alias("at"), e["column"].alias("column"), e["message"].alias("message")))
        for at, e in (
            *[(GROUP, _row_error(inputs[g], "group")) for g in plan.group_by],
            *[(AGGREGATE + k, _row_error(inputs[a.column], a.op)) for k, a in enumerate(plan.aggregates) if a.column],
        )
        if e is not None
    ]


def _grouped(df: DataFrame, plan: Plan, inputs: dict[str, Input], more: list[Column]) -> DataFrame:
    keys = [_key(inputs[g]).alias(f"k{n}") for n, g in enumerate(plan.group_by)]
    values = [(F.first(F.col(f"k{n}")) if inputs[g].kind else F.min_by(inputs[g].column, F.col(ROW))).alias(f"g{n}") for n, g in enumerate(plan.group_by) if not inputs[g].kind]
    own = [_aggregate(a, inputs.get(a.column)).alias(f"a{n}") for n, a in enumerate(plan.aggregates)]
    out = df.groupBy(*keys).agg(F.min(ROW).alias("first_row"), *values, *own, *more)
    return out


def _evidence(df: DataFrame, plan: Plan, inputs: dict[str, Input]) -> DataFrame:
    keys = [f"k{n}" for n in range(len(plan.group_by))]
    rows = df.select(ROW, *[_key(inputs[g]).alias(k) for k, g in zip(keys, plan.group_by, strict=True)])
    if not keys:
        return rows.orderBy(ROW).limit(plan.evidence_rows).agg(F.array_sort(F.collect_list(ROW)).alias("source_rows"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ROW))
    return rows.withColumn("rank", rank).where(F.col("rank") <= plan.evidence_rows).groupBy(*keys).agg(F.array_sort(F.collect_list(ROW)).alias("source_rows"))


def _finished(groups: DataFrame, evidence: DataFrame | None, plan: Plan, inputs: dict[str, Input]) -> DataFrame:
    none = F.array().cast("array<long>")
    if evidence is None:
        both = groups.withColumn("source_rows", none)
    elif plan.group_by:
        other = evidence.select(*[F.col(f"k{n}").alias(f"e{n}") for n in range(len(plan.group_by))], "source_rows")
        on = F.lit(True)
        for n in range(len(plan.group_by)):
            on = on & groups[f"k{n}"].eqNullSafe(other[f"e{n}"])
        both = groups.join(other, on, "left")
    else:
        both = groups.crossJoin(F.broadcast(evidence))  # one row each
    out = [F.col(f"k{n}" if inputs[g].kind else f"g{n}").alias(g) for n, g in enumerate(plan.group_by)]
    out += [F.col(f"a{n}").alias(a.alias) for n, a in enumerate(plan.aggregates)]
    both = both.orderBy("first_row")
    both = both.limit(plan.limit) if plan.limit else both
    return both.select(*out, "source_rows", "first_row")


def matched(sheet: Sheet, plan: Plan) -> DataFrame:
    """Rows that pass the filter; errors are not looked for."""
    df, _, term, _ = _prepared(sheet, plan)
    return df if term is None else df.where(term.rows)


def analyze_frame(sheet: Sheet, plan: Plan) -> DataFrame:
    """The result as a lazy DataFrame: group columns, aliases, source_rows, first_row. The group limit and cells' errors are not looked for: for sheets whose types rule errors out."""
    df, inputs, term, _ = _prepared(sheet, plan)
    rows = df if term is None else df.where(term.rows)
    evidence = _evidence(rows, plan, inputs) if plan.evidence_rows else None
    return _finished(_grouped(rows, plan, inputs, []), evidence, plan, inputs)


def _metrics(observation: Observation, df: DataFrame, *of: Column) -> dict:
    """What was observed; where the optimizer found the input empty and dropped the observation, it is computed."""
    try:
        found = observation.get
    except Exception:  # an observation without values can't be converted
        found = {}
    return found or df.agg(*of).first().asDict()


def analyze(sheet: Sheet, plan: Plan) -> AnalysisResult:
    """The result, with the plan's guarantees: the first error in sheet order raises, and so do more groups than allowed."""
    df, inputs, term, errors = _prepared(sheet, plan)
    seen = Observation()
    at = [F.struct(F.col(ROW).alias("row"), F.lit(FILTER).alias("at"), term.error["column"].alias("column"), term.error["message"].alias("message"))] if term is not None and term.error is not None else []
    metrics = [F.count(F.lit(1)).alias("seen")]
    if at:
        metrics.append(F.min_by(at[0], F.when(term.error.isNotNull(), F.col(ROW))).alias("error"))
    rows = df.observe(seen, *metrics)
    rows = rows if term is None else rows.where(term.rows)
    more = [F.count(F.lit(1)).alias("n_rows")]
    if errors:
        error = F.coalesce(*errors)
        more.append(F.min_by(error, F.when(error.isNotNull(), F.col(ROW))).alias("row_error"))
    mixed = _first_errors(plan, inputs)
    more += [x.alias(f"mixed{k}") for k, x in enumerate(mixed)]
    groups = _grouped(rows, plan, inputs, more)
    found = [*(["row_error"] if errors else []), *(f"mixed{k}" for k in range(len(mixed)))]
    worst = [F.min_by(F.col(n), F.when(F.col(n)["row"].isNotNull(), F.struct(F.col(n)["row"], F.col(n)["at"]))).alias(n) for n in found]
    all_groups = Observation()
    counted = groups.observe(all_groups, F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), *worst)
    # One job. The plan bounds what comes to the driver: max_groups rows, and one to tell that there are more.
    top = counted.orderBy("first_row").limit(plan.max_groups + 1).collect()
    total, whole = _metrics(all_groups, groups, F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), *worst), _metrics(seen, df, *metrics)
    candidates = [total[n] for n in found if total[n] is not None]
    if at and whole["error"] is not None:
        candidates.append(whole["error"])
    first = min(candidates, key=lambda e: (e["row"], e["at"]), default=None)
    if total["groups"] > plan.max_groups:
        # the row that would have opened one group too many
        opened = top[plan.max_groups]["first_row"]
        if first is None or (first["row"], first["at"]) > (opened, LIMIT):
            raise GroupLimitError(f"more than {plan.max_groups} groups, at row {opened}")
    if first is not None:
        raise AnalysisError(sheet.name, first["column"], first["row"], first["message"])
    plain = df if term is None else df.where(term.rows)
    evidence = _evidence(plain, plan, inputs) if plan.evidence_rows else None
    held = sheet.df.sparkSession.createDataFrame(top, groups.schema)
    returned = min(total["groups"], plan.limit) if plan.limit else total["groups"]
    return AnalysisResult(_finished(held, evidence, plan, inputs).drop("first_row"), sheet.name, plan, whole["seen"], total["rows"], total["groups"], returned, returned < total["groups"])
