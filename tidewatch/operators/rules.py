"""User expressions over tables: all rules of a table in one aggregate, unreadable rules as rows with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GROUP = "_rule_group"


@dataclass(frozen=True)
class Rule:
    """An aggregate expression over a table, perhaps over some of its rows only."""

    id: str
    table: str
    expression: str
    where: str | None = None


def safe_expr(text: str) -> Column:
    """A user expression; statements are refused."""
    if ";" in text:
        raise ValueError(f"expression must not hold a statement separator: {text!r}")
    return F.expr(text)


def _reason(e: Exception) -> str:
    """First line of an error, without where in a plan it happened."""
    return str(e).strip().split("\n")[0].split(" SQLSTATE")[0].strip() or type(e).__name__


def problem_of(rule: Rule, tables: dict[str, DataFrame], kind: str) -> str | None:
    """Why a rule can't be worked out, found without reading any row."""
    if rule.table not in tables:
        return f"unknown table {rule.table}"
    df = tables[rule.table]
    try:
        if rule.where:
            df = df.filter(safe_expr(rule.where))
        df.agg(safe_expr(rule.expression).cast(kind))
    except (ValueError, ParseException, AnalysisException) as e:
        return _reason(e)
    return None


def _on_one_table(df: DataFrame, rules: list[Rule], kind: str) -> DataFrame:
    """(rule, value): one scan; a row counts once for each different condition it meets."""
    wheres = list(dict.fromkeys(r.where or "" for r in rules))
    expressions = list(dict.fromkeys(r.expression for r in rules))
    values = [safe_expr(e).cast(kind).alias(f"e{i}") for i, e in enumerate(expressions)]
    hits = [F.when(safe_expr(w), i) if w else F.lit(i) for i, w in enumerate(wheres)]
    found = df.withColumn(GROUP, F.explode(F.array_compact(F.array(*hits)))).groupBy(GROUP).agg(*values)
    # A condition no row meets leaves the value over no rows.
    empty = df.limit(0).agg(*values).withColumn(GROUP, F.explode(F.array(*[F.lit(i) for i in range(len(wheres))])))
    both = found.withColumn("_o", F.lit(0)).unionByName(empty.withColumn("_o", F.lit(1)))
    one = both.groupBy(GROUP).agg(*[F.min_by(f"e{i}", "_o").alias(f"e{i}") for i in range(len(expressions))])
    entries = F.array(*[
        F.struct(F.lit(r.id).alias("rule"), F.lit(wheres.index(r.where or "")).alias("at"), F.col(f"e{expressions.index(r.expression)}").alias("value")) for r in rules])
    return one.select(GROUP, F.explode(entries).alias("x")).filter(F.col("x.at") == F.col(GROUP)).select("x.rule", "x.value")


def rule_values(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Rule], kind: str) -> DataFrame:
    """(rule, value, problem): the value of every rule, each table read once.

    Rules are settings, so their number is the driver's to hold. What can't be parsed or resolved becomes a row with the
    reason and leaves the others alone; values that fail on the data follow the session's setting for such errors.
    """
    problems = {r.id: problem_of(r, tables, kind) for r in rules}
    out = spark.createDataFrame([(k, None, p) for k, p in problems.items() if p], f"rule string, value {kind}, problem string")
    for name in dict.fromkeys(r.table for r in rules):
        good = [r for r in rules if r.table == name and not problems[r.id]]
        if good:
            out = out.unionByName(_on_one_table(tables[name], good, kind).withColumn("problem", F.lit(None).cast("string")))
    return out
