"""Plan checks: read what Catalyst chose, from ``explain`` text."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def pushed_filters(df: DataFrame) -> list[str]:
    """``PushedFilters`` lists of every parquet scan in the physical plan."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df))


def operators(df: DataFrame) -> list[str]:
    """Physical operator names, in plan order (formatted mode)."""
    return re.findall(r"^\(\d+\) (\w+)", plan_text(df), flags=re.M)


def scans(df: DataFrame) -> list[tuple[str, int]]:
    """(path or table, rows that came out of it) of every file scan of an executed DataFrame.

    A scan that adaptive execution reuses counts once.  Call it after an action on ``df``.
    """
    seen, out = set(), []

    def visit(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "ReusedExchangeExec":
            return None
        if name == "FileSourceScanExec" and node.id() not in seen:
            seen.add(node.id())
            where = node.tableIdentifier()
            label = where.get().table() if where.isDefined() else node.relation().location().rootPaths().mkString(",")
            out.append((label, node.metrics().apply("numOutputRows").value()))
        for i in range(node.children().size()):
            visit(node.children().apply(i))
        return None

    visit(df._jdf.queryExecution().executedPlan())
    return out
