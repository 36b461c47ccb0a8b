"""Summaries of ``DataFrame.explain`` output.

Used by the tests to pin the plan shapes the operators are designed for:
filters pushed into the Parquet scan, only needed columns read, no
cartesian or nested-loop joins, a bounded number of shuffles.
"""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

# Physical operators that emit all pairs of rows; none of the shop queries
# may plan one.
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@dataclass
class Scan:
    location: str
    pushed_filters: str
    read_schema: str

    @property
    def columns(self) -> list[str]:
        inner = self.read_schema[len("struct<"):-1]
        return [c.split(":")[0] for c in re.split(r",(?![^<]*>)", inner) if c]


def scans(df: DataFrame) -> list[Scan]:
    text = plan_text(df)
    out = []
    for block in text.split("\n\n"):
        block = block.strip()
        if "Scan parquet" not in block.split("\n")[0]:
            continue
        loc = re.search(r"Location: \w+ \[(.*?)\]", block)
        pushed = re.search(r"PushedFilters: (\[.*\])", block)
        schema = re.search(r"ReadSchema: (struct<.*>)", block)
        out.append(Scan(loc.group(1) if loc else "", pushed.group(1) if pushed else "[]",
                        schema.group(1) if schema else "struct<>"))
    return out


def _initial_tree(df: DataFrame) -> str:
    text = plan_text(df)
    return text.split("\n\n")[0]


def count_nodes(df: DataFrame, name: str) -> int:
    """Occurrences of an operator in the (initial) physical plan tree."""
    return len(re.findall(rf"\b{name}\b[^\n(]*\(\d+\)", _initial_tree(df)))


def forbidden_nodes(df: DataFrame) -> list[str]:
    tree = _initial_tree(df)
    return [n for n in PAIRWISE if n in tree]


def scan_files(df: DataFrame) -> dict[str, int]:
    """Run ``df`` and return the number of files that its scans opened, by the last folder of a table's path."""
    query = df._jdf.queryExecution()
    df.collect()
    found: dict[str, int] = {}

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return visit(node.plan())
        if kind == "FileSourceScanExec":
            roots = node.relation().location().rootPaths()
            table = re.search(r"/data/([^/]+)/|([^/]+)$", roots.head().toString())
            name = table.group(1) or table.group(2)
            files = node.metrics().get("numFiles")
            found[name] = found.get(name, 0) + (files.get().value() if files.isDefined() else 0)
        children = node.children()
        for k in range(children.size()):
            visit(children.apply(k))

    visit(query.executedPlan())
    return found
