"""Integrity check: what the database enforced, reported as violations.

Spark does not enforce keys, NOT NULL or numeric(10,2) ranges, so a job
that changes tables runs this check on the result. Each rule is a
distributed scan, aggregation or anti join; all violations come back as one
DataFrame (table_name, rule, column_name, value, rows) with nothing
collected. Rule expressions are written as SQL expressions, one per
projection, so building the plan costs a handful of calls per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from overhaul.schema import KEYS, MONEY, REFERENCES, SCHEMAS

Tables = dict[str, DataFrame]

MONEY_LIMIT = 10 ** (MONEY.precision - MONEY.scale)  # |value| must stay below 1e8


def _q(name: str) -> str:
    return f"`{name}`"


def _row_ref(table: str) -> str:
    """SQL text that identifies a row: its key, or order_id:order_line."""
    if table in KEYS:
        return f"cast({_q(KEYS[table])} as string)"
    return "concat_ws(':', cast(order_id as string), cast(order_line as string))"


def money_too_large(df: DataFrame, name: str) -> str | None:
    """numeric(10,2) test for one column; None when its type cannot violate."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DecimalType) and dtype.precision - dtype.scale <= MONEY.precision - MONEY.scale:
        return None
    rounded = f"round(try_cast({_q(name)} as decimal(38,6)), 2)"
    return f"({_q(name)} is not null and ({rounded} is null or abs({rounded}) >= {MONEY_LIMIT}))"


def row_violations(df: DataFrame, table: str) -> DataFrame | None:
    """NOT NULL and numeric(10,2) violations, all rules in one scan.

    Each row yields the list of rules it breaks; the list is exploded, so a
    clean row produces nothing.
    """
    checks = []
    for f in SCHEMAS[table].fields:
        if f.name not in df.columns:
            continue
        if not f.nullable:
            checks.append((f"{_q(f.name)} is null", "not_null", f.name))
        if f.dataType == MONEY:
            bad = money_too_large(df, f.name)
            if bad is not None:
                checks.append((bad, "numeric_10_2", f.name))
    if not checks:
        return None
    cases = ", ".join(f"case when {c} then named_struct('rule', '{r}', 'column_name', '{n}') end"
                      for c, r, n in checks)
    return (df.selectExpr(f"{_row_ref(table)} as value",
                          f"explode(filter(array({cases}), x -> x is not null)) as v")
              .selectExpr(f"'{table}' as table_name", "v.rule as rule", "v.column_name as column_name",
                          "value", "cast(1 as bigint) as rows"))


def key_violations(df: DataFrame, table: str) -> DataFrame | None:
    """Key values held by more than one row, with the number of rows."""
    if table not in KEYS:
        return None
    key = _q(KEYS[table])
    dup = df.selectExpr(f"{key} as k").where("k is not null").groupBy("k").count().where("count > 1")
    return dup.selectExpr(f"'{table}' as table_name", "'unique_key' as rule",
                          f"'{KEYS[table]}' as column_name", "cast(k as string) as value",
                          "cast(count as bigint) as rows")


def reference_violations(t: Tables) -> DataFrame:
    """Child values without a parent row, with the number of child rows.

    Each child table is scanned once for all its references and each parent
    once for all references to it: child values become (reference, value)
    pairs counted per pair (a heavily used value collapses map-side), then
    one anti join on (reference, value) against the parents' keys.
    """
    refs = list(enumerate(REFERENCES))
    used = []
    for child in dict.fromkeys(r.child for _, r in refs):
        pairs = ", ".join(f"named_struct('ref', {i}, 'value', cast({_q(r.column)} as bigint))"
                          for i, r in refs if r.child == child)
        used.append(t[child].selectExpr(f"inline(array({pairs}))"))
    counted = (reduce(DataFrame.unionByName, used).where("value is not null")
               .groupBy("ref", "value").count())
    parents = []
    for parent in dict.fromkeys(r.parent for _, r in refs):
        idx = ", ".join(str(i) for i, r in refs if r.parent == parent)
        parents.append(t[parent].selectExpr(f"explode(array({idx})) as ref",
                                            f"cast({_q(KEYS[parent])} as bigint) as value"))
    missing = counted.join(reduce(DataFrame.unionByName, parents), ["ref", "value"], "left_anti")

    def pick(values):
        return "element_at(array(" + ", ".join(f"'{v}'" for v in values) + "), ref + 1)"

    return missing.selectExpr(
        f"{pick(r.child for _, r in refs)} as table_name",
        f"{pick('references_' + r.parent for _, r in refs)} as rule",
        f"{pick(r.column for _, r in refs)} as column_name",
        "cast(value as string) as value", "cast(count as bigint) as rows")


def check_tables(t: Tables) -> DataFrame:
    """All violations of NOT NULL, primary keys, references and money ranges."""
    parts = []
    for table in SCHEMAS:
        if table in t:
            parts += [p for p in (row_violations(t[table], table), key_violations(t[table], table))
                      if p is not None]
    parts.append(reference_violations(t))
    return reduce(DataFrame.unionByName, parts)
