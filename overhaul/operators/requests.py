"""Which save requests a database would refuse, request by request, and why.

A request breaks a rule if it leaves a NOT NULL column empty, refers to a row
that its parent table does not have, or carries an amount beyond numeric(10,2).
An update of an unknown key touches no row and therefore breaks none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.joins import split_join
from overhaul.operators import changes
from overhaul.operators.integrity import money_too_large
from overhaul.schema import KEYS, MONEY, REFERENCES, SCHEMAS, not_null_columns
from overhaul.session import materialize

Tables = dict[str, DataFrame]

# Columns that a save request writes, where these are not all: a purchase request
# carries a sum, but the service never stores it.
WRITTEN = {"purchases": ["purchase_date", "trader", "material_id", "price", "quantity"]}


def written_columns(name: str) -> list[str]:
    return WRITTEN.get(name) or [c for c in SCHEMAS[name].names if c != KEYS[name]]


def judged(t: Tables, name: str, requests: DataFrame) -> DataFrame:
    """``requests`` to save rows of table ``name``, each with ``faults``: the (rule, column_name) that it breaks.

    Each reference and the key itself is one join with the parent's keys (one
    row each), which Spark can split where many requests name one parent. Keys
    are small in a compressed file and large in memory, so they are merged, not
    sent whole to every task.
    """
    key, written = KEYS[name], written_columns(name)
    new = F.col(key).isNull() | (F.col(key) == 0)
    known = t[name].select(key, F.lit(True).alias("_there")).hint("merge")
    df = split_join(requests, known, [key], "left")
    faults = []
    for c in written:
        if c in not_null_columns(name):
            faults.append((F.col(c).isNull(), "not_null", c))
        if SCHEMAS[name][c].dataType == MONEY and (test := money_too_large(requests, c)):
            faults.append((F.expr(test), "numeric_10_2", c))
    for r in REFERENCES:
        if r.child == name and r.column in written:
            flag = f"_has_{r.column}"
            parents = t[r.parent].select(F.col(KEYS[r.parent]).alias(r.column), F.lit(True).alias(flag)).hint("merge")
            df = split_join(df, parents, [r.column], "left")
            faults.append((F.col(r.column).isNotNull() & F.col(flag).isNull(), f"references_{r.parent}", r.column))
    counts = new | F.col("_there")
    listed = F.array(*(F.when(test & counts, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name")))
                       for test, rule, c in faults)) if faults else F.expr("cast(array() as array<struct<rule: string, column_name: string>>)")
    return df.select(*requests.columns, F.filter(listed, lambda x: x.isNotNull()).alias("faults"))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("faults") == 0).drop("faults")


def rejected(checked: DataFrame) -> DataFrame:
    """One row for each rule that a request breaks: its columns, rule, column_name."""
    return checked.select(*[c for c in checked.columns if c != "faults"], F.inline("faults"))


def save_checked(t: Tables, name: str, requests: DataFrame, seq: str = "seq", start: int | None = None):
    """``changes.apply_saves`` of the requests that break no rule. Returns (new table, refused requests with rule
    and column). A refused request changes nothing; of several for one key the last one that is left wins."""
    checked = materialize(judged(t, name, requests), "judged")
    return changes.apply_saves(t[name], valid(checked), KEYS[name], seq, start, written_columns(name)), rejected(checked)
