"""Exact money arithmetic on decimals.

Amounts are rounded per line before any sum, half away from zero (Spark's
``round`` on decimals is HALF_UP). Nothing here goes through double.
Arguments are column names; each function returns one SQL expression (so a
plan is built with one call per expression).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from overhaul.schema import AMOUNT, TOTAL


def _q(name: str) -> str:
    return f"`{name}`"


def line_amount_sql(price: str, quantity: str) -> str:
    return f"cast(round({_q(price)} * {_q(quantity)}, 2) as {AMOUNT.simpleString()})"


def line_amount(price: str, quantity: str) -> Column:
    """round(price * quantity, 2) as decimal(20,2); NULL if either is NULL."""
    return F.expr(line_amount_sql(price, quantity))


def line_amount_net_sql(price: str, quantity: str, percent_off: str) -> str:
    factor = f"((100BD - cast({_q(percent_off)} as decimal(10,0))) * 0.01BD)"
    return f"cast(round({_q(price)} * {_q(quantity)} * {factor}, 2) as {AMOUNT.simpleString()})"


def line_amount_net(price: str, quantity: str, percent_off: str) -> Column:
    """round(price * quantity * (100 - percent_off) / 100, 2).

    A NULL percent gives NULL, which ``sum`` skips (the order gets no
    discounted amount for that line).
    """
    return F.expr(line_amount_net_sql(price, quantity, percent_off))


def to_total(name: str) -> Column:
    """Cast a sum of amounts or quantities to the report type decimal(38,2)."""
    return F.expr(f"cast({_q(name)} as {TOTAL.simpleString()})")


def pay(ktu: str, coeff: int, orders_sum: str) -> Column:
    """round(ktu * coeff * coalesce(orders_sum, 0) / 10000, 2), exact.

    ktu and coeff are percentages. The product is formed in decimal with the
    sum cast to decimal(38,2) first, so no scale is lost to the 38-digit cap.
    """
    total = TOTAL.simpleString()
    weight = f"cast(cast({_q(ktu)} as bigint) * {int(coeff)}L as decimal(20,0))"
    amount = f"coalesce(cast({_q(orders_sum)} as {total}), cast(0 as {total}))"
    return F.expr(f"cast(round({weight} * {amount} * 0.0001BD, 2) as {total})")


def round_avg(total_col: str, count_col: str) -> Column:
    """round(sum / count, 2), half away from zero, from an exact integer sum.

    Used for the average ktu of the pay report (the database averages
    integers as numeric). Division carries 18 decimals before the final round.
    """
    s, n = _q(total_col), _q(count_col)
    return F.expr(f"cast(case when {n} > 0 then round(cast({s} as decimal(20,0)) / "
                  f"cast({n} as decimal(20,0)), 2) end as decimal(12,2))")
