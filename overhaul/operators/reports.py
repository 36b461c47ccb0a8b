"""The three analytic reports: works performed, material balance, mechanics' pay.

All take the dict of shop tables (see ``overhaul.sources``) and scalar
parameters and return a DataFrame sorted as the original service sorts it
(PostgreSQL order: NULLs last). ``collation`` names a collation to sort names by;
without one they sort by bytes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.filters import by_name, day_of, in_days, in_months, where_all
from overhaul.functions.idlists import summarize_with_id_lists
from overhaul.functions.joins import split_join
from overhaul.functions.money import (
    line_amount, line_amount_net_sql, line_amount_sql, pay, round_avg, to_total,
)
from overhaul.schema import KTU, TOTAL

Tables = dict[str, DataFrame]


def executed_works(t: Tables, begin=None, end=None, collation: str | None = None) -> DataFrame:
    """Works performed, per service *name*, for orders dated in [begin, end].

    Columns: sum (gross), orders (number of service lines with an order),
    average_percent_off (double), max_percent_off, service_name, order_ids
    (distinct order ids as sorted text), discount_sum. Lines whose order or
    service is missing are kept (outer joins) unless a date filter removes
    them.
    """
    lines = in_months(t["order_services"], begin, end).select("order_id", "service_id", "price", "quantity")
    days = in_days("order_date", begin, end)
    orders = in_months(t["orders"], begin, end).select(F.col("order_id").alias("o_order_id"), "order_date", "percent_off")
    services = t["services"].select("service_id", "service_name")
    joined = (lines.join(orders, lines["order_id"] == orders["o_order_id"], "left")
              .join(services, "service_id", "left"))
    joined = where_all(joined, days)
    out = summarize_with_id_lists(
        joined, ["service_name"],
        [("sum", "sum", line_amount_sql("price", "quantity")),
         ("orders", "count", "o_order_id"),
         ("pct_sum", "sum", "cast(percent_off as bigint)"),
         ("pct_n", "count", "percent_off"),
         ("max_percent_off", "max", "percent_off"),
         ("discount_sum", "sum", line_amount_net_sql("price", "quantity", "percent_off"))],
        {"order_ids": "o_order_id"},
    )
    zero = F.lit(0).cast(TOTAL)
    return out.select(
        F.coalesce(to_total("sum"), zero).alias("sum"),
        F.col("orders").cast("long").alias("orders"),
        F.when(F.col("pct_n") > 0, F.col("pct_sum").cast("double") / F.col("pct_n").cast("double"))
        .alias("average_percent_off"),
        F.col("max_percent_off"),
        F.col("service_name"),
        F.col("order_ids"),
        F.coalesce(to_total("discount_sum"), zero).alias("discount_sum"),
    ).orderBy(by_name("service_name", collation))


def executed_work_ids(t: Tables, begin=None, end=None) -> DataFrame:
    """The works report's id lists in long form: distinct (service_name, order_id).

    No group is gathered anywhere, whatever its size.
    """
    lines = in_months(t["order_services"], begin, end).select("order_id", "service_id")
    orders = where_all(in_months(t["orders"], begin, end), in_days("order_date", begin, end)).select("order_id")
    named = t["services"].select("service_id", "service_name")
    return (lines.join(orders, "order_id").join(named, "service_id", "left")
            .select("service_name", "order_id").distinct())


def material_move_ids(t: Tables, begin, end) -> DataFrame:
    """The balance's id lists in long form: distinct (material_id, kind, id) of
    the purchases and orders dated in [begin, end]."""
    bought = where_all(t["purchases"], in_days("purchase_date", begin, end)).select(
        "material_id", F.lit("purchase").alias("kind"), F.col("purchase_id").alias("id"))
    orders = where_all(t["orders"], in_days("order_date", begin, end)).select("order_id")
    used = t["order_materials"].join(orders, "order_id").select(
        "material_id", F.lit("order").alias("kind"), F.col("order_id").alias("id"))
    return bought.unionByName(used).distinct()


def materials_using(t: Tables, begin, end, only_available: bool = False, collation: str | None = None) -> DataFrame:
    """Material balance for the days [begin, end].

    One pass over all movements instead of four aggregates joined to the
    catalogue: purchases are incoming, order materials (dated by their order)
    outgoing; movements after ``end`` are pruned at the scan; one grouped
    aggregation computes the four sums and both id lists per material, then
    a single full outer join attaches the catalogue. With ``only_available``
    only materials with a positive closing balance remain.

    Tables of a store (``sources.store``) come with the sums of each month's
    movements: then months before ``begin`` are read as sums, one row for each
    material and part, and single movements from the first of that month on.
    """
    b, e = day_of(begin), day_of(end)
    if b is None or e is None:
        raise ValueError("materials_using needs both begin and end")
    summed = "purchase_sums" in t
    since = b.replace(day=1) if summed else None  # movements before it come as sums
    p = in_months(t["purchases"], since, e)
    incoming = p.where(in_days("purchase_date", since, e)).select(
        "material_id", F.col("purchase_date").alias("ts"), "quantity",
        F.lit(True).alias("is_in"), F.col("purchase_id").alias("ref_id"))
    orders = in_months(t["orders"], since, e).where(in_days("order_date", since, e)).select("order_id", "order_date")
    om = in_months(t["order_materials"], since, e).select("order_id", "material_id", "quantity")
    outgoing = om.join(orders, "order_id").select(
        "material_id", F.col("order_date").alias("ts"), "quantity",
        F.lit(False).alias("is_in"), F.col("order_id").alias("ref_id"))
    moves = incoming.unionByName(outgoing)
    if summed:
        for name, is_in in (("purchase_sums", True), ("material_sums", False)):
            before = t[name].where((F.col("month") > 0) & (F.col("month") < since.year * 100 + since.month))
            moves = moves.unionByName(before.select(
                "material_id", F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz").alias("ts"), "quantity",
                F.lit(is_in).alias("is_in"), F.lit(None).cast("long").alias("ref_id")))

    # Conditions on the movement kind and day, as SQL text for the aggregates.
    b_lit, e_next = f"timestamp_ntz'{b} 00:00:00'", f"timestamp_ntz'{e + dt.timedelta(days=1)} 00:00:00'"
    cond = {"in_before": f"is_in and ts < {b_lit}", "out_before": f"not is_in and ts < {b_lit}",
            "in_during": f"is_in and ts >= {b_lit} and ts < {e_next}",
            "out_during": f"not is_in and ts >= {b_lit} and ts < {e_next}"}
    totals = summarize_with_id_lists(
        moves, ["material_id"],
        [("incoming_sum_begin", "sum", f"case when {cond['in_before']} then quantity end"),
         ("outgoing_sum_begin", "sum", f"case when {cond['out_before']} then quantity end"),
         ("incoming_sum", "sum", f"case when {cond['in_during']} then quantity end"),
         ("outgoing_sum", "sum", f"case when {cond['out_during']} then quantity end"),
         ("n_ib", "count", f"case when {cond['in_before']} then 1 end"),
         ("n_ob", "count", f"case when {cond['out_before']} then 1 end"),
         ("n_i", "count", f"case when {cond['in_during']} then 1 end"),
         ("n_o", "count", f"case when {cond['out_during']} then 1 end")],
        {"purchase_ids": f"case when {cond['in_during']} then ref_id end",
         "order_ids": f"case when {cond['out_during']} then ref_id end"},
    )
    mats = t["materials"].select("material_id", "material_name", F.lit(True).alias("_known"))
    joined = mats.join(totals, "material_id", "full_outer")

    # A material of the catalogue gets one row with all four parts. An id
    # missing from the catalogue (impossible under the foreign keys, reported
    # by the integrity check) gets one row per part it occurs in, as the
    # original chain of full joins on the catalogue id produces.
    parts = [("incoming_sum_begin", "n_ib", None), ("outgoing_sum_begin", "n_ob", None),
             ("incoming_sum", "n_i", "purchase_ids"), ("outgoing_sum", "n_o", "order_ids")]
    fields = [p[0] for p in parts] + ["purchase_ids", "order_ids"]
    types = {f: joined.schema[f].dataType.simpleString() for f in fields}

    def piece(keep):
        return "named_struct(" + ", ".join(
            f"'{f}', " + (f if f in keep else f"cast(null as {types[f]})") for f in fields) + ")"

    orphan = ", ".join(f"case when {n} > 0 then {piece({s, lst})} end" for s, n, lst in parts)
    rows = (f"case when _known is not null then array({piece(fields)}) "
            f"else filter(array({orphan}), x -> x is not null) end")
    flat = joined.selectExpr("material_id", "material_name", f"inline({rows})")

    zero = F.lit(0).cast(TOTAL)
    ib = F.coalesce(to_total("incoming_sum_begin"), zero)
    ob = F.coalesce(to_total("outgoing_sum_begin"), zero)
    i = F.coalesce(to_total("incoming_sum"), zero)
    o = F.coalesce(to_total("outgoing_sum"), zero)
    out = flat.select(
        "material_id", "material_name", "purchase_ids", "order_ids",
        ib.alias("incoming_sum_begin"), ob.alias("outgoing_sum_begin"),
        (ib - ob).cast(TOTAL).alias("balance_begin"),
        i.alias("incoming_sum"), o.alias("outgoing_sum"),
        (ib - ob + i - o).cast(TOTAL).alias("balance_end"),
    )
    if only_available:
        out = out.where(F.col("balance_end") > 0)
    return out.orderBy(by_name("material_name", collation), F.asc_nulls_last("material_id")).drop("material_id")


def salary_details(t: Tables, begin, end, coeff: int) -> DataFrame:
    """Pay per (order, staffer line) for orders dated in [begin, end].

    orders_sum is the undiscounted sum of the order's rounded service lines
    (0 without lines); pay = round(ktu * coeff * orders_sum / 10000, 2).
    Duplicate staffer lines stay duplicated here.
    """
    if day_of(begin) is None or day_of(end) is None:
        raise ValueError("salary needs both begin and end")
    orders = in_months(t["orders"], begin, end).where(in_days("order_date", begin, end)).select("order_id")
    per_order = (split_join(in_months(t["order_services"], begin, end).select("order_id", "price", "quantity"), orders, ["order_id"])
                 .groupBy("order_id")
                 .agg(F.sum(line_amount("quantity", "price")).alias("orders_sum")))
    staff = in_months(t["order_staffers"], begin, end).select("order_id", "staffer_id", "ktu").join(orders, "order_id")
    detail = split_join(staff, per_order, ["order_id"], "left")
    return detail.select(
        "order_id", "staffer_id", "ktu",
        F.coalesce(to_total("orders_sum"), F.lit(0).cast(TOTAL)).alias("orders_sum"),
        pay("ktu", coeff, "orders_sum").alias("zp"),
    )


def salary(t: Tables, begin, end, coeff: int) -> DataFrame:
    """Mechanics' pay: detail rows plus one subtotal row per staffer.

    Detail rows (order_id, staffer_id, ktu, zp, orders_sum, staffer_name '')
    are de-duplicated, as the UNION of the original query does; the subtotal
    rows (order_id 0, average ktu rounded to 2 places, summed pay and order
    sums, the staffer's name) are computed over the rows *before*
    de-duplication, and only for staffers present in the staffer table.
    Sorted by staffer, the subtotal first.
    """
    d = salary_details(t, begin, end, coeff)
    # One aggregation with two grouping sets: grouping by all detail columns
    # yields each distinct detail row once (the UNION's de-duplication);
    # grouping by staffer sums the rows *before* de-duplication, as the
    # subtotal of the original does. The inputs are scanned once.
    cols = ["order_id", "staffer_id", "ktu", "zp", "orders_sum"]
    agg = d.groupingSets([cols, ["staffer_id"]], *cols).agg(
        F.grouping_id().alias("_gid"),
        F.sum(F.col("ktu").cast("long")).alias("ktu_sum"),
        F.count("ktu").alias("ktu_n"),
        F.sum("zp").alias("zp_sum"),
        F.sum("orders_sum").alias("orders_sum_sum"))
    # Subtotals only for staffers present in the staffer table (inner join
    # in the original); staffer_id is its key, so the join never fans out.
    staffers = t["staffers"].select("staffer_id", "staffer_name", F.lit(True).alias("_known"))
    detail = F.col("_gid") == 0
    return (agg.join(staffers, "staffer_id", "left")
            .where(detail | F.col("_known").isNotNull())
            .select(
                F.when(detail, F.col("order_id")).otherwise(F.lit(0).cast("long")).alias("order_id"),
                "staffer_id",
                F.when(detail, F.col("ktu").cast(KTU)).otherwise(round_avg("ktu_sum", "ktu_n")).alias("ktu"),
                F.when(detail, F.col("zp")).otherwise(to_total("zp_sum")).alias("zp"),
                F.when(detail, F.col("orders_sum")).otherwise(to_total("orders_sum_sum")).alias("orders_sum"),
                F.when(detail, F.lit("")).otherwise(F.col("staffer_name")).alias("staffer_name"))
            .orderBy(F.asc_nulls_last("staffer_id"), F.asc_nulls_last("order_id")))
