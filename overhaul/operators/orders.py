"""Order listings and order documents (header plus three child lists)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.filters import equals_unless, in_days, where_all
from overhaul.functions.joins import split_join
from overhaul.functions.money import line_amount, line_amount_net, line_amount_sql, to_total
from overhaul.functions.ranking import positions_within
from overhaul.schema import TOTAL

Tables = dict[str, DataFrame]

ORDER_COLUMNS = ("order_id", "order_date", "car", "card_number", "percent_off")
LINE_COLUMNS = ("kind", "position", "order_line", "item_id", "item_name", "price", "quantity", "amount", "ktu")


def select_orders(t: Tables, card_number: str = "", begin=None, end=None) -> DataFrame:
    return where_all(t["orders"], equals_unless("card_number", card_number, ""),
                     in_days("order_date", begin, end))


def order_list(t: Tables, card_number: str = "", begin=None, end=None) -> DataFrame:
    """Orders with the card's telephone, the number of service lines and the
    gross and discounted totals (lines rounded before summing; 0 without
    lines); sorted by order date.

    Lines are summed per order in two steps (before and after the shuffle), so
    the header is joined to one row per order. Cards are aggregated per number:
    should a number repeat, the telephone is the largest and the counts and
    totals are multiplied by the number of copies, exactly as the original join
    of orders, cards and lines counts them. Orders without a card (NULL or '')
    bypass the join with the cards; a hot card or order is split.
    """
    orders = select_orders(t, card_number, begin, end)
    pct = orders.select("order_id", "percent_off")
    lines = t["order_services"].select("order_id", "order_line", "price", "quantity")
    lines = (split_join(lines, pct, ["order_id"])
             .groupBy("order_id")
             .agg(F.count("order_line").alias("order_lines"),
                  F.sum(line_amount("price", "quantity")).alias("total"),
                  F.sum(line_amount_net("price", "quantity", "percent_off")).alias("discounted_total")))
    phones = (t["discount_cards"].groupBy("card_number")
              .agg(F.max("customer_telephone").alias("customer_telephone"), F.count(F.lit(1)).alias("_copies")))
    no_card = F.coalesce(F.col("card_number") == "", F.lit(True))
    without = orders.where(no_card).withColumns({
        "customer_telephone": F.lit(None).cast("string"), "_copies": F.lit(None).cast("long")})
    with_phones = (split_join(orders.where(~no_card), phones.where("card_number <> ''"), ["card_number"], "left")
                   .unionByName(without))
    return (with_phones.join(lines, "order_id", "left")
            .selectExpr(*ORDER_COLUMNS, "customer_telephone", "coalesce(_copies, 1) as _k",
                        "order_lines", "total", "discounted_total")
            .selectExpr(*ORDER_COLUMNS, "customer_telephone",
                        "coalesce(order_lines, 0L) * _k as order_lines",
                        f"cast(coalesce(total * cast(_k as decimal(20,0)), 0) as {TOTAL.simpleString()}) as total",
                        f"cast(coalesce(discounted_total * cast(_k as decimal(20,0)), 0) as {TOTAL.simpleString()})"
                        " as discounted_total")
            .orderBy(F.asc_nulls_last("order_date"), "order_id"))


def order_documents(t: Tables, begin=None, end=None, card_number: str = "",
                    keys: DataFrame | None = None) -> DataFrame:
    """Order documents for the selected orders (date range, card, or a key set).

    Each document is the header plus three arrays sorted by order_line:
    order_services (with service_name and the line sum, 0 when the price is
    missing), order_materials (with material_name) and order_staffers (with
    staffer_name). An order without children gets empty arrays. Children are
    grouped per order *before* joining the header, so the lists never
    multiply each other.
    """
    header = select_orders(t, card_number, begin, end)
    if keys is not None:
        header = header.join(keys.select("order_id"), "order_id", "left_semi")
    ids = header.select("order_id")

    # (child table, dimension, dimension key, SQL of the item struct)
    children = {
        "order_services": ("services", "service_id", "service_name",
                           "named_struct('order_id', order_id, 'order_line', order_line, 'service_id', service_id, "
                           "'price', price, 'quantity', quantity, 'service_name', service_name, 'sum', "
                           f"coalesce({line_amount_sql('price', 'quantity')}, 0.00BD))"),
        "order_materials": ("materials", "material_id", "material_name",
                            "named_struct('order_id', order_id, 'order_line', order_line, "
                            "'material_id', material_id, 'quantity', quantity, 'material_name', material_name)"),
        "order_staffers": ("staffers", "staffer_id", "staffer_name",
                           "named_struct('order_id', order_id, 'order_line', order_line, "
                           "'staffer_id', staffer_id, 'ktu', ktu, 'staffer_name', staffer_name)"),
    }
    doc = header
    for name, (dim, key, label, item) in children.items():
        arr = (t[name].join(ids, "order_id", "left_semi")
               .join(t[dim].select(key, label), key, "left")
               .groupBy("order_id").agg(F.expr(f"array_sort(collect_list({item})) as {name}")))
        array_type = arr.schema[name].dataType.simpleString()
        doc = doc.join(arr, "order_id", "left").withColumn(
            name, F.expr(f"coalesce({name}, cast(array() as {array_type}))"))
    return doc.select(*ORDER_COLUMNS, *children)


def flatten_documents(docs: DataFrame) -> DataFrame:
    """One row per child item (position from 0), with the header repeated.

    An empty list yields one row of its kind with NULL position, so documents
    without children stay visible. Used to compare documents with a flat SQL
    oracle.
    """
    def part(kind, arr, item_id, item_name, price, quantity, amount, ktu):
        def field(f, typ, out):
            return f"it.{f} as {out}" if f else f"cast(null as {typ}) as {out}"
        return (docs.selectExpr(*ORDER_COLUMNS, f"posexplode_outer({arr}) as (position, it)")
                .selectExpr(*ORDER_COLUMNS, f"'{kind}' as kind", "cast(position as int) as position",
                            "it.order_line as order_line", f"it.{item_id} as item_id",
                            f"it.{item_name} as item_name", field(price, "decimal(10,2)", "price"),
                            field(quantity, "decimal(10,2)", "quantity"), field(amount, "decimal(20,2)", "amount"),
                            field(ktu, "int", "ktu")))

    return (part("service", "order_services", "service_id", "service_name", "price", "quantity", "sum", None)
            .unionByName(part("material", "order_materials", "material_id", "material_name",
                              None, "quantity", None, None))
            .unionByName(part("staffer", "order_staffers", "staffer_id", "staffer_name",
                              None, None, None, "ktu")))


def document_lines(t: Tables, begin=None, end=None, card_number: str = "",
                   keys: DataFrame | None = None) -> DataFrame:
    """The order documents as lines, the same rows as
    ``flatten_documents(order_documents(...))``, computed without gathering
    any order in one task.

    Each child line gets its position inside (order, kind) from a
    distributed numbering (``functions.ranking.positions_within``), so an
    order with a huge number of lines is spread over many tasks; lists that
    are empty give one row of their kind with a NULL position.
    """
    header = select_orders(t, card_number, begin, end)
    if keys is not None:
        header = header.join(keys.select("order_id"), "order_id", "left_semi")
    ids = header.select("order_id")
    null = "cast(null as {}) as {}".format
    kinds = {
        "service": ("order_services", "services", "service_id", "service_name",
                    ["price", "quantity", f"coalesce({line_amount_sql('price', 'quantity')}, 0.00BD) as amount",
                     null("int", "ktu")]),
        "material": ("order_materials", "materials", "material_id", "material_name",
                     [null("decimal(10,2)", "price"), "quantity", null("decimal(20,2)", "amount"),
                      null("int", "ktu")]),
        "staffer": ("order_staffers", "staffers", "staffer_id", "staffer_name",
                    [null("decimal(10,2)", "price"), null("decimal(10,2)", "quantity"),
                     null("decimal(20,2)", "amount"), "ktu"]),
    }
    parts = []
    for kind, (child, dim, key, label, rest) in kinds.items():
        parts.append(t[child].join(ids, "order_id", "left_semi")
                     .join(t[dim].select(key, label), key, "left")
                     .selectExpr("order_id", f"'{kind}' as kind", "order_line", f"{key} as item_id",
                                 f"{label} as item_name", *rest))
    lines = reduce(DataFrame.unionByName, parts)
    ranked = positions_within(lines, ["order_id", "kind"],
                              ["order_line", "item_id", "price", "quantity", "ktu", "item_name"])
    present = lines.select("order_id", "kind").distinct()
    empty = (ids.selectExpr("order_id", "explode(array('service', 'material', 'staffer')) as kind")
             .join(present, ["order_id", "kind"], "left_anti")
             .selectExpr("order_id", "kind", "cast(null as int) as position", "cast(null as int) as order_line",
                         "cast(null as bigint) as item_id", "cast(null as string) as item_name",
                         "cast(null as decimal(10,2)) as price", "cast(null as decimal(10,2)) as quantity",
                         "cast(null as decimal(20,2)) as amount", "cast(null as int) as ktu"))
    body = ranked.unionByName(empty)
    return header.join(body, "order_id").select(*ORDER_COLUMNS, *LINE_COLUMNS)
