"""The registered workload: every operator as a query over the test data.

Each entry maps a name to a callable ``(spark, sf_dir) -> DataFrame`` and to
an independent SQL text (DuckDB dialect, written to the original semantics,
literal joins and aggregates) over the same source tables. Parameters are
fixed days inside the test data's range; no query restricts the input to a
subset of ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.operators import catalog, integrity, orders, purchases, reports
from overhaul.operators import changes as ch
from overhaul.sources.testdata import shop_tables, with_views

# Fixed parameters of the registered queries.
WORKS_DAYS = ("1999-01-01", "1999-01-31")
BALANCE_DAYS = ("1999-01-10", "1999-01-20")
PAY_DAYS = ("1999-01-01", "1999-03-31")
PAY_COEFF = 10
ORDERS_FROM = "1999-01-01"
DOCUMENT_DAYS = ("1999-01-01", "1999-01-31")
PURCHASE_DAYS = ("1999-01-05", "1999-01-25")
ONE_CARD = "10"
ONE_MATERIAL = 7
NAME_TEXT = "ring"
ROLE = "mechanic"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return deco


def _t(spark, d):
    return shop_tables(spark, d)


# ---------------------------------------------------------------- reports

_NET = "round({a}.price * {a}.quantity * cast(100 - {h}.percent_off as decimal(10,0)) * cast(0.01 as decimal(3,2)), 2)"

_WORK_LINES = """with work as (
  select v.service_name, h.order_id as done_id, h.percent_off as pct,
    round(l.price * l.quantity, 2) as gross, """ + _NET.format(a="l", h="h") + """ as net
  from v_order_services l
    left join v_orders h on h.order_id = l.order_id
    left join v_services v on v.service_id = l.service_id
  {where})"""

_WORKS_SQL = _WORK_LINES + """,
named_ids as (
  select service_name, array_to_string(list_sort(list_distinct(list(cast(done_id as varchar)))), ',') as order_ids
  from work where done_id is not null group by service_name),
totals as (
  select service_name, sum(gross) as g, sum(net) as n, count(done_id) as c, avg(pct) as a, max(pct) as m
  from work group by service_name)
select t.service_name, i.order_ids, t.c as orders, t.a as average_percent_off, t.m as max_percent_off,
  cast(coalesce(t.g, 0) as decimal(38,2)) as sum, cast(coalesce(t.n, 0) as decimal(38,2)) as discount_sum
from totals t left join named_ids i on i.service_name is not distinct from t.service_name"""

_WORKS_DAYS_SQL = (f"where cast(h.order_date as date) >= date '{WORKS_DAYS[0]}' "
                   f"and cast(h.order_date as date) <= date '{WORKS_DAYS[1]}'")


@register("executed_works", _WORKS_SQL.format(where=_WORKS_DAYS_SQL))
def q_executed_works(spark, d):
    return reports.executed_works(_t(spark, d), *WORKS_DAYS)


@register("executed_works_all", _WORKS_SQL.format(where=""))
def q_executed_works_all(spark, d):
    return reports.executed_works(_t(spark, d))


@register("executed_work_ids", _WORK_LINES.format(where=_WORKS_DAYS_SQL) + """
select distinct service_name, done_id as order_id from work where done_id is not null""")
def q_executed_work_ids(spark, d):
    return reports.executed_work_ids(_t(spark, d), *WORKS_DAYS)


_MOVES_SQL = """with move as (
  select material_id as mid, cast(purchase_date as date) as day, quantity as came, null as went,
    purchase_id as bought, null as used_by
  from v_purchases
  union all
  select m.material_id, cast(h.order_date as date), null, m.quantity, null, h.order_id
  from v_orders h join v_order_materials m on m.order_id = h.order_id)"""

_BALANCE_SQL = _MOVES_SQL + """,
summed as (
  select mid,
    coalesce(sum(came) filter (where day < date '{b}'), 0) - coalesce(sum(went) filter (where day < date '{b}'), 0) as before,
    coalesce(sum(came) filter (where day < date '{b}'), 0) as came_before,
    coalesce(sum(went) filter (where day < date '{b}'), 0) as went_before,
    coalesce(sum(came) filter (where day between date '{b}' and date '{e}'), 0) as came_now,
    coalesce(sum(went) filter (where day between date '{b}' and date '{e}'), 0) as went_now,
    list(distinct cast(bought as varchar)) filter (where bought is not null and day between date '{b}' and date '{e}') as pids,
    list(distinct cast(used_by as varchar)) filter (where used_by is not null and day between date '{b}' and date '{e}') as oids
  from move group by mid)
select c.material_name,
  nullif(array_to_string(list_sort(x.pids), ','), '') as purchase_ids,
  nullif(array_to_string(list_sort(x.oids), ','), '') as order_ids,
  cast(coalesce(x.came_before, 0) as decimal(38,2)) as incoming_sum_begin,
  cast(coalesce(x.went_before, 0) as decimal(38,2)) as outgoing_sum_begin,
  cast(coalesce(x.before, 0) as decimal(38,2)) as balance_begin,
  cast(coalesce(x.came_now, 0) as decimal(38,2)) as incoming_sum,
  cast(coalesce(x.went_now, 0) as decimal(38,2)) as outgoing_sum,
  cast(coalesce(x.before + x.came_now - x.went_now, 0) as decimal(38,2)) as balance_end
from v_materials c left join summed x on x.mid = c.material_id
where {all_rows} or x.before + x.came_now - x.went_now > 0"""


@register("materials_using", _BALANCE_SQL.format(b=BALANCE_DAYS[0], e=BALANCE_DAYS[1], all_rows="true"))
def q_materials_using(spark, d):
    return reports.materials_using(_t(spark, d), *BALANCE_DAYS)


@register("materials_available", _BALANCE_SQL.format(b=BALANCE_DAYS[0], e=BALANCE_DAYS[1], all_rows="false"))
def q_materials_available(spark, d):
    return reports.materials_using(_t(spark, d), *BALANCE_DAYS, only_available=True)


@register("material_move_ids", (_MOVES_SQL + """
select distinct mid as material_id, case when bought is null then 'order' else 'purchase' end as kind,
  coalesce(bought, used_by) as id
from move where day between date '{b}' and date '{e}'""").format(b=BALANCE_DAYS[0], e=BALANCE_DAYS[1]))
def q_material_move_ids(spark, d):
    return reports.material_move_ids(_t(spark, d), *BALANCE_DAYS)


_PAY_SQL = """with gross as (select order_id, sum(round(price * quantity, 2)) as amount from v_order_services group by order_id),
share as (
  select w.order_id, w.staffer_id, w.ktu, cast(coalesce(g.amount, 0) as decimal(38,2)) as base
  from v_order_staffers w left join gross g on g.order_id = w.order_id
  where w.order_id in (select order_id from v_orders where cast(order_date as date) between date '{b}' and date '{e}')),
due as (
  select *, cast(round(cast(ktu * {coeff} as decimal(18,0)) * cast(base as decimal(18,2)) * cast(0.0001 as decimal(5,4)), 2)
                 as decimal(38,2)) as pay from share)
select distinct order_id, staffer_id, cast(ktu as decimal(12,2)) as ktu, pay as zp, base as orders_sum, '' as staffer_name
from due
union all
select 0, f.staffer_id,
  cast(cast((200 * sum(due.ktu) + count(due.ktu)) // (2 * count(due.ktu)) as decimal(18,0)) * cast(0.01 as decimal(3,2))
       as decimal(12,2)),
  cast(sum(due.pay) as decimal(38,2)), cast(sum(due.base) as decimal(38,2)), any_value(f.staffer_name)
from v_staffers f join due on due.staffer_id = f.staffer_id
group by f.staffer_id"""


@register("salary", _PAY_SQL.format(b=PAY_DAYS[0], e=PAY_DAYS[1], coeff=PAY_COEFF))
def q_salary(spark, d):
    return reports.salary(_t(spark, d), *PAY_DAYS, PAY_COEFF)


# ---------------------------------------------------------------- orders

_ORDER_LIST_SQL = """with bill as (
  select l.order_id, count(l.order_line) as n, sum(round(l.price * l.quantity, 2)) as gross,
    sum(""" + _NET.format(a="l", h="h") + """) as net
  from v_order_services l join v_orders h on h.order_id = l.order_id group by l.order_id),
phone as (select card_number, max(customer_telephone) as tel from v_discount_cards group by card_number)
select h.order_id, h.order_date, h.car, h.card_number, h.percent_off, phone.tel as customer_telephone,
  coalesce(bill.n, 0) as order_lines, cast(coalesce(bill.gross, 0) as decimal(38,2)) as total,
  cast(coalesce(bill.net, 0) as decimal(38,2)) as discounted_total
from v_orders h left join phone on phone.card_number = h.card_number left join bill on bill.order_id = h.order_id
where true {where}"""


@register("order_list", _ORDER_LIST_SQL.format(
    where=f"and cast(h.order_date as date) >= date '{ORDERS_FROM}'"))
def q_order_list(spark, d):
    return orders.order_list(_t(spark, d), begin=ORDERS_FROM)


@register("order_list_by_card", _ORDER_LIST_SQL.format(where=f"and h.card_number = '{ONE_CARD}'"))
def q_order_list_by_card(spark, d):
    return orders.order_list(_t(spark, d), card_number=ONE_CARD)


_DOC_SQL = """with hdr as (
  select * from v_orders
  where cast(order_date as date) between date '{b}' and date '{e}'),
svc as (
  select s.order_id, s.order_line, s.service_id as item_id, r.service_name as item_name,
    s.price, s.quantity, cast(coalesce(round(s.price * s.quantity, 2), 0) as decimal(20,2)) as amount,
    cast(null as integer) as ktu,
    row_number() over (partition by s.order_id order by s.order_line, s.service_id,
      s.price nulls first, s.quantity nulls first, r.service_name nulls first) - 1 as position
  from v_order_services s left join v_services r on s.service_id = r.service_id
  where s.order_id in (select order_id from hdr)),
mat as (
  select m.order_id, m.order_line, m.material_id as item_id, c.material_name as item_name,
    cast(null as decimal(10,2)) as price, m.quantity, cast(null as decimal(20,2)) as amount,
    cast(null as integer) as ktu,
    row_number() over (partition by m.order_id order by m.order_line, m.material_id,
      m.quantity nulls first, c.material_name nulls first) - 1 as position
  from v_order_materials m left join v_materials c on m.material_id = c.material_id
  where m.order_id in (select order_id from hdr)),
stf as (
  select t.order_id, t.order_line, t.staffer_id as item_id, f.staffer_name as item_name,
    cast(null as decimal(10,2)) as price, cast(null as decimal(10,2)) as quantity,
    cast(null as decimal(20,2)) as amount, t.ktu,
    row_number() over (partition by t.order_id order by t.order_line, t.staffer_id,
      t.ktu nulls first, f.staffer_name nulls first) - 1 as position
  from v_order_staffers t left join v_staffers f on t.staffer_id = f.staffer_id
  where t.order_id in (select order_id from hdr))
{parts}"""

_DOC_PART = """select h.order_id, h.order_date, h.car, h.card_number, h.percent_off, '{kind}' as kind,
  cast(c.position as integer) as position, c.order_line, c.item_id, c.item_name, c.price, c.quantity,
  c.amount, c.ktu
from hdr h left join {cte} c on h.order_id = c.order_id"""


@register("order_documents", _DOC_SQL.format(
    b=DOCUMENT_DAYS[0], e=DOCUMENT_DAYS[1],
    parts="\nunion all\n".join(_DOC_PART.format(kind=k, cte=c) for k, c in
                               (("service", "svc"), ("material", "mat"), ("staffer", "stf")))))
def q_order_documents(spark, d):
    return orders.flatten_documents(orders.order_documents(_t(spark, d), *DOCUMENT_DAYS))


_DOC_BY_KEYS_SQL = _DOC_SQL.replace(
    "where cast(order_date as date) between date '{b}' and date '{e}'",
    "where order_id in (select order_id from v_order_materials where quantity >= 49)")


@register("order_documents_by_keys", _DOC_BY_KEYS_SQL.format(
    parts="\nunion all\n".join(_DOC_PART.format(kind=k, cte=c) for k, c in
                               (("service", "svc"), ("material", "mat"), ("staffer", "stf")))))
def q_order_documents_by_keys(spark, d):
    """The documents of all orders that use much of a material; an order is named once for each such line."""
    t = _t(spark, d)
    keys = t["order_materials"].where(F.col("quantity") >= 49).select("order_id")
    return orders.flatten_documents(orders.order_documents(t, keys=keys))


@register("order_document_lines", _DOC_SQL.format(
    b=DOCUMENT_DAYS[0], e=DOCUMENT_DAYS[1],
    parts="\nunion all\n".join(_DOC_PART.format(kind=k, cte=c) for k, c in
                               (("service", "svc"), ("material", "mat"), ("staffer", "stf")))))
def q_order_document_lines(spark, d):
    return orders.document_lines(_t(spark, d), *DOCUMENT_DAYS)


# ---------------------------------------------------------------- purchases

_PURCHASE_SQL = """select p.purchase_id, p.purchase_date, p.trader, m.material_id, p.price, p.quantity,
  cast(round(p.price * p.quantity, 2) as decimal(20,2)) as sum,
  m.material_name, m.part, m.measure, m.article
from v_purchases p left join v_materials m on p.material_id = m.material_id
where true {where}
order by p.purchase_date"""


@register("purchase_list", _PURCHASE_SQL.format(
    where=f"and cast(p.purchase_date as date) >= date '{PURCHASE_DAYS[0]}' "
          f"and cast(p.purchase_date as date) <= date '{PURCHASE_DAYS[1]}'"))
def q_purchase_list(spark, d):
    return purchases.purchase_list(_t(spark, d), begin=PURCHASE_DAYS[0], end=PURCHASE_DAYS[1])


@register("purchase_list_by_material", _PURCHASE_SQL.format(where=f"and p.material_id = {ONE_MATERIAL}"))
def q_purchase_list_by_material(spark, d):
    return purchases.purchase_list(_t(spark, d), material_id=ONE_MATERIAL)


@register("purchase_cards", _PURCHASE_SQL.format(
    where="and p.purchase_id in (select purchase_id from v_purchases where trader = 'purchase')"))
def q_purchase_cards(spark, d):
    t = _t(spark, d)
    keys = t["purchases"].where(F.col("trader") == "purchase").select("purchase_id")
    return purchases.purchase_lookup(t, keys)


# ---------------------------------------------------------------- catalogue

@register("material_list", f"""select * from v_materials
where position(upper('{NAME_TEXT}') in upper(material_name)) > 0 and part = true order by material_name""")
def q_material_list(spark, d):
    return catalog.material_list(_t(spark, d), NAME_TEXT, True)


@register("service_list", f"""select * from v_services
where position(upper('{NAME_TEXT}') in upper(service_name)) > 0 order by service_name""")
def q_service_list(spark, d):
    return catalog.service_list(_t(spark, d), NAME_TEXT)


@register("staffer_list", f"""select staffer_id, staffer_name, role, login from v_staffers
where role = '{ROLE}' order by staffer_name""")
def q_staffer_list(spark, d):
    return catalog.staffer_list(_t(spark, d), ROLE)


@register("card_list", "select * from v_discount_cards order by card_number")
def q_card_list(spark, d):
    return catalog.card_list(_t(spark, d))


@register("lookup_materials", """select * from v_materials
where material_id in (select material_id from v_purchases)""")
def q_lookup_materials(spark, d):
    t = _t(spark, d)
    return catalog.lookup(t["materials"], t["purchases"], "material_id")


@register("lookup_staffers", """select staffer_id, staffer_name, role, login from v_staffers
where staffer_id in (select staffer_id from v_order_staffers where ktu >= 40)""")
def q_lookup_staffers(spark, d):
    t = _t(spark, d)
    keys = t["order_staffers"].where(F.col("ktu") >= 40)
    return catalog.lookup(t["staffers"].select(*catalog.STAFFER_PUBLIC), keys, "staffer_id")


@register("attach_service_price", """select s.*, r.price as service_price
from v_order_services s left join v_services r on s.service_id = r.service_id""")
def q_attach_service_price(spark, d):
    t = _t(spark, d)
    return catalog.attach_service_price(t["order_services"], t["services"])


@register("attach_card_percent", """select o.*, d.percent_off as card_percent_off
from v_orders o left join v_discount_cards d on o.card_number = d.card_number""")
def q_attach_card_percent(spark, d):
    t = _t(spark, d)
    return catalog.attach_card_percent(t["orders"], t["discount_cards"])


# ---------------------------------------------------------------- change sets
# Change sets are derived from the tables themselves (every request row comes
# from a table row), so their size grows with the data.



def material_changes(m: DataFrame) -> DataFrame:
    """Save requests: rename every part (twice for Brand#13; the later one
    wins), updates of unknown ids (ignored) and copies of non-parts as new
    materials."""
    cols = ["material_id", "material_name", "part", "measure", "article"]
    rename = m.where("part").select(
        "material_id", F.upper("material_name").alias("material_name"), "part", "measure", "article",
        (F.col("material_id") * 4).alias("seq"))
    again = m.where(F.col("part") & (F.col("article") == "Brand#13")).select(
        "material_id", F.concat("material_name", F.lit(" v2")).alias("material_name"), "part",
        F.lit("box").alias("measure"), "article", (F.col("material_id") * 4 + 1).alias("seq"))
    unknown = m.where(F.col("article") == "Brand#22").select(
        (F.col("material_id") + 1000000000).alias("material_id"), "material_name", "part", "measure",
        "article", (F.col("material_id") * 4 + 2).alias("seq"))
    new = m.where(~F.col("part")).select(
        F.lit(0).cast("long").alias("material_id"), F.concat("material_name", F.lit(" new")).alias("material_name"),
        "part", "measure", "article", (F.col("material_id") * 4 + 3).alias("seq"))
    return rename.unionByName(again).unionByName(unknown).unionByName(new).select(*cols, "seq")


_SAVE_MATERIALS_CTES = """with changes as (
  select material_id, upper(material_name) as material_name, part, measure, article, material_id * 4 as seq
  from v_materials where part
  union all select material_id, concat(material_name, ' v2'), part, 'box', article, material_id * 4 + 1
  from v_materials where part and article = 'Brand#13'
  union all select material_id + 1000000000, material_name, part, measure, article, material_id * 4 + 2
  from v_materials where article = 'Brand#22'
  union all select 0, concat(material_name, ' new'), part, measure, article, material_id * 4 + 3
  from v_materials where not part),
upd as (select * from (select *, row_number() over (partition by material_id order by seq desc) as rn
                       from changes where material_id <> 0) where rn = 1),
saved as (
select m.material_id,
  case when u.material_id is null then m.material_name else u.material_name end as material_name,
  case when u.material_id is null then m.part else u.part end as part,
  case when u.material_id is null then m.measure else u.measure end as measure,
  case when u.material_id is null then m.article else u.article end as article
from v_materials m left join upd u on m.material_id = u.material_id
union all
select (select max(material_id) from v_materials) + row_number() over (order by seq),
  material_name, part, measure, article
from changes where material_id = 0)"""


@register("save_materials", _SAVE_MATERIALS_CTES + "\nselect * from saved")
def q_save_materials(spark, d):
    t = _t(spark, d)
    return ch.apply_saves(t["materials"], material_changes(t["materials"]), "material_id")


def purchase_saves(p: DataFrame) -> DataFrame:
    """Save requests: every 'click' purchase re-priced (+1.00), every 'view'
    purchase copied as a new one a day later; all requests carry a sum the
    service ignores."""
    upd = p.where(F.col("trader") == "click").selectExpr(
        "purchase_id", "purchase_date", "trader", "material_id", "cast(price + 1 as decimal(10,2)) as price",
        "quantity", "cast(999 as decimal(10,2)) as sum", "purchase_id * 2 as seq")
    new = p.where(F.col("trader") == "view").selectExpr(
        "cast(0 as bigint) as purchase_id", "purchase_date + interval 1 day as purchase_date",
        "'copy' as trader", "material_id", "price", "quantity", "cast(1 as decimal(10,2)) as sum",
        "purchase_id * 2 + 1 as seq")
    return upd.unionByName(new)


@register("save_purchases", """with changes as (
  select purchase_id, purchase_date, trader, material_id, cast(price + 1 as decimal(10,2)) as price, quantity,
    purchase_id * 2 as seq from v_purchases where trader = 'click'
  union all
  select 0, purchase_date + interval 1 day, 'copy', material_id, price, quantity, purchase_id * 2 + 1
  from v_purchases where trader = 'view')
select p.purchase_id, p.purchase_date, p.trader, p.material_id,
  coalesce(c.price, p.price) as price, p.quantity, p.sum
from v_purchases p left join changes c on p.purchase_id = c.purchase_id
union all
select (select max(purchase_id) from v_purchases) + row_number() over (order by seq),
  purchase_date, trader, material_id, price, quantity, cast(null as decimal(10,2))
from changes where purchase_id = 0""")
def q_save_purchases(spark, d):
    t = _t(spark, d)
    return ch.save_purchases(t["purchases"], purchase_saves(t["purchases"]))


def card_inserts(t) -> DataFrame:
    """Insert a card for every card number used by an order (existing ones are
    rejected); urgent customers are requested twice (the second rejected)."""
    used = t["orders"].select("card_number").distinct()
    urgent = t["orders"].where(F.col("car") == "1-URGENT").select("card_number").distinct()
    num = F.col("card_number").cast("long")
    a = used.select("card_number", F.concat(F.lit("Client "), "card_number").alias("customer_name"),
                    F.lit(None).cast("string").alias("customer_telephone"), F.lit(5).alias("percent_off"),
                    (num * 2).alias("seq"))
    b = urgent.select("card_number", F.concat(F.lit("Urgent "), "card_number").alias("customer_name"),
                      F.lit(None).cast("string").alias("customer_telephone"), F.lit(10).alias("percent_off"),
                      (num * 2 + 1).alias("seq"))
    return a.unionByName(b)


@register("insert_cards", """with changes as (
  select card_number, concat('Client ', card_number) as customer_name, cast(null as varchar) as customer_telephone,
    5 as percent_off, cast(card_number as bigint) * 2 as seq
  from (select distinct card_number from v_orders)
  union all
  select card_number, concat('Urgent ', card_number), cast(null as varchar), 10, cast(card_number as bigint) * 2 + 1
  from (select distinct card_number from v_orders where car = '1-URGENT')),
firsts as (select * from (select *, row_number() over (partition by card_number order by seq) as rn
                          from changes) where rn = 1)
select card_number, customer_name, customer_telephone, percent_off from v_discount_cards
union all
select card_number, customer_name, customer_telephone, percent_off from firsts
where card_number not in (select card_number from v_discount_cards)""")
def q_insert_cards(spark, d):
    t = _t(spark, d)
    table, _rejected = ch.apply_inserts(t["discount_cards"], card_inserts(t), "card_number")
    return table


def odd_card_inserts(t) -> DataFrame:
    """``card_inserts``, some of them sent twice alike, some without a card number."""
    asked = card_inserts(t)
    num = F.col("card_number").cast("long")
    return (asked.unionByName(asked.where(num % 3 == 0))
            .unionByName(asked.where(num % 5 == 0).withColumn("card_number", F.lit(None).cast("string"))))


_ODD_CARDS_SQL = """with asked as (
  select card_number, concat('Client ', card_number) as customer_name, cast(null as varchar) as customer_telephone,
    5 as percent_off, cast(card_number as bigint) * 2 as seq
  from (select distinct card_number from v_orders)
  union all
  select card_number, concat('Urgent ', card_number), cast(null as varchar), 10, cast(card_number as bigint) * 2 + 1
  from (select distinct card_number from v_orders where car = '1-URGENT')),
changes as (
  select * from asked
  union all select * from asked where cast(card_number as bigint) % 3 = 0
  union all select null, customer_name, customer_telephone, percent_off, seq from asked where cast(card_number as bigint) % 5 = 0),
turns as (select *, row_number() over (partition by card_number order by seq, customer_name, percent_off) as turn from changes)
"""


@register("insert_cards_rejected", _ODD_CARDS_SQL + """select card_number, customer_name, customer_telephone, percent_off, seq
from turns where card_number is null or turn > 1 or card_number in (select card_number from v_discount_cards)""")
def q_insert_cards_rejected(spark, d):
    t = _t(spark, d)
    _table, rejected = ch.apply_inserts(t["discount_cards"], odd_card_inserts(t), "card_number")
    return rejected


@register("insert_odd_cards", _ODD_CARDS_SQL + """select * from v_discount_cards
union all
select card_number, customer_name, customer_telephone, percent_off from turns
where turn = 1 and card_number not in (select card_number from v_discount_cards)""")
def q_insert_odd_cards(spark, d):
    t = _t(spark, d)
    table, _rejected = ch.apply_inserts(t["discount_cards"], odd_card_inserts(t), "card_number")
    return table


def card_updates(cards: DataFrame) -> DataFrame:
    num = F.col("card_number").cast("long")
    a = cards.where(F.col("percent_off") < 8).select(
        "card_number", F.upper("customer_name").alias("customer_name"), "customer_telephone",
        (F.col("percent_off") + 1).alias("percent_off"), (num * 2).alias("seq"))
    b = cards.where(F.col("percent_off") == 3).select(
        "card_number", "customer_name", F.lit(None).cast("string").alias("customer_telephone"),
        F.lit(0).alias("percent_off"), (num * 2 + 1).alias("seq"))
    c = cards.where(F.col("percent_off") == 15).select(
        F.concat("card_number", F.lit("-x")).alias("card_number"), "customer_name", "customer_telephone",
        F.lit(1).alias("percent_off"), (num * 2).alias("seq"))
    return a.unionByName(b).unionByName(c)


@register("update_cards", """with changes as (
  select card_number, upper(customer_name) as customer_name, customer_telephone, percent_off + 1 as percent_off,
    cast(card_number as bigint) * 2 as seq from v_discount_cards where percent_off < 8
  union all select card_number, customer_name, cast(null as varchar), 0, cast(card_number as bigint) * 2 + 1
  from v_discount_cards where percent_off = 3
  union all select concat(card_number, '-x'), customer_name, customer_telephone, 1, cast(card_number as bigint) * 2
  from v_discount_cards where percent_off = 15),
upd as (select * from (select *, row_number() over (partition by card_number order by seq desc) as rn
                       from changes) where rn = 1)
select d.card_number,
  case when u.card_number is null then d.customer_name else u.customer_name end as customer_name,
  case when u.card_number is null then d.customer_telephone else u.customer_telephone end as customer_telephone,
  case when u.card_number is null then d.percent_off else u.percent_off end as percent_off
from v_discount_cards d left join upd u on d.card_number = u.card_number""")
def q_update_cards(spark, d):
    t = _t(spark, d)
    return ch.apply_updates(t["discount_cards"], card_updates(t["discount_cards"]), "card_number")


@register("delete_purchases", """select * from v_purchases
where purchase_id not in (select purchase_id from v_purchases where trader = 'error')""")
def q_delete_purchases(spark, d):
    t = _t(spark, d)
    keys = t["purchases"].where(F.col("trader") == "error").select("purchase_id")
    return ch.apply_deletes(t["purchases"], keys, "purchase_id")


_LONG_SQL = """select 'orders' as tbl, order_id, cast(null as integer) as order_line, cast(null as bigint) as item_id,
  order_date, car, card_number, percent_off, cast(null as decimal(10,2)) as price,
  cast(null as decimal(10,2)) as quantity, cast(null as integer) as ktu from {o}
union all select 'order_services', order_id, order_line, service_id, cast(null as timestamp), cast(null as varchar),
  cast(null as varchar), cast(null as integer), price, quantity, cast(null as integer) from {s}
union all select 'order_materials', order_id, order_line, material_id, cast(null as timestamp), cast(null as varchar),
  cast(null as varchar), cast(null as integer), cast(null as decimal(10,2)), quantity, cast(null as integer) from {m}
union all select 'order_staffers', order_id, order_line, staffer_id, cast(null as timestamp), cast(null as varchar),
  cast(null as varchar), cast(null as integer), cast(null as decimal(10,2)), cast(null as decimal(10,2)), ktu from {st}"""

_LOW = "(select order_id from v_orders where car = '5-LOW')"


@register("delete_orders_cascade", _LONG_SQL.format(
    o=f"v_orders where order_id not in {_LOW}", s=f"v_order_services where order_id not in {_LOW}",
    m=f"v_order_materials where order_id not in {_LOW}", st=f"v_order_staffers where order_id not in {_LOW}"))
def q_delete_orders_cascade(spark, d):
    t = _t(spark, d)
    keys = t["orders"].where(F.col("car") == "5-LOW").select("order_id")
    return ch.order_tables_long(ch.delete_orders(t, keys))


@register("delete_materials_restricted", """select * from v_materials where material_id not in (
  select material_id from v_materials where not part
    and material_id not in (select material_id from v_purchases)
    and material_id not in (select material_id from v_order_materials))""")
def q_delete_materials_restricted(spark, d):
    t = _t(spark, d)
    keys = t["materials"].where(~F.col("part")).select("material_id")
    table, _rejected = ch.delete_restricted(
        t["materials"], keys, "material_id",
        [(t["purchases"], "material_id"), (t["order_materials"], "material_id")])
    return table


@register("delete_materials_rejected", """select material_id from v_materials where not part
  and (material_id in (select material_id from v_purchases) or material_id in (select material_id from v_order_materials))""")
def q_delete_materials_rejected(spark, d):
    t = _t(spark, d)
    _tables, rejected = ch.delete_rows(t, "materials", t["materials"].where(~F.col("part")).select("material_id"))
    return rejected


@register("delete_services_restricted", """select * from v_services where not (
  service_id % 2 = 0 and service_id not in (select service_id from v_order_services))""")
def q_delete_services_restricted(spark, d):
    t = _t(spark, d)
    tables, _rejected = ch.delete_rows(t, "services", t["services"].where(F.col("service_id") % 2 == 0))
    return tables["services"]


@register("delete_staffers_restricted", """select * from v_staffers where not (
  role = 'manager' and staffer_id not in (select staffer_id from v_order_staffers))""")
def q_delete_staffers_restricted(spark, d):
    t = _t(spark, d)
    tables, _rejected = ch.delete_rows(t, "staffers", t["staffers"].where(F.col("role") == "manager"))
    return tables["staffers"]


@register("save_services", """select service_id, case when price < 1500 then upper(service_name) else service_name end as service_name,
  cast(case when price < 1500 then price + 1 else price end as decimal(10,2)) as price from v_services
union all
select (select max(service_id) from v_services) + row_number() over (order by service_id), concat(service_name, ' plus'), price
from v_services where price >= 1500""")
def q_save_services(spark, d):
    """Cheap services renamed and raised by one, the others copied as new ones."""
    s = _t(spark, d)["services"]
    cheap = F.col("price") < 1500
    asked = s.select(
        F.when(cheap, F.col("service_id")).alias("service_id"),
        F.when(cheap, F.upper("service_name")).otherwise(F.concat("service_name", F.lit(" plus"))).alias("service_name"),
        F.when(cheap, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)").alias("price"),
        F.col("service_id").alias("seq"))
    return ch.apply_saves(s, asked, "service_id")


@register("save_staffers", """select staffer_id, staffer_name, case when role = 'manager' then 'head' else role end as role, login
from v_staffers
union all
select (select max(staffer_id) from v_staffers) + row_number() over (order by staffer_id), staffer_name, 'helper', concat(login, 'x')
from v_staffers where role = 'mechanic'""")
def q_save_staffers(spark, d):
    """Managers get a new role, every mechanic a new helper."""
    s = _t(spark, d)["staffers"]
    manager = F.col("role") == "manager"
    asked = s.select(
        F.when(manager, F.col("staffer_id")).otherwise(0).alias("staffer_id"), "staffer_name",
        F.when(manager, "head").otherwise("helper").alias("role"),
        F.when(manager, F.col("login")).otherwise(F.concat("login", F.lit("x"))).alias("login"), F.col("staffer_id").alias("seq"))
    return ch.apply_saves(s, asked, "staffer_id")


@register("lookup_services", "select * from v_services where service_id in (select service_id from v_order_services where quantity >= 49)")
def q_lookup_services(spark, d):
    t = _t(spark, d)
    return catalog.lookup(t["services"], t["order_services"].where(F.col("quantity") >= 49), "service_id")


@register("lookup_cards", "select * from v_discount_cards where card_number in (select card_number from v_orders where car = '5-LOW')")
def q_lookup_cards(spark, d):
    t = _t(spark, d)
    return catalog.lookup(t["discount_cards"], t["orders"].where(F.col("car") == "5-LOW"), "card_number")


@register("save_then_delete_materials", _SAVE_MATERIALS_CTES + """
select * from saved where material_id not in (
  select material_id from saved where not part
    and material_id not in (select material_id from v_purchases)
    and material_id not in (select material_id from v_order_materials))""")
def q_save_then_delete_materials(spark, d):
    """Save requests, then a restricted delete of every non-part: the new
    copies are unused and go, the used originals are refused and stay."""
    t = _t(spark, d)
    saved = ch.apply_saves(t["materials"], material_changes(t["materials"]), "material_id")
    keys = saved.where(~F.col("part")).select("material_id")
    table, _rejected = ch.delete_restricted(
        saved, keys, "material_id", [(t["purchases"], "material_id"), (t["order_materials"], "material_id")])
    return table


SAVE_DAYS = {"update": ("1999-02-01", "1999-02-28"), "copy": ("1999-03-01", "1999-03-31"),
             "unknown": ("1999-04-01", "1999-04-30"), "faulty": ("1999-05-01", "1999-05-31")}


def order_saves(t) -> DataFrame:
    """Order documents to save: February orders re-saved with a changed car
    and no staff, March orders copied as new orders, April orders sent with
    ids that do not exist, May orders with services that do not exist (both
    rejected; a May order without services is saved as it is)."""
    docs = orders.order_documents(t, SAVE_DAYS["update"][0], SAVE_DAYS["faulty"][1])
    month = F.month("order_date")
    feb, mar, may = month == 2, month == 3, month == 5
    docs = docs.withColumn("order_services", F.when(may, F.transform(
        "order_services", lambda x: x.withField("service_id", x["service_id"] + 1000000000))).otherwise(F.col("order_services")))
    return docs.select(
        F.when(feb | may, F.col("order_id")).when(mar, F.lit(0).cast("long"))
        .otherwise(F.col("order_id") + 1000000000).alias("order_id"),
        "order_date",
        F.when(feb, F.concat("car", F.lit(" saved"))).otherwise(F.col("car")).alias("car"),
        "card_number", "percent_off", "order_services", "order_materials",
        F.when(feb, F.filter("order_staffers", lambda x: F.lit(False))).otherwise(F.col("order_staffers"))
        .alias("order_staffers"),
        (F.col("order_id") * 2 + F.when(mar, 1).otherwise(0)).alias("seq"))


def _in_days_sql(col, key):
    b, e = SAVE_DAYS[key]
    return f"cast({col} as date) between date '{b}' and date '{e}'"


@register("save_orders", f"""with feb as (select order_id from v_orders where {_in_days_sql('order_date', 'update')}),
mar as (select order_id, (select max(order_id) from v_orders) + row_number() over (order by order_id * 2 + 1) as new_id
        from v_orders where {_in_days_sql('order_date', 'copy')}),
o_new as (
  select order_id, order_date,
    case when order_id in (select order_id from feb) then concat(car, ' saved') else car end as car,
    card_number, percent_off from v_orders
  union all select m.new_id, o.order_date, o.car, o.card_number, o.percent_off
  from v_orders o join mar m on o.order_id = m.order_id),
s_new as (select * from v_order_services
  union all select m.new_id, s.order_line, s.service_id, s.price, s.quantity
  from v_order_services s join mar m on s.order_id = m.order_id),
m_new as (select * from v_order_materials
  union all select m.new_id, s.order_line, s.material_id, s.quantity
  from v_order_materials s join mar m on s.order_id = m.order_id),
st_new as (select * from v_order_staffers where order_id not in (select order_id from feb)
  union all select m.new_id, s.order_line, s.staffer_id, s.ktu
  from v_order_staffers s join mar m on s.order_id = m.order_id)
{_LONG_SQL.format(o='o_new', s='s_new', m='m_new', st='st_new')}""")
def q_save_orders(spark, d):
    t = _t(spark, d)
    tables, _rejected = ch.save_orders(t, order_saves(t))
    return ch.order_tables_long(tables)


@register("save_orders_rejected", f"""select order_id + 1000000000 as order_id, order_id * 2 as seq from v_orders
where {_in_days_sql('order_date', 'unknown')}
union all
select order_id, order_id * 2 from v_orders
where {_in_days_sql('order_date', 'faulty')} and order_id in (select order_id from v_order_services)""")
def q_save_orders_rejected(spark, d):
    t = _t(spark, d)
    return ch.rejected_orders(t, order_saves(t)).select("order_id", "seq")


def faulty_tables(t):
    """The tables with faults derived from their own rows: every 'error'
    purchase duplicated onto a missing material, order materials of quantity
    50 without material, gizmo services priced 100000 times higher."""
    out = dict(t)
    p = t["purchases"]
    out["purchases"] = p.unionByName(
        p.where(F.col("trader") == "error").withColumn("material_id", F.col("material_id") + 1000000))
    om = t["order_materials"]
    out["order_materials"] = om.withColumn(
        "material_id", F.when(F.col("quantity") >= 50, F.lit(None).cast("long")).otherwise(F.col("material_id")))
    s = t["services"]
    out["services"] = s.withColumn(
        "price", F.when(F.col("service_name").contains("gizmo"), F.col("price") * F.lit(100000))
        .otherwise(F.col("price")).cast("decimal(20,2)"))
    return out


# The rules of the original tables, written out (table, column, key or line of the row).
_LINE = "concat_ws(':', cast(order_id as varchar), cast(order_line as varchar))"
_NOT_NULL = [
    ("staffers", "staffer_id", "cast(staffer_id as varchar)"),
    ("discount_cards", "card_number", "card_number"),
    ("services", "service_id", "cast(service_id as varchar)"),
    ("services", "service_name", "cast(service_id as varchar)"),
    ("materials", "material_id", "cast(material_id as varchar)"),
    ("materials", "material_name", "cast(material_id as varchar)"),
    ("orders", "order_id", "cast(order_id as varchar)"),
    ("orders", "order_date", "cast(order_id as varchar)"),
    ("order_services", "order_id", _LINE),
    ("order_services", "order_line", _LINE),
    ("order_services", "service_id", _LINE),
    ("order_materials", "order_id", _LINE),
    ("order_materials", "order_line", _LINE),
    ("order_materials", "material_id", _LINE),
    ("order_staffers", "order_id", _LINE),
    ("order_staffers", "order_line", _LINE),
    ("order_staffers", "staffer_id", _LINE),
    ("purchases", "purchase_id", "cast(purchase_id as varchar)"),
    ("purchases", "purchase_date", "cast(purchase_id as varchar)"),
    ("purchases", "material_id", "cast(purchase_id as varchar)"),
]
_UNIQUE = [("staffers", "staffer_id"), ("discount_cards", "card_number"), ("services", "service_id"),
           ("materials", "material_id"), ("orders", "order_id"), ("purchases", "purchase_id")]
_FOREIGN = [
    ("order_services", "order_id", "orders"), ("order_services", "service_id", "services"),
    ("order_materials", "order_id", "orders"), ("order_materials", "material_id", "materials"),
    ("order_staffers", "order_id", "orders"), ("order_staffers", "staffer_id", "staffers"),
    ("purchases", "material_id", "materials"),
]


def _integrity_sql() -> str:
    def src(table):
        return f"f_{table}" if table in ("purchases", "order_materials", "services") else f"v_{table}"

    parts = [f"select '{t}' as table_name, 'not_null' as rule, '{c}' as column_name, {row} as value, "
             f"cast(1 as bigint) as rows from {src(t)} where {c} is null" for t, c, row in _NOT_NULL]
    parts += [f"select '{t}', 'unique_key', '{k}', cast({k} as varchar), count(*) from {src(t)} "
              f"where {k} is not null group by {k} having count(*) > 1" for t, k in _UNIQUE]
    parts.append("select 'services', 'numeric_10_2', 'price', cast(service_id as varchar), cast(1 as bigint) "
                 "from f_services where abs(round(price, 2)) >= 100000000")
    parts += [f"select '{t}', 'references_{p}', '{c}', cast({c} as varchar), count(*) from {src(t)} "
              f"where {c} is not null and {c} not in (select {c} from {src(p)}) group by {c}" for t, c, p in _FOREIGN]
    return ("""with f_purchases as (
  select * from v_purchases
  union all select purchase_id, purchase_date, trader, material_id + 1000000, price, quantity, sum
  from v_purchases where trader = 'error'),
f_order_materials as (
  select order_id, order_line, case when quantity >= 50 then null else material_id end as material_id, quantity
  from v_order_materials),
f_services as (
  select service_id, service_name,
    cast(case when service_name like '%gizmo%' then price * 100000 else price end as decimal(20,2)) as price
  from v_services)
""" + "\nunion all\n".join(parts))


@register("integrity_violations", _integrity_sql())
def q_integrity_violations(spark, d):
    return integrity.check_tables(faulty_tables(_t(spark, d)))


from overhaul import store_queries  # noqa: E402,F401  (registers its queries here)
