"""Table schemas, keys and references of the shop data model.

Fixed values: column names, types, keys and references follow the data model
of the original service (nine tables). Keys widen to long; money and
quantities are decimal(10,2); timestamps carry no zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)          # numeric(10,2) column type
AMOUNT = T.DecimalType(20, 2)         # one rounded line amount: round(price * quantity, 2)
TOTAL = T.DecimalType(38, 2)          # sums of amounts / quantities in reports
KTU = T.DecimalType(12, 2)            # ktu column of the pay report (int details, rounded averages)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


STAFFERS = T.StructType([
    _f("staffer_id", T.LongType(), False),
    _f("staffer_name", T.StringType()),
    _f("role", T.StringType()),
    _f("login", T.StringType()),
])

DISCOUNT_CARDS = T.StructType([
    _f("card_number", T.StringType(), False),
    _f("customer_name", T.StringType()),
    _f("customer_telephone", T.StringType()),
    _f("percent_off", T.IntegerType()),
])

SERVICES = T.StructType([
    _f("service_id", T.LongType(), False),
    _f("service_name", T.StringType(), False),
    _f("price", MONEY),
])

MATERIALS = T.StructType([
    _f("material_id", T.LongType(), False),
    _f("material_name", T.StringType(), False),
    _f("part", T.BooleanType()),
    _f("measure", T.StringType()),
    _f("article", T.StringType()),
])

ORDERS = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("order_date", T.TimestampNTZType(), False),
    _f("car", T.StringType()),
    _f("card_number", T.StringType()),
    _f("percent_off", T.IntegerType()),
])

ORDER_SERVICES = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("order_line", T.IntegerType(), False),
    _f("service_id", T.LongType(), False),
    _f("price", MONEY),
    _f("quantity", MONEY),
])

ORDER_MATERIALS = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("order_line", T.IntegerType(), False),
    _f("material_id", T.LongType(), False),
    _f("quantity", MONEY),
])

ORDER_STAFFERS = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("order_line", T.IntegerType(), False),
    _f("staffer_id", T.LongType(), False),
    _f("ktu", T.IntegerType()),
])

PURCHASES = T.StructType([
    _f("purchase_id", T.LongType(), False),
    _f("purchase_date", T.TimestampNTZType(), False),
    _f("trader", T.StringType()),
    _f("material_id", T.LongType(), False),
    _f("price", MONEY),
    _f("quantity", MONEY),
    _f("sum", MONEY),
])

SCHEMAS = {
    "staffers": STAFFERS,
    "discount_cards": DISCOUNT_CARDS,
    "services": SERVICES,
    "materials": MATERIALS,
    "orders": ORDERS,
    "order_services": ORDER_SERVICES,
    "order_materials": ORDER_MATERIALS,
    "order_staffers": ORDER_STAFFERS,
    "purchases": PURCHASES,
}

# Primary keys; the three child tables of an order have none.
KEYS = {
    "staffers": "staffer_id",
    "discount_cards": "card_number",
    "services": "service_id",
    "materials": "material_id",
    "orders": "order_id",
    "purchases": "purchase_id",
}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    on_delete: str  # "cascade" or "restrict"


# Foreign keys. orders.card_number deliberately has none.
REFERENCES = (
    Reference("order_services", "order_id", "orders", "cascade"),
    Reference("order_services", "service_id", "services", "restrict"),
    Reference("order_materials", "order_id", "orders", "cascade"),
    Reference("order_materials", "material_id", "materials", "restrict"),
    Reference("order_staffers", "order_id", "orders", "cascade"),
    Reference("order_staffers", "staffer_id", "staffers", "restrict"),
    Reference("purchases", "material_id", "materials", "restrict"),
)

CHILD_TABLES = ("order_services", "order_materials", "order_staffers")

# Input of the order change set: a header plus three child arrays.
ORDER_SERVICE_ITEM = T.StructType([
    _f("order_line", T.IntegerType()), _f("service_id", T.LongType()),
    _f("price", MONEY), _f("quantity", MONEY),
])
ORDER_MATERIAL_ITEM = T.StructType([
    _f("order_line", T.IntegerType()), _f("material_id", T.LongType()), _f("quantity", MONEY),
])
ORDER_STAFFER_ITEM = T.StructType([
    _f("order_line", T.IntegerType()), _f("staffer_id", T.LongType()), _f("ktu", T.IntegerType()),
])
ORDER_DOCUMENT_INPUT = T.StructType([
    _f("order_id", T.LongType()),
    _f("order_date", T.TimestampNTZType(), False),
    _f("car", T.StringType()),
    _f("card_number", T.StringType()),
    _f("percent_off", T.IntegerType()),
    _f("order_services", T.ArrayType(ORDER_SERVICE_ITEM)),
    _f("order_materials", T.ArrayType(ORDER_MATERIAL_ITEM)),
    _f("order_staffers", T.ArrayType(ORDER_STAFFER_ITEM)),
])


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]


def money_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if f.dataType == MONEY]
