"""Column-level building blocks (built-in Spark expressions, no UDFs)."""

from overhaul.functions.filters import (
    before_day, day_of, equals_unless, in_days, name_contains, where_all,
)
from overhaul.functions.idlists import summarize_with_id_lists
from overhaul.functions.joins import split_join
from overhaul.functions.money import line_amount, line_amount_net, pay, round_avg, to_total
from overhaul.functions.ranking import positions_within, row_numbers

__all__ = [
    "before_day", "day_of", "equals_unless", "in_days", "name_contains", "where_all",
    "summarize_with_id_lists", "line_amount", "line_amount_net", "pay", "round_avg", "to_total",
    "positions_within", "row_numbers", "split_join",
]
