"""Grouped aggregates together with sorted, comma-joined distinct id lists.

The reports return, next to sums, ``string_agg(DISTINCT id::text, ',')`` per
group: the distinct ids as text, sorted as text, joined by commas, NULL when
there is none. A plain ``collect_set`` per group would merge every distinct id
of a hot group in one task. Instead the lists are built in two aggregation
rounds:

0. group by (keys, list, id): de-duplicates ids and pre-sums, in a
   code-generated hash aggregate;
1. group by (keys, list, chunk) where chunk is the id text's first
   ``prefix_len`` characters; each chunk's ids are sorted and joined there;
2. group by keys and concatenate the chunk strings in chunk order.

Text order is prefix-consistent (if the first k characters of a sort before
those of b, then a sorts before b), so concatenating sorted chunks in chunk
order yields the fully sorted list. Round 1 splits a hot group into up to
~10**prefix_len tasks; round 2 only moves one short string per chunk. The
other aggregates (sum, count, max) are computed partially in round 0 and
merged in rounds 1 and 2, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": "sum", "count": "sum", "max": "max"}
_PARTIAL = {"sum": "sum", "count": "count", "max": "max"}


def summarize_with_id_lists(df: DataFrame, keys: list[str], aggs: list[tuple[str, str, str]],
                            id_lists: dict[str, str], prefix_len: int = 3) -> DataFrame:
    """Group ``df`` by ``keys``.

    aggs: (name, kind, SQL expression) with kind ``sum``, ``count``
        (non-NULL values) or ``max``.
    id_lists: output name -> SQL expression of the id; a row contributes its
        id to the first list whose expression is not NULL (each row feeds at
        most one list).
    Returns keys, the aggregates and one string column per list.
    Expressions are SQL text, so each step is built with one call.
    """
    names = list(id_lists)
    exprs = list(id_lists.values())
    tag = "coalesce(" + ", ".join(f"case when ({e}) is not null then {i} end" for i, e in enumerate(exprs)) \
        + ", cast(null as int))"
    ident = "coalesce(" + ", ".join(f"({e})" for e in exprs) + ")"
    k = [f"`{c}`" for c in keys]
    staged = df.selectExpr(*k, *[f"({e}) as `{n}`" for n, _, e in aggs], f"{tag} as _tag", f"{ident} as _idv")

    # Round 0: distinct ids with partial sums, a plain (codegen) hash
    # aggregate on the typed id; collecting starts only from distinct ids.
    round0 = staged.groupBy(*keys, "_tag", "_idv").agg(
        *[F.expr(f"{_PARTIAL[kind]}(`{n}`) as `{n}`") for n, kind, _ in aggs])
    round1 = (round0.selectExpr(*k, "_tag", *[f"`{n}`" for n, _, _ in aggs], "cast(_idv as string) as _id",
                                f"substring(cast(_idv as string), 1, {int(prefix_len)}) as _chunk")
              .groupBy(*keys, "_tag", "_chunk").agg(
                  *[F.expr(f"{_MERGE[kind]}(`{n}`) as `{n}`") for n, kind, _ in aggs],
                  F.expr("array_join(array_sort(collect_list(_id)), ',') as _ids")))
    round2 = round1.groupBy(*keys).agg(
        *[F.expr(f"{_MERGE[kind]}(`{n}`) as `{n}`") for n, kind, _ in aggs],
        F.expr("array_sort(collect_list(case when _tag is not null then "
               "named_struct('_tag', _tag, '_chunk', _chunk, '_ids', _ids) end)) as _parts"))
    lists = [f"nullif(array_join(transform(filter(_parts, p -> p._tag = {i}), p -> p._ids), ','), '') as `{name}`"
             for i, name in enumerate(names)]
    return round2.selectExpr(*k, *[f"`{n}`" for n, _, _ in aggs], *lists)
