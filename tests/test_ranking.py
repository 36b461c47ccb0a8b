"""Distributed numbering equals a sort-and-enumerate done by hand."""

from hypothesis import given, settings, strategies as st

from overhaul.functions.ranking import positions_within, row_numbers

rows_strategy = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(0, 30)),
                                   st.integers(0, 10**6)), min_size=1, max_size=80, unique_by=lambda r: r[2])


@settings(max_examples=10, deadline=None)
@given(rows=rows_strategy)
def test_positions_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, u long").repartition(5)
    got = {(r.g, r.u): r.position for r in positions_within(df, ["g"], ["k", "u"]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected.update({(g, r[2]): i for i, r in enumerate(mine)})
    assert got == expected


def test_row_numbers_dense_from_zero(spark):
    df = spark.range(0, 3000).selectExpr("id * 13 % 3001 as v").repartition(7)
    got = sorted((r.v, r._row) for r in row_numbers(df, ["v"]).collect())
    assert [n for _, n in got] == list(range(3000))
