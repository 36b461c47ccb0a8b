"""The two-round id lists equal a brute-force string_agg(distinct) per group."""

from hypothesis import given, settings, strategies as st

from overhaul.functions.idlists import summarize_with_id_lists

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 2500)),
              st.integers(-5, 5), st.booleans()),
    min_size=0, max_size=60)


def brute(rows):
    out = {}
    for g, i, v, flag in rows:
        e = out.setdefault(g, {"s": None, "n": 0, "m": None, "x": set(), "y": set()})
        e["s"] = v if e["s"] is None else e["s"] + v
        e["n"] += i is not None
        e["m"] = v if e["m"] is None else max(e["m"], v)
        if i is not None:
            (e["x"] if flag else e["y"]).add(str(i))
    fmt = lambda s: ",".join(sorted(s)) or None
    return {g: (e["s"], e["n"], e["m"], fmt(e["x"]), fmt(e["y"])) for g, e in out.items()}


@settings(max_examples=15, deadline=None)
@given(rows=rows_strategy, prefix=st.integers(1, 3))
def test_matches_brute_force(spark, rows, prefix):
    df = spark.createDataFrame(rows, "g string, i long, v int, flag boolean")
    out = summarize_with_id_lists(
        df, ["g"], [("s", "sum", "v"), ("n", "count", "i"), ("m", "max", "v")],
        {"x": "case when flag then i end", "y": "case when not flag then i end"},
        prefix_len=prefix)
    got = {r.g: (r.s, r.n, r.m, r.x, r.y) for r in out.collect()}
    assert got == brute(rows)
