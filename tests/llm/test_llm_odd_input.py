"""Input that is odd in shape or size: broken markup, deep nesting, huge numbers, half characters, rewrapped licences."""

import re
import textwrap
import time

import pytest

from overhaul.llm import chat, html_text, licenses


@pytest.mark.parametrize("page", [
    "<a " * 350_000, '<a "' * 200_000 + ">", "<!" * 500_000, "</" * 400_000, "<svg>" + "</svg " * 200_000, "<!--" * 250_000,
    "<svg>" * 200_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p class='a'>" * 80_000 + "x"])
def test_long_pages_take_linear_time(page):
    began = time.time()
    html_text.blocks(page)
    assert time.time() - began < 20


def test_broken_markup_keeps_text():
    found = lambda page: ["".join(t for _, t in parts).strip() for _, parts in html_text.blocks(page)[0]]
    assert found("a <b>c</b> < d <p title='x>y'>e") == ["a c < d", "e"]
    assert found("<p>one</p><p title='two>three</p><p>four") == ["one", "three", "four"]
    assert found("<svg>x</svg a>y<script>a</script >z <!-- > -->w") == ["y z w"]
    assert found("x <a href=") == ["x <a href="]


def test_depth_does_not_lengthen_paths():
    found, counts, _ = html_text.blocks("<div class='c'>" * 5000 + "x")
    assert len(counts) == 5000 and max(map(len, counts)) < 40 and len(found) == 1


def test_tool_calls_with_odd_arguments(spark):
    schema = {"type": "object", "properties": {"x": {"type": ["integer", "string"], "enum": [1, "a"]}, "n": {"type": "integer", "maximum": 9}}}
    texts = ['{"x":"\\ud800"}', '{"n":' + "9" * 400 + "}", '{"n":' + "9" * 5000 + "}", '{"x":true}', '{"x":1.0}', '{"n":1e400}', '{"x":"a"}']
    calls = spark.createDataFrame([(1, k, f"c{k}", "t", t) for k, t in enumerate(texts)], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    errors = {r.call_id: r.errors for r in chat.link(calls, results, {"t": schema}).collect()}
    assert errors == {"c0": ["$: not JSON"], "c1": ["$.n: too large"], "c2": ["$: not JSON"], "c3": ["$.x: not integer/string"],
                      "c4": [], "c5": ["$: not JSON"], "c6": []}
    for bad in ({"type": "string", "pattern": "a"}, {"properties": {"x": {"exclusiveMinimum": 1}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            chat.link(calls, results, {"t": bad})


def wrappings(text):
    """As it is, a paragraph to a line, 60 and 78 columns, CRLF, with comment signs."""
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    yield text
    yield "\n\n".join(parts)
    for width in (60, 78):
        wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in parts)
        yield wrapped
        yield wrapped.replace("\n", "\r\n")
        yield "\n".join(" * " + line for line in wrapped.split("\n"))


def test_known_licences_however_wrapped(spark):
    top = "Copyright (c) 2019 Some One\nCopyright 2020, 2021 Others <o@example.org>\nAll rights reserved.\n\n"
    rows = []
    for name, text in dict(licenses.bodies()).items():
        heading = licenses.HEADINGS.get(name, [""])[0]
        rows += [(len(rows) + k, name, f"{heading}\n\n{top}{t}") for k, t in enumerate(wrappings(text))]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, _, t in rows], "doc_id long, text string, licence string, digest string")
    found = {(r.doc_id, r.licence) for r in licenses.scan(docs).where("whole_text").collect()}
    assert {(d, n) for d, n, _ in rows} - found == set()
    # a table that holds licences gives the same whatever its other columns
    plain = sorted(map(tuple, licenses.scan(docs.select("doc_id", "text")).collect()))
    assert sorted(map(tuple, licenses.scan(docs).collect())) == plain and len(plain) >= len(rows)
