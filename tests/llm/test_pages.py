"""Tables with spans, hidden elements and lists of pages."""

import random
import time

import pytest

from scenequarry.llm import html_text


def text(page):
    return html_text.render(page)[1]


@pytest.mark.parametrize("n", [20, 160, 1000])
def test_spanned_rows_take_no_time(n):
    began = time.time()
    out = text("<table>" + "<tr><td rowspan=65000 colspan=1000>a" * n)
    assert out.split() == ["a"] * n and time.time() - began < 1.5


def test_stretches_against_single_columns():
    """Held columns by stretches are those held one by one."""
    rng = random.Random(3)
    for _ in range(300):
        old, new, held = [], [], {}
        for out in (old, new):
            at = 0
            for _ in range(rng.randrange(0, 5)):
                at += rng.randrange(0, 4)
                end, free = at + rng.randrange(1, 5), rng.randrange(1, 4)
                out.append((at, end, free))
                for c in range(at, end):
                    held[c] = max(held.get(c, 0), free)
                at = end
        got = html_text._stretches(old, new)
        assert {c: f for a, b, f in got for c in range(a, b)} == held
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_spans_push_cells_aside():
    out = text("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d<tr><td>e</table>").splitlines()
    assert [line.split() for line in out] == [["a", "b"], ["c", "d"], ["e"]]
    assert out[1].index("c") == out[0].index("b") and out[2].index("e") == 0


def test_what_shows():
    assert text("a<ruby>b<rp>(</rp><rt>c</rt><rp>)</rp></ruby>").replace(" ", "") == "abc"
    assert text("<progress value=1>fallback</progress><meter>other</meter>x").strip() == "x"
    assert text("<object>shown</object>").strip() == "shown" and text("<object data=a.swf>hidden</object>x").strip() == "x"
    assert text("<ul><li>one<ul>two</li>three</ul>four</li><li>five</ul>").splitlines() == ["- one", "    two", "    three", "  four", "- five"]
