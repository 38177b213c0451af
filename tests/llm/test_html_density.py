"""Density against its definition, and what decides: densities, not word lists."""

import math
import os
import random
import time

import pytest

from tributary.llm import html_text as H

PAGES = "/root/testdata/sf0.01/pages.parquet"


def tree(r, depth=0):
    """(tag, children), strings among them."""
    tag = r.choice(["div", "p", "a", "section", "span"]) if depth else "body"
    inner = [r.choice([lambda: "".join(r.choice("ab ") for _ in range(r.randrange(1, 40))), lambda: tree(r, depth + 1)])() for _ in range(r.randrange(4))] if depth < 4 else ["text"]
    return tag, inner


def built(t, parent=None):
    node = H.Node(t[0], parent, False)
    node.children = [c if isinstance(c, str) else built(c, node) for c in t[1]]
    return node


def below(t):
    """All elements within."""
    return [x for c in t[1] if not isinstance(c, str) for x in (c, *below(c))]


def chars(t):
    return sum(len(c.replace(" ", "")) if isinstance(c, str) else chars(c) for c in t[1])


def link_chars(t):
    return chars(t) if t[0] == "a" else sum(link_chars(c) for c in t[1] if not isinstance(c, str))


def density(t, body):
    c, tags, lc = chars(t), len(below(t)), link_chars(t)
    lt = tags if t[0] == "a" else sum(x[0] == "a" for x in below(t))
    inner = lambda x: [y for y in below(x)]
    if t[0] != "a":  # all elements within a link belong to it
        seen, lt = set(), 0
        for x in below(t):
            if x[0] == "a" and id(x) not in seen:
                own = inner(x)
                seen |= {id(y) for y in own}
                lt += 1 + len(own)
    if not c:
        return 0.0
    base = math.log(c * lc / max(c - lc, 1) + link_chars(body) / max(chars(body), 1) * c + math.e)
    return c / max(tags, 1) * math.log(max(c * max(tags, 1) / (max(lc, 1) * max(lt, 1)), 1.0)) / base


@pytest.mark.parametrize("seed", range(60))
def test_densities(seed):
    t = tree(random.Random(seed))
    root = built(t)
    H.measure(root)

    def same(node, x):
        assert math.isclose(node.density, density(x, t), rel_tol=1e-9, abs_tol=1e-9)
        inside = [density(c, t) for c in x[1] if not isinstance(c, str)]
        assert math.isclose(node.total, sum(inside) if inside else node.density, rel_tol=1e-9, abs_tol=1e-9)
        for n, c in zip(node.children, x[1]):
            if not isinstance(c, str):
                same(n, c)

    same(root, t)
    nodes = [(root, t)]
    for n, x in nodes:
        nodes += [(k, c) for k, c in zip(n.children, x[1]) if not isinstance(c, str)]
    with_text = [n for n, x in nodes if chars(x)]
    if with_text:  # the core is in the result, whole
        best = max(n.total for n in with_text)
        assert any(isinstance(k, H.Node) and math.isclose(k.total, best) for k in H.content(built(t)))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no tables")
def test_densities_decide(monkeypatch):
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table(PAGES, columns=["html"])["html"].to_pylist() if x]
    with_lists = [H.main_text(x) for x in pages]
    monkeypatch.setattr(H, "MARKS", frozenset())
    assert sum(a != H.main_text(x) for a, x in zip(with_lists, pages)) < len(pages) / 10
    monkeypatch.setattr(H, "ROLES", frozenset())
    monkeypatch.setattr(H, "DROPPED", frozenset(("script", "style", "head", "title", "form")))
    assert sum(a != H.main_text(x) for a, x in zip(with_lists, pages)) < len(pages) / 5


BROKEN = {"tags that don't end": "<a " * 330_000, "depth": "<div>x" * 160_000, "open quotes": "<a ='x>" * 140_000, "ends in vain": "<x><td>" + "<b>" * 100_000 + "</x>" * 100_000, "open comments": "<!--x" * 200_000, "references": "&amp" * 250_000, "signs": "<" * 1_000_000}


@pytest.mark.parametrize("name", BROKEN)
def test_time_is_linear(name):
    times = []
    for part in (len(BROKEN[name]) // 4, len(BROKEN[name])):
        began = time.process_time()
        H.main_text(BROKEN[name][:part])
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0] + 1


def test_threshold_on_the_path():
    para = "<p>" + "Words of the article go on and on, in sentences of some length. " * 6 + "</p>"
    page = f"<body><div><span>ab</span></div><div class='x'><h2>Head</h2><div>{para * 3}</div><div><i>q</i><i>r</i><b>s</b></div></div><p>short</p></body>"
    out = H.main_text(page).split("\n")
    assert out[0] == "Head" and len(out) == 4 and "short" not in out and "ab" not in out
    between = f"<body><div><div>{para}</div><p>short</p><div>{para * 3}</div></div></body>"
    assert "short" in H.main_text(between).split("\n")
    assert H.main_text(f"<article><h1>T</h1><div>{para * 3}</div><p>End.</p></article>").split("\n")[-1] == "End."
