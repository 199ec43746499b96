"""Descendants over all parents, against brute force."""

import random
from collections import defaultdict

import pytest

from cairnlake.operators.hierarchy import hierarchy
from cairnlake.plans import problems


def below_all(links):
    """All (ancestor, descendant) pairs of (child, parent) links, without a node itself."""
    down, out = defaultdict(set), set()
    for c, p in links:
        down[p].add(c)
    for n in list(down):
        seen, todo = set(), [n]
        while todo:
            for y in down.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(n, y) for y in seen if y != n}
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_descendants_over_all_parents(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k:03d}" for k in range(60)]
    links = {(nodes[k], nodes[k - 1]) for k in range(1, 20)}
    links |= {(nodes[rng.randrange(20, 60)], nodes[rng.randrange(0, 56)]) for _ in range(60)}
    if seed:  # cycles, one of them with a way out
        links |= {(nodes[50], nodes[52]), (nodes[52], nodes[51]), (nodes[51], nodes[50]), (nodes[59], nodes[59])}
    data = [(c, p, 0 if c in ("n050", "n051", "n052") and p in ("n050", "n051", "n052") else 1 + rng.randrange(3)) for c, p in links]
    g = hierarchy(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(data, "child string, parent string, ord int"))
    got = [tuple(r) for r in g.all_descendants(g.nodes).collect()]
    want = below_all(links)
    assert len(got) == len(set(got)) and set(got) == want
    counts = defaultdict(int)
    for n, _ in want:
        counts[n] += 1
    rooted = {r["node"] for r in g.root_links().select("node").collect()}
    for r in g.with_paths().collect():
        assert r["n_descendants"] == counts[r["node"]]
        assert (r["path"] is None) == (r["node"] not in rooted)
        if r["path"]:
            steps = r["path"].split("/")
            assert all((c, p) in links for p, c in zip(steps, steps[1:]))


def test_descendants_query(spark, root):
    g = problems._graph(spark, root)
    links = {(r["child"], r["parent"]) for r in g.links.collect()}
    got = {(r["kind"][0] + ":" + r["node"], r["kind"][0] + ":" + r["descendant"]) for r in problems.p2_descendants(spark, root).collect()}
    assert got == below_all(links)


@pytest.mark.parametrize("rows,result_rows", [(0, 0), (10**6, 4)])
def test_distributed_rounds_give_the_same(spark, monkeypatch, rows, result_rows):
    """Without tables in one task, and with results that outgrow one."""
    from test_problems import brute_graph

    from cairnlake.operators import small

    monkeypatch.setattr(small, "ROWS", rows)
    monkeypatch.setattr(small, "RESULT_ROWS", result_rows)
    links = {("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "d"), ("e", "x"), ("f", "e"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "r"), ("g", "s"), ("g", "f"), ("y", "z"), ("z", "y"), ("y", "a"), ("w", "z"), ("l", "l")}
    nodes = sorted({n for pair in links for n in pair})
    g = hierarchy(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([(c, p, 0) for c, p in links], "child string, parent string, ord int"))
    want, cyc = brute_graph(nodes, links)
    assert {tuple(r) for r in g.root_links().collect()} == want
    assert {tuple(r) for r in g.on_cycles.collect()} == cyc
    if not rows:
        assert {tuple(r) for r in g.all_descendants(g.nodes).collect()} == below_all(links)
    up = {tuple(r) for r in g.ancestors(spark.createDataFrame([("g",), ("y",)], "node string")).select("start", "node").collect()}
    assert {(a, b) for a, b in up if a != b} == {(d, a) for a, d in below_all(links) if d in ("g", "y")}
