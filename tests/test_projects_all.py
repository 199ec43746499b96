"""Dependencies of every project, against brute force."""

from collections import defaultdict

from cairnlake.operators import dependencies as D
from cairnlake.plans import activity
from cairnlake.plans import relations as R


def brute_reach(start, parents):
    seen, todo = {start}, [start]
    while todo:
        for y in parents[todo.pop()]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_dependencies_of_every_project(spark, root):
    nodes, edges = R.dependency_nodes(spark, root), R.dependency_edges(spark, root)
    state = {r["node"]: r for r in nodes.collect()}
    uses = defaultdict(set)
    for r in edges.collect():
        if r["src"] in state and state[r["src"]]["is_project"]:
            uses[r["src"]].add(r["dst"])
    want = {(p, n) for p, r in state.items() if r["is_project"] for n in brute_reach(p, uses) - {p}}
    starts = activity._projects(spark, root)
    got = [tuple(r) for r in D.in_blocks(D.closure, starts, nodes, edges, 20_000).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = defaultdict(lambda: [0, 0, 0])
    for p, n in want:
        if n in state:
            counts[p][2 if not state[n]["exists_on_disk"] else 0 if state[n]["is_tracked"] else 1] += 1
    assert {r[0]: list(r[1:]) for r in activity.QUERIES["dep_validate"](spark, root).collect()} == dict(counts)
