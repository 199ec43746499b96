"""The loops of :mod:`cairnlake.operators.hierarchy` on tables that one task can hold.

A round of a distributed loop costs a second or so whatever it does.  Once a table has no more than ``ROWS`` rows, one task
carries on with the same rounds on arrays.  Nothing is dropped: whatever outgrows the bound on the way is handed back to
the distributed loop as it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that one task may hold (five numbers each), and of a result that it may build up.
ROWS, RESULT_ROWS = 250_000, 2_000_000

#: Links and starts that :func:`hubs` may hold, rows that it may build up, nodes that it takes for its hubs, and nodes that
#: it tries for each. A start that reaches no more nodes than ``NEAR`` on average isn't worth a hub.
LINKS, HUB_ROWS, HUBS, TRIED, NEAR = 4_000_000, 8_000_000, 32, 16, 16

#: Kinds of rows that :func:`hubs` gives.
SET, MEMBER, SEED, LINK, NAME, PAIRS = range(6)


def in_one_task(df: DataFrame, schema: str, solve: Callable[..., tuple]) -> DataFrame:
    """``solve`` over the columns of ``df`` (bigints; nulls come as -1) as arrays, giving those of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            out = [np.asarray(c) for c in solve(*columns)]
            for at in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000].astype(np.int64)) for c in out], names)

    return df.select(*[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in df.columns]).repartition(1).mapInArrow(run, schema)


def _positions(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` lie in the sorted ``ids``; -1 stays."""
    return np.where(wanted < 0, -1, np.searchsorted(ids, wanted))


def upward(ids: np.ndarray, parent: np.ndarray, kind: np.ndarray) -> tuple:
    """(id, parent, kind, size, low, stuck): subtree sizes by doubling, and what lies at or below a cycle."""
    order = np.argsort(ids)
    ids, parent, kind = ids[order], parent[order], kind[order]
    up = _positions(ids, parent)
    size, low = np.ones(len(ids), np.int64), np.arange(len(ids))
    active = int((up >= 0).sum())
    while active:
        go = np.flatnonzero(up >= 0)
        to = up[go]
        below = np.zeros(len(ids), np.int64)
        np.add.at(below, to, size[go])
        lower = np.minimum(low[go], low[to])
        moved = bool((lower < low[go]).any())
        size, up[go], low[go] = size + below, up[to], lower
        left = int((up >= 0).sum())
        if left == active and not moved:
            break
        active = left
    return ids, parent, kind, size, ids[low], up >= 0


def downward(ids: np.ndarray, parent: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple:
    """(id, parent, size, pre, depth, top, top_kind): sibling ranges by prefix sums, summed downward by doubling."""
    order = np.argsort(ids)
    ids, parent, size, kind = ids[order], parent[order], size[order], kind[order]
    up = _positions(ids, parent)
    siblings = np.argsort(up, kind="stable")
    before = np.cumsum(size[siblings]) - size[siblings]
    first = np.flatnonzero(np.diff(up[siblings], prepend=-2))
    before -= np.repeat(before[first], np.diff(np.append(first, len(ids))))
    pre, depth, top = np.empty_like(before), (up >= 0).astype(np.int64), np.arange(len(ids))
    pre[siblings] = before
    pre += depth
    go = np.flatnonzero(up >= 0)
    top[go] = up[go]
    while len(go):
        to = up[go]
        pre[go], depth[go], top[go], up[go] = pre[go] + pre[to], depth[go] + depth[to], top[to], up[to]
        go = go[up[go] >= 0]
    return ids, parent, size, pre, depth, ids[top], kind[top]


def _least(code: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its least links."""
    order = np.lexsort((links, code))
    code, links = code[order], links[order]
    keep = np.diff(code, prepend=-1) != 0
    return code[keep], links[keep]


def relax(side: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> tuple:
    """(at, key, links, front) from seeds (side 0: at, key, links) and edges (side 1: src, dst, links); ``front`` marks what
    still has to go on because the result outgrew its bound."""
    seed, edge = side == 0, side == 1
    places = np.unique(np.concatenate([a[seed], a[edge], b[edge]]))
    keys = np.unique(b[seed])
    src, dst, length = np.searchsorted(places, a[edge]), np.searchsorted(places, b[edge]), links[edge]
    order = np.argsort(src, kind="stable")
    src, dst, length = src[order], dst[order], length[order]
    starts = np.searchsorted(src, np.arange(len(places) + 1))
    width = max(1, len(keys))
    code, best = _least(np.searchsorted(places, a[seed]) * width + np.searchsorted(keys, b[seed]), links[seed])
    front, far = code, best
    while len(front) and len(code) <= RESULT_ROWS:
        at = front // width
        n = starts[at + 1] - starts[at]
        which = np.repeat(np.arange(len(front)), n)
        e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
        more, way = _least(dst[e] * width + front[which] % width, far[which] + length[e])
        k = np.minimum(np.searchsorted(code, more), len(code) - 1)
        better = (code[k] != more) | (way < best[k])
        front, far = more[better], way[better]
        code, best = _least(np.concatenate([code, front]), np.concatenate([best, far]))
    return places[code // width], keys[code % width], best, np.isin(code, front)


def _sorted_links(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's links begin, and where they lead."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _walk(links: tuple[np.ndarray, np.ndarray], front: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which nodes are reached from those of ``front``, themselves included, over nodes that are ``inside`` only."""
    begin, to = links
    seen = np.zeros(len(inside), bool)
    seen[front] = True
    while len(front):
        n = begin[front + 1] - begin[front]
        near = to[np.arange(n.sum()) + np.repeat(begin[front] - (np.cumsum(n) - n), n)]
        front = np.unique(near[inside[near] & ~seen[near]])
        seen[front] = True
    return seen


def hubs(side: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """(kind, x, y): all that starts (side 0: a) reach over links (side 1: a to b), as sets that many starts share.

    A hub splits the walks in two. Starts that reach it reach all that it reaches: that set is given once (SET: number,
    node), with those starts (MEMBER: number, start); they go on without the nodes of the set, from which nothing leads
    out. The others go on without the nodes that lead to the hub, which they can't meet. Both are split again while a hub
    saves a twentieth of their pairs or more. What is left is a graph to walk link by link: its nodes are numbered, as
    often as walks of several kinds meet them (NAME: number, node), with starts (SEED: number, start) and links (LINK:
    number to number); PAIRS: about how many pairs of a start and a node these walks will give.

    Hubs are picked from what some of the starts reach. That decides how much is shared, not what is found.
    """
    seed, link = side == 0, side == 1
    places = np.unique(np.concatenate([a, b[link]]))
    n = len(places)
    src, dst = np.searchsorted(places, a[link]), np.searchsorted(places, b[link])
    onward, back = _sorted_links(src, dst, n), _sorted_links(dst, src, n)
    degree = (np.diff(onward[0]) + 1) * (np.diff(back[0]) + 1)
    rng = np.random.default_rng(0)
    some = lambda of, k: of if len(of) <= k else rng.choice(of, k, replace=False)
    out: list[tuple[np.ndarray, ...]] = []
    give = lambda kind, x, y: out.append((np.full(len(x), kind), x, y))
    first = np.zeros(n, bool)
    first[np.searchsorted(places, a[seed])] = True
    todo, found, given, numbered = [(first, np.ones(n, bool))], 0, 0, 0
    while todo:
        starts, inside = todo.pop()
        at = np.flatnonzero(starts)
        if not len(at):
            continue
        seen = [_walk(onward, np.array([x]), inside) for x in some(at, TRIED)]
        often = np.sum(seen, axis=0)
        pairs = int(often.sum() / len(seen) * len(at))
        saved, best = max(pairs // 20, 1), None
        if pairs > NEAR * len(at) and found < HUBS and given < HUB_ROWS:
            met = np.flatnonzero(often >= often.max() / 2)
            tried = np.zeros(n, bool)
            for x in np.concatenate([some(at, TRIED), some(met, TRIED), met[np.argsort(degree[met])[-TRIED:]]]):
                if not tried[x]:
                    below, above = _walk(onward, np.array([x]), inside), _walk(back, np.array([x]), inside)
                    tried |= below & above
                    if (pays := int(below.sum()) * int((above & starts).sum())) >= saved:
                        saved, best = pays, (below, above)
        if best:
            below, above = best
            nodes, members = np.flatnonzero(below), np.flatnonzero(above & starts)
            give(SET, np.full(len(nodes), found), places[nodes])
            give(MEMBER, np.full(len(members), found), places[members])
            found, given = found + 1, given + len(nodes) + len(members)
            todo += [(starts & above & ~below, inside & ~below), (starts & ~above, inside & ~above)]
        else:
            reached = _walk(onward, at, inside)
            number = numbered + np.cumsum(reached) - 1
            e = np.flatnonzero(reached[src] & reached[dst])
            give(NAME, number[reached], places[reached])
            give(SEED, number[at], places[at])
            give(LINK, number[src[e]], number[dst[e]])
            give(PAIRS, np.array([pairs]), np.array([0]))
            numbered += int(reached.sum())
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def components(a: np.ndarray, b: np.ndarray) -> tuple:
    """(portal, scc) of the nodes of edges (a, b) that lie on cycles: both ends are peeled until only cycles and what lies
    between them is left; each walk through the rest then numbers its components by their greatest node."""
    while len(a):
        keep = np.isin(b, a) & np.isin(a, b)
        if keep.all():
            break
        a, b = a[keep], b[keep]
    onward: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        onward.setdefault(x, []).append(y)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    on: set[int] = set()
    out: list[tuple[int, int]] = []
    for start in onward:
        if start in number:
            continue
        work = [(start, iter(onward[start]))]
        number[start] = low[start] = len(number)
        open_.append(start)
        on.add(start)
        while work:
            x, rest = work[-1]
            for y in rest:
                if y not in number:
                    number[y] = low[y] = len(number)
                    open_.append(y)
                    on.add(y)
                    work.append((y, iter(onward.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], number[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == number[x]:
                    part = []
                    while not part or part[-1] != x:
                        part.append(open_.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or x in onward.get(x, ()):
                        out += [(y, max(part)) for y in part]
    return np.array([x for x, _ in out], np.int64), np.array([c for _, c in out], np.int64)
