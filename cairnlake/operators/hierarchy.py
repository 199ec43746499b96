"""From parent-child links to full hierarchies, by nested sets.

Nodes get numbers first; everything below works on numbers.

1. *Chains.*  Every node with one parent hangs below it; nodes without parent and nodes with several (*portals*) are the
   tops of trees.  Subtree sizes are summed upward, siblings get consecutive preorder ranges by prefix sums, and these
   are summed downward together with the depth.  Both directions go by doubling: in round k a node knows its ancestor
   2^k links up, so a chain of any length takes as many rounds as its length has binary digits.  Nodes that still have
   an ancestor when a round resolves nobody are unprocessed: they lie on a cycle or below one.  Such a cycle is cut at
   its least node, which is a portal from then on.
2. *Portals.*  Each parent of a portal leads to the top of its tree.  On this much smaller graph the fewest links to
   every root are relaxed link by link, only what became better going on; peeling off the portals that nothing leads to
   or that lead nowhere leaves those on cycles, and those between two cycles.
3. *The forest.*  A portal's primary parent is the one nearest to a root (then by ``ord`` and name), so that no cycle
   of primary links can arise.  The forest of primary parents is numbered like the chains.  The descendants of a node
   are the nodes whose number lies in its range, or in the range of a portal that reaches it over another parent.

Tables that one task can hold are solved there (:mod:`cairnlake.operators.small`), by the same rounds on arrays.
Rounds of step 2 are as many as the longest way has portals, those of the other steps grow with the logarithm of the
depth.  No table is larger than the nodes, the links, or the result asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators import small
from cairnlake.operators.ranks import parts_for, running
from cairnlake.session import cut, staged

#: What the top of a tree is: a root, a portal, a node whose only parent is itself, the node where a cycle was cut.
ROOT, PORTAL, LONE, CUT = 1, 2, 3, 4


def _portal(c: str = "top_kind") -> Column:
    return F.col(c).isin(PORTAL, CUT)


# -- numbering a forest --------------------------------------------------------------------------------------------


def _upward(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Subtree sizes of ``rows`` (id, parent, kind): (id, parent, kind, size) of the nodes that have a top, (id, parent, low)
    of those at or below a cycle (None if there is none; ``low`` is the least number above), and the number of rounds."""
    if rows.count() <= small.ROWS:
        t = staged(small.in_one_task(rows.select("id", "parent", "kind"), "id long, parent long, kind long, size long, low long, stuck long", small.upward), "upward")
        t = t.select("id", _known("parent"), _known("kind"), "size", "low", "stuck")
        stuck = t.where("stuck = 1").select("id", "parent", "low")
        return t.where("stuck = 0").select("id", "parent", "kind", "size"), None if stuck.isEmpty() else stuck, 64
    t = cut(rows.select("id", "parent", "kind", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.col("id").alias("low"), F.lit(False).alias("moved")))
    active, rounds = t.where("up is not null").count(), 0
    while active:
        going = t.where("up is not null")
        above = t.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jumped = going.join(above, "up").select("id", "parent", "kind", F.col("up2").alias("up"), "size", F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        ended = t.where("up is null").withColumn("moved", F.lit(False))
        below = going.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("below"))
        rows = jumped.unionByName(ended).join(below, "id", "left")
        t = cut(rows.withColumn("size", F.col("size") + F.coalesce("below", F.lit(0))).drop("below"), t)
        state = t.where("up is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved")).first()
        rounds += 1
        if state["n"] == active and not state["moved"]:
            return t.where("up is null").select("id", "parent", "kind", "size"), t.where("up is not null").select("id", "parent", "low"), rounds
        active = state["n"]
    return t.select("id", "parent", "kind", "size"), None, rounds


def _downward(sized: DataFrame, rounds: int) -> DataFrame:
    """(id, parent, size, pre, depth, top, top_kind) of a forest (id, parent, kind, size): the nodes at and below a node are
    those with pre <= number < pre + size; depth counts links to the top."""
    n = sized.count()
    if n <= small.ROWS:
        t = staged(small.in_one_task(sized.select("id", "parent", "size", "kind"), "id long, parent long, size long, pre long, depth long, top long, top_kind long", small.downward), "downward")
        return t.withColumns({"parent": _known("parent"), "top_kind": _known("top_kind")})
    step = running(sized.withColumn("at", F.coalesce("parent", F.lit(-1))), ["at"], "id", parts_for(n), left=F.col("size"))
    top = F.col("parent").isNull()
    t = cut(
        step.select(
            "id", "parent", "size", F.col("parent").alias("up"), (F.col("left") + F.when(top, 0).otherwise(1)).alias("pre"),
            F.when(top, 0).otherwise(1).cast("long").alias("depth"), F.when(top, F.col("id")).alias("top"), F.when(top, F.col("kind")).alias("top_kind"),
        )
    )
    for _ in range(rounds):
        if rounds == 64 and t.where("up is not null").isEmpty():  # sizes came from one task, which doesn't tell its rounds
            break
        above = t.select(F.col("id").alias("up"), *[F.col(c).alias(c + "2") for c in ("up", "pre", "depth", "top", "top_kind")])
        jumped = t.where("up is not null").join(above, "up").select(
            "id", "parent", "size", F.col("up2").alias("up"), (F.col("pre") + F.col("pre2")).alias("pre"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("top2").alias("top"), F.col("top_kind2").alias("top_kind")
        )
        t = cut(jumped.unionByName(t.where("up is null")), t)
    return t.drop("up")


def small_table(df: DataFrame) -> bool:
    """Whether one task can hold ``df``; looks at no more rows than that."""
    return df.limit(small.ROWS + 1).count() <= small.ROWS


def _known(c: str) -> Column:
    """The numbers of a column of :func:`small.in_one_task`, with nulls again."""
    return F.when(F.col(c) >= 0, F.col(c)).alias(c)


def relax(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """(at, key, links): the fewest links from where ``seed`` (at, key, links) starts each key over ``edges`` (src, dst, links).

    Only what became better in a round goes on in the next; keys that meet a cycle end there, since no way round it is
    shorter.  Rounds: the links of the longest of the shortest ways.
    """
    best = lambda df: df.groupBy("at", "key").agg(F.min("links").alias("links"))
    if small_table(seed) and small_table(edges):
        both = seed.select(F.lit(0).alias("side"), F.col("at").alias("a"), F.col("key").alias("b"), "links").unionByName(edges.select(F.lit(1).alias("side"), F.col("src").alias("a"), F.col("dst").alias("b"), "links"))
        t = staged(small.in_one_task(both, "at long, key long, links long, front long", small.relax), "relaxed")
        known, front = t.select("at", "key", "links"), t.where("front = 1").select("at", "key", "links")
        if front.isEmpty():
            return known
        parts, k = [], 0
    else:
        front = cut(best(seed.select("at", "key", "links")))
        known, parts, k = front, [front], 0
    while not front.isEmpty():
        more = best(front.join(edges, front["at"] == edges["src"]).select(F.col("dst").alias("at"), "key", (front["links"] + edges["links"]).alias("links")))
        old = best(known).withColumnRenamed("links", "old")
        front = cut(more.join(old, ["at", "key"], "left").where("old is null or links < old").select("at", "key", "links"))
        known, k = known.unionByName(front), k + 1
        parts.append(front)
        if k % 6 == 0:
            known = cut(best(known), *parts[:-1])
            parts = [known, front]
    return cut(best(known), *parts)


@dataclass
class Hierarchy:
    """A graph of ``names`` (id, node) and ``arcs`` (child, parent, ord), both distinct; arcs join numbers of the graph."""

    names: DataFrame
    arcs: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.names.select("node")

    @property
    def links(self) -> DataFrame:
        """(child, parent, ord) by name."""
        return self.named(self.arcs, "child", "parent")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the names in place of the numbers in these columns; rows whose number is null stay."""
        order = df.columns
        for c in columns:
            df = df.join(self.names.select(F.col("id").alias(c), F.col("node").alias("_name")), c, "left").withColumn(c, F.col("_name")).drop("_name")
        return df.select(*order)

    def numbered(self, df: DataFrame, name: str = "node") -> DataFrame:
        """(id, name): the rows of ``df`` whose name is a node, each once."""
        return df.select(F.col(name).alias("node")).distinct().join(self.names, "node").select("id", "node")

    # -- chains ----------------------------------------------------------------------------------------------------

    @cached_property
    def chains(self) -> DataFrame:
        """(id, parent, size, pre, depth, top, top_kind): the forest of the nodes with one parent, numbered."""
        other = F.col("child") != F.col("parent")
        per = self.arcs.groupBy(F.col("child").alias("id")).agg(F.count_if(other).alias("n"), F.max(F.when(other, F.col("parent"))).alias("only"))
        kind = F.when(F.col("n").isNull(), ROOT).when(F.col("n") > 1, PORTAL).when(F.col("n") == 0, LONE)
        start = self.names.select("id").join(per, "id", "left").select("id", F.when(F.col("n") == 1, F.col("only")).alias("parent"), kind.alias("kind"))
        sized, stuck, rounds = _upward(start)
        if stuck is not None:
            at = F.col("low") == F.col("id")
            opened = stuck.select("id", F.when(~at, F.col("parent")).alias("parent"), F.when(at, CUT).alias("kind"))
            more, none, r = _upward(opened)
            assert none is None
            sized, rounds = sized.unionByName(more), max(rounds, r)
        return _downward(sized, rounds)

    # -- portals ---------------------------------------------------------------------------------------------------

    @cached_property
    def steps(self) -> DataFrame:
        """(portal, via, ord, links, target, root): each parent ``via`` of each portal, and what lies at the top of its tree:
        another portal (target), a root, or neither; ``links`` from the portal to there."""
        portals = self.chains.where(F.col("parent").isNull() & _portal()).select(F.col("id").alias("child"))
        up = self.chains.select(F.col("id").alias("parent"), "depth", "top", "top_kind")
        over = self.arcs.where("child <> parent").join(portals, "child", "left_semi").join(up, "parent")
        return staged(
            over.select(
                F.col("child").alias("portal"), F.col("parent").alias("via"), "ord", (F.col("depth") + 1).alias("links"),
                F.when(_portal(), F.col("top")).alias("target"), F.when(F.col("top_kind") == ROOT, F.col("top")).alias("root"),
            ),
            "steps",
        )

    @cached_property
    def _near(self) -> DataFrame:
        """(portal, root, links): every root that a portal descends from, with the fewest links."""
        seed = self.steps.where("root is not null").select(F.col("portal").alias("at"), F.col("root").alias("key"), "links")
        down = self.steps.where("target is not null").groupBy(F.col("target").alias("src"), F.col("portal").alias("dst")).agg(F.min("links").alias("links"))
        return relax(seed, cut(down)).select(F.col("at").alias("portal"), F.col("key").alias("root"), "links")

    @cached_property
    def portal_cycles(self) -> DataFrame:
        """(portal, scc): the portals on cycles; portals on one cycle have one scc."""
        edges = cut(self.steps.where("target is not null").select("portal", "target").distinct())
        n = edges.count()
        if n <= small.ROWS:
            return staged(small.in_one_task(edges, "portal long, scc long", small.components), "components")
        while n:  # peel both ends: what nothing leads to, and what leads nowhere
            onward, reached = edges.select(F.col("portal").alias("target")).distinct(), edges.select(F.col("target").alias("portal")).distinct()
            edges = cut(edges.join(onward, "target", "left_semi").join(reached, "portal", "left_semi").select("portal", "target"), edges)
            if (m := edges.count()) == n:
                break
            n = m
        rest = cut(edges.select("portal").distinct())
        found = rest.limit(0).withColumn("scc", F.col("portal"))
        within = lambda e, k: e.join(k.select("portal"), "portal", "left_semi").join(k.select(F.col("portal").alias("target")), "target", "left_semi")
        while not rest.isEmpty():
            color = rest.withColumn("color", F.col("portal"))
            while True:  # the greatest number that a portal reaches
                best = edges.join(color.select(F.col("portal").alias("target"), F.col("color").alias("c2")), "target").groupBy("portal").agg(F.max("c2").alias("c2"))
                color = cut(color.join(best, "portal", "left").select("portal", F.greatest("color", "c2").alias("color"), (F.col("c2") > F.col("color")).alias("moved")))
                moved = not color.where("moved").isEmpty()
                color = color.drop("moved")
                if not moved:
                    break
            same = cut(
                edges.join(color.select("portal", "color"), "portal").join(color.select(F.col("portal").alias("target"), F.col("color").alias("color2")), "target").where("color = color2").select("portal", "target", "color")
            )
            front = inside = cut(color.where("portal = color").select("portal", "color"))
            while not front.isEmpty():  # what the number's own portal reaches within its color: its component
                more = same.join(front, ["portal", "color"], "left_semi").select(F.col("target").alias("portal"), "color").distinct()
                front = cut(more.join(inside, ["portal", "color"], "left_anti"))
                inside = inside.unionByName(front)
            inside = cut(inside)
            cyclic = same.join(inside, ["portal", "color"], "left_semi").join(inside.select(F.col("portal").alias("target"), "color"), ["target", "color"], "left_semi")
            found = cut(found.unionByName(cyclic.select("portal", F.col("color").alias("scc")).distinct()))
            rest = cut(rest.join(inside.select("portal"), "portal", "left_anti"))
            edges = cut(within(edges, rest))
        return found

    @cached_property
    def cyclic(self) -> DataFrame:
        """(id, scc): every node on a cycle of several nodes, and which nodes share one.

        A cycle runs from portal to portal of one component, each time over a parent and up that parent's tree: the nodes
        that have such a parent in their range, in the tree of a portal of the component.
        """
        scc = self.portal_cycles
        inner = self.steps.where("target is not null").join(scc, "portal").join(scc.select(F.col("portal").alias("target"), F.col("scc").alias("scc2")), "target").where("scc = scc2")
        marks = cut(inner.groupBy("target", F.col("via").alias("id")).agg(F.max("scc").alias("scc")))
        if marks.isEmpty():
            return marks.select("id", "scc")
        trees = marks.select(F.col("target").alias("top"), "scc").distinct()
        among = self.chains.join(trees.select("top"), "top", "left_semi")
        sums = _range_sums(among, marks.select("id", F.lit(1).cast("long").alias("mark")))
        return cut(sums.where("total > 0").join(among.select("id", "top"), "id").join(trees, "top").select("id", "scc"), marks)

    @cached_property
    def on_cycles(self) -> DataFrame:
        """(node): every node on a cycle, a node naming itself included."""
        itself = self.arcs.where("child = parent").select(F.col("child").alias("id"))
        return self.named(self.cyclic.select("id").unionByName(itself).distinct(), "id").select(F.col("id").alias("node"))

    def root_links(self) -> DataFrame:
        """(node, root, n_links): for each node every root it descends from over any parents, with the fewest links."""
        own = self.chains.where(F.col("top_kind") == ROOT).select("id", F.col("top").alias("root"), F.col("depth").alias("n_links"))
        via = self.chains.where(_portal()).select("id", "depth", F.col("top").alias("portal"))
        carried = via.join(self._near, "portal").select("id", "root", (F.col("depth") + F.col("links")).alias("n_links"))
        return self.named(own.unionByName(carried), "id", "root").withColumnRenamed("id", "node")

    # -- upward from some nodes ------------------------------------------------------------------------------------

    def _tops(self, starts: DataFrame) -> DataFrame:
        return starts.join(self.chains.select("id", "depth", "top", "top_kind"), "id")

    def ancestors(self, of: DataFrame) -> DataFrame:
        """(start, node, steps): all that each node of ``of`` (node) reaches over any parents, itself with 0 steps, by the
        fewest steps.  Each portal reached is entered once, then the nodes whose ranges hold its parents are read off."""
        starts = cut(self.numbered(of).select("id"))
        up = cut(self.steps.where("target is not null").groupBy(F.col("portal").alias("src"), F.col("target").alias("dst")).agg(F.min("links").alias("links")))
        seed = self._tops(starts).where(_portal()).select(F.col("top").alias("at"), F.col("id").alias("key"), F.col("depth").alias("links"))
        met = relax(seed, up)
        over = self.steps.select(F.col("portal").alias("at"), F.col("via").alias("id"))
        entered = met.join(over, "at").select(F.col("key").alias("start"), "id", (F.col("links") + 1).alias("base"))
        entered = cut(entered.unionByName(starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("base"))).groupBy("start", "id").agg(F.min("base").alias("base")))
        ranges = self.chains.select(F.col("id").alias("node"), F.col("depth").alias("high"), F.col("pre").alias("a"), (F.col("pre") + F.col("size")).alias("b"))
        points = self.chains.join(entered.select("id").distinct(), "id", "left_semi").select("id", "depth", F.col("pre").alias("at"))
        above = _in_ranges(ranges, points, self._n).select("id", "node", (F.col("depth") - F.col("high")).alias("d"))
        out = entered.join(above, "id").groupBy("start", "node").agg(F.min(F.col("base") + F.col("d")).alias("steps"))
        return self.named(out, "start", "node")

    def marked(self, of: DataFrame) -> DataFrame:
        """(node): all that some node of ``of`` (node) reaches over any parents, itself included: a set of portals that were
        visited, then the nodes that have a mark in their range."""
        starts = self.numbered(of).select("id")
        up = cut(self.steps.where("target is not null").select(F.col("portal").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("links")).distinct())
        seed = self._tops(starts).where(_portal()).select(F.col("top").alias("at"), F.lit(0).alias("key"), F.lit(0).alias("links"))
        over = relax(seed, up).select(F.col("at").alias("portal")).join(self.steps, "portal").select(F.col("via").alias("id"))
        marks = starts.unionByName(over).distinct().withColumn("mark", F.lit(1).cast("long"))
        return self.named(_range_sums(self.chains, marks).where("total > 0").select("id"), "id").select(F.col("id").alias("node"))

    def heads(self) -> DataFrame:
        """(node): every node that is no other node's parent, and of each cycle that nothing outside leads to the greatest node."""
        links = self.arcs.where("child <> parent")
        free = self.names.join(links.select(F.col("parent").alias("id")).distinct(), "id", "left_anti").select("id", "node")
        scc = self.cyclic
        if scc.isEmpty():
            return free.select("node")
        of = scc.select(F.col("id").alias("child"), F.col("scc").alias("child_scc"))
        led = links.join(scc.withColumnRenamed("id", "parent"), "parent").join(of, "child", "left").where("child_scc is null or child_scc <> scc").select("scc")
        last = scc.join(led.distinct(), "scc", "left_anti").join(self.names, "id").groupBy("scc").agg(F.max("node").alias("node")).select("node")
        return free.select("node").unionByName(last)

    # -- the forest of primary parents -------------------------------------------------------------------------------

    @cached_property
    def _n(self) -> int:
        return self.names.count()

    @cached_property
    def forest(self) -> DataFrame:
        """(id, parent, size, pre, depth, top, top_kind): every node below its primary parent; portals that descend from no
        root are tops."""
        near = self._near.groupBy(F.col("portal").alias("target")).agg(F.min("links").alias("more"))
        ways = self.steps.join(near, "target", "left").where("root is not null or more is not null")
        ways = ways.select("portal", "via", "ord", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links")).join(self.names.select(F.col("id").alias("via"), "node"), "via")
        best = ways.groupBy(F.col("portal").alias("id")).agg(F.min(F.struct("links", "ord", "node", "via"))["via"].alias("best"))
        tops = F.when(F.col("parent").isNull() & F.col("best").isNull(), F.col("top_kind"))
        rows = self.chains.join(best, "id", "left").select("id", F.coalesce("parent", "best").alias("parent"), tops.alias("kind"))
        sized, stuck, rounds = _upward(rows)
        assert stuck is None
        return _downward(sized, rounds)

    @cached_property
    def nested(self) -> DataFrame:
        """(node, parent, depth, top, pre, size, unprocessed) of the forest, by name."""
        return self.named(self.forest.select("id", "parent", "depth", "top", "pre", "size", (F.col("top_kind") != ROOT).alias("unprocessed")), "id", "parent", "top").withColumnRenamed("id", "node")

    def with_paths(self, names: DataFrame | None = None, separator: str = "/") -> DataFrame:
        """(node, path, depth, root, pre, size, n_descendants, unprocessed) of each node.

        ``path`` joins the names - ``names`` (node, name), else the node keys - from the nearest root down, by the fewest
        links (ties: the least ord, then the least parent).  Depth, root and path are null where no root lies above;
        ``size`` is that of the range, ``n_descendants`` counts over all parents, without the node itself.
        """
        own = self.names if names is None else self.names.join(names.dropDuplicates(["node"]), "node", "left").select("id", F.coalesce("name", "node").alias("node"))
        t = cut(self.forest.join(own, "id").select("id", F.col("parent").alias("up"), F.col("node").alias("path")))
        while not t.where("up is not null").isEmpty():
            above = t.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
            jumped = t.where("up is not null").join(above, "up").select("id", F.col("up2").alias("up"), F.concat_ws(separator, "path2", "path").alias("path"))
            t = cut(jumped.unionByName(t.where("up is null")), t)
        below = self.covers.groupBy("id").agg((F.sum(F.col("b") - F.col("a")) - 1).alias("n_descendants"))
        rooted = F.col("top_kind") == ROOT
        known = lambda c: F.when(rooted, F.col(c)).alias({"top": "root"}.get(c, c))
        out = self.forest.join(t.select("id", "path"), "id").join(below, "id").select("id", known("path"), known("depth"), known("top"), "pre", "size", "n_descendants", (~rooted).alias("unprocessed"))
        return self.named(out, "id", "root").withColumnRenamed("id", "node").select("node", "path", "depth", "root", "pre", "size", "n_descendants", "unprocessed")

    @cached_property
    def covers(self) -> DataFrame:
        """(id, a, b): disjoint ranges of preorder numbers that hold the node and all its descendants over any parents.

        A portal and all below it descend from each parent outside the forest, from those of the portals that it reaches,
        and from the forest's ancestors of these.  Ranges lie in each other or apart, so the outermost are kept.
        """
        own = self.forest.select("id", F.col("pre").alias("a"), (F.col("pre") + F.col("size")).alias("b"))
        first = self.forest.where("parent is not null").select(F.col("id").alias("portal"), F.col("parent").alias("via"))
        extra = cut(self.steps.select("portal", "via").distinct().join(first, ["portal", "via"], "left_anti"))
        if extra.isEmpty():
            return own
        seed = extra.select(F.col("portal").alias("at"), F.col("portal").alias("key"), F.lit(0).alias("links")).distinct()
        up = cut(self.steps.where("target is not null").select(F.col("portal").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("links")).distinct())
        met = relax(seed, up).select("key", F.col("at").alias("portal"))
        under = met.join(extra, "portal").select(F.col("key").alias("id"), "via").distinct()
        under = cut(_outermost(under.join(own, "id").drop("id"), "via"))
        at = under.select("via").distinct().join(own.select(F.col("id").alias("via"), F.col("a").alias("at")), "via")
        above = _in_ranges(own, at, self._n).select("id", "via")
        return cut(_outermost(above.join(under, "via").select("id", "a", "b").unionByName(own).distinct(), "id"), under)

    def descendants(self, of: DataFrame) -> DataFrame:
        """(node, descendant): the nodes below each node of ``of`` (node) in the forest, from the nested-set ranges."""
        return self._below(self.forest.select("id", F.col("pre").alias("a"), (F.col("pre") + F.col("size")).alias("b")), of)

    def all_descendants(self, of: DataFrame) -> DataFrame:
        """(node, descendant): the nodes below each node of ``of`` (node) over any parents, each once, without the node itself."""
        return self._below(self.covers, of)

    def _below(self, ranges: DataFrame, of: DataFrame) -> DataFrame:
        points = self.forest.join(self.names, "id").select(F.col("id").alias("d"), F.col("node").alias("descendant"), F.col("pre").alias("at"))
        return _in_ranges(ranges.join(self.numbered(of), "id"), points, self._n).where("id <> d").select("node", "descendant")


def _in_ranges(ranges: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Rows of ``ranges`` (.., a, b) beside those of ``points`` (.., at) with a <= at < b, all below ``n``.

    They are matched in blocks of numbers, the square root of all wide, so no block is compared with all nodes and a range
    meets at most two blocks that it doesn't fill.
    """
    block = max(1, int(n**0.5))
    number = lambda c: F.floor(F.expr(c) / block)
    spread = ranges.withColumn("block", F.explode(F.sequence(number("a"), number("b - 1"))))
    return spread.join(points.withColumn("block", number("at")), "block").where("at >= a and at < b").drop("block")


def _range_sums(ranges: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, total): for each node of ``ranges`` (id, pre, size) the sum of ``marks`` (id, mark) in its range: the difference
    of two running sums, which are taken in parts."""
    zero = F.lit(0).cast("long")
    at = ranges.join(marks.groupBy("id").agg(F.sum("mark").alias("mark")), "id").select(F.col("pre").alias("at"), "mark", F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign"))
    low = ranges.select(F.col("pre").alias("at"), zero.alias("mark"), "id", F.lit(-1).alias("sign"))
    high = ranges.select((F.col("pre") + F.col("size")).alias("at"), zero.alias("mark"), "id", F.lit(1).alias("sign"))
    rows = at.unionByName(low).unionByName(high).withColumn("part", F.floor(F.col("at") / 200_000))
    totals = rows.groupBy("part").agg(F.sum("mark").alias("t"))
    before = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a part
    # a range's ends count the marks at smaller numbers: rows at one number are summed without each other
    w = Window.partitionBy("part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("mark").over(w), F.lit(0))).where("sign <> 0")
    return own.join(before, "part").groupBy("id").agg(F.sum(F.col("sign") * (F.col("own") + F.col("before"))).alias("total"))


def _outermost(ranges: DataFrame, key: str) -> DataFrame:
    """The ranges (key, a, b) that lie in no other of their key; ranges lie in each other or apart."""
    w = Window.partitionBy(key).orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("end", F.max("b").over(w)).where("end is null or b > end").select(key, "a", "b")


def hierarchy(nodes: DataFrame, links: DataFrame) -> Hierarchy:
    """The hierarchy of ``nodes`` (node string) and ``links`` (child, parent, ord int).

    Nulls are dropped, repeated rows count once (with the least ord), links to or from nodes that aren't there are ignored,
    other columns too; empty inputs give empty results.  This and the properties of the result run jobs and write tables
    in the shared folder.
    """
    names = staged(nodes.select("node").where(F.col("node").isNotNull()).distinct().select(F.monotonically_increasing_id().alias("id"), "node"), "names")
    once = links.where("child is not null and parent is not null").groupBy("child", "parent").agg(F.min("ord").alias("ord"))
    number = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    arcs = once.join(number("child"), "child").join(number("parent"), "parent")
    return Hierarchy(names, staged(arcs.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"), "ord"), "arcs"))
