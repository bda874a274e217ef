"""The commit graph: edges from child to parent, ``ord`` 0 being the first parent.

First parents form trees, which the Euler tour turns into paths at once; the other links are followed hop by
hop. So the number of rounds depends on how often merges are nested, not on how long history is.

What is asked of pairs of nodes needs no rounds: no way leads out of a connected part of the graph, so parts
are put together in blocks, and a task walks its block once, from children to parents, with a bit for each pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..workspace import discard, materialize
from .hierarchy import BASE_ROWS, _single, hierarchy, node_paths

#: Links that a block of parts holds, about; a part of more is a block of its own.
BLOCK_LINKS = 1 << 15
#: Links of a part up to which a task walks it: some 400 bytes a link, 100 MB. A larger one is followed hop by hop by all tasks.
WHOLE_LINKS = 1 << 18
#: Pairs whose bits a walk carries; a walk over a part of 2 ** 18 links holds some 100 MB of them at most.
BITS = 1024
#: Links times pairs of a part that a task walks; the pairs of a part with more are spread over tasks.
SLICE = 1 << 33


def commit_edges(commits: DataFrame) -> DataFrame:
    """``src dst ord`` from the commits' lists of parents; null parents and commits without id make no edge."""
    return (
        commits.select(norm_id("commit_id").alias("src"), F.posexplode("parents").alias("ord", "dst"))
        .select("src", norm_id("dst").alias("dst"), "ord")
        .dropna()
        .groupBy("src", "dst")
        .agg(F.min("ord").alias("ord"))
    )


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct links with both ends, ids normalised, the smallest ``ord`` of a link."""
    return edges.select(norm_id("src").alias("src"), norm_id("dst").alias("dst"), "ord").dropna().groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def _connected_rest(t: pd.DataFrame) -> pd.DataFrame:
    """The parts of a whole table of links ``(a, b)``, each named after its smallest node."""
    nodes, at = np.unique(np.concatenate([t["a"], t["b"]]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(at[: len(t)].tolist(), at[len(t) :].tolist()):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"v": nodes, "part": nodes[[top(x) for x in range(len(nodes))]]})


def connected(links: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """``v part``: the nodes of ``links(a, b)`` with a node that names their connected part.

    Links within ``base_rows`` are joined up in one task. More are contracted first: every node hooks on to
    the least of its neighbours and itself, by a hash that changes by round, and what hooks together becomes
    one node; that takes a constant share of the nodes away, as is to be expected.
    """
    links, names, level = links.select("a", "b"), None, 0
    while links.count() > base_rows:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = near.unionByName(near.select("a", F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b", F.lit(level)).alias("h"), F.col("b").alias("at")))["at"]
        state = materialize(near.groupBy(F.col("a").alias("v")).agg(least.alias("at")))
        while True:
            there = state.select(F.col("v").alias("at"), F.col("at").alias("at2"))
            new = materialize(state.join(there, "at").select("v", F.col("at2").alias("at"), (F.col("at") != F.col("at2")).alias("moved")))
            moved = new.filter("moved").limit(1).count()
            discard(state)
            state = new
            if not moved:
                break
        end = lambda key: state.select(F.col("v").alias(key), F.col("at").alias(key + "2"))  # noqa: E731, B023
        joined = links.join(end("a"), "a").join(end("b"), "b").filter("a2 <> b2")
        links = materialize(joined.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        names = state.select("v", F.col("at").alias("part")) if names is None else materialize(names.join(end("part"), "part", "left").select("v", F.coalesce("part2", "part").alias("part")))
        level += 1
    rest = materialize(_single(links, _connected_rest, "v long, part long"))
    if names is None:
        return rest
    return materialize(names.join(rest.select(F.col("v").alias("part"), F.col("part").alias("part2")), "part", "left").select("v", F.coalesce("part2", "part").alias("part")))


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], int]:
    """The set of each node, and their number: nodes on one loop are a set, and links between sets lead to smaller numbers."""
    order = np.argsort(src, kind="stable")
    first, dst = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    at, seen, low, of, path, k, n_sets = first[:-1], [0] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        todo = [] if seen[root] else [root]
        while todo:
            v = todo[-1]
            if not seen[v]:
                k += 1
                seen[v] = low[v] = k
                path.append(v)
            if at[v] < first[v + 1]:
                w = dst[at[v]]
                at[v] += 1
                if not seen[w]:
                    todo.append(w)
                elif of[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            todo.pop()
            if todo and low[v] < low[todo[-1]]:
                low[todo[-1]] = low[v]
            if low[v] == seen[v]:
                while of[v] < 0:
                    of[path.pop()] = n_sets
                n_sets += 1
    return of, n_sets


class _Block:
    """The links, pairs and marked nodes of some parts as numbers; :meth:`walks` says which pairs' bits are carried together."""

    def __init__(self, t: pd.DataFrame) -> None:
        pairs = t[t["kind"] == 1]
        t = t[t["part"].isin(pairs["part"].unique())]
        links, marked = t[t["kind"] == 0], t[t["kind"] == 2]
        at, self.names = pd.factorize(np.concatenate([links["a"], links["b"], pairs["a"], pairs["b"], marked["a"]]))
        src, dst, left, right, flags = np.split(at, np.cumsum([len(links), len(links), len(pairs), len(pairs)]))
        of, self.n = _strong(len(self.names), src, dst)
        of = np.array(of, np.int64)
        up = np.unique(np.stack([of[src], of[dst]], 1)[of[src] != of[dst]], axis=0)
        self.first, self.up = np.searchsorted(up[:, 0], np.arange(self.n + 1)).tolist(), up[:, 1].tolist()
        self.a, self.b, self.part = pairs["a"].tolist(), pairs["b"].tolist(), pairs["part"].tolist()
        self.left, self.right, self.marked = of[left].tolist(), of[right].tolist(), set(of[flags].tolist())
        self.members, self.rank = of, pairs.groupby("part").cumcount().to_numpy()

    def walks(self):
        """Lists of ``(number, bit)`` of pairs; the bits tell apart the pairs of one part."""
        walk = defaultdict(list)
        for i, r in enumerate(self.rank.tolist()):
            walk[r // BITS].append((i, 1 << r % BITS))
        return walk.values()


def _lowest_common(t: pd.DataFrame) -> pd.DataFrame:
    """``left_id right_id id``: the lowest common ancestors of the block's pairs; all nodes of a loop, if one is."""
    k, found = _Block(t), []
    nodes = defaultdict(list)
    for walk in k.walks():
        left, right, below, who = [0] * k.n, [0] * k.n, [0] * k.n, {}
        for i, bit in walk:
            left[k.left[i]] |= bit
            right[k.right[i]] |= bit
            who[k.part[i], bit] = i
        part = {k.left[i]: k.part[i] for i, _ in walk}
        for c in range(k.n - 1, -1, -1):
            x, y = left[c], right[c]
            if not x:
                if not y:
                    continue
            both, ups = x & y, k.up[k.first[c] : k.first[c + 1]]
            low = both & ~below[c]
            while low:
                bit = low & -low
                found.append((who[part[c], bit], c))
                low ^= bit
            for p in ups:
                left[p] |= x
                right[p] |= y
                below[p] |= both
                if x:
                    part[p] = part[c]
            left[c] = right[c] = below[c] = 0
    wanted = {c for _, c in found}
    for at, c in enumerate(k.members.tolist()):
        if c in wanted:
            nodes[c].append(k.names[at])
    return pd.DataFrame([(k.a[i], k.b[i], name) for i, c in found for name in nodes[c]], columns=["left_id", "right_id", "id"], dtype=object)


def _passing(t: pd.DataFrame) -> pd.DataFrame:
    """``left_id right_id``: the block's pairs with a marked node on a way from left up to right, ends included."""
    k, found = _Block(t), []
    for walk in k.walks():
        reached, passed, ends = [0] * k.n, [0] * k.n, defaultdict(list)
        for i, bit in walk:
            reached[k.left[i]] |= bit
            ends[k.right[i]].append((i, bit))
        for c in range(k.n - 1, -1, -1):
            x = reached[c]
            if not x:
                continue
            y = x if c in k.marked else passed[c]
            found += [i for i, bit in ends.get(c, ()) if y & bit]
            for p in k.up[k.first[c] : k.first[c + 1]]:
                reached[p] |= x
                passed[p] |= y
            reached[c] = passed[c] = 0
    return pd.DataFrame([(k.a[i], k.b[i]) for i in found], columns=["left_id", "right_id"], dtype=object)


class Graph:
    """Nodes and links with the first-parent trees worked out.

    Loops of first parents are cut at each of their nodes, and the cut links are followed as hops. Without
    ``looped``, loops are left out with all that hangs from them.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, looped: bool = True) -> None:
        ids = nodes.select(norm_id("id").alias("id")).dropna().distinct()
        tree = hierarchy(ids, edges)
        self.tree = materialize(tree if looped else tree.filter("node_depth >= 0"))
        end = lambda key: self.tree.select(F.col("id").alias(key), F.col("tour_root").alias(key + "_tree"))
        self.links = materialize(clean_edges(edges).join(end("src"), "src").join(end("dst"), "dst"))
        self.edges = self.links.select("src", "dst", "ord")
        self.merges = self.edges.filter("ord > 0").select("src", "dst")

    @cached_property
    def paths(self) -> DataFrame:
        """``id chain``: every node's ancestors by first parents, from the tree's top down to itself."""
        return materialize(node_paths(self.tree).withColumn("chain", F.split("path", "/")).drop("path"))

    @cached_property
    def hops(self) -> DataFrame:
        """``src dst`` of the links that are on no chain."""
        on_chain = self.paths.filter("size(chain) > 1").select(F.col("id").alias("src"), F.element_at("chain", -2).alias("dst"))
        return materialize(self.edges.select("src", "dst").join(on_chain, ["src", "dst"], "left_anti"))

    @cached_property
    def parts(self) -> DataFrame:
        """``v part``: the first-parent trees that links join to others, by ``tour_root``, with the name of their connected part."""
        between = self.links.filter("src_tree <> dst_tree").select(F.least("src_tree", "dst_tree").alias("a"), F.greatest("src_tree", "dst_tree").alias("b"))
        return connected(materialize(between.distinct()))

    def _in_part(self, df: DataFrame, tree: str, *columns: str) -> DataFrame:
        """``columns`` and the ``part`` of a table whose column ``tree`` is a ``tour_root``."""
        return df.join(self.parts.withColumnRenamed("v", tree), tree, "left").select(*columns, F.coalesce("part", tree).alias("part"))

    def _by_blocks(self, pairs: DataFrame, work: Callable, schema: str, marked: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``work`` on blocks of whole parts with what is asked of them, and the pairs of parts that are too large for a task, if any.

        ``pairs`` has distinct ``left_id`` and ``right_id``, ``marked`` distinct ``id``. Pairs over two parts are left out.
        """
        end = lambda key: self._in_part(self.tree.withColumnRenamed("id", key), "tour_root", key)
        asked = pairs.join(end("left_id"), "left_id").join(end("right_id"), ["right_id", "part"]).select(F.lit(1).alias("kind"), "part", F.col("left_id").alias("a"), F.col("right_id").alias("b"))
        told = self._in_part(self.links, "src_tree", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
        if marked is not None:
            told = told.unionByName(marked.join(end("id"), "id").select(F.lit(2).alias("kind"), "part", F.col("id").alias("a"), F.col("id").alias("b")))
        told = materialize(told)
        sizes = materialize(told.groupBy("part").agg(F.count("*").alias("n")))
        n_blocks = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // BLOCK_LINKS
        block, rest = (-1 - F.pmod(F.xxhash64("part"), F.lit(n_blocks))).alias("block"), None
        if not sizes.filter(F.col("n") > BLOCK_LINKS).limit(1).count():
            rows = told.unionByName(asked).select("kind", "part", "a", "b", block, F.lit(0).alias("slice"))
        else:
            asked = materialize(asked)
            large = sizes.filter(F.col("n") > BLOCK_LINKS).join(asked.groupBy("part").agg(F.count("*").alias("m")), "part")
            large = materialize(large.select("part", (F.col("n") > WHOLE_LINKS).alias("over"), (1 + F.floor(F.col("n") * F.col("m") / SLICE)).cast("int").alias("slices")))
            if large.filter("over").limit(1).count():
                rest = asked.join(large.filter("over"), "part", "left_semi").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))
            sliced = told.unionByName(asked).join(large, "part", "left").filter("not coalesce(over, false)").withColumn("slices", F.coalesce("slices", F.lit(1)))
            own = F.pmod(F.xxhash64("a", "b"), F.col("slices")).cast("int")
            spread = F.when(F.col("kind") == 1, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))
            rows = sliced.select("kind", "part", "a", "b", F.when(F.col("over").isNull(), block).otherwise(F.col("part")).alias("block"), F.explode(spread).alias("slice"))
        return rows.groupBy("block", "slice").applyInPandas(work, schema), rest

    def reach(self, starts: DataFrame) -> DataFrame:
        """``start id``: everything reachable from each start, itself included. ``starts`` has ``start`` and ``id``."""
        frontier = materialize(starts.select("start", norm_id("id").alias("id")).dropna().distinct())
        seen, made = None, [frontier]
        while frontier.limit(1).count():
            chain = frontier.join(self.paths, "id").select("start", F.explode("chain").alias("id")).distinct()
            if seen is not None:
                chain = chain.join(seen, ["start", "id"], "left_anti")
            new = materialize(chain)
            made.append(new)
            seen = new if seen is None else seen.unionByName(new)
            hops = new.join(self.hops, new["id"] == self.hops["src"]).select("start", F.col("dst").alias("id")).distinct()
            frontier = materialize(hops.join(seen, ["start", "id"], "left_anti"))
            made.append(frontier)
        return seen if seen is not None else frontier

    def depths(self) -> DataFrame:
        """``id depth``: links on the shortest way to a node without parents, null if there is none."""
        # every node's ancestors-or-self with other links than the chain's, and what a shorter way through these saves
        chain = self.paths.select("id", F.posexplode("chain").alias("at", "src"))
        through = materialize(chain.join(self.hops.select("src").distinct(), "src", "left_semi"))
        top = self.edges.select(F.col("src").alias("top")).distinct().withColumn("has_parent", F.lit(True))
        own = self.paths.select("id", (F.size("chain") - 1).alias("tree_depth"), F.col("chain")[0].alias("top"))
        base = materialize(own.join(top, "top", "left").select("id", "tree_depth", F.when(F.col("has_parent").isNull(), F.col("tree_depth")).alias("rooted")))
        depth, made = base.select("id", F.col("rooted").alias("depth")), []
        while True:
            other = depth.select(F.col("id").alias("dst"), F.col("depth").alias("d"))
            own = base.select(F.col("id").alias("src"), F.col("tree_depth").alias("t"))
            saved = self.hops.join(other, "dst").join(own, "src").groupBy("src").agg(F.min(F.col("d") + 1 - F.col("t")).alias("gain"))
            gains = through.join(saved, "src").groupBy("id").agg(F.min("gain").alias("gain"))
            new = materialize(
                base.join(gains, "id", "left").select("id", F.least("rooted", F.col("tree_depth") + F.col("gain")).alias("depth"))
            )
            changed = new.join(depth.select("id", F.col("depth").alias("was")), "id").filter("not (depth <=> was)").limit(1).count()
            if made:
                discard(made.pop())
            made.append(new)
            depth = new
            if not changed:
                break
        discard(through, base)
        return depth.select("id", "depth")

    def children(self) -> DataFrame:
        """``id n_children n_parents`` of every node."""
        down = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_children"))
        up = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_parents"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.tree.select("id").join(down, "id", "left").join(up, "id", "left").select("id", zero("n_children"), zero("n_parents"))

    def common_ancestors(self, pairs: DataFrame) -> DataFrame:
        """``pair id``: the common ancestors of ``left_id`` and ``right_id`` that no other common ancestor descends from.

        A node is its own ancestor. Nodes on one loop are ancestors of one another, so they are lowest together.
        """
        pairs = pairs.select("pair", norm_id("left_id").alias("left_id"), norm_id("right_id").alias("right_id")).distinct()
        found, rest = self._by_blocks(pairs.select("left_id", "right_id").distinct(), _lowest_common, "left_id string, right_id string, id string")
        if rest is not None:
            key = F.struct("left_id", "right_id").alias("pair")
            found = found.unionByName(self._common_by_hops(rest.select(key, "left_id", "right_id")).select("pair.left_id", "pair.right_id", "id"))
        return pairs.join(found, ["left_id", "right_id"]).select("pair", "id")

    def _common_by_hops(self, pairs: DataFrame) -> DataFrame:
        """:meth:`common_ancestors` from all that each side reaches.

        Whatever a common ancestor reaches is common too, so one is lowest exactly if none of its children is
        common, but for those that it reaches itself: on a loop.
        """
        both = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("left_id").alias("id")), F.struct(F.lit(1).alias("s"), F.col("right_id").alias("id")))).alias("x"))
        starts = both.select(F.struct("pair", "x.s").alias("start"), "x.id")
        reached = self.reach(starts).select("start.pair", "start.s", "id")
        common = materialize(reached.groupBy("pair", "id").agg(F.count_distinct("s").alias("n")).filter("n = 2").drop("n"))
        above = common.join(self.edges, common["id"] == self.edges["src"]).select("pair", "src", F.col("dst").alias("id"))
        on_loops = self.loop_links().withColumnRenamed("dst", "id")
        above = materialize(above.join(on_loops, ["src", "id"], "left_anti").select("pair", "id").distinct())
        # a loop with one such node isn't lowest at all
        around = self.reach(above.join(on_loops.select("id").distinct(), "id", "left_semi").select(F.col("pair").alias("start"), "id"))
        above = above.unionByName(around.withColumnRenamed("start", "pair"))
        return common.join(above, ["pair", "id"], "left_anti")

    def loop_links(self) -> DataFrame:
        """``src dst`` of the links on loops: those whose parent reaches the child."""
        # chains have no loop, so each loop has a hop, and all its links start where the hops on loops lead
        tried = self.reach(self.hops.select(F.col("dst").alias("start"), F.col("dst").alias("id")))
        round_ = lambda links, reached: links.join(reached.select(F.col("start").alias("dst"), F.col("id").alias("src")), ["src", "dst"], "left_semi")
        back = round_(self.hops, tried)
        near = tried.join(back.select(F.col("dst").alias("start")).distinct(), "start", "left_semi").select("id").distinct()
        links = materialize(self.edges.select("src", "dst").join(near.select(F.col("id").alias("dst")), "dst", "left_semi"))
        return materialize(round_(links, self.reach(links.select(F.col("dst").alias("start"), F.col("dst").alias("id")))))

    def passes(self, pairs: DataFrame, marked: DataFrame) -> DataFrame:
        """``pair passes``: whether a way from ``left_id`` up to ``right_id`` goes through a node of ``marked``, ends included.

        The nodes of a loop count as marked if one is, as a way may go around it.
        """
        pairs = pairs.select("pair", norm_id("left_id").alias("left_id"), norm_id("right_id").alias("right_id"))
        flags = marked.select(norm_id("id").alias("id")).dropna().distinct()
        found, rest = self._by_blocks(pairs.select("left_id", "right_id").distinct(), _passing, "left_id string, right_id string", flags)
        if rest is not None:
            key = F.struct("left_id", "right_id").alias("pair")
            found = found.unionByName(self._passes_by_hops(rest.select(key, "left_id", "right_id"), flags).select("pair.left_id", "pair.right_id"))
        hit = found.withColumn("passes", F.lit(True))
        return pairs.join(hit, ["left_id", "right_id"], "left").select("pair", F.coalesce("passes", F.lit(False)).alias("passes"))

    def _passes_by_hops(self, pairs: DataFrame, flags: DataFrame) -> DataFrame:
        """``pair`` of the pairs that pass, from all that is reached: a marked node must be reached by the start and reach the end."""
        a = self.reach(pairs.select(F.col("pair").alias("start"), F.col("left_id").alias("id"))).join(flags, "id", "left_semi")
        mid = materialize(a.select(F.col("start").alias("pair"), F.col("id").alias("mid")))
        b = self.reach(mid.select(F.col("mid").alias("start"), F.col("mid").alias("id")).distinct())
        return mid.join(b, mid["mid"] == b["start"]).select("pair", "id").join(pairs.select("pair", F.col("right_id").alias("id")), ["pair", "id"]).select("pair").distinct()

    def first_parents(self, starts: DataFrame) -> DataFrame:
        """``start id back``: the first-parent history of each start; ``back`` counts from 0 at the start itself.

        A history that runs into a loop goes once around it. A task holds one loop.
        """
        s = starts.select("start", norm_id("id").alias("id"))
        own = s.join(self.paths, "id")
        chain = own.select("start", F.posexplode(F.reverse("chain")).alias("back", "id")).select("start", "id", "back")
        cut = self.paths.filter("size(chain) = 1").join(self.tree.filter("node_depth < 0").select("id", "root_id"), "id").select("id", "root_id")
        up = self.edges.filter("ord = 0").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("p"))

        def walk(t: pd.DataFrame) -> pd.DataFrame:
            up, at, order = dict(zip(t["id"], t["p"])), t["root_id"].iloc[0], []
            for _ in range(len(t)):
                order.append(at)
                at = up[at]
            return pd.DataFrame({"id": order, "root_id": t["root_id"].iloc[0], "pos": range(len(t)), "n": len(t)})

        ring = materialize(cut.join(up, "id").groupBy("root_id").applyInPandas(walk, "id string, root_id string, pos int, n int"))
        entered = own.select("start", F.col("chain")[0].alias("id"), (F.size("chain") - 1).alias("steps")).join(ring, "id")
        there = ring.select("root_id", F.col("id").alias("there"), F.col("pos").alias("other"))
        around = entered.join(there, "root_id").filter("other <> pos").select("start", F.col("there").alias("id"), (F.col("steps") + F.pmod(F.col("other") - F.col("pos"), F.col("n"))).alias("back"))
        return chain.unionByName(around)

    def topological(self) -> DataFrame:
        """``id generation``: 0 without parents, else one more than the largest of the parents'; parents come first.

        The longest way up: relaxed like :meth:`depths`, with the largest in place of the smallest. Links that
        are no first parents may close a loop; then there is no such order, and a ValueError is raised.
        """
        if self.tree.filter("node_depth < 0").limit(1).count():
            raise ValueError("the links have a loop")
        nodes = self.tree.count()
        chain = self.paths.select("id", F.posexplode("chain").alias("at", "src"))
        through = materialize(chain.join(self.merges.select("src").distinct(), "src", "left_semi"))
        base = self.tree.select("id", F.col("node_depth").alias("t"))
        gen = materialize(base.withColumn("generation", F.col("t")))
        while True:
            other = gen.select(F.col("id").alias("dst"), F.col("generation").alias("g"))
            own = base.select(F.col("id").alias("src"), F.col("t"))
            more = self.merges.join(other, "dst").join(own, "src").groupBy("src").agg(F.max(F.col("g") + 1 - F.col("t")).alias("gain"))
            gains = through.join(more, "src").groupBy("id").agg(F.max("gain").alias("gain"))
            new = materialize(base.join(gains, "id", "left").select("id", "t", (F.col("t") + F.greatest(F.coalesce("gain", F.lit(0)), F.lit(0))).alias("generation")))
            changed = new.join(gen.select("id", F.col("generation").alias("was")), "id").filter("generation > was").limit(1).count()
            discard(gen)
            gen = new
            if not changed:
                return gen.select("id", "generation")
            if gen.filter(F.col("generation") >= nodes).limit(1).count():
                raise ValueError("the links have a loop")
