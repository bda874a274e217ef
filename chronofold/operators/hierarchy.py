"""Parent-child links to full hierarchies: root, depth, ancestors, descendants and loops of every node.

Leaves are peeled until only loops are left, the loops are cut, and an Euler tour is built over the
forest: every node has an enter and an exit element, linked into one list per tree. Parallel list ranking
gives every element its distance to the end of its list; the running balance of enters and exits is the
depth, the end of the list names the root, and the two positions of a node are an interval that holds
exactly those of its descendants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..workspace import discard, materialize, number_rows

#: Rows up to which a forest, a contracted list or a peeled rest is finished in one task: some ten longs a row, 80 MB.
BASE_ROWS = 1 << 20
#: One list element in so many is a splitter.
SPLIT = 16


def _single(df: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` on all rows of a table whose counted size is at most a documented bound."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            yield work(pd.concat(got, ignore_index=True))

    return df.coalesce(1).mapInPandas(whole, schema)


# -- loops ------------------------------------------------------------------------------------------


def _peel_rest(t: pd.DataFrame) -> pd.DataFrame:
    """Peel leaves to the end; what is left are loops, each labelled with its smallest node."""
    v, p = t["v"].to_numpy(), t["p"].fillna(-1).to_numpy().astype(np.int64)
    order = np.argsort(v)
    v, p = v[order], p[order]
    at = np.searchsorted(v, p).clip(max=len(v) - 1)
    up = np.where(v[at] == p, at, -1)
    children = np.bincount(up[up >= 0], minlength=len(v))
    left, front = np.ones(len(v), bool), np.flatnonzero(children == 0)
    while len(front):
        left[front] = False
        above = up[front]
        above, lost = np.unique(above[above >= 0], return_counts=True)
        children[above] -= lost
        front = above[children[above] == 0]
    ring = np.flatnonzero(left)
    # the smallest node of each loop, by doubling; positions are in the order of v
    loop, to, at = np.minimum(np.arange(len(v)), np.where(left, up, len(v))), np.where(left, up, 0), 1
    while at < len(ring):
        loop[ring], to[ring], at = np.minimum(loop[ring], loop[to[ring]]), to[to[ring]], 2 * at
    return pd.DataFrame({"v": v[ring], "p": v[up[ring]], "loop": v[loop[ring]]})


def _peel_chains(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes left after peeling every leaf with the chain of single-child ancestors above it, and those peeled.

    At least half of the leaves of what is left had two leaves below, so a logarithmic number of rounds
    peels every tree, however deep. Within a round, chains are followed downwards by pointer doubling.
    """
    kids = active.filter("p is not null").groupBy(F.col("p").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("kid"))
    # at: the node reached so far; kind: 0 = it is a leaf, 2 = it has several children, 1 = still on the chain
    state = materialize(
        active.join(kids, "v", "left").select(
            "v", "p", F.when(F.col("n") == 1, F.col("kid")).alias("at"),
            F.when(F.col("n").isNull(), 0).when(F.col("n") == 1, 1).otherwise(2).alias("kind"),
        )
    )
    todo = state.filter("kind = 1").count()
    while todo:
        there = state.select(F.col("v").alias("at"), F.col("at").alias("at2"), F.col("kind").alias("kind2"))
        moved = (
            state.filter("kind = 1").join(there, "at").select("v", "p", F.coalesce("at2", "at").alias("at"), F.col("kind2").alias("kind"))
        )
        new = materialize(state.filter("kind <> 1").unionByName(moved))
        discard(state)
        state, before = new, todo
        todo = state.filter("kind = 1").count()
        if todo == before:  # distances on chains have no gaps, so the rest runs in circles
            break
    return state.filter("kind <> 0").select("v", "p"), state


def _label_loops(ring: DataFrame) -> DataFrame:
    """Smallest node of each loop, by doubling; for more loop nodes than one task may hold."""
    state, n, step = materialize(ring.select("v", "p", F.col("p").alias("to"), F.least("v", "p").alias("loop"))), ring.count(), 1
    while step < n:
        there = state.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("loop").alias("loop2"))
        new = materialize(state.join(there, "to").select("v", "p", F.col("to2").alias("to"), F.least("loop", "loop2").alias("loop")))
        changed = new.join(state.select("v", F.col("loop").alias("was")), "v").filter("loop <> was").limit(1).count()
        discard(state)
        state, step = new, 2 * step
        if not changed:
            break
    return state.select("v", "p", "loop")


def loops(parents: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """``v p loop``: the nodes on loops of ``parents(v, p)``, each with the smallest node of its loop."""
    active, rows = parents.select("v", "p"), parents.count()
    old = None
    while rows > base_rows:
        rest, table = _peel_chains(active)
        left = rest.count()
        if old is not None:
            discard(old)
        active, old = rest, table
        if left == rows:
            return materialize(_label_loops(active))
        rows = left
    return materialize(_single(active, _peel_rest, "v long, p long, loop long"))


# -- list ranking -----------------------------------------------------------------------------------


def _rank_rest(t: pd.DataFrame) -> pd.DataFrame:
    """Wyllie's pointer doubling on arrays."""
    t = t.sort_values("e", ignore_index=True)
    e, cnt, wt = (t[c].to_numpy() for c in ("e", "cnt", "wt"))
    to = t["to"].fillna(-1).to_numpy().astype(np.int64)
    end = t["end"].fillna(-1).to_numpy().astype(np.int64)
    cnt, wt = cnt.copy(), wt.copy()
    at = np.where(to >= 0, np.searchsorted(e, to).clip(max=len(e) - 1), -1)
    while (go := np.flatnonzero(at >= 0)).size:
        n = at[go]
        cnt[go], wt[go], end[go], at[go] = cnt[go] + cnt[n], wt[go] + wt[n], end[n], at[n]
    return pd.DataFrame({"e": e, "end": end, "cnt": cnt, "wt": wt})


def rank_lists(lists: DataFrame, base_rows: int = BASE_ROWS, level: int = 0) -> DataFrame:
    """Rank linked lists: ``e end cnt wt`` with the list's last element, and count and weight from e to it.

    ``lists`` has ``e``, ``to`` (next element, null at the end), ``cnt``, ``wt`` (what the element stands
    for) and ``end`` (itself where ``to`` is null). One element in sixteen, by hash, is a splitter: every
    element jumps, doubling, to the next splitter, the splitters form a list a sixteenth as long that is
    ranked the same way, and one join brings the rest up to date. The work is linear in the elements and
    the number of rounds depends on the longest gap between splitters only; a list within ``base_rows``
    is finished in one task.
    """
    if lists.count() <= base_rows:
        return _single(lists, _rank_rest, "e long, end long, cnt long, wt long")
    split = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(SPLIT)) == 0
    cols = ["e", "to", "cnt", "wt", "end"]
    stopped = F.col("to").isNull() | split("to")
    last = materialize(lists.select(cols).withColumn("done", stopped))
    done = [last.filter("done")]
    made = [last]
    while (active := last.filter("not done")).limit(1).count():
        there = active
        for d in done:
            there = there.unionByName(d)
        there = there.select(F.col("e").alias("to"), *[F.col(c).alias(c + "2") for c in cols[1:]], F.col("done").alias("done2"))
        moved = active.join(there, "to").select(
            "e", F.col("to2").alias("to"), (F.col("cnt") + F.col("cnt2")).alias("cnt"), (F.col("wt") + F.col("wt2")).alias("wt"),
            F.col("end2").alias("end"), F.col("done2").alias("done"),
        )
        last = materialize(moved)
        made.append(last)
        done.append(last.filter("done"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    short = materialize(every.filter(split("e")).select(cols))
    ranked = materialize(rank_lists(short, base_rows, level + 1))
    r = ranked.select(F.col("e").alias("to"), F.col("end").alias("end2"), F.col("cnt").alias("cnt2"), F.col("wt").alias("wt2"))
    add = lambda c: (F.col(c) + F.coalesce(c + "2", F.lit(0))).alias(c)
    out = materialize(every.join(r, "to", "left").select("e", F.coalesce("end2", "end").alias("end"), add("cnt"), add("wt")))
    discard(*made, short, ranked)
    return out


# -- tours ------------------------------------------------------------------------------------------


def _tour_rest(t: pd.DataFrame) -> pd.DataFrame:
    """Loops, Euler tour and its ranking of a whole table ``(v, p)``: what the distributed steps give, on arrays."""
    t = t.sort_values("v", ignore_index=True)
    v, rings = t["v"].to_numpy(), _peel_rest(t)
    p = t["p"].fillna(-1).to_numpy().astype(np.int64)
    n, loop = len(v), np.full(len(v), -1)
    cut = np.searchsorted(v, rings["v"].to_numpy())
    p[cut], loop[cut] = -1, rings["loop"].to_numpy()
    up = np.where(p >= 0, np.searchsorted(v, p).clip(max=n - 1), -1)
    child = np.flatnonzero(up >= 0)
    child = child[np.argsort(up[child], kind="stable")]
    first, sibling = np.full(n, -1), np.full(n, -1)
    starts = np.flatnonzero(np.r_[True, up[child][1:] != up[child][:-1]]) if len(child) else child
    first[up[child[starts]]] = child[starts]
    same = up[child][1:] == up[child][:-1]
    sibling[child[:-1][same]] = child[1:][same]
    at = np.arange(n)
    to = np.empty(2 * n, np.int64)  # 2i enters node i, 2i + 1 leaves it
    to[0::2] = np.where(first >= 0, 2 * first, 2 * at + 1)
    to[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(up >= 0, 2 * up + 1, -1))
    e = np.arange(2 * n)
    wt = np.where(e % 2 == 0, 1, -1)
    r = _rank_rest(pd.DataFrame({"e": e, "to": to, "cnt": np.ones(2 * n, np.int64), "wt": wt, "end": np.where(to < 0, e, -1)}))
    end, cnt, wt = (r[c].to_numpy() for c in ("end", "cnt", "wt"))
    root = end[0::2] >> 1
    return pd.DataFrame({"v": v, "root": v[root], "depth": -wt[0::2], "entry": cnt[0::2], "exit": cnt[1::2], "loop": pd.array(np.where(loop[root] >= 0, loop[root], 0), "Int64").copy()}).assign(
        loop=lambda d: d["loop"].mask(loop[root] < 0)
    )


def euler_tour(forest: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """``v root depth entry exit`` of a forest ``(v, p)``, ``p`` null at roots.

    ``entry`` and ``exit`` count from the end of the tree's tour: b descends from a exactly if they have
    the same root, ``a.entry > b.entry`` and ``a.exit < b.exit``. A parent of any number of children is
    split over tasks: siblings are found by their number in one global order.
    """
    child = forest.filter("p is not null")
    numbered, _ = number_rows(child, ["p", "v"], "g")
    first = numbered.groupBy("p").agg(F.min("v").alias("first")).withColumnRenamed("p", "v")
    nxt = numbered.select((F.col("g") - 1).alias("g"), F.col("p").alias("p2"), F.col("v").alias("sibling"))
    after = numbered.join(nxt, "g").filter("p = p2").select("v", "sibling")
    linked = forest.join(first, "v", "left").join(after, "v", "left")
    enter, leave = F.col("v") * 2, F.col("v") * 2 + 1
    one = F.lit(1).cast("long")
    arcs = F.array(
        F.struct(enter.alias("e"), F.coalesce(F.col("first") * 2, leave).alias("to"), one.alias("wt")),
        F.struct(leave.alias("e"), F.coalesce(F.col("sibling") * 2, F.col("p") * 2 + 1).alias("to"), (-one).alias("wt")),
    )
    lists = materialize(
        linked.select(F.explode(arcs).alias("x")).select(
            "x.e", "x.to", one.alias("cnt"), "x.wt", F.when(F.col("x.to").isNull(), F.col("x.e")).alias("end")
        )
    )
    ranked = rank_lists(lists, base_rows)
    entering = F.col("e") % 2 == 0
    return ranked.groupBy(F.shiftright("e", 1).alias("v")).agg(
        F.max(F.when(entering, F.shiftright("end", 1))).alias("root"),
        F.max(F.when(entering, -F.col("wt"))).alias("depth"),
        F.max(F.when(entering, F.col("cnt"))).alias("entry"),
        F.max(F.when(~entering, F.col("cnt"))).alias("exit"),
    )


def hierarchy(nodes: DataFrame, edges: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """``id root_id node_depth tour_root entry exit n_descendants``: one row for each distinct id of ``nodes``.

    Only edges with ``ord`` 0 and both ends in ``nodes`` count; should a child have several first parents,
    the smallest counts. A node whose walk upwards never ends has depth -1 and the smallest id of the loop
    it runs into as root; the loop is cut at every node, so ``tour_root``, ``entry`` and ``exit`` describe
    the tree hanging from the loop's node. Null ids, repeats and links to absent nodes are left out; a
    node linked to itself is a loop of one. No nodes give no rows.
    """
    ids, n = number_rows(nodes.select(norm_id("id").alias("id")).dropna().distinct(), ["id"], "v")
    link = edges.filter("ord = 0").select(norm_id("src").alias("src"), norm_id("dst").alias("dst")).dropna().distinct()
    child, above = ids.select(F.col("id").alias("src"), "v"), ids.select(F.col("id").alias("dst"), F.col("v").alias("p"))
    linked = link.join(child, "src").join(above, "dst").groupBy("v").agg(F.min("p").alias("p"))
    parents = materialize(ids.select("v").join(linked, "v", "left"))
    if n <= base_rows:
        tour = materialize(_single(parents, _tour_rest, "v long, root long, depth long, entry long, exit long, loop long"))
    else:
        rings = loops(parents, base_rows)
        cut = rings.select("v", F.lit(True).alias("_cut"))
        forest = materialize(parents.join(cut, "v", "left").select("v", F.when(F.col("_cut").isNull(), F.col("p")).alias("p")))
        tour = euler_tour(forest, base_rows).join(rings.select(F.col("v").alias("root"), "loop"), "root", "left")
    name = lambda key: ids.select(F.col("v").alias(key), F.col("id").alias(key + "_name"))
    return (
        tour.withColumn("top", F.coalesce("loop", "root"))
        .join(name("v"), "v").join(name("top"), "top")
        .select(
            F.col("v_name").alias("id"), F.col("top_name").alias("root_id"),
            F.when(F.col("loop").isNull(), F.col("depth")).otherwise(F.lit(-1)).cast("int").alias("node_depth"),
            F.col("root").alias("tour_root"), "entry", "exit",
            F.expr("(entry - exit - 1) div 2").alias("n_descendants"),
        )
    )


def preorder(tree: DataFrame) -> DataFrame:
    """``tree`` (of :func:`hierarchy`) with ``pos``: 0, 1, 2 ... over all trees in the order in which tours enter nodes.

    A node's descendants are those at ``pos + 1`` to ``pos + n_descendants``. Trees of any size and number fill
    the positions without gaps.
    """
    # entry counts from the end of the tour, so the order is descending
    numbered, _ = number_rows(tree.withColumn("_late", -F.col("entry")), ["tour_root", "_late"], "pos")
    return numbered.drop("_late")


def node_paths(tree: DataFrame, block: int = 4096) -> DataFrame:
    """``id path``: every node's ancestors from its tour root down to itself, joined by ``/``.

    ``tree`` is the result of :func:`hierarchy`. Positions are cut in blocks of ``block`` nodes, whatever the
    trees; a node with descendants in a later block is sent there as an open ancestor, and each block is walked
    with a stack of lengths of one path. A task holds one block, its open ancestors and one path.
    """
    placed = preorder(tree) if "pos" not in tree.columns else tree
    high = F.floor((F.col("pos") + F.col("n_descendants")) / block).cast("long")
    home = F.floor(F.col("pos") / block).cast("long")
    spread = placed.select("id", "pos", (F.col("pos") + F.col("n_descendants")).alias("last"), home.alias("home"), F.explode(F.sequence(home, high)).alias("b"))

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        ids, paths, path, stack = [], [], "", []
        for name, pos, last, home, b in zip(t["id"], t["pos"], t["last"], t["home"], t["b"]):
            while stack and stack[-1][0] < pos:
                stack.pop()
            path = path[: stack[-1][1]] + "/" + name if stack else name
            stack.append((last, len(path)))
            if home == b:
                ids.append(name)
                paths.append(path)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "path": pd.Series(paths, dtype=object)})

    return spread.groupBy("b").applyInPandas(walk, "id string, path string")


def descendants(tree: DataFrame, of: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """``ancestor_id id``: all descendants of the ids in ``of``, or of every node.

    A node's descendants are a range of positions (:func:`preorder`): it is cut into whole blocks and the single
    positions at its ends, and both are found by equality, so nothing is compared that isn't a result, and a
    large tree is spread by its blocks. Nodes on one loop are no descendants of one another here (see
    :func:`hierarchy`).
    """
    placed = materialize(preorder(tree) if "pos" not in tree.columns else tree)
    a = placed if of is None else placed.join(of.select(norm_id("id").alias("id")).dropna().distinct(), "id")
    low, high = F.col("pos") + 1, F.col("pos") + F.col("n_descendants")
    first, after = F.ceil(low / block).cast("long"), F.floor((high + 1) / block).cast("long")
    none = F.array().cast("array<bigint>")
    span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(none)
    split = first < after
    pieces = F.concat(
        F.transform(F.when(split, span(first, after - 1)).otherwise(none), lambda k: F.struct(F.lit(1).alias("level"), k.alias("at"))),
        F.transform(span(low, F.when(split, first * block - 1).otherwise(high)), lambda k: F.struct(F.lit(0).alias("level"), k.alias("at"))),
        F.transform(F.when(split, span(after * block, high)).otherwise(none), lambda k: F.struct(F.lit(0).alias("level"), k.alias("at"))),
    )
    asked = a.filter("n_descendants > 0").select(F.col("id").alias("ancestor_id"), F.explode(pieces).alias("x")).select("ancestor_id", "x.level", "x.at")
    lone = placed.select("id", F.lit(0).alias("level"), F.col("pos").alias("at"))
    blocks = placed.select("id", F.lit(1).alias("level"), F.floor(F.col("pos") / block).cast("long").alias("at"))
    return asked.join(lone.unionByName(blocks), ["level", "at"]).select("ancestor_id", "id")
