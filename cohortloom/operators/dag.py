"""Causal-graph queries over an edge table (graph_id, src, dst)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import checkpointed

EDGE = ["graph_id", "src", "dst"]
# written steps of two layers each before paths are contracted; it decides about work, never about results
SHALLOW = 4


def neighbours(edges: DataFrame) -> DataFrame:
    """Parents and children of every node, one row each."""
    rows = F.array(
        F.struct(F.col("src").alias("node"), F.lit("child").alias("relation"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.lit("parent").alias("relation"), F.col("src").alias("other")),
    )
    return edges.select("graph_id", F.inline(rows)).distinct()


def closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant) pairs as ``src`` and ``dst``.

    All pairs, each round doubling the path length covered; or, with ``nodes`` (graph_id, node), the pairs
    that have one of these at either end, read off an index (``reach_index``) without the other pairs.
    """
    if nodes is not None:
        index = reach_index(edges)
        asked = checkpointed(nodes.select("graph_id", "node").distinct())
        found = descendants(index, asked).unionByName(ancestors(index, asked))
        return found.distinct()
    reach = checkpointed(edges.select(*EDGE).distinct())
    fresh = reach
    while True:
        step = fresh.select("graph_id", "src", F.col("dst").alias("mid")).join(
            reach.select("graph_id", F.col("src").alias("mid"), "dst"), ["graph_id", "mid"]
        )
        fresh = checkpointed(step.select(*EDGE).distinct().join(reach, EDGE, "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = reach.unionByName(fresh)


def path_ends(steps: DataFrame, key: list[str]) -> DataFrame:
    """Where paths of one-way ``steps`` (*key, node, nxt) lead: (*key, node, end, hops).

    Every node has at most one step. Each round the step of a step is taken, so a path of n nodes ends
    after log2(n) rounds; nodes on or before a ring, which never end, have a null ``end``.
    """
    at = checkpointed(steps.select(*key, "node", F.col("nxt").alias("end"), F.lit(1).cast("long").alias("hops")))

    def doubled(at):
        on = at.select(*key, F.col("node").alias("end"), F.col("end").alias("further"), F.col("hops").alias("more"))
        return at.join(on, [*key, "end"], "left").select(
            *key,
            "node",
            F.coalesce("further", "end").alias("end"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("further").isNotNull().alias("moved"),
        )

    # two doublings per written step
    for _ in range((max(1, at.count()).bit_length() + 1) // 2):
        at = checkpointed(doubled(doubled(at).drop("moved")))
        ended = at.where("moved").isEmpty()
        at = at.drop("moved")
        if ended:
            break
    # what still has a step after so many doublings goes round for ever
    left = at.select(*key, F.col("node").alias("end"), F.lit(True).alias("ring"))
    return at.join(left, [*key, "end"], "left").select(
        *key, "node", F.when(F.col("ring").isNull(), F.col("end")).alias("end"), "hops"
    )


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with every one-in one-out path as one edge, and the graphs in which such a path is a ring."""
    ways = edges.groupBy("graph_id", F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("nxt")
    )
    came = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    through = ways.where("n_out = 1").join(came.where("n_in = 1"), ["graph_id", "node"])
    ends = checkpointed(path_ends(through, ["graph_id"]))
    inner = ends.select("graph_id", "node", "end")
    kept = edges.join(inner.select("graph_id", F.col("node").alias("src")), ["graph_id", "src"], "left_anti")
    kept = kept.join(inner.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left")
    kept = checkpointed(kept.select("graph_id", "src", F.coalesce("end", "dst").alias("dst")).distinct())
    return kept, inner.where(F.col("end").isNull()).select("graph_id").distinct()


def cyclic_graphs(edges: DataFrame) -> DataFrame:
    """``graph_id`` of the graphs with a directed cycle.

    Sources and sinks are trimmed until nothing changes; after a few steps, which are enough for shallow
    graphs, paths are contracted in turns with it. A path that is a ring shows when it is contracted; what is left
    at the end has a way on from every node, so it has a cycle.
    """
    left = checkpointed(edges.select(*EDGE).distinct())
    rings, size, step = [], -1, 0
    while True:
        if step >= SHALLOW:
            left, ring = contracted(left)
            rings.append(ring)
        # two layers per written step
        left = checkpointed(_ends_off(_ends_off(left)))
        now, step = left.count(), step + 1
        if now in (0, size):
            return reduce(DataFrame.unionByName, rings, left.select("graph_id")).distinct()
        size = now


def _ends_off(edges: DataFrame) -> DataFrame:
    """Edges without those that start at a source or end at a sink."""
    entered = edges.select("graph_id", F.col("dst").alias("src")).distinct()
    left_by = edges.select("graph_id", F.col("src").alias("dst")).distinct()
    kept = edges.join(entered, ["graph_id", "src"], "left_semi")
    return kept.join(left_by, ["graph_id", "dst"], "left_semi").select(*EDGE)


def acyclicity(edges: DataFrame) -> DataFrame:
    """Whether each graph is free of directed cycles."""
    bad = checkpointed(cyclic_graphs(edges)).withColumn("__bad", F.lit(1))
    graphs = edges.groupBy("graph_id").agg(F.countDistinct("src", "dst").alias("n_edges"))
    out = graphs.join(bad, "graph_id", "left")
    return out.select("graph_id", "n_edges", F.col("__bad").isNull().alias("acyclic"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that lie on a directed cycle, with the cycles' component: (graph_id, src, dst, component).

    Components are found many at a time by forward and backward reach: the least and the largest node of
    every undecided part are pivots; what a pivot reaches and is reached by is its component, and what is left falls
    into parts (reached, reaching, neither) that no cycle crosses.
    """
    bad = checkpointed(cyclic_graphs(edges))
    open_ = edges.select(*EDGE).distinct().join(bad, "graph_id", "left_semi")
    open_ = checkpointed(open_.withColumn("part", F.lit("")))
    done = None
    key = ["graph_id", "part"]
    while True:
        open_ = _trimmed(open_)
        if open_.isEmpty():
            break
        pivots = open_.groupBy(*key).agg(F.min("src").alias("low"), F.max("src").alias("high"))
        pivots = pivots.select(*key, F.inline(F.array(
            F.struct(F.lit("l").alias("side"), F.col("low").alias("node")),
            F.struct(F.lit("h").alias("side"), F.col("high").alias("node")))))
        ways = F.array(
            F.struct(F.lit("f").alias("way"), F.col("src").alias("node"), F.col("dst").alias("nxt")),
            F.struct(F.lit("b").alias("way"), F.col("dst").alias("node"), F.col("src").alias("nxt")),
        )
        sides = F.explode(F.array(F.lit("l"), F.lit("h"))).alias("side")
        moves = open_.select(*key, F.inline(ways)).select(*key, "way", "node", "nxt", sides)
        mark = F.struct("part", "side", "way").alias("mark")
        starts = pivots.select(*key, "side", "node", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"))
        seen = spread_marks(
            checkpointed(moves.select("graph_id", mark, "node", "nxt")), starts.select("graph_id", mark, "node")
        )
        has = lambda s, w: F.max((F.col("mark.side") == s) & (F.col("mark.way") == w)).cast("int")
        flags = seen.groupBy("graph_id", F.col("mark.part").alias("part"), "node").agg(
            *[has(s, w).alias(f"{s}{w}") for s in "lh" for w in "fb"]
        )
        nodes = open_.select(*key, F.explode(F.array("src", "dst")).alias("node")).distinct()
        flags = nodes.join(flags, [*key, "node"], "left").fillna(0)
        both = F.when(F.expr("lf + lb = 2"), "low").when(F.expr("hf + hb = 2"), "high")
        where = F.concat_ws(".", "part", F.concat("lf", "lb", "hf", "hb"))
        flags = checkpointed(flags.select(*key, "node", both.alias("found"), where.alias("next")))
        ends = [flags.withColumnsRenamed({c: f"{end}_{c}" for c in ("node", "found", "next")} | {"graph_id": f"{end}_g", "part": f"{end}_p"}) for end in "ab"]
        joined = open_
        for end, node, side in (("a", "src", ends[0]), ("b", "dst", ends[1])):
            joined = joined.join(side, (F.col("graph_id") == F.col(f"{end}_g")) & (F.col("part") == F.col(f"{end}_p")) & (F.col(node) == F.col(f"{end}_node")))
        joined = checkpointed(joined.select(*EDGE, "part", "a_found", "b_found", "a_next", "b_next"))
        closed = joined.where("a_found = b_found").select(*EDGE, F.concat_ws(".", "part", "a_found").alias("component"))
        done = closed if done is None else done.unionByName(closed)
        open_ = joined.where("a_found IS NULL AND b_found IS NULL AND a_next = b_next").select(*EDGE, F.col("a_next").alias("part"))
    if done is None:
        return open_.select(*EDGE, F.col("part").alias("component"))
    least = done.groupBy("graph_id", "component").agg(F.min("src").alias("least"))
    return done.join(least, ["graph_id", "component"]).select(*EDGE, F.col("least").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (graph_id, part, src, dst) without those that start at a source or end at a sink, for good."""
    size = -1
    while True:
        entered = edges.select("graph_id", "part", F.col("dst").alias("src")).distinct()
        left_by = edges.select("graph_id", "part", F.col("src").alias("dst")).distinct()
        kept = edges.join(entered, ["graph_id", "part", "src"], "left_semi")
        edges = checkpointed(kept.join(left_by, ["graph_id", "part", "dst"], "left_semi").select(*EDGE, "part"))
        now = edges.count()
        if now in (0, size):
            return edges
        size = now


def _hop(front: DataFrame, moves: DataFrame) -> DataFrame:
    step = front.join(moves, ["graph_id", "mark", "node"])
    return step.select("graph_id", "mark", F.col("nxt").alias("node")).distinct()


def spread_marks(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """Marks (graph_id, node, mark) reachable from ``starts`` along ``moves``.

    ``moves`` is (graph_id, mark, node, nxt): a mark walks only its own moves. A node that one move alone
    leads to has the mark exactly when the node before it has; such nodes are tied to the head of their
    path or tree by pointer doubling, and the walk goes over the heads only. State grows with moves and
    marked nodes, never with pairs of nodes; a path or tree of any depth takes rounds with its logarithm.
    """
    key = ["graph_id", "mark", "node"]
    moves = moves.select(*key, "nxt").distinct()
    seen, front = _walked(moves, checkpointed(starts.select(*key).distinct()), SHALLOW)
    if front is None:
        return seen
    # deeper than a few steps: the nodes that one move leads to are settled with their heads
    came = moves.groupBy("graph_id", "mark", F.col("nxt").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("nxt")
    )
    alone = came.where("n = 1").join(seen, key, "left_anti")
    heads = checkpointed(path_ends(alone, ["graph_id", "mark"])).withColumnRenamed("end", "head").drop("hops")
    tied = heads.select("graph_id", "mark", F.col("node").alias("nxt"))
    over = moves.join(tied, ["graph_id", "mark", "nxt"], "left_anti").join(heads, key, "left")
    # a tied node without a head is on a ring that nothing enters
    over = over.join(heads.where(F.col("head").isNull()).select(*key), key, "left_anti")
    over = checkpointed(over.select("graph_id", "mark", F.coalesce("head", "node").alias("node"), "nxt").distinct())
    seen, _ = _walked(over, seen, None)
    below = heads.join(seen.withColumnRenamed("node", "head"), ["graph_id", "mark", "head"])
    return checkpointed(seen.unionByName(below.select(*key)))


def _walked(moves: DataFrame, seen: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """What ``seen`` reaches in at most ``most`` written steps, and the last front unless all is reached."""
    key = ["graph_id", "mark", "node"]
    front, step = seen, 0
    while True:
        one = _hop(front, moves)
        # two hops per written step: half the rounds, same marks
        both = one.unionByName(_hop(one, moves)).distinct()
        front = checkpointed(both.join(seen, key, "left_anti"))
        if front.isEmpty():
            return seen, None
        seen, step = seen.unionByName(front), step + 1
        if step == most:
            return seen, front


class ReachIndex(NamedTuple):
    """Chains and ways between them.

    ``places``: (graph_id, node, chain, pos), every node on one chain, of which later places follow from
    earlier ones. ``exits``: (graph_id, chain, upto, to, first): from places of ``chain`` not after
    ``upto``, all of ``to`` from ``first`` on is reached; none is implied by another.
    """

    places: DataFrame
    exits: DataFrame


def _outermost(exits: DataFrame) -> DataFrame:
    """Exits that no later start with an earlier arrival makes needless."""
    best = exits.groupBy("graph_id", "chain", "to", "upto").agg(F.min("first").alias("first"))
    after = W.partitionBy("graph_id", "chain", "to").orderBy(F.desc("upto")).rowsBetween(W.unboundedPreceding, -1)
    best = best.withColumn("later", F.min("first").over(after))
    return best.where("later IS NULL OR first < later").drop("later")


def reach_index(edges: DataFrame) -> ReachIndex:
    """Chain decomposition and exits of every graph; one path is one chain and has no exits.

    Cycles are allowed: what leads back to an earlier place of its own chain is an exit like any other.
    Exits are completed by doubling, keeping only the outermost ones. State is linear in nodes and grows
    with the ways between chains, not with pairs of nodes.
    """
    edges = checkpointed(edges.select(*EDGE).distinct())
    # a chain goes from a node to the one child for which it is the one parent
    down = edges.groupBy("graph_id", "src").agg(F.min("dst").alias("dst"))
    up = edges.groupBy("graph_id", "dst").agg(F.min("src").alias("src"))
    along = checkpointed(down.join(up, EDGE).where("src <> dst").select(*EDGE))
    back = along.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("nxt"))
    ends = checkpointed(path_ends(back, ["graph_id"]))
    # a ring is opened at one of its moves: nodes without an end are dealt by label spreading over the ring
    ring = ends.where(F.col("end").isNull()).select("graph_id", "node")
    if not ring.isEmpty():
        back = checkpointed(_opened(back, ring))
        ends = checkpointed(path_ends(back, ["graph_id"]))
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    places = checkpointed(
        nodes.join(ends, ["graph_id", "node"], "left").select(
            "graph_id", "node", F.coalesce("end", "node").alias("chain"), F.coalesce("hops", F.lit(0)).alias("pos")
        )
    )
    start = places.select("graph_id", F.col("node").alias("src"), "chain", F.col("pos").alias("upto"))
    stop = places.select("graph_id", F.col("node").alias("dst"), F.col("chain").alias("to"), F.col("pos").alias("first"))
    direct = edges.join(start, ["graph_id", "src"]).join(stop, ["graph_id", "dst"])
    # a step ahead on one chain says nothing new
    direct = direct.where("chain <> to OR first <= upto").select("graph_id", "chain", "upto", "to", "first")
    exits = checkpointed(_outermost(direct))
    while True:
        on = exits.select(
            "graph_id", F.col("chain").alias("to"), F.col("upto").alias("last"), F.col("to").alias("on"), F.col("first").alias("there")
        )
        further = exits.join(on, ["graph_id", "to"]).where("last >= first")
        further = further.select("graph_id", "chain", "upto", F.col("on").alias("to"), F.col("there").alias("first"))
        both = checkpointed(_outermost(exits.unionByName(further.where("chain <> to OR first <= upto"))))
        if both.join(exits, both.columns, "left_anti").isEmpty():
            return ReachIndex(places, exits)
        exits = both


def _opened(back: DataFrame, ring: DataFrame) -> DataFrame:
    """Steps without the one that leaves the least node of each ring."""
    own = ring.join(back, ["graph_id", "node"]).select("graph_id", "node", "nxt", F.col("node").alias("least"))
    rounds = max(1, own.count()).bit_length()
    for _ in range(rounds):
        on = own.select("graph_id", F.col("node").alias("nxt"), F.col("nxt").alias("further"), F.col("least").alias("other"))
        own = checkpointed(
            own.join(on, ["graph_id", "nxt"]).select(
                "graph_id", "node", F.col("further").alias("nxt"), F.least("least", "other").alias("least")
            )
        )
    cut = own.where("node = least").select("graph_id", "node")
    return back.join(cut, ["graph_id", "node"], "left_anti")


def descendants(index: ReachIndex, nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst) for ``src`` among ``nodes`` (graph_id, node)."""
    own = nodes.join(index.places, ["graph_id", "node"])
    out = own.join(index.exits, ["graph_id", "chain"]).where("pos <= upto")
    out = out.select("graph_id", F.col("node").alias("src"), F.col("to").alias("chain"), "first")
    ahead = own.select("graph_id", F.col("node").alias("src"), "chain", (F.col("pos") + 1).alias("first"))
    out = out.unionByName(ahead).groupBy("graph_id", "src", "chain").agg(F.min("first").alias("first"))
    found = out.join(index.places, ["graph_id", "chain"]).where("pos >= first")
    return found.select("graph_id", "src", F.col("node").alias("dst"))


def ancestors(index: ReachIndex, nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst) for ``dst`` among ``nodes`` (graph_id, node)."""
    own = nodes.join(index.places, ["graph_id", "node"]).select("graph_id", F.col("node").alias("dst"), F.col("chain").alias("to"), "pos")
    came = own.join(index.exits, ["graph_id", "to"]).where("first <= pos").select("graph_id", "dst", "chain", "upto")
    behind = own.select("graph_id", "dst", F.col("to").alias("chain"), (F.col("pos") - 1).alias("upto"))
    came = came.unionByName(behind).groupBy("graph_id", "dst", "chain").agg(F.max("upto").alias("upto"))
    found = came.join(index.places, ["graph_id", "chain"]).where("pos <= upto")
    return found.select("graph_id", F.col("node").alias("src"), "dst")


def variable_roles(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """Role of every node given exposure and outcome per graph (``graph_id, exposure, outcome``)."""
    edges = edges.select(*EDGE).distinct().join(questions, "graph_id")
    src, dst = F.col("src"), F.col("dst")
    x, y = F.col("exposure"), F.col("outcome")
    step = lambda mark, a, b: F.struct(F.lit(mark).alias("mark"), a.alias("node"), b.alias("nxt"))
    begin = lambda mark, a: F.struct(F.lit(mark).alias("mark"), a.alias("node"))
    moves = edges.select(
        "graph_id",
        F.inline(
            F.array_compact(
                F.array(
                    step("above_x", dst, src),
                    step("above_y", dst, src),
                    F.when(src != x, step("above_y_off_x", dst, src)),
                    step("below_x", src, dst),
                    F.when(dst != x, step("below_c", src, dst)),
                )
            )
        ),
    )
    moves = checkpointed(moves)
    starts = questions.select(
        "graph_id",
        F.inline(
            F.array(
                begin("above_x", x), begin("below_x", x), begin("above_y", y), begin("above_y_off_x", y)
            )
        ),
    )
    marks = spread_marks(moves, starts)
    has = lambda m: F.max(F.col("mark") == m)
    flags = marks.groupBy("graph_id", "node").agg(
        *[F.coalesce(has(m), F.lit(False)).alias(m)
          for m in ("above_x", "above_y", "above_y_off_x", "below_x")]
    )
    ends = (F.col("node") == F.col("exposure")) | (F.col("node") == F.col("outcome"))
    confounder = F.col("above_x") & F.col("above_y_off_x") & ~ends
    known = flags.join(questions, "graph_id")
    conf = known.where(confounder).select("graph_id", "node", F.lit("below_c").alias("mark"))
    below = spread_marks(moves, conf).select("graph_id", "node", F.lit(True).alias("below_c"))
    nodes = edges.select(
        "graph_id", "exposure", "outcome", F.explode(F.array("src", "dst")).alias("node")
    ).distinct()
    full = (
        nodes
        .join(flags, ["graph_id", "node"], "left")
        .join(below, ["graph_id", "node"], "left")
        .fillna(False, ["above_x", "above_y", "above_y_off_x", "below_x", "below_c"])
    )
    role = (
        F.when(F.col("node") == F.col("exposure"), "exposure")
        .when(F.col("node") == F.col("outcome"), "outcome")
        .when(confounder, "confounder")
        .when(F.col("below_x") & F.col("above_y"), "mediator")
        .when(F.col("below_c") & F.col("above_y") & ~F.col("above_x"), "proxy confounder")
        .when(F.col("above_y_off_x"), "competing exposure")
        .otherwise("other")
    )
    return full.select("graph_id", "node", role.alias("role"))


def role_report(roles: DataFrame, labels: DataFrame) -> DataFrame:
    """Roles with node labels (``graph_id, node, label``); unlabelled nodes keep a null label."""
    return roles.join(labels, ["graph_id", "node"], "left")
