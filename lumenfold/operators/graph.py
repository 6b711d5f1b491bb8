"""Graphs as edge lists (src, dst): ranks, components, paths, communities.

Iterations are driver loops over joins. Written tables cut the lineage between rounds, and only scalars (a sum, a count)
reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.components import components
from lumenfold.storage import dealt, materialise

#: Rounds between two written tables.
CUT_EVERY = 5


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, rounds: int | None = None, alpha: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, pagerank): rounds go on until the ranks, which sum to 1, change by less than `tolerance` in sum, whatever the number
    of nodes; the mass of nodes without edges is spread evenly. (G2)

    A change shrinks at least by `alpha` a round and is at most 2 at first, so the tolerance is reached within
    log(tolerance / 2) / log(alpha) rounds; `rounds` may set an earlier end."""
    enough = math.ceil(math.log(tolerance / 2) / math.log(alpha)) + 1
    rounds = enough if rounds is None else min(rounds, enough)
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    shares = materialise(edges.join(out, "src"))
    every = materialise(node_set(edges).join(out, F.col("node") == F.col("src"), "left").select("node", F.col("out").isNull().alias("dangling")))
    n = every.count()
    ranks = every.select("node", "dangling", F.lit(1.0 / max(n, 1)).alias("r"), F.lit(1.0).alias("before"))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("lost"))
        given = shares.join(ranks, shares.src == ranks.node).groupBy("dst").agg(F.sum(F.col("r") / F.col("out")).alias("got"))
        old = ranks.select("node", "dangling", F.col("r").alias("before"))
        ranks = old.join(given, old.node == given.dst, "left").crossJoin(F.broadcast(lost))  # one row
        ranks = ranks.select("node", "dangling", ((1 - alpha) / max(n, 1) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("r"), "before")
        ranks = materialise(ranks)  # three plans hang on it
        if (ranks.agg(F.sum(F.abs(F.col("r") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return ranks.select("node", F.col("r").alias("pagerank"))


def hits(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(node, hub, authority), each normed to a sum of 1: rounds go on until the hubs change by less than `tolerance` in sum,
    or `rounds` are done. (G3)"""
    edges = materialise(edges.select("src", "dst").distinct())
    by_src, by_dst = dealt(edges, "src"), dealt(edges, "dst")
    every = materialise(node_set(edges))
    hub = every.select("node", F.lit(1.0).alias("h"))
    lists = lambda h: by_src.join(h.select(F.col("node").alias("src"), "h").hint("shuffle_hash"), "src").groupBy("dst").agg(F.sum("h").alias("a"))
    for _ in range(rounds):
        # edges lie where they are needed: a round deals out sums and the hubs, and a hub's old value comes as one more row
        given = by_dst.join(lists(hub).hint("shuffle_hash"), "dst").select(F.col("src").alias("node"), "a", F.lit(None).cast("double").alias("before"))
        old = hub.select("node", F.lit(None).cast("double").alias("a"), F.col("h").alias("before"))
        new = materialise(given.unionByName(old).groupBy("node").agg(F.sum("a").alias("a"), F.max("before").alias("before")).where("a IS NOT NULL"))
        total = new.agg(F.sum("a")).first()[0] or 1.0
        share, last = F.col("a") / F.lit(total), hub
        hub = new.select("node", share.alias("h"))
        if (new.agg(F.sum(F.abs(share - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    authority = materialise(lists(last).select(F.col("dst").alias("node"), "a")) if rounds else every.select("node", F.lit(1.0).alias("a"))
    whole = authority.agg(F.sum("a").alias("whole"))
    scores = authority.crossJoin(F.broadcast(whole)).select("node", (F.col("a") / F.col("whole")).alias("a"))  # one row
    return every.join(hub, "node", "left").join(scores, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the undirected component."""
    return components(edges)


def strong_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node among those that reach each other.

    Colouring: the smallest label that reaches a node spreads forwards; nodes that also reach their colour's root
    backwards within the colour form its component and leave the graph.
    """
    left = materialise(edges.select("src", "dst").where("src <> dst").distinct())
    rest = materialise(node_set(edges))
    done = None
    for _ in range(rounds):
        if rest.isEmpty():
            break
        colour = _spread(left, rest.select("node", F.col("node").alias("label")))
        # backwards from each root, inside its colour
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst")
        inner = materialise(inner)
        reached = materialise(colour.where("node = label").select("node", "label"))
        front = reached
        while not front.isEmpty():
            step = inner.join(front, inner.dst == front.node).select(F.col("src").alias("node"), "label").distinct()
            front = materialise(step.join(reached, "node", "left_anti"))
            reached = materialise(reached.unionByName(front))
        found = reached.select("node", F.col("label").alias("component"))
        done = found if done is None else done.unionByName(found)
        rest = materialise(rest.join(reached, "node", "left_anti"))
        left = materialise(left.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi"))
    else:
        raise RuntimeError("strong components did not settle")
    least = done.groupBy("component").agg(F.min("node").alias("least"))
    return done.join(least, "component").select("node", F.col("least").alias("component"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges."""
    while True:
        got = edges.join(labels, edges.src == labels.node).groupBy("dst").agg(F.min("label").alias("got"))
        new = labels.join(got, labels.node == got.dst, "left").select("node", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("moved"))
        new = materialise(new)
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def simple_paths(edges: DataFrame, source, target, longest: int = 5) -> DataFrame:
    """(path, length) of all simple paths up to `longest` edges, shortest first.

    Nodes that cannot reach the target in the steps left are never visited.
    """
    edges = materialise(edges.select("src", "dst").distinct())
    to_target = [edges.where(F.col("dst") == target).select(F.col("src").alias("node")).distinct()]
    for _ in range(longest - 1):
        step = edges.join(to_target[-1], edges.dst == to_target[-1].node).select(F.col("src").alias("node"))
        to_target.append(materialise(step.union(to_target[-1]).distinct()))
    paths = edges.where(F.col("src") == source).select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    out = None
    for k in range(1, longest + 1):
        whole = paths.where(F.col("end") == target).select(F.array_join("path", ">").alias("path"), F.lit(k).alias("length"))
        out = whole if out is None else out.unionByName(whole)
        if k < longest:
            on = paths.where(F.col("end") != target).join(to_target[longest - k - 1], F.col("end") == F.col("node"), "left_semi")
            on = on.join(edges, on.end == edges.src).where(~F.array_contains("path", F.col("dst")))
            paths = on.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
    return out


def distances_from(edges: DataFrame, source, longest: int | None = None) -> DataFrame:
    """(node, distance) by breadth-first search, as far as there are nodes, or up to `longest` steps."""
    edges = materialise(edges.select("src", "dst").distinct())
    seen = front = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("distance"))
    k = 0
    while longest is None or k < longest:
        k += 1
        step = edges.join(front, edges.src == front.node).select(F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = materialise(seen.unionByName(front)) if k % CUT_EVERY == 0 else seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, source, target, longest: int | None = None) -> DataFrame:
    """(path, length): the lexicographically least shortest path, of whatever length or of up to `longest` edges, or no row.

    Layers are walked until the target or nothing new is met; each node keeps the least path to it, so a layer has one row
    a node.
    """
    edges = materialise(edges.select("src", "dst").distinct())
    front = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    seen, k = materialise(front.select("node")), 0
    while not front.isEmpty():
        hit = front.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select(F.array_join("path", ">").alias("path"), F.lit(k).alias("length"))
        if k == longest:
            break
        k += 1
        step = edges.join(front, edges.src == front.node).groupBy("dst").agg(F.min("path").alias("path"))
        front = materialise(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(seen, "node", "left_anti"))
        seen = materialise(seen.union(front.select("node")))
    return edges.sparkSession.createDataFrame([], "path string, length int")


def ego_network(edges: DataFrame, centre, depth: int = 1) -> DataFrame:
    """Edges among the nodes within `depth` steps in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return induced(edges, distances_from(both, centre, depth).select("node"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes`."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end in `nodes`: a union of two semi joins, never an OR in a join."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").unionByName(edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)).distinct()


def _best(gains: DataFrame, by: str, gain: str) -> DataFrame:
    """(by, community, gain): of each node the community of the largest gain, ties to the smaller."""
    best = gains.groupBy(by).agg(F.min(F.struct((-F.col(gain)).alias("loss"), "community")).alias("m"))
    return best.select(by, "m.community", (-F.col("m.loss")).alias(gain))


def both_ways(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(src, dst, w): every edge in both directions, parallel ones summed, without loops."""
    weight = F.col("weight").cast("double") if weighted and "weight" in edges.columns else F.lit(1.0)
    one = edges.select("src", "dst", weight.alias("w")).where("src <> dst")
    return materialise(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))


def label_propagation(edges: DataFrame, rounds: int = 5, weighted: bool = True) -> DataFrame:
    """(node, community) by synchronous label propagation: the heaviest label among neighbours and the node's own (which
    counts the node's mean edge weight once), ties to the smaller; rounds are fixed, so the result is deterministic."""
    both = both_ways(edges, weighted)
    own = both.groupBy("src").agg(F.avg("w").alias("w"))
    # votes lie where they are told their labels, in all rounds
    votes = dealt(both.unionByName(own.select("src", F.col("src").alias("dst"), "w")), "dst")
    labels = node_set(both).select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        tally = votes.join(labels.hint("shuffle_hash"), votes.dst == labels.node).groupBy("src", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = materialise(_best(tally, "src", "w").select(F.col("src").alias("node"), "community"))
    return labels


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 2, weighted: bool = True) -> DataFrame:
    """(level, node, community): modularity communities, level 1 the finest. Nodes may be of any ordered type.

    In a round every node looks for the neighbouring community of the largest gain
    k_in - resolution * k * total / 2m, ties to the smaller name, and goes there if that beats its own; in turns only to
    smaller names and only to larger ones, which keeps neighbours from changing places.
    A level has `rounds` rounds, or fewer when a pair of them moves nothing; then communities become the
    nodes of the next level. A community is named by its smallest node.
    """
    graph = both_ways(edges, weighted)
    names = materialise(node_set(graph).select("node", F.col("node").alias("at")))
    whole = graph.agg(F.sum("w")).first()[0] or 0.0
    out = None
    for level in range(1, levels + 1):
        labels = _local_moves(graph, whole, lambda _: F.lit(float(resolution)), rounds)
        least = labels.join(names.groupBy("at").agg(F.min("node").alias("least")), labels.node == F.col("at")).groupBy("community").agg(F.min("least").alias("name"))
        named = materialise(labels.join(least, "community").select(F.col("node").alias("at"), F.col("name").alias("community")))
        names = materialise(names.join(named, "at").select("node", F.col("community").alias("at")))
        rows = names.select(F.lit(level).alias("level"), "node", F.col("at").alias("community"))
        out = rows if out is None else out.unionByName(rows)
        if level < levels:
            ends = graph.join(named.select(F.col("at").alias("src"), F.col("community").alias("a")), "src").join(named.select(F.col("at").alias("dst"), F.col("community").alias("b")), "dst")
            graph = materialise(ends.groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    return out


def _local_moves(graph: DataFrame, whole: float, resolution: Rate, rounds: int, start: DataFrame | None = None) -> DataFrame:
    """(node, community) after `rounds` rounds of moves from `start`, or from every node on its own.

    Links are dealt out once for all rounds, by the end that tells its community and that one's total, and once a round by the
    end that is told them. There they stay for the sums, the offers and the best of them: a link brings the degree of that
    end, and a node's own row its community, so nothing is joined there."""
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = degree.select("node", "k", F.col("node").alias("community")) if start is None else degree.join(start.hint("merge"), "node").select("node", "k", "community")
    state = materialise(state)
    links = dealt(graph.where("src <> dst").join(state.select(F.col("node").alias("src"), "k").hint("merge"), "src").select("src", "dst", "w", "k"), "dst")
    still = 0
    for r in range(rounds):
        total = state.groupBy("community").agg(F.sum("k").alias("total"))
        placed = state.join(total.hint("merge"), "community").select("node", "community", "total", "k")
        told = links.join(placed.select(F.col("node").alias("dst"), "community", "total").hint("shuffle_hash"), "dst")
        told = told.select(F.col("src").alias("node"), "community", "total", "k", F.col("w").alias("k_in"), F.lit(False).alias("own"))
        offers = told.unionByName(placed.withColumn("k_in", F.lit(0.0)).withColumn("own", F.lit(True))).repartition("node")
        offers = offers.groupBy("node", "community").agg(F.sum("k_in").alias("k_in"), F.max("total").alias("total"), F.max("k").alias("k"), F.max("own").alias("own"))
        rest = F.col("total") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
        valued = offers.select("node", "community", "own", "k", F.round(F.col("k_in") - resolution("node") * F.col("k") * rest / whole, 9).alias("gain"))
        mine = [F.max(F.when(F.col("own"), F.col(c))).alias(name) for c, name in (("gain", "mine"), ("community", "at"))]
        best = valued.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("m"), F.max("k").alias("k"), *mine)
        there = F.col("m.community")
        moves = (there > F.col("at") if r % 2 else there < F.col("at")) & (-F.col("m.loss") > F.col("mine"))
        state = materialise(best.select("node", "k", F.when(moves, there).otherwise(F.col("at")).alias("community"), moves.alias("moved")))
        still = 0 if not state.where("moved").isEmpty() else still + 1
        if still == 2:
            break
    return state.select("node", "community")


def numbered(edges: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """`edges` with numbers for nodes, and (node, name) of the numbers, which are in the order of the names. `written` edges are read
    from where they are."""
    edges = edges if written else materialise(edges)
    # a sorted table's rows have growing ids
    names = materialise(node_set(edges).orderBy("node").select(F.monotonically_increasing_id().alias("number"), F.col("node").alias("name")))
    for c in ("src", "dst"):
        edges = edges.join(names.withColumnRenamed("name", c), c).drop(c).withColumnRenamed("number", c)
    return edges, names.withColumnRenamed("number", "node")


def renamed(levels: DataFrame, names: DataFrame) -> DataFrame:
    """(level, node, community) of `numbered` nodes with their names."""
    for c in ("node", "community"):
        levels = levels.join(names.select(F.col("node").alias(c), "name"), c).drop(c).withColumnRenamed("name", c)
    return levels.select("level", "node", "community")


def leiden(edges: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 2, weighted: bool = True, names: DataFrame | None = None) -> DataFrame:
    """(level, node, community): modularity communities that are connected, level 1 the finest.

    A level has three phases. Local moves as in `louvain`, from the communities of the level before. Then every community is
    split into its connected parts, which can only raise the modularity. Then it is refined: its nodes start alone again
    and merge, only with parts of the same community that they have an edge to and gain by, and only where both sides are
    well connected to the rest of the community, that is by at least resolution * k * (K - k) / 2m. Refined parts are the
    nodes of the next level, which starts from the communities they came from, so later moves can take a community apart
    along its refined parts but never along anything less connected. Communities of a level are connected, since its nodes
    are and the split comes last. A community is named by its smallest node. `names` (node, name) are what is hashed of
    nodes that are `numbered`.
    """
    graph = both_ways(edges, weighted)
    return _leiden(graph, graph.agg(F.sum("w")).first()[0] or 0.0, lambda _: F.lit(float(resolution)), rounds, levels, names)


#: From the name of a column of nodes to their resolution.
Rate = Callable[[str], Column]


def _leiden(graph: DataFrame, whole: float, resolution: Rate, rounds: int, levels: int, hashed: DataFrame | None = None, spelled: Rate = F.col) -> DataFrame:
    names = materialise(node_set(graph).select("node", F.col("node").alias("at")))
    out = start = None
    for level in range(1, levels + 1):
        moved = _local_moves(graph, whole, resolution, rounds, start)
        inside = dealt(_within(graph, moved), "dst")
        homes = _connected_parts(inside, moved)
        labels = names.join(homes.withColumnRenamed("node", "at"), "at").select("node", "community")
        least = labels.groupBy("community").agg(F.min("node").alias("name"))
        rows = materialise(labels.join(least, "community").select(F.lit(level).alias("level"), "node", F.col("name").alias("community")))
        out = rows if out is None else out.unionByName(rows)
        if level < levels:
            parts = _refined(graph, inside, homes, whole, resolution, rounds, hashed, spelled)
            names = materialise(names.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
            start = parts.select(F.col("part").alias("node"), "community").distinct()
            ends = graph.join(parts.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
            graph = materialise(ends.groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    return out


def _within(graph: DataFrame, homes: DataFrame) -> DataFrame:
    """(src, dst, w): edges between two nodes of one community."""
    ends = graph.where("src <> dst").join(homes.select(F.col("node").alias("src"), "community").hint("merge"), "src").join(homes.select(F.col("node").alias("dst"), F.col("community").alias("other")).hint("merge"), "dst")
    return ends.where("community = other").select("src", "dst", "w")


def _connected_parts(inside: DataFrame, homes: DataFrame) -> DataFrame:
    """(node, community): the connected parts of communities, each named by its smallest node. No edge of `inside` leads from
    one part to another."""
    parts = components(inside.where("src < dst"))
    return materialise(homes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community")))


def _refined(graph: DataFrame, inside: DataFrame, homes: DataFrame, whole: float, resolution: Rate, rounds: int, hashed: DataFrame | None = None, spelled: Rate = F.col) -> DataFrame:
    """(node, community, part): communities refined into well-connected parts, each named by a node of it.

    In a round, half of the parts (by a hash of name and round) stay, and nodes that are parts of their own in the other half
    may join one of those; so whatever joins a part has an edge to nodes that stay in it."""
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    linked = inside.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("linked"))
    nodes = homes.join(degree.hint("merge"), "node").join(linked.hint("merge"), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(0.0)))
    volume = nodes.groupBy("community").agg(F.sum("k").alias("volume"))
    nodes = nodes.join(volume.hint("merge"), "community")
    enough = lambda name, cut, k: F.col(cut) >= F.round(resolution(name) * F.col(k) * (F.col("volume") - F.col(k)) / whole, 9)
    state = materialise(nodes.select("node", "community", "volume", "k", enough("node", "linked", "k").alias("well"), F.col("node").alias("part")))
    still = 0
    for r in range(rounds):
        stays = F.substring(F.md5(F.concat(F.lit(f"{r}:"), (F.col("name") if hashed is not None else spelled("part")).cast("string"))), 1, 1) < "8"
        to = inside.join(state.select(F.col("node").alias("dst"), F.col("part").alias("to")).hint("shuffle_hash"), "dst")
        # from a node to the parts of its community, and what the node brings to its own
        told = to.select(F.col("src").alias("node"), "to", "w")
        ties = materialise(told.repartition("node").groupBy("node", "to").agg(F.round(F.sum("w"), 9).alias("k_in")).join(state.select("node", "part", "k", "well").hint("merge"), "node"))
        cut = ties.where(F.col("to") != F.col("part")).groupBy("part").agg(F.sum("k_in").alias("cut"))
        sums = state.groupBy("part").agg(F.sum("k").alias("part_k"), F.first("volume").alias("volume"), F.count("*").alias("size"))
        parts = sums.join(cut.hint("merge"), "part", "left").withColumn("cut", F.coalesce("cut", F.lit(0.0)))
        if hashed is not None:
            parts = parts.join(hashed.select(F.col("node").alias("part"), "name").hint("merge"), "part")
        parts = materialise(parts.select("part", "part_k", "size", stays.alias("stays"), enough("part", "cut", "part_k").alias("open")))
        movers = ties.where("well").join(parts.where("size = 1 AND NOT stays").select("part").hint("merge"), "part", "left_semi").select("node", "k", "to", "k_in")
        targets = parts.where("stays AND open").select(F.col("part").alias("to"), "part_k")
        gain = F.round(F.col("k_in") - resolution("node") * F.col("k") * F.col("part_k") / whole, 9)
        offers = movers.join(targets.hint("merge"), "to").select("node", F.col("to").alias("community"), gain.alias("gain")).where("gain > 0")
        best = _best(offers, "node", "gain").select("node", F.col("community").alias("to"))
        state = materialise(state.join(best.hint("merge"), "node", "left").select("node", "community", "volume", "k", "well", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")))
        still = 0 if not state.where("moved").isEmpty() else still + 1
        if still == 2:
            break
    return state.select("node", "community", "part")


def resolution_levels(edges: DataFrame, resolutions: Sequence[float], rounds: int = 6, levels: int = 2, weighted: bool = True) -> DataFrame:
    """(level, node, community): one level for each resolution, in the order given, each the coarsest communities of `leiden`;
    `hierarchy` adds the parents. (G13, G15)

    All resolutions are worked on at once: the graph is taken as often as there are resolutions, with nodes (level, node),
    and each copy has its own resolution. Where nodes are whole numbers that leave room, (level, node) is one number, which
    is dealt out and sorted at a third of the cost."""
    one = both_ways(edges, weighted)
    n = len(resolutions)
    whole, low, high = one.agg(F.sum("w"), F.min("src"), F.max("src")).first()
    rates = F.array(*[F.lit(float(r)) for r in resolutions])
    run = F.explode(F.array(*[F.lit(i) for i in range(1, n + 1)])).alias("run")
    copied = one.select(run, "src", "dst", "w")
    whole_numbers = one.schema["src"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole_numbers and -(1 << 62) // n < (low or 0) and (high or 0) < (1 << 62) // n:
        level = lambda name: F.pmod(F.col(name), F.lit(n)).cast("int") + 1
        node = lambda name: F.expr(f"(`{name}` - pmod(`{name}`, {n}L)) div {n}L").cast(one.schema["src"].dataType)
        copies = copied.select(*[(F.col(c).cast("long") * n + F.col("run") - 1).alias(c) for c in ("src", "dst")], "w")
        found = _leiden(materialise(copies), whole or 0.0, lambda name: F.element_at(rates, level(name)), rounds, levels, spelled=lambda name: F.struct(level(name), node(name)))
        return top_level(found).select(level("node").alias("level"), node("node").alias("node"), node("community").alias("community"))
    copies = copied.select(*[F.struct("run", F.col(c).alias("node")).alias(c) for c in ("src", "dst")], "w")
    found = _leiden(materialise(copies), whole or 0.0, lambda name: F.element_at(rates, F.col(name)["run"]), rounds, levels)
    return top_level(found).select(F.col("node.run").alias("level"), "node.node", F.col("community.node").alias("community"))


def entity_communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 2, least: int = 2) -> DataFrame:
    """(community, size, internal_edges, density, modularity): communities of at least `least` nodes, and the modularity of all.
    Nodes without an edge are communities of their own. nodes: (node). (G14)"""
    linked = materialise(top_level(leiden(edges, resolution, rounds, levels)))
    alone = nodes.select("node").distinct().join(linked, "node", "left_anti")
    labels = linked.unionByName(alone.select("node", F.col("node").alias("community")))
    whole = modularity(edges, linked, resolution, weighted="weight" in edges.columns)
    return community_sizes(edges, labels, least).crossJoin(F.broadcast(whole))  # one row


def top_level(levels: DataFrame) -> DataFrame:
    """(node, community) of the coarsest level of `louvain`."""
    last = levels.agg(F.max("level").alias("level"))
    return levels.join(F.broadcast(last), "level").select("node", "community")  # one row


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, weighted: bool = False) -> DataFrame:
    """One row: sum over communities of L/m - gamma (d / 2m)**2."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    ends = edges.select("src", "dst", w.alias("w")).join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    ends = materialise(ends.groupBy("a", "b").agg(F.sum("w").alias("w")))
    inside = ends.where("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("inner"))
    degree = ends.select(F.col("a").alias("community"), "w").unionByName(ends.select(F.col("b").alias("community"), "w")).groupBy("community").agg(F.sum("w").alias("degree"))
    m = ends.agg(F.sum("w").alias("m"))
    parts = degree.join(inside, "community", "left").crossJoin(F.broadcast(m))  # one row
    q = F.coalesce("inner", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))
    return parts.agg(F.round(F.coalesce(F.sum(q), F.lit(0.0)), 6).alias("modularity"))


def community_sizes(edges: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """(community, size, internal_edges, density) of communities of at least `least` nodes."""
    size = labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    inner = edges.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("internal_edges"))
    both = size.join(inner, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return both.withColumn("density", F.round(F.when(pairs > 0, F.col("internal_edges") / pairs).otherwise(0.0), 6))


def parents(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(community, parent, shared): the community of `parent` that shares most members with each of `child`."""
    both = child.select("node", "community").join(parent.select("node", F.col("community").alias("parent")), "node").groupBy("community", "parent").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("shared"), "parent"))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank")


def hierarchy(levels: DataFrame) -> DataFrame:
    """(level, node, community, parent): levels (level, node, community) from fine to coarse with parents on the level above,
    the community there that shares most members. (G13, G15)"""
    numbers = sorted(r["level"] for r in levels.select("level").distinct().collect())  # a few levels
    kind = levels.schema["community"].dataType
    out = None
    for k in numbers:
        rows = levels.where(F.col("level") == k)
        if k == numbers[-1]:
            rows = rows.select("level", "node", "community", F.lit(None).cast(kind).alias("parent"))
        else:
            above = parents(rows, levels.where(F.col("level") == numbers[numbers.index(k) + 1]))
            rows = rows.join(above.select("community", "parent"), "community", "left").select("level", "node", "community", "parent")
        out = rows if out is None else out.unionByName(rows)
    return out


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the largest weak component; ties to the smaller component id."""
    labels = materialise(components(edges))
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def report_communities(edges: DataFrame, rounds: int = 6, levels: int = 2) -> DataFrame:
    """Communities of the largest component."""
    return top_level(louvain(induced(edges, largest_component(edges)), rounds=rounds, levels=levels))


def community_reports(edges: DataFrame, members: DataFrame, k: int = 5, write=None) -> DataFrame:
    """(community, title, summary, size, internal_edges) by a template over the `k` most frequent members, or the summary by
    `write`, a function of the columns names, size and internal_edges. members: (node, community, frequency)."""
    top = Window.partitionBy("community").orderBy(F.desc("frequency"), "node")
    first = members.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k)
    names = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "node"))), lambda x: x["node"].cast("string")), ", ").alias("names"))
    found = community_sizes(edges, members.select("node", "community")).join(names, "community")
    template = F.concat(F.col("size").cast("string"), F.lit(" members and "), F.col("internal_edges").cast("string"), F.lit(" relations about "), F.col("names"))
    summary = write(F.col("names"), F.col("size"), F.col("internal_edges")) if write else template
    return found.select("community", F.concat(F.lit("Community of "), "names").alias("title"), summary.alias("summary"), "size", "internal_edges")
