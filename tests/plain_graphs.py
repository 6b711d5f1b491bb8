"""Community detection on dicts, one node after the other, to hold the distributed results against."""

import hashlib
from collections import defaultdict


def weights(edges):
    """{node: {other: weight}} both ways, parallel edges summed, without loops."""
    out = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            out[a][b] += w
            out[b][a] += w
    return out


def parts_of(graph, nodes):
    """Connected parts of the subgraph on `nodes`, as sets."""
    nodes, out = set(nodes), []
    while nodes:
        todo, part = [min(nodes)], set()
        while todo:
            n = todo.pop()
            if n in nodes:
                nodes.remove(n)
                part.add(n)
                todo += [m for m in graph[n] if m in nodes]
        out.append(part)
    return out


def groups(labels):
    out = defaultdict(set)
    for n, c in labels.items():
        out[c].add(n)
    return out


def moves(graph, whole, resolution, rounds, start=None):
    k = {n: sum(near.values()) for n, near in graph.items()}
    at, still = dict(start) if start else {n: n for n in graph}, 0
    for r in range(rounds):
        total = defaultdict(float)
        for n, c in at.items():
            total[c] += k[n]
        new = {}
        for n, own in at.items():
            tied = defaultdict(float, {own: 0.0})
            for m, w in graph[n].items():
                if m != n:
                    tied[at[m]] += w
            gain = {c: round(v - resolution * k[n] * (total[c] - (k[n] if c == own else 0)) / whole, 9) for c, v in tied.items()}
            best = min(gain, key=lambda c: (-gain[c], c))
            new[n] = best if gain[best] > gain[own] and (best > own if r % 2 else best < own) else own
        still = still + 1 if new == at else 0
        at = new
        if still == 2:
            break
    return at


def refined(graph, homes, whole, resolution, rounds, named=str):
    k = {n: sum(near.values()) for n, near in graph.items()}
    volume = defaultdict(float)
    for n, c in homes.items():
        volume[c] += k[n]
    enough = lambda cut, size, c: cut >= round(resolution * size * (volume[c] - size) / whole, 9)
    near = {n: {m: w for m, w in ms.items() if m != n and homes[m] == homes[n]} for n, ms in graph.items()}
    well = {n for n in graph if enough(sum(near[n].values()), k[n], homes[n])}
    part, still = {n: n for n in graph}, 0
    for r in range(rounds):
        held = groups(part)
        size = {p: sum(k[n] for n in ns) for p, ns in held.items()}
        is_open = {p: enough(sum(w for n in ns for m, w in near[n].items() if part[m] != p), size[p], homes[p]) for p, ns in held.items()}
        stays = {p: hashlib.md5(f"{r}:{named(p)}".encode()).hexdigest()[0] < "8" for p in held}
        new = dict(part)
        for n in well:
            if len(held[part[n]]) == 1 and not stays[part[n]]:
                tied = defaultdict(float)
                for m, w in near[n].items():
                    tied[part[m]] += w
                gain = {p: round(round(v, 9) - resolution * k[n] * size[p] / whole, 9) for p, v in tied.items() if stays[p] and is_open[p]}
                gain = {p: g for p, g in gain.items() if g > 0}
                if gain:
                    new[n] = min(gain, key=lambda p: (-gain[p], p))
        still = still + 1 if new == part else 0
        part = new
        if still == 2:
            break
    return part


def leiden(edges, resolution=1.0, rounds=6, levels=2, refine=True, named=str):
    """[{node: community}] by level; without `refine` it is Louvain's method."""
    first = weights(edges)
    graph, at, start, out = first, {n: n for n in first}, None, []
    whole = sum(sum(near.values()) for near in graph.values())
    for _ in range(levels):
        homes = moves(graph, whole, resolution, rounds, start)
        if refine:
            homes = {n: min(part) for ns in groups(homes).values() for part in parts_of(graph, ns) for n in part}
        else:
            homes = {n: min(ns) for ns in groups(homes).values() for n in ns}
        held = groups({n: homes[a] for n, a in at.items()})
        out.append({n: min(ns) for ns in held.values() for n in ns})
        part = refined(graph, homes, whole, resolution, rounds, named) if refine else homes
        start = {part[n]: homes[n] for n in graph} if refine else None
        at = {n: part[a] for n, a in at.items()}
        merged = defaultdict(lambda: defaultdict(float))
        for a, near in graph.items():
            for b, w in near.items():
                merged[part[a]][part[b]] += w
        graph = merged
    return out


def modularity(edges, labels, resolution=1.0):
    graph = weights(edges)
    k = {n: sum(near.values()) for n, near in graph.items()}
    whole, total = sum(k.values()), defaultdict(float)
    for n, c in labels.items():
        total[c] += k[n]
    inside = sum(w for a, near in graph.items() for b, w in near.items() if labels[a] == labels[b])
    return inside / whole - resolution * sum((t / whole) ** 2 for t in total.values())
