"""Agglomerative clustering in numpy: merges, cuts and the choice of the number of clusters.

A merge table has a row for each merge: the two clusters (below n: points), their distance, the size. Merges are sorted by
distance, and clusters numbered from n in that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Squared distances below this share of the squared lengths are taken anew, from differences.
CLOSE = 1e-6
#: Cells of differences at once.
CELLS = 4_000_000
#: Clusters whose square of distances one task holds (415 MB); points of a tile and of its clusters, of which a few squares are held.
TABLE, TILE, STRIP = 7200, 512, 512
#: Pairs by point that a sweep lists, of few clusters a 64th of their square, never more than MOST_LISTED, and pairs of points by point that it may look up for them.
LISTED, MOST_LISTED, LOOKED_UP = 30, 3_000_000, 1000
#: Share of its bound that a sweep in single precision may lose to its rounding; points of the clusters from which the bound is guessed.
ROUNDING, SAMPLE = 0.1, 3000
#: Members of a cluster that are added one by one.
FEW = 16


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points as the sides of a product that gives squared distances, and their squared lengths."""
    own, one = (x * x).sum(axis=1), np.ones(len(x))
    return np.column_stack([x, own, one]), np.column_stack([-2 * x, one, own]), own


def _roots(d: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distances from squared ones, in place; those of close rows from their differences."""
    bound = CLOSE * (own.max(initial=0) + other.max(initial=0))
    if d.min(initial=np.inf) <= bound:
        row, column = np.nonzero(d <= bound)
        close = d[row, column] <= CLOSE * (own[row] + other[column])
        row, column = row[close], column[close]
        step = max(1, CELLS // max(1, x.shape[1]))
        for i in range(0, len(row), step):
            r, c = row[i : i + step], column[i : i + step]
            d[r, c] = ((x[r] - y[c]) ** 2).sum(axis=1)
        np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y: by one product, and for close rows, where that loses digits, from their differences."""
    mean = x.mean(axis=0) if len(x) else 0.0
    x, y = x - mean, y - mean
    (left, _, own), (_, right, other) = _sides(x), _sides(y)
    return _roots(left @ right.T, x, y, own, other)


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean, of all pairs; beside the square only tiles of it are held."""
    out = np.empty((len(x), len(x)))
    for p in range(0, len(x), TILE):
        for q in range(p, len(x), TILE):
            d = apart(x[p : p + TILE], x[q : q + TILE])
            out[p : p + TILE, q : q + TILE] = d = (d + d.T) / 2 if p == q else d
            out[q : q + TILE, p : p + TILE] = d.T
    np.fill_diagonal(out, 0)
    return out


def numbered(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges of points that stand for their clusters -> the merge table."""
    merges = [merges[i] for i in np.argsort([m[2] for m in merges], kind="stable")]
    top, name, size = list(range(n)), list(range(n)), [1] * n
    out = np.zeros((len(merges), 4))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (i, j, d) in enumerate(merges):
        i, j = find(i), find(j)
        a, b = sorted((name[i], name[j]))
        size[i] += size[j]
        top[j], name[i] = i, n + k
        out[k] = a, b, d, size[i]
    return out


def merges_by_average(d: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (each by two members) of clusters of ``size`` points with the mean distances ``d``, along chains of nearest neighbours; d is used up.

    Rows and columns of clusters that are gone are taken out, in place, when they are a quarter.
    """
    n = left = len(d)
    np.fill_diagonal(d, np.inf)
    flat = d.reshape(-1)
    size, name, gone = size.astype(float), np.arange(n), np.zeros(n)
    merges, chain = [], []
    for _ in range(n - 1):
        if left < 3 * len(d) / 4:
            keep = np.flatnonzero(gone == 0)
            for to, i in enumerate(keep.tolist()):
                flat[to * left : (to + 1) * left] = d[i, keep]
            d, chain = flat[: left * left].reshape(left, left), np.searchsorted(keep, chain).tolist()
            size, name, gone = size[keep], name[keep], np.zeros(left)
        if not chain:
            chain.append(int(np.argmin(gone)))
        before, here = None, d[chain[-1]] + gone
        while True:
            a, b = chain[-1], int(np.argmin(here))
            if len(chain) > 1 and here[chain[-2]] <= here[b]:
                b = chain[-2]
                break
            chain.append(b)
            before, here = here, d[b] + gone
        del chain[-2:]
        merges.append((int(name[a]), int(name[b]), float(here[b])))
        both = size[a] + size[b]
        here *= size[a] / both
        here += (d[b] if before is None else before) * (size[b] / both)
        d[a], d[:, a] = here, here
        size[a], gone[b] = both, np.inf
        left -= 1
    return merges


def merges_by_single(d: np.ndarray) -> list[tuple[int, int, float]]:
    """The shortest spanning tree of clusters with the least distances ``d``."""
    n = len(d)
    best, source = np.full(n, np.inf), np.zeros(n, int)
    outside = np.ones(n, bool)
    at, merges = 0, []
    for _ in range(n - 1):
        outside[at] = False
        nearer = outside & (d[at] < best)
        best[nearer], source[nearer] = d[at][nearer], at
        at = int(np.argmin(np.where(outside, best, np.inf)))
        merges.append((int(source[at]), at, float(best[at])))
    return merges


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each unordered pair."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    x = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _sums(d: np.ndarray, at: np.ndarray, number: int, axis: int) -> np.ndarray:
    """Rows or columns of ``d`` summed by their cluster ``at``, which rises along the first members, then along the second ones, and so on."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] <= at[:-1])))
    if len(first) == 1 and len(at) == number:
        return d
    if len(first) > FEW:
        one = (np.arange(number)[:, None] == at[None, :]).astype(d.dtype)
        return d @ one.T if axis else one @ d
    out = np.zeros((len(d), number) if axis else (number, d.shape[1]), d.dtype)
    for p, q in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        to = slice(at[p], at[q - 1] + 1)  # clusters are sorted by size: those with a member of that number are neighbours
        if axis:
            out[:, to] += d[:, p:q]
        else:
            out[to] += d[p:q]
    return out


def _tiles(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, rough: bool = False) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Mean distances of clusters, numbered from 0 by falling size, of points that stand for ``weight`` equal ones: of clusters a to b those to clusters c to d, on and below the diagonal. ``rough``: in single
    precision, and squared where each cluster is a point."""
    size, total = np.bincount(cluster), np.bincount(cluster, weight)
    ends, edges = np.cumsum(size), [0]
    while edges[-1] < len(size):
        before = ends[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, before + STRIP, side="right"))))
    by = np.argsort(cluster, kind="stable")
    member = np.empty(len(x), int)
    member[by] = np.arange(len(x)) - np.repeat(ends - size, size)
    order = np.lexsort((cluster, member, np.searchsorted(edges, cluster, side="right")))
    x, weight, cluster = x[order] - x.mean(axis=0), weight[order], cluster[order]
    left, right, own = _sides(x)
    points = len(size) == len(x)
    plain, at = points or bool((weight == 1).all()), [0, *ends[np.array(edges[1:]) - 1].tolist()]
    if rough:
        left, right, weight, total = (v.astype(np.float32) for v in (left, right, weight, total))
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        for j in range(i + 1):
            c, d = edges[j], edges[j + 1]
            means = None
            for p in range(at[i], at[i + 1], TILE):
                r = slice(p, min(p + TILE, at[i + 1]))
                for q in range(at[j], at[j + 1], TILE):
                    s = slice(q, min(q + TILE, at[j + 1]))
                    far = left[r] @ right[s].T
                    if not rough:
                        far = _roots(far, x[r], x[s], own[r], own[s])
                    elif not points:
                        np.sqrt(np.maximum(far, 0, out=far), out=far)
                    if not plain:
                        far *= weight[r, None]
                        far *= weight[s]
                    far = _sums(_sums(far, cluster[r] - a, b - a, 0), cluster[s] - c, d - c, 1)
                    means = far if means is None else means + far
            if not points and (not plain or total[a] > 1 or total[c] > 1):
                means /= total[a:b, None] * total[c:d]
            if i == j:
                means = (means + means.T) / 2
                np.fill_diagonal(means, np.inf)
            yield a, b, c, d, means


def _nearest_clusters(tiles: Iterable[tuple[int, int, int, int, np.ndarray]], number: int) -> tuple[np.ndarray, np.ndarray]:
    """By cluster its nearest other one and their mean distance; of equal ones the pair with the least hash, the same for both. Tiles on the diagonal are symmetric."""
    far, mark, near = np.full(number, np.inf), np.zeros(number, np.int64), np.full(number, -1)

    def offer(at: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        tie = pair_hash(at, other)
        order = np.lexsort((tie, at))
        order = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))] if len(order) else order
        at, other, d, tie = at[order], other[order], d[order], tie[order]
        ok = (d < far[at]) | (d == far[at]) & (tie < mark[at])
        far[at[ok]], mark[at[ok]], near[at[ok]] = d[ok], tie[ok], other[ok]

    for a, b, c, d, means in tiles:
        least = means.min(axis=1)
        rows = np.flatnonzero((least <= far[a:b]) & np.isfinite(least))
        row, column = np.nonzero(means[rows] == least[rows, None])
        offer(rows[row] + a, column + c, least[rows[row]])
        if a >= d:
            least = means.min(axis=0)
            columns = np.flatnonzero((least <= far[c:d]) & np.isfinite(least))
            row, column = np.nonzero(means[:, columns] == least[columns])
            offer(columns[column] + c, row + a, least[columns[column]])
    return near, far


def _pairs(near: np.ndarray) -> np.ndarray:
    """The first ones of pairs that are each other's nearest."""
    own = np.arange(len(near))
    return np.flatnonzero((near[near] == own) & (near > own))


def _few(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few true cells, by eight at once."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _short(tiles: Iterable[tuple[int, int, int, int, np.ndarray]], most: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The pairs of clusters with the least mean distances, about ``most`` and below ``bound``: those below the bound given back, which all others reach. None where more than ``most`` are equally near."""
    held, count = [], 0

    def least() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal bound
        one, other, far = (np.concatenate(v) for v in zip(*held, strict=True))
        if len(far) > most:
            bound = float(np.partition(far, most)[most])
        return one[far < bound], other[far < bound], far[far < bound]

    for a, _, c, d, means in tiles:
        row, column = np.divmod(_few(means < bound), d - c)
        if a == c:
            row, column = row[row > column], column[row > column]
        held.append(((row + a).astype(np.int32), (column + c).astype(np.int32), means[row, column]))
        count += len(row)
        if count > 2 * most:
            held = [least()]
            count = len(held[0][0])
    return *least(), bound


def _sums_between(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """By pair of clusters of ``size`` members the distances between members, summed; as many differences at once as a tile has cells."""
    by, first, out = np.argsort(cluster, kind="stable"), np.cumsum(size) - size, np.zeros(len(one))
    x, weight, number = x[by], weight[by], size[one] * size[other]
    ends, most, p = np.cumsum(number), max(1, TILE**2 // max(1, x.shape[1])), 0
    while p < len(one):
        q = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + most, side="right")))
        pair = np.repeat(np.arange(q - p), number[p:q])
        begin = np.cumsum(number[p:q]) - number[p:q]
        row, column = np.divmod(np.arange(len(pair)) - begin[pair], size[other[p:q]][pair])
        row, column = row + first[one[p:q]][pair], column + first[other[p:q]][pair]
        for r in range(0, len(pair), most):  # of a single pair there can be more
            i, j = row[r : r + most], column[r : r + most]
            far = x[i]
            far -= x[j]
            far = np.sqrt(np.einsum("ij,ij->i", far, far))
            out[p:q] += np.bincount(pair[r : r + most], far * weight[i] * weight[j], q - p)
        p = q
    return out


def _about(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, size: np.ndarray, most: int) -> float:
    """From the pairs of some clusters, about below which mean distance there are ``most``; a sweep that begins there keeps few pairs to drop them again."""
    chosen = np.sort(np.random.default_rng(0).permutation(len(size))[: max(2, int(SAMPLE * len(size) / len(x)))])
    if len(chosen) ** 2 > len(size) ** 2 / 4:
        return np.inf
    to = np.full(len(size), -1)
    to[chosen] = np.arange(len(chosen))
    own = to[cluster] >= 0
    far = np.concatenate([means[np.isfinite(means)] for *_, means in _tiles(x[own], weight[own], to[cluster[own]], True)])  # those of the diagonal twice
    at = int(1.25 * most / (len(size) ** 2 / 2) * len(far))
    return float(np.partition(far, at)[at]) if at < len(far) else np.inf


def _short_by_points(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """The same from a sweep in single precision: the pairs that it lists are measured anew, and the bound is lower by what rounding can have hidden beyond it. None where that is too much of it."""
    size, total = np.bincount(cluster), np.bincount(cluster, weight)
    one, other, _, rough = _short(_tiles(x, weight, cluster, True), most, _about(x, weight, cluster, size, most))
    eps = float(np.finfo(np.float32).eps)
    square = 2 * (x.shape[1] + 8) * eps * float(((x - x.mean(axis=0)) ** 2).sum(axis=1).max())  # of a squared distance
    if not np.isfinite(rough):
        bound = rough
    elif len(size) == len(x):
        rough, bound = float(np.sqrt(max(rough, 0))), float(np.sqrt(max(rough - square, 0)))
    else:
        bound = rough - float(np.sqrt(square)) - 2 * (int(size.max()) + 4) * eps * rough
    if bound < (1 - ROUNDING) * rough:
        return None
    one, other = one.astype(np.int64), other.astype(np.int64)
    far = _sums_between(x, weight, cluster, size, one, other) / (total[one] * total[other])
    return one[far < bound], other[far < bound], far[far < bound], bound


def _merges_of_short(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, one: np.ndarray, other: np.ndarray, far: np.ndarray, bound: float) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """The merges below ``bound`` of clusters of which all pairs below it are given, and by point the cluster after them. A merged cluster is below it only from clusters from which one of its parts is: what
    isn't listed of those is looked up from the points. When that comes to more than a new sweep, or the table holds what is left, it ends early; what was merged until then holds."""
    number, merges, left = cluster.max() + 1, [], LOOKED_UP * len(x)
    while len(far) and left > 0 and number - len(merges) > TABLE:
        total, size = np.bincount(cluster, weight, number), np.bincount(cluster, minlength=number)
        near = np.full(number, np.inf)
        np.minimum.at(near, one, far)
        np.minimum.at(near, other, far)
        at = np.flatnonzero((far == near[one]) & (far == near[other]))
        tie, mark = pair_hash(one[at], other[at]), np.full(number, np.iinfo(np.int64).max)
        np.minimum.at(mark, one[at], tie)
        np.minimum.at(mark, other[at], tie)
        at = at[(tie == mark[one[at]]) & (tie == mark[other[at]])]
        a, b = one[at], other[at]
        merges += zip(a.tolist(), b.tolist(), far[at].tolist(), strict=True)
        to, part = np.arange(number), np.full(number, -1)
        to[b], part[a] = a, b
        new = (part >= 0) | (to != np.arange(number))
        new = new[one] | new[other]
        sums = far[new] * total[one[new]] * total[other[new]]
        listed = np.sort(np.minimum(one[new], other[new]) * number + np.maximum(one[new], other[new]))
        p, q = to[one[new]], to[other[new]]
        between = p != q
        pairs, at = np.unique((np.minimum(p, q) * number + np.maximum(p, q))[between], return_inverse=True)
        sums = np.bincount(at, sums[between], len(pairs))
        p, q = np.divmod(pairs, number)
        parts = [(np.arange(len(pairs)), p, q), *((np.flatnonzero(ok), u[ok], v[ok]) for u, v in ((part[p], q), (p, part[q]), (part[p], part[q])) if (ok := (u >= 0) & (v >= 0)).any())]
        at, u, v = (np.concatenate(w) for w in zip(*parts, strict=True))
        asked = np.minimum(u, v) * number + np.maximum(u, v)
        more = listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] != asked
        at, u, v = at[more], u[more], v[more]
        left -= int((size[u] * size[v]).sum())
        if left > 0:
            sums += np.bincount(at, _sums_between(x, weight, cluster, size, u, v), len(pairs))
        cluster = to[cluster]
        total = np.bincount(cluster, weight, number)
        sums = sums / (total[p] * total[q])
        below = sums < bound
        one, other, far = (np.concatenate((v[~new], w[below])) for v, w in ((one, p), (other, q), (far, sums)))
    return merges, cluster


def _merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of average linkage: equal points are joined and stand for one; of more clusters than a task's table holds, in each sweep over the pairs of points all merges below a bound, until the table holds
    those that are left. Where a sweep gets few, the next one takes all pairs of clusters that are each other's nearest. The order of such merges doesn't matter, for a merged cluster's mean distance is never less than the lesser of its parts'."""
    _, first, top, weight = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    top = first[top.reshape(-1)]
    again = np.flatnonzero(top != np.arange(len(x)))
    again = again[np.argsort(top[again], kind="stable")]
    merges = [(i, j, 0.0) for i, j in zip(top[again].tolist(), again.tolist(), strict=True)]
    order = np.argsort(first)
    x, weight, top = x[first[order]], weight[order].astype(float), first[order]  # by distinct point the name of its cluster
    short = rough = True
    while True:
        names, cluster, size = np.unique(top, return_inverse=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        to = np.empty(len(names), int)
        to[order] = np.arange(len(names))
        names, cluster = names[order], to[cluster]
        if len(names) <= TABLE:
            break
        if short:
            most = min(LISTED * len(x), MOST_LISTED, len(names) ** 2 // 64)
            listed = _short_by_points(x, weight, cluster, most) if rough else None
            rough = listed is not None
            found, to = _merges_of_short(x, weight, cluster, *(listed or _short(_tiles(x, weight, cluster), most)))
            merges += [(int(names[i]), int(names[j]), d) for i, j, d in found]
            top, short = names[to], 10 * len(found) > len(names)
            continue
        short = True
        near, far = _nearest_clusters(_tiles(x, weight, cluster), len(names))
        a = _pairs(near)
        if not len(a):
            raise ValueError("points without distances")
        merges += zip(names[a].tolist(), names[near[a]].tolist(), far[a].tolist(), strict=True)
        joined = names.copy()
        joined[near[a]] = names[a]
        top = joined[cluster]
    table = np.empty((len(names), len(names)))
    for a, b, c, d, means in _tiles(x, weight, cluster):
        table[a:b, c:d] = means
        table[c:d, a:b] = means.T
    return merges + [(int(names[i]), int(names[j]), d) for i, j, d in merges_by_average(table, np.bincount(cluster, weight))]


def average(x: np.ndarray) -> np.ndarray:
    """The merge table of average linkage; no more than a square of TABLE distances is held."""
    return numbered(_merges(x), len(x))


def _tree_by_rows(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The shortest spanning tree, each point's distances taken when it joins."""
    n, columns = len(x), np.ascontiguousarray(x.T)
    best, source = np.full(n, np.inf), np.zeros(n, int)
    outside = np.ones(n, bool)
    at, merges = 0, []
    for _ in range(n - 1):
        outside[at], best[at] = False, np.inf
        d = columns - columns[:, at : at + 1]
        d = np.sqrt(np.einsum("ij,ij->j", d, d))
        nearer = outside & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        at = int(np.argmin(best))
        merges.append((int(source[at]), at, float(best[at])))
    return merges


def single(x: np.ndarray) -> np.ndarray:
    """The merge table of single linkage, likewise."""
    return numbered(merges_by_single(distances(x)) if len(x) <= TABLE else _tree_by_rows(x), len(x))


def _height(z: np.ndarray, k: int) -> float:
    """The distance up to which merges are made for at most k clusters."""
    n = len(z) + 1
    if k >= n:
        return -1.0 if not len(z) or z[0, 2] > 0 else 0.0
    return z[n - 1 - k, 2] if k >= 1 else np.inf


def cut(z: np.ndarray, k: int) -> np.ndarray:
    """Labels from 1 of at most k clusters; merges of equal distance are taken together. Numbered from left to right of the tree."""
    n, height = len(z) + 1, _height(z, k)
    labels, count = np.zeros(n, int), 0
    stack = [(2 * n - 2, 0)]
    while stack:
        node, own = stack.pop()
        if not own and (node < n or z[node - n, 2] <= height):
            count += 1
            own = count
        if node < n:
            labels[node] = own
        else:
            stack += [(int(z[node - n, 1]), own), (int(z[node - n, 0]), own)]
    return labels


def cut_height(z: np.ndarray, k: int) -> float:
    """Where a tree is drawn as cut into k clusters."""
    return float(z[-(k - 1), 2]) if 2 <= k <= len(z) else 0.0


def inertia(x: np.ndarray, labels: np.ndarray) -> float:
    return float(sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in np.unique(labels)))


def sums_by_cluster(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """For each labelling in ``cuts``, of one tree, every point's distances to the members of each cluster, summed: one pass over tiles of pairs for the finest of them, whose clusters make up the others'."""
    finest = max(cuts, key=lambda labels: len(np.unique(labels)))
    _, first, at = np.unique(finest, return_index=True, return_inverse=True)
    every = (at[:, None] == np.arange(len(first))[None, :]).astype(float)
    sums = np.zeros(every.shape)
    for p in range(0, len(x), TILE):
        for q in range(p, len(x), TILE):
            d = apart(x[p : p + TILE], x[q : q + TILE])
            if p == q:
                np.fill_diagonal(d, 0)
            sums[p : p + TILE] += d @ every[q : q + TILE]
            if q > p:
                sums[q : q + TILE] += d.T @ every[p : p + TILE]
    return [sums @ (labels[first][:, None] == np.unique(labels)[None, :]).astype(float) for labels in cuts]


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    return silhouette_of_sums(d @ (labels[:, None] == np.unique(labels)[None, :]).astype(float), labels)


def silhouette_of_sums(sums: np.ndarray, labels: np.ndarray) -> float:
    """From every point's distances to the members of each cluster, summed."""
    names, at, size = np.unique(labels, return_inverse=True, return_counts=True)
    if not 2 <= len(names) < len(labels):
        return float("nan")
    own = size[at]
    a = sums[np.arange(len(at)), at] / np.maximum(1, own - 1)
    mean = sums / size
    mean[np.arange(len(at)), at] = np.inf
    b = mean.min(axis=1)
    s = np.where(own == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
    return float(s.mean())


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    n, k = len(x), len(names)
    if not 2 <= k < n:
        return float("nan")
    mean = x.mean(axis=0)
    between = sum((labels == c).sum() * ((x[labels == c].mean(axis=0) - mean) ** 2).sum() for c in names)
    within = inertia(x, labels)
    return float(between * (n - k) / (within * (k - 1))) if within else 1.0


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    if not 2 <= len(names) < len(x):
        return float("nan")
    c = np.stack([x[labels == k].mean(axis=0) for k in names])
    s = np.array([np.sqrt(((x[labels == k] - m) ** 2).sum(axis=1)).mean() for k, m in zip(names, c, strict=True)])
    d = distances(c)
    np.fill_diagonal(d, np.inf)
    d[d == 0] = np.inf
    return float(((s[:, None] + s[None, :]) / d).max(axis=1).mean())


def dispersion(x: np.ndarray, labels: np.ndarray) -> float:
    """Sum over clusters of all pairs' distances by size."""
    return float(sum(distances(x[labels == c]).sum() / 2 / (labels == c).sum() for c in np.unique(labels)))


def dispersion_of_sums(sums: np.ndarray, labels: np.ndarray) -> float:
    """The same from every point's distances to the members of each cluster, summed."""
    _, at, size = np.unique(labels, return_inverse=True, return_counts=True)
    return float((sums[np.arange(len(at)), at] / 2 / size[at]).sum())


def dispersions(z: np.ndarray, ks: list[int]) -> list[float]:
    """The same of the cuts of an average linkage into each of ``ks``, from its merges alone: a merge's distance is the mean of those between its two clusters."""
    n = len(z) + 1
    size, within, after = [1.0] * n, [0.0] * n, [0.0]
    for a, b, d, _ in z.tolist():
        a, b = int(a), int(b)
        size.append(size[a] + size[b])
        within.append(within[a] + within[b] + d * size[a] * size[b])
        after.append(after[-1] + within[-1] / size[-1] - within[a] / size[a] - within[b] / size[b])
    return [after[int(np.searchsorted(z[:, 2], _height(z, k), side="right"))] for k in ks]


def elbow(ks: list[int], values: list[float]) -> int | None:
    """The first k whose relative drop is below the mean drop, else the first that has a drop; none after an inertia of 0."""
    if len(values) < 3:
        return None
    drops = {k: (a - b) / a for k, a, b in zip(ks[1:], values, values[1:], strict=False) if a > 0}
    if not drops:
        return None
    mean = sum(drops.values()) / len(drops)
    return next((k for k, d in drops.items() if d < mean), next(iter(drops)))


def candidates(n: int) -> list[int]:
    return list(range(3, min(10, max(3, int(np.sqrt(n)))) + 1))
