"""Groups of mutually similar points, each with its size and most typical members.

Method: Gaussian mixtures fitted by expectation-maximisation. Space is cut into blocks with a rim, so that blocks are worked
on in parallel; within a block the points of touching cells are fitted together. There the points are projected onto their
tangent plane (three numbers reduced to two), standardised, and mixtures of 1 to MAX_COMPONENTS Gaussians with regularised
covariances are fitted, all of a batch at once; the Bayesian information criterion chooses the number of components. The
components are the candidates; one that is wider than a group is fitted again on its own, so that the number of components is
not limited. An exact check follows: are all members of a component mutually similar (by its box, by its points where the
box leaves it open), which components are near each other, and are those similar as a whole? Components that pass are
joined and are a group. Where the check fails, components that are not tight are fitted again with two components or more
until they are; components near each other then make up a neighbourhood, and one that is not mutually similar as a whole is
cut on its own: from the densest member of each component a group grows by points similar to all of its members, those of
the component first, and the heaviest stands. Members are ranked by their density in the mixture of their neighbourhood;
the first ones represent the group. No pairs of points are listed.

A neighbourhood that is to be cut and reaches so far that a block may see only a part of it is gathered from its pieces and cut
as a whole, so that the groups do not depend on the blocks. Blocks far fuller than the rest are cut into finer ones. Exact copies are one weighted point during the fit, however many.

Defined results: points with a null, NaN or infinite coordinate, a null or negative id or a null scope take no part; copies
are members like all others; of groups of equal size the one found first by density stands; empty inputs give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import BROADCAST_ROWS, Stage, lookup, small
from ..tables import finite
from .components import components

MAX_COMPONENTS = 3
ROUNDS = 25
REGULAR = 1e-3  # added to the variances of standardised features
BLOCK_RADII, FINE_RADII, RIM_RADII = 64, 8, 3
FULL_BLOCK = 50_000
CHUNK = 30_000
_PAIRS = 4_000_000


def _touching(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all occupied cells that touch, each pair once; a cell touches itself. cells: sorted keys, `bits` per axis."""
    out_a, out_b = [], []
    half = [(0, 0, 0)] + [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    for x, y, z in half:
        other = cells + (x << 2 * bits) + (y << bits) + z
        at = np.searchsorted(cells, other)
        hit = np.flatnonzero((at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == other))
        out_a.append(hit)
        out_b.append(at[hit])
    return np.concatenate(out_a), np.concatenate(out_b)


def _pairs(start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k, i, j) in slices: every item i of run a[k] with every item j of run b[k]."""
    n = size[a] * size[b]
    for lo, hi in _slices(n):
        m = n[lo:hi]
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat(size[b[lo:hi]], m)
        yield np.repeat(np.arange(lo, hi), m), np.repeat(start[a[lo:hi]], m) + k // wide, np.repeat(start[b[lo:hi]], m) + k % wide


def _length(d: np.ndarray) -> np.ndarray:
    return np.sqrt((d * d).sum(axis=-1))


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PAIRS, side="right")))
        yield lo, hi
        lo = hi


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position each point is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fit_mixtures(seg: np.ndarray, x: np.ndarray, w: np.ndarray, fewest: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(component, log density) of each point, for mixtures of `fewest` components or more fitted to every segment on its
    own. seg: 0, 1, ... sorted; x: standardised features (points x 2); w: weights."""
    m = int(seg[-1]) + 1
    total = np.bincount(seg, w, m)
    first = np.searchsorted(seg, np.arange(m))
    points = np.diff(np.append(first, len(seg)))
    # points in the order of the feature that varies most, for the start
    spread = np.stack([np.bincount(seg, w * x[:, a] ** 2, m) for a in (0, 1)], axis=1)
    main = x[np.arange(len(x)), spread.argmax(axis=1)[seg]]
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((main, seg))] = np.arange(len(x)) - np.repeat(first, points)
    best_bic = np.full(m, np.inf)
    comp, dens = np.zeros(len(x), np.int64), np.zeros(len(x))
    for k in range(fewest, MAX_COMPONENTS + 1):
        r = np.zeros((len(x), k))
        r[np.arange(len(x)), np.minimum(rank * k // points[seg], k - 1)] = 1.0
        for _ in range(ROUNDS if k > 1 else 1):
            logp = np.empty((len(x), k))
            for c in range(k):
                rw = r[:, c] * w
                s = np.bincount(seg, rw, m) + 1e-12
                mean = np.stack([np.bincount(seg, rw * x[:, a], m) / s for a in (0, 1)], axis=1)
                d = x - mean[seg]
                a = np.bincount(seg, rw * d[:, 0] ** 2, m) / s + REGULAR
                b = np.bincount(seg, rw * d[:, 0] * d[:, 1], m) / s
                e = np.bincount(seg, rw * d[:, 1] ** 2, m) / s + REGULAR
                det = np.maximum(a * e - b * b, REGULAR**2)
                q = (e[seg] * d[:, 0] ** 2 - 2 * b[seg] * d[:, 0] * d[:, 1] + a[seg] * d[:, 1] ** 2) / det[seg]
                logp[:, c] = (np.log(s / total) - 0.5 * np.log(det) - np.log(2 * np.pi))[seg] - 0.5 * q
            top = logp.max(axis=1)
            whole = top + np.log(np.exp(logp - top[:, None]).sum(axis=1))
            r = np.exp(logp - whole[:, None])
        bic = -2 * np.bincount(seg, w * whole, m) + (6 * k - 1) * np.log(total)
        better = bic < best_bic
        best_bic[better] = bic[better]
        at = better[seg]
        comp[at], dens[at] = logp[at].argmax(axis=1), whole[at]
    return comp, dens


def _features(seg: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Tangent-plane coordinates of each segment's points, standardised."""
    m = int(seg[-1]) + 1
    total = np.bincount(seg, w, m)
    mean = np.stack([np.bincount(seg, w * p[:, a], m) / total for a in range(3)], axis=1)
    up = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-300)[:, None]
    axis = np.where(np.abs(up[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    east = np.cross(axis, up)
    east /= np.maximum(np.linalg.norm(east, axis=1), 1e-300)[:, None]
    north = np.cross(up, east)
    d = p - mean[seg]
    x = np.stack([(d * east[seg]).sum(axis=1), (d * north[seg]).sum(axis=1)], axis=1)
    sd = np.sqrt(np.stack([np.bincount(seg, w * x[:, a] ** 2, m) / total for a in (0, 1)], axis=1))
    return x / np.maximum(sd, 1e-12)[seg]


def _described(rows: np.ndarray, group: np.ndarray, ids: np.ndarray, comp: np.ndarray, dens: np.ndarray) -> pd.DataFrame:
    """(row, group_id, rank, components) of grouped points."""
    out = pd.DataFrame({"row": rows, "g": group, "id": ids, "dens": dens, "comp": comp})
    out["group_id"] = out.groupby("g")["id"].transform("min")
    out["components"] = out.groupby("g")["comp"].transform("nunique")
    out = out.sort_values(["g", "dens", "id"], ascending=[True, False, True], kind="stable")
    out["rank"] = out.groupby("g").cumcount() + 1
    return out[["row", "group_id", "rank", "components"]].reset_index(drop=True)


def _grown(p: np.ndarray, order: np.ndarray, radius: float) -> np.ndarray:
    """Members of the group that grows from the first point of `order`, taking points in that order while they are similar to
    all members."""
    group, left, q = [], order, p[order]
    while len(left):
        group.append(left[0])
        d = q[1:] - q[0]
        near = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", d, d)) <= radius) + 1
        left, q = left[near], q[near]
    return np.array(group, np.int64)


def _cut(part: np.ndarray, p: np.ndarray, dens: np.ndarray, w: np.ndarray, radius: float, least: int) -> list[np.ndarray]:
    """Groups of one neighbourhood that is not mutually similar as a whole: the heaviest group that grows from a component, then
    the heaviest of the rest, and so on. A group that lost members to another one is grown again from what its component has
    left."""
    place = np.empty(len(p), np.int64)
    place[np.lexsort((np.arange(len(p)), -dens))] = np.arange(len(p))
    cell = np.floor((p - p.min(axis=0)) / radius).astype(np.int64) + 1
    by_cell = pd.Series(np.arange(len(p))).groupby(list(cell.T)).indices
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    free, out = np.ones(len(p), bool), []
    members = {c: s[np.argsort(place[s])] for c, s in pd.Series(np.arange(len(p))).groupby(part).indices.items()}

    def grow(c: int) -> tuple[float, int, np.ndarray] | None:
        own = members[c][free[members[c]]]
        if not len(own):
            return None
        x, y, z = cell[own[0]].tolist()
        near = np.concatenate([by_cell[k] for k in ((x + a, y + b, z + c) for a, b, c in around) if k in by_cell])
        near = near[free[near]]
        near = near[_length(p[near] - p[own[0]]) <= radius]
        # the densest member comes first, then its component, then the others
        group = _grown(p, near[np.lexsort((place[near], part[near] != c))], radius)
        return -float(w[group].sum()), c, group

    heap = [g for c in sorted(members) if (g := grow(c))]
    heapq.heapify(heap)
    while heap:
        weight, c, group = heapq.heappop(heap)
        if free[group].all():
            if -weight < least:
                break
            out.append(group)
            free[group] = False
        if g := grow(c):
            heapq.heappush(heap, g)
    return out


def cut_sets(seg: np.ndarray, p: np.ndarray, ids: np.ndarray, w: np.ndarray, radius: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group or -1, component, log density) of each point of neighbourhoods to be cut, each from its own mixture only. seg: 0,
    1, ... in any order."""
    by = np.lexsort((*p.T, ids, seg))
    x, q, v = seg[by], p[by], w[by]
    part, comp, dens = _candidates(x, q, v, radius)
    part = _tightened(part, q, v, radius)
    group, n = np.full(len(seg), -1), 0
    first = np.searchsorted(x, np.arange(int(x[-1]) + 2))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        for members in _cut(part[lo:hi], q[lo:hi], dens[lo:hi], v[lo:hi], radius, least):
            group[by[lo + members]] = n
            n += 1
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return group, comp[back], dens[back]


def cut_neighbourhood(p: np.ndarray, ids: np.ndarray, w: np.ndarray, radius: float, least: int) -> pd.DataFrame:
    """The groups of one neighbourhood that no block holds as a whole."""
    group, comp, dens = cut_sets(np.zeros(len(ids), np.int64), p, ids, w, radius, least)
    inside = np.flatnonzero(group >= 0)
    return _described(inside, group[inside], ids[inside], comp[inside], dens[inside])


def _candidates(hood: np.ndarray, p: np.ndarray, w: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, component, log density) of each point. Parts are the mixtures' components; one that is too wide for a group is
    fitted again on its own, until the information criterion leaves it whole. Component and density are those of the first
    fit. hood: 0, 1, ... sorted."""
    part, todo, first = hood, np.arange(len(hood)), None
    while len(todo):
        todo = todo[np.argsort(part[todo], kind="stable")]
        _, seg = np.unique(part[todo], return_inverse=True)
        comp, dens = fit_mixtures(seg, _features(seg, p[todo], w[todo]), w[todo])
        first = first or (comp, dens)
        new = np.zeros(len(part), np.int64)
        new[todo] = comp
        _, now = np.unique(part * MAX_COMPONENTS + new, return_inverse=True)
        m = int(seg[-1]) + 1
        split = np.zeros((m, MAX_COMPONENTS), bool)
        split[seg, comp] = True
        start, lo, hi, by = _boxes(now, p)
        wide = ((hi - lo) > radius).any(axis=1)
        part, todo = now, todo[(split.sum(axis=1) > 1)[seg] & wide[now[todo]]]
    return part, *first


def _tightened(part: np.ndarray, p: np.ndarray, w: np.ndarray, radius: float) -> np.ndarray:
    """Parts whose points are all mutually similar: those that are not are fitted again with two components or more. Where
    the fit leaves all points in one component, they are halved."""
    open_part = np.ones(int(part.max()) + 1, bool)
    while True:
        start, lo, hi, by = _boxes(part, p)
        each = np.flatnonzero(open_part)
        _, tight = _met(p[by], start, np.bincount(part), lo, hi, each, each, radius)
        open_part[each[tight]] = False
        todo = np.flatnonzero(open_part[part])
        if not len(todo):
            return part
        todo = todo[np.argsort(part[todo], kind="stable")]
        _, seg = np.unique(part[todo], return_inverse=True)
        comp, _ = fit_mixtures(seg, _features(seg, p[todo], w[todo]), w[todo], fewest=2)
        m = int(seg[-1]) + 1
        seen = np.zeros((m, MAX_COMPONENTS), bool)
        seen[seg, comp] = True
        stuck = (seen.sum(axis=1) == 1)[seg]
        if stuck.any():
            size = np.bincount(seg, minlength=m)
            place = np.arange(len(seg)) - (np.cumsum(size) - size)[seg]
            comp = np.where(stuck, (2 * place >= size[seg]).astype(np.int64), comp)
        new = np.zeros(len(part), np.int64)
        new[todo] = comp
        old_open = open_part[part]
        _, part = np.unique(part * MAX_COMPONENTS + new, return_inverse=True)
        open_part = np.zeros(int(part.max()) + 1, bool)
        open_part[part[old_open]] = True


def _boxes(part: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, lowest, highest corner) of each part, in the points' order by part, and that order."""
    by = np.argsort(part, kind="stable")
    start = np.searchsorted(part[by], np.arange(int(part.max()) + 1))
    return start, np.minimum.reduceat(p[by], start), np.maximum.reduceat(p[by], start), by


def _met(p: np.ndarray, start: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(some, every): whether some and whether all points of part a[k] are within the radius of those of part b[k]. Boxes
    decide where they can; points are compared only of the parts that are left in doubt."""
    gap = np.maximum(np.maximum(lo[b] - hi[a], lo[a] - hi[b]), 0.0)
    far = np.maximum(hi[a] - lo[b], hi[b] - lo[a])
    every = _length(far) <= radius
    some = every | (a == b)
    doubt = (_length(gap) <= radius) & ~every & ((a != b) | (far <= radius).all(axis=1))
    n = size[a] * size[b]
    few = np.flatnonzero(doubt & (n <= _PAIRS))
    for k, i, j in _pairs(start, size, a[few], b[few]):
        ok = _length(p[i] - p[j]) <= radius
        hits = np.bincount(k[ok], minlength=len(few))
        seen = np.unique(k)
        some[few[seen]], every[few[seen]] = hits[seen] > 0, hits[seen] == n[few[seen]]
    for k in np.flatnonzero(doubt & (n > _PAIRS)).tolist():
        x, y = (p[start[c] : start[c] + size[c]] for c in (a[k], b[k]))

        def any_pair(test, u, v):
            step = max(1, _PAIRS // max(len(v), 1))
            return any(bool(test(_length(u[c : c + step, None] - v[None])).any()) for c in range(0, len(u), step)) if len(v) else False

        fx, fy = x[_length(np.maximum(x - lo[b[k]], hi[b[k]] - x)) > radius], y[_length(np.maximum(y - lo[a[k]], hi[a[k]] - y)) > radius]
        every[k] = not any_pair(lambda d: d > radius, fx, fy)
        some[k] = every[k] or a[k] == b[k] or any_pair(lambda d: d <= radius, *(u[_length(np.maximum(np.maximum(lo[c] - u, u - hi[c]), 0.0)) <= radius] for u, c in ((x, b[k]), (y, a[k]))))
    return some, every


def _settled(cell: np.ndarray, names: np.ndarray, bits: int, part: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, settled) of each point: parts with points near each other make a set; it is settled if all of its points are
    mutually similar, and nothing outside of it is near it."""
    start, lo, hi, by = _boxes(part, p)
    m = len(start)
    size = np.bincount(part, minlength=m)
    entry = np.unique(cell * m + part)  # parts of each cell
    first, count = np.searchsorted(entry, np.arange(len(names)) * m), np.bincount(entry // m, minlength=len(names))
    found = [np.zeros(0, np.int64)]
    for _, i, j in _pairs(first, count, *_touching(names, bits)):
        i, j = entry[i] % m, entry[j] % m
        found.append(np.unique((np.minimum(i, j) * m + np.maximum(i, j))[i != j]))
    pairs = np.unique(np.concatenate(found))
    a, b = pairs // m, pairs % m
    some, every = _met(p[by], start, size, lo, hi, a, b, radius)
    each = np.arange(m)
    _, tight = _met(p[by], start, size, lo, hi, each, each, radius)
    a, b, every = a[some], b[some], every[some]
    label = _labels(m, a, b)
    parts = np.bincount(label, minlength=m)
    ok = (np.bincount(label[a[every]], minlength=m) == parts * (parts - 1) // 2) & (np.bincount(label, ~tight, m) == 0)
    return label[part], ok[label[part]]


def find_groups(block: np.ndarray, cells: np.ndarray, p: np.ndarray, ids: np.ndarray, w: np.ndarray, home: np.ndarray, radius: float, least: int, edge: np.ndarray | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(row, group_id, rank, components) of the members of groups; a neighbourhood belongs to the block that its smallest id is
    at home in. And (row, piece) of neighbourhoods to be cut that some block may not see as a whole, wherever one of their
    points is at home. edge: points so far out in the rim that their neighbours may be beyond it."""
    edge = np.zeros(len(ids), bool) if edge is None else edge
    key = (block << 21) | (cells[:, 0] << 14) | (cells[:, 1] << 7) | cells[:, 2]
    empty = pd.DataFrame({"row": np.zeros(0, np.int64), "group_id": np.zeros(0, np.int64), "rank": np.zeros(0, np.int64), "components": np.zeros(0, np.int64)})
    none = pd.DataFrame({"row": np.zeros(0, np.int64), "piece": np.zeros(0, np.int64)})
    names, cell = np.unique(key, return_inverse=True)
    label = _labels(len(names), *_touching(names, 7))[cell]
    cut_off = (np.bincount(label, home, len(names)) > 0) & (np.bincount(label, edge, len(names)) > 0)
    rows = np.flatnonzero(((np.bincount(label, w, len(names)) >= least) | cut_off)[label])
    if not len(rows):
        return empty, none
    rows = rows[np.lexsort((*p[rows].T, ids[rows], label[rows]))]
    _, hood = np.unique(label[rows], return_inverse=True)
    part, comp, dens = _candidates(hood, p[rows], w[rows], radius)
    near, whole = _settled(cell[rows], names, 7, part, p[rows], radius)
    # sets that the components leave unsettled, by tight components
    at = np.flatnonzero(~whole)
    if len(at):
        _, some = np.unique(part[at], return_inverse=True)
        finer, all_of = _settled(cell[rows][at], names, 7, _tightened(some, p[rows][at], w[rows][at], radius), p[rows][at], radius)
        near[at] = int(near.max()) + 1 + finer
        whole[at] = all_of
    _, near = np.unique(near, return_inverse=True)
    size = np.bincount(near)
    m = len(size)
    whole_of = np.zeros(m, bool)
    whole_of[near] = whole
    # a cut needs all of the neighbourhood: within reach of each of the finest blocks that its points can be at home in
    start, lo, hi, by = _boxes(near, p[rows])
    fine, reach = FINE_RADII * radius, (RIM_RADII - 1) * radius * (1 - 1e-9)
    seen = ((hi <= (np.floor(lo / fine) + 1) * fine + reach) & (lo >= np.floor(hi / fine) * fine - reach)).all(axis=1)
    has = [np.bincount(near, v[rows], m) > 0 for v in (home, edge)]
    opened = ~whole_of & has[0] & (has[1] | ~seen)
    kept = ((np.bincount(near, w[rows]) >= least) & ~opened & home[rows[by[start]]])[near]
    pieces = np.flatnonzero(opened[near])
    pieces = pd.DataFrame({"row": rows[pieces], "piece": near[pieces]})
    # a neighbourhood's own mixture gives the densities
    other = np.flatnonzero(kept & whole_of[near] & (size[near] != np.bincount(hood)[hood]))
    if len(other):
        other = other[np.argsort(near[other], kind="stable")]
        _, seg = np.unique(near[other], return_inverse=True)
        comp[other], dens[other] = fit_mixtures(seg, _features(seg, p[rows[other]], w[rows[other]]), w[rows[other]])
    group = np.where(kept & whole_of[near], near, -1)
    broken = np.flatnonzero(kept & ~whole_of[near])
    if len(broken):
        _, seg = np.unique(near[broken], return_inverse=True)
        cut, comp[broken], dens[broken] = cut_sets(seg, p[rows[broken]], ids[rows[broken]], w[rows[broken]], radius, least)
        group[broken] = np.where(cut >= 0, m + cut, -1)
    inside = np.flatnonzero(group >= 0)
    return (_described(rows[inside], group[inside], ids[rows[inside]], comp[inside], dens[inside]) if len(inside) else empty), pieces


def _blocks(df: DataFrame, side: float, rim: float) -> DataFrame:
    """Each point in its home block and in those whose rim it lies in."""
    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - rim) / side).cast("int"), F.floor((F.col(c) + rim) / side).cast("int"))

    out = df
    for c in "xyz":
        out = out.select("*", F.explode(span(c)).alias(f"b{c}"))
    home = F.lit(True)
    for c in "xyz":
        home = home & (F.col(f"b{c}") == F.floor(F.col(c) / side))
    return out.withColumn("home", home).withColumn("side", F.lit(side))


def similarity_groups(points: DataFrame, radius: float, least: int = 4) -> DataFrame:
    """(scope, group_id, id, rank, components) per member; points: (scope, id, x, y, z). rank: 1 for the most typical."""
    spark = points.sparkSession
    stage = Stage(spark, "mixture")
    ok = F.col("scope").isNotNull() & (F.col("id") >= 0)
    for c in "xyz":
        ok = ok & finite(F.col(c))
    rows = points.select("scope", F.col("id").cast("long").alias("id"), "x", "y", "z").filter(ok)
    single = stage.write(rows.groupBy("scope", "x", "y", "z").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    side, fine, rim = BLOCK_RADII * radius, FINE_RADII * radius, RIM_RADII * radius
    at = [F.floor(F.col(c) / side).cast("int").alias(f"h{c}") for c in "xyz"]
    # blocks with too many points; there are at most (points / FULL_BLOCK) of them
    same = ["scope", "hx", "hy", "hz"]
    full, n_full = stage.write_counted(single.select("scope", *at).groupBy(*same).count().filter(F.col("count") > FULL_BLOCK).select(*same))
    ready = _blocks(single, side, rim)
    if n_full:
        named = ready.withColumnsRenamed({f"b{c}": f"h{c}" for c in "xyz"})
        usual = named.join(small(full, n_full), same, "left_anti").withColumnsRenamed({f"h{c}": f"b{c}" for c in "xyz"})
        crowded = named.join(small(full, n_full), same, "left_semi")
        # a fine block belongs to the coarse one it lies in; side is a multiple of fine
        split = _blocks(crowded.select("scope", "x", "y", "z", "id", "n").distinct(), fine, rim)
        inner = [F.floor(F.col(f"b{c}") / (BLOCK_RADII // FINE_RADII)).cast("int").alias(f"h{c}") for c in "xyz"]
        split = split.select("*", *inner).join(small(full, n_full), same, "left_semi").drop("hx", "hy", "hz")
        ready = usual.unionByName(split)
    keys = ["scope", "side", "bx", "by", "bz"]
    ready = ready.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def groups(b: pd.DataFrame) -> pd.DataFrame:
            block = b.groupby(keys, sort=False).ngroup().to_numpy(np.int64)
            p = b[["x", "y", "z"]].to_numpy(float)
            corner = b[["bx", "by", "bz"]].to_numpy(float) * b[["side"]].to_numpy(float)
            cells = np.floor((p - corner) / radius).astype(np.int64) + RIM_RADII + 2
            beyond = np.maximum(corner - p, p - corner - b[["side"]].to_numpy(float)).max(axis=1)
            edge = beyond > (RIM_RADII - 1) * radius * (1 - 1e-9)
            found, pieces = find_groups(block, cells, p, b["id"].to_numpy(np.int64), b["n"].to_numpy(float), b["home"].to_numpy(bool), radius, least, edge)
            point = ["scope", "x", "y", "z", "id", "n"]
            out = b.iloc[found["row"].to_numpy()][point].reset_index(drop=True)
            out = out.assign(group_id=found["group_id"], rank=found["rank"].astype(np.int32), components=found["components"].astype(np.int32), piece=None, home=True)
            if not len(pieces):
                return out
            part = b.iloc[pieces["row"].to_numpy()].reset_index(drop=True)
            name = part[keys].astype(str).agg("|".join, axis=1) + "|" + pieces["piece"].astype(str)
            part = part[[*point, "home"]].assign(group_id=-1, rank=np.int32(0), components=np.int32(0), piece=name)
            return pd.concat([out, part[out.columns]], ignore_index=True)

        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < CHUNK:
                continue
            b = pd.concat(held, ignore_index=True)
            last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            done, rest = b[~last], b[last]
            held, n = [rest], len(rest)
            if len(done):
                yield groups(done.reset_index(drop=True))
        if n:
            yield groups(pd.concat(held, ignore_index=True))

    schema = T.StructType([single.schema[c] for c in ("scope", "x", "y", "z", "id", "n")] + [T.StructField("group_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("components", T.IntegerType())])
    found = stage.write(ready.mapInPandas(run, T.StructType([*schema, T.StructField("piece", T.StringType()), T.StructField("home", T.BooleanType())])))
    opened = found.filter("piece is not null")
    found = found.filter("piece is null").select(*schema.names)
    if not opened.isEmpty():
        found = stage.write(found.unionByName(_gathered(opened, stage, schema, radius, least)))
    alone = found.filter("n = 1").select("scope", "group_id", "id", "rank", "components")
    copies, n_copies = stage.write_counted(found.filter("n > 1").select(F.struct("scope", "x", "y", "z").alias("point"), "group_id", "rank", "components"))
    if not n_copies:
        return alone
    keyed = rows.select(F.struct("scope", "x", "y", "z").alias("point"), "id")
    return alone.unionByName(lookup(keyed, rows.count() if n_copies > BROADCAST_ROWS else 0, "point", copies, n_copies).select(F.col("point.scope").alias("scope"), "group_id", "id", "rank", "components"))


def _gathered(opened: DataFrame, stage: Stage, schema: T.StructType, radius: float, least: int) -> DataFrame:
    """Groups of the neighbourhoods that blocks see in pieces: pieces that share points are one neighbourhood, which is gathered
    under its label, each point once, and cut as a whole in one task."""
    node = F.concat_ws("|", F.lit("x"), *[F.col(c).cast("string") for c in ("scope", "x", "y", "z")])
    pieces = opened.withColumn("node", node)
    label = stage.write(components(pieces.select(F.concat(F.lit("p"), "piece").alias("a"), F.col("node").alias("b"))))
    at_home, n = stage.write_counted(pieces.filter("home").select("node", "scope", "x", "y", "z", "id", "n"))
    whole = lookup(at_home, n, "node", label, label.count())

    def cut(b: pd.DataFrame) -> pd.DataFrame:
        found = cut_neighbourhood(b[["x", "y", "z"]].to_numpy(float), b["id"].to_numpy(np.int64), b["n"].to_numpy(float), radius, least)
        out = b.iloc[found["row"].to_numpy()][["scope", "x", "y", "z", "id", "n"]].reset_index(drop=True)
        return out.assign(group_id=found["group_id"], rank=found["rank"].astype(np.int32), components=found["components"].astype(np.int32))

    return whole.groupBy("root").applyInPandas(cut, schema)


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """(scope, group_id, size, components, typical): one row per group with its most typical members by density."""
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= typical, F.struct("rank", "id"))))
    return members.groupBy("scope", "group_id").agg(F.count("*").alias("size"), F.max("components").alias("components"), F.slice(few, 1, typical).alias("t")).select(
        "scope", "group_id", "size", "components", F.transform("t", lambda s: s["id"]).alias("typical")
    )


def detection_points(detections: DataFrame, clusters: DataFrame) -> DataFrame:
    """(scope, id, x, y, z): valid vectors by catalog, and the local points of each linked cluster."""
    x, y, z = (F.col(f"rho_{c}") for c in "xyz")
    unit = F.abs(F.sqrt(x * x + y * y + z * z) - 1.0) <= 1e-6
    own = detections.filter(finite(x) & finite(y) & finite(z)).filter(unit).select(F.col("catalog_id").alias("scope"), F.col("intid").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))
    zipped = F.arrays_zip("local_intids", "local_points")
    local = clusters.filter("local_points is not null and local_intids is not null").select(F.col("cluster_id").cast("string").alias("scope"), F.explode(zipped).alias("m"))
    local = local.filter(F.size("m.local_points") == 3).select("scope", F.col("m.local_intids").alias("id"), *[F.get("m.local_points", F.lit(a)).alias(c) for a, c in enumerate("xyz")])
    return own.unionByName(local)
