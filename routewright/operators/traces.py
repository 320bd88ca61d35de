"""Mean distances between two lines with points between their vertices, pair by pair inside a task.

The points between are many times the vertices, so only vertices are shuffled: the points are made where a pair's vertices
meet, searched there and never leave the task. A search walks down two trees of consecutive points together, keeping for each node the nodes
of the other line that can still hold a nearest point, so near and far lines cost alike and no line is compared with a whole other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from routewright.functions import geo

# Points of a leaf, children of a node.
_LEAF, _FAN = 8, 4
# Dense points made at a time (a longer pair alone), pairs of nodes held at a time, pairs of leaves measured at a time.
_DENSE, _PAIRS, _MEASURED = 1 << 15, 1 << 18, 1 << 9
# Slack of the bounds in earth radii: far above rounding, far below a step.
_SLACK = 1e-9


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ..`` of each row, ``count`` of them, one row after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _firsts(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def _steps(v: dict, step_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first part, number of points, parts of its segment) of every vertex, as :func:`lines.densify` splits them."""
    if step_m <= 0:
        one = np.ones(len(v["lat"]), dtype=np.int64)
        return one * 0, one, one
    has_next = np.append((v["line"][1:] == v["line"][:-1]), False)[:len(v["line"])]
    lat, lat2, lon, lon2 = v["lat"], np.roll(v["lat"], -1), v["lon"], np.roll(v["lon"], -1)
    half_lat, half_lon = np.sin(np.radians(lat2 - lat) / 2), np.sin(np.radians(lon2 - lon) / 2)
    chord = np.sqrt(half_lat * half_lat + np.cos(np.radians(lat)) * np.cos(np.radians(lat2)) * half_lon * half_lon)
    parts = np.fmax(1, np.ceil(2 * geo.OUTLINE_RADIUS_M * np.arcsin(chord) / step_m)).astype(np.int64)
    starts = v["seq"] == 0
    return np.where(starts, 0, 1), np.where(has_next, parts, 0) + starts, parts


def _points(v: dict, first: np.ndarray, count: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, lat, lon) of the points that :func:`_steps` counted."""
    at = np.repeat(np.arange(len(count)), count)
    part, n = _ranges(first, count), parts[at]

    def between(c: np.ndarray) -> np.ndarray:
        here, there = c[at], np.roll(c, -1)[at]
        return np.where(part == 0, here, np.where(n == 1, there, here + (there - here) * (part / n)))

    return v["line"][at], between(v["lat"]), between(v["lon"])


def _placed(lat: np.ndarray, lon: np.ndarray, size: np.ndarray) -> np.ndarray:
    """East, north and up on the unit sphere, as seen from the first of each ``size`` points: differences of near points keep all their digits."""
    first = _firsts(size)
    d_lat, turn = np.radians(lat - np.repeat(lat[first], size)), lon - np.repeat(lon[first], size)
    d_lon = np.radians(turn - 360.0 * np.round(turn / 360.0))
    cos_lat, origin = np.cos(np.radians(lat)), np.radians(lat[first])
    sag = 2 * cos_lat * np.sin(d_lon / 2) ** 2
    north = np.sin(d_lat) + np.repeat(np.sin(origin), size) * sag
    return np.stack([cos_lat * np.sin(d_lon), north, -2 * np.sin(d_lat / 2) ** 2 - np.repeat(np.cos(origin), size) * sag])


def _length(gap: np.ndarray) -> np.ndarray:
    return np.sqrt((gap * gap).sum(axis=0))


def _tree(xyz: np.ndarray, count: np.ndarray, height: int) -> list[dict]:
    """Levels from leaves of points up to one node for each line: the place of a point of the node, how far its points
    lie from that, and its children. ``count`` points of each line follow one another."""
    leaves = -(-count // _LEAF)
    line = np.repeat(np.arange(len(count)), leaves)
    start = np.repeat(_firsts(count), leaves) + (np.arange(len(line)) - np.repeat(_firsts(leaves), leaves)) * _LEAF
    slots = np.minimum(start + np.arange(_LEAF)[:, None], (np.cumsum(count) - 1)[line])
    points = xyz.take(slots, axis=1)
    centre = points[:, _LEAF // 2]
    levels = [{"slots": slots, "points": points, "centre": centre, "radius": _length(points - centre[:, None]).max(axis=0)}]
    nodes = leaves
    for _ in range(height - 1):
        below, above = levels[-1], -(-nodes // _FAN)
        line = np.repeat(np.arange(len(nodes)), above)
        nth = np.arange(len(line)) - np.repeat(_firsts(above), above)
        first = _firsts(nodes)[line] + nth * _FAN
        children = np.minimum(_FAN, nodes[line] - nth * _FAN)
        centre = below["centre"].take(first + children // 2, axis=1)
        reach = _length(below["centre"] - np.repeat(centre, children, axis=1)) + below["radius"]
        levels.append({"centre": centre, "radius": np.maximum.reduceat(reach, first), "first": first, "children": children})
        nodes = above
    return levels


def _measured(a: dict, b: dict, nodes: np.ndarray, count: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared chord from each point of the leaves ``nodes`` to the nearest point of its ``count`` leaves in ``others``."""
    best, own = np.full((_LEAF, len(others)), np.inf), np.repeat(nodes, count)
    buffers = np.empty((3, _LEAF, _MEASURED))
    for start in range(0, len(others), _MEASURED):
        some = slice(start, start + _MEASURED)
        here, there, nearest = a["points"].take(own[some], axis=2), b["points"].take(others[some], axis=2), best[:, some]
        gap = buffers[:, :, :nearest.shape[1]]
        for slot in range(_LEAF):
            np.subtract(here, there[:, slot, None], out=gap)
            np.multiply(gap, gap, out=gap)
            np.add(gap[0], gap[1], out=gap[0])
            np.add(gap[0], gap[2], out=gap[0])
            np.minimum(nearest, gap[0], out=nearest)
    return np.minimum.reduceat(best, _firsts(count), axis=1)


def _nearest(a: list[dict], b: list[dict], lines: int, n: int) -> np.ndarray:
    """Chord from each of the ``n`` points of tree ``a`` to the nearest point of the same line's tree in ``b``.

    A node's nearest points lie no farther than the nearest centre of the other line (a point itself) plus its own
    radius, so nodes beyond that are left. Where very many stay, half of the nodes waits, which bounds the memory.
    """
    found = np.empty(n)
    waiting = [(len(a) - 1, np.arange(lines), np.ones(lines, dtype=np.int64), np.arange(lines))]
    while waiting:
        level, nodes, count, others = waiting.pop()
        if level == 0:
            found[a[0]["slots"][:, nodes]] = _measured(a[0], b[0], nodes, count, others)
            continue
        up, other_up, down, other_down = a[level], b[level], a[level - 1], b[level - 1]
        if len(nodes) > 1 and int((np.add.reduceat(other_up["children"][others], _firsts(count)) * up["children"][nodes]).sum()) > _PAIRS:
            half = len(nodes) // 2
            cut = int(count[:half].sum())
            waiting += [(level, nodes[:half], count[:half], others[:cut]), (level, nodes[half:], count[half:], others[cut:])]
            continue
        children = up["children"][nodes]
        own = _ranges(up["first"][nodes], children)
        lists = np.repeat(count, children)
        met = others[_ranges(np.repeat(_firsts(count), children), lists)]
        spread = other_up["children"][met]
        lists = np.add.reduceat(spread, _firsts(lists))
        met = _ranges(other_up["first"][met], spread)
        gap = _length(np.repeat(down["centre"].take(own, axis=1), lists, axis=1) - other_down["centre"].take(met, axis=1))
        reach = np.minimum.reduceat(gap, _firsts(lists)) + 2 * down["radius"][own] + _SLACK
        kept = gap - other_down["radius"][met] <= np.repeat(reach, lists)
        waiting.append((level - 1, own, np.add.reduceat(kept, _firsts(lists), dtype=np.int64), met[kept]))
    return np.sqrt(found)


def _means(v: dict, pairs: int, steps: tuple) -> np.ndarray:
    """Mean distances there and back of each pair; infinite where the other line has no point, NaN where a distance is none.

    ``line`` is twice the pair's number, plus one for the second line. Absent points are NaN, points that are no numbers infinite.
    """
    line, lat, lon = _points(v, *steps)
    odd = np.bincount(line[np.isinf(lat) | np.isinf(lon)], minlength=2 * pairs) > 0
    real = np.isfinite(lat) & np.isfinite(lon)
    line, lat, lon = line[real], lat[real], lon[real]
    count = np.bincount(line, minlength=2 * pairs)
    both = (count.reshape(pairs, 2) > 0).all(axis=1)
    means = np.full(2 * pairs, np.inf)
    if both.any():
        kept = both[line // 2]
        line, lat, lon = line[kept], lat[kept], lon[kept]
        sizes = count.reshape(pairs, 2)[both]
        xyz, second = _placed(lat, lon, sizes.sum(axis=1)), line % 2 == 1
        sides = [(xyz[:, ~second], sizes[:, 0]), (xyz[:, second], sizes[:, 1])]
        most, height = -(-int(sizes.max()) // _LEAF), 1
        while most > 1:
            most, height = -(-most // _FAN), height + 1
        trees = [_tree(*side, height) for side in sides]
        for side in (0, 1):
            chord = _nearest(trees[side], trees[1 - side], len(sizes), sides[side][0].shape[1])
            metres = 2 * geo.OUTLINE_RADIUS_M * np.arcsin(np.minimum(1.0, chord / 2))
            means[side::2][both] = np.add.reduceat(metres, _firsts(sizes[:, side])) / sizes[:, side]
    means, odd = means.reshape(pairs, 2), odd.reshape(pairs, 2)
    some = (count.reshape(pairs, 2) > 0) | odd
    # The distance from or only to a point that is no number is none.
    means[some.all(axis=1)[:, None] & (odd | (odd & (count.reshape(pairs, 2) == 0))[:, ::-1])] = np.nan
    return means


def mean_distances(batches: Iterator[pa.RecordBatch], step_m: float) -> Iterator[pa.RecordBatch]:
    """``there_m, back_m`` of each row's ``vertices`` (array of side 0 or 1, seq, lat, lon) after the row's other columns.

    The mean, over a line's points ``step_m`` apart, of the distance to the nearest such point of the other line; null for a line without
    a row, infinite where the other line has no point. A vertex without a place is left out.
    """
    with np.errstate(invalid="ignore"):
        for batch in batches:
            n, listed = batch.num_rows, batch.column("vertices")
            flat = listed.flatten()
            v = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("side", "seq", "lat", "lon")}
            missing = flat.field("lat").is_null().to_numpy(zero_copy_only=False) | flat.field("lon").is_null().to_numpy(zero_copy_only=False)
            broken = ~missing & ~(np.isfinite(v["lat"]) & np.isfinite(v["lon"]))
            v["line"] = 2 * np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy())) + v["side"]
            for c in ("lat", "lon"):
                v[c] = np.where(missing, np.nan, np.where(broken, np.inf, v[c]))
            order = np.lexsort((v["seq"], v["line"]))
            v = {c: column[order] for c, column in v.items()}
            steps = _steps(v, step_m)
            ends = np.searchsorted(v["line"], np.arange(0, 2 * n + 1, 2))
            made = np.append(0, np.cumsum(steps[1]))[ends]
            means, start = np.empty((n, 2)), 0
            while start < n:
                stop = max(start + 1, int(np.searchsorted(made, made[start] + _DENSE, "right")) - 1)
                some = slice(ends[start], ends[stop])
                part = {c: column[some] for c, column in v.items()}
                part["line"] = part["line"] - 2 * start
                means[start:stop] = _means(part, stop - start, tuple(s[some] for s in steps))
                start = stop
            absent = np.bincount(v["line"], minlength=2 * n).reshape(n, 2) == 0
            rest = [name for name in batch.schema.names if name != "vertices"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), *(pa.array(means[:, side], mask=absent[:, side]) for side in (0, 1))],
                names=[*rest, "there_m", "back_m"])
