"""Work on lines of voxels: exact distance fields and separable filters.

Spark deals out whole lines along one axis, sorted; a task streams them and never
holds more than a batch and the line that goes over its end. An operation over
all three axes is three such passes. Two of them share a shuffle: what is dealt out
by planes has whole lines along both axes of a plane, and is only sorted anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Size = tuple[float, float, float]
AXES = "zyx"


def whole_lines(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Cuts sorted frames anew so that no line is cut; with the number of each row's line."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        line = _numbers(f, keys)
        cut = int(np.searchsorted(line, line[-1]))
        if cut:
            yield f.iloc[:cut].reset_index(drop=True), line[:cut]
        held = f.iloc[cut:]
    if held is not None and len(held):
        held = held.reset_index(drop=True)
        yield held, _numbers(held, keys)


def _numbers(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(f), bool)
    for k in keys:
        a = f[k].to_numpy()
        new[1:] |= a[1:] != a[:-1]
    return np.cumsum(new)


def envelope(line: np.ndarray, pos: np.ndarray, value: np.ndarray, q_line: np.ndarray, q_pos: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """For every query the site of its line with the least value + (scale * gap)^2.

    The lower envelope of one parabola a site, built site by site from the left:
    a parabola drops off the end as soon as the next one is below all of it, so
    each goes in and out once. All lines advance together. Sites are sorted by
    line and position, lines are numbered 0, 1, ... and each has a site. Of
    equal sites the leftmost is taken.
    """
    count = np.bincount(line)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    p = pos * scale
    lift = value + p * p
    stack, start = np.zeros(len(pos), np.int64), np.full(len(pos), -np.inf)
    depth = np.zeros(len(count), np.int64)
    for k in range(int(count.max(initial=0))):
        at = np.flatnonzero(count > k)
        site = first[at] + k
        while len(at):
            end = first[at] + np.maximum(depth[at] - 1, 0)
            top = stack[end]
            some = depth[at] > 0
            cut = np.where(some, (lift[site] - lift[top]) / np.where(some, 2 * (p[site] - p[top]), 1.0), -np.inf)
            out = some & (cut < start[end])
            put = at[~out]
            slot = first[put] + depth[put]
            stack[slot], start[slot] = site[~out], cut[~out]
            depth[put] += 1
            depth[at[out]] -= 1
            at, site = at[out], site[out]
    held = np.arange(len(pos)) - np.repeat(first, count) < np.repeat(depth, count)
    site, owner = stack[held], line[held]
    low, high = min(p.min(), (q_pos * scale).min()), max(p.max(), (q_pos * scale).max())
    wide = 2 * (high - low) + 4
    key = owner * wide + np.clip(start[held], low - 1, high + 1) - low
    at = np.searchsorted(key, q_line * wide + q_pos * scale - low, "right") - 1
    head = np.searchsorted(owner, np.arange(len(count)))
    least, most = head[q_line], head[q_line] + depth[q_line] - 1
    at = np.clip(at, least, most)
    cost = lambda i, q: value[site[i]] + ((q_pos[q] - pos[site[i]]) * scale) ** 2
    # rounding may put a query one site off, and the leftmost of equals is wanted
    for step in (1, -1):
        go = np.arange(len(at))
        while len(go):
            go = go[(at[go] < most[go]) if step > 0 else (at[go] > least[go])]
            here, there = cost(at[go], go), cost(at[go] + step, go)
            go = go[(there < here) if step > 0 else (there <= here)]
            at[go] += step
    return site[at]


def _dealt(df: DataFrame, line: list[str], axis: str, by: list[str] | None = None) -> DataFrame:
    """Whole lines, sorted, dealt out by some of their columns; not dealt out again if ``by`` is empty."""
    by = line if by is None else by
    return (df.repartition(*by) if by else df).sortWithinPartitions(*line, axis)


def distance_field(domain: DataFrame, features: DataFrame, size: Size = (1.0, 1.0, 1.0), keys: tuple[str, ...] = ("tomo",), planar: bool = False) -> DataFrame:
    """(keys, z, y, x, distance, near_z, near_y, near_x) of every voxel of the domain.

    The exact Euclidean distance to the nearest feature voxel of the same keys,
    and where that is; of equally near ones the first in z, y, x order. Each pass
    takes the lower envelope along an axis and carries the end points on, over
    the bounding box of the domain. Keys without a feature give no rows; rows
    with a null coordinate or key are left out, repeated ones count once.
    ``planar`` says that the rows of a key have one z: then domain and features
    are shuffled once, and there is no pass along z.
    """
    unit = list(keys)
    types = dict(domain.dtypes)
    at = [F.col(c).cast("int").alias(c) for c in AXES]
    clean = lambda v: v.select(*unit, *at).dropna().distinct()
    domain = clean(domain)
    box = domain.groupBy(*unit).agg(*[f(c).alias(f"{n}_{c}") for c in "yx" for n, f in (("lo", F.min), ("hi", F.max))])
    state = clean(features).join(box, unit).withColumns({"d2": F.lit(0.0), "near_y": F.col("y"), "near_x": F.col("x")})
    head = [f"`{k}` {types[k]}" for k in unit]

    def spread(axis: str, scale: float, line: list[str], carry: list[str]) -> Callable:
        """All positions of the box along the axis, from the sites of a line."""

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f, number in whole_lines(frames, line):
                site = f["d2"].notna().to_numpy()
                if not site.all():  # what is asked goes on as it is
                    yield f[~site][names]
                    f, number = f[site].reset_index(drop=True), np.unique(number[site], return_inverse=True)[1]
                if not len(f):
                    continue
                top = np.flatnonzero(np.diff(number, prepend=-1))
                lo, hi = f[f"lo_{axis}"].to_numpy(np.int64)[top], f[f"hi_{axis}"].to_numpy(np.int64)[top]
                q_line = np.repeat(np.arange(len(top)), hi - lo + 1)
                q_pos = np.arange(len(q_line)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[q_line]
                pos, d2 = f[axis].to_numpy(np.int64), f["d2"].to_numpy(np.float64)
                won = envelope(number, pos, d2, q_line, q_pos, scale)
                out = f.iloc[won][[*line, *carry]].reset_index(drop=True)
                yield out.assign(**{axis: q_pos.astype(np.int32), "d2": d2[won] + ((q_pos - pos[won]) * scale) ** 2, f"near_{axis}": pos[won].astype(np.int32)})[names]

        return work

    schema = ", ".join([*head, *[f"{c} int" for c in ("z", "y", "x", "lo_y", "hi_y", "lo_x", "hi_x")], "d2 double, near_y int, near_x int"])
    boxed = ["lo_y", "hi_y", "lo_x", "hi_x"]
    names = [*unit, *AXES, *boxed, "d2", "near_y", "near_x"]
    asked = domain.withColumns({"d2": F.lit(None).cast("double"), "near_y": F.lit(0), "near_x": F.lit(0)})
    if planar:
        state = state.unionByName(asked.withColumns({c: F.lit(0) for c in boxed}))
    # a slice has whole lines along x and along y: the second pass needs no shuffle
    line = [*unit, "z", "y"]
    state = _dealt(state.select(*names), line, "x", [*unit, "z"]).mapInPandas(spread("x", float(size[2]), line, [*boxed, "near_y"]), schema)
    line = [*unit, "z", "x"]
    if planar:
        axis, scale, both = "y", float(size[1]), _dealt(state.select(*asked.columns), line, "y", [])
    else:
        state = _dealt(state, line, "y", []).mapInPandas(spread("y", float(size[1]), line, [*boxed, "near_x"]), schema)
        line, axis, scale = [*unit, "y", "x"], "z", float(size[0])
        both = _dealt(state.select(*asked.columns).unionByName(asked), line, "z")

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Positions of the domain alone, from the sites along the last axis."""
        for f, number in whole_lines(frames, line):
            site = f["d2"].notna().to_numpy()
            full = np.unique(number[site])  # lines of keys with features
            sites, ask = np.flatnonzero(site), np.flatnonzero(~site & np.isin(number, full))
            if not len(ask):
                continue
            at, d2 = f[axis].to_numpy(np.int64), f["d2"].to_numpy(np.float64)
            won = sites[envelope(np.searchsorted(full, number[sites]), at[sites], d2[sites], np.searchsorted(full, number[ask]), at[ask], scale)]
            out = f.iloc[ask][[*unit, "z", "y", "x"]].reset_index(drop=True)
            out["distance"] = np.sqrt(d2[won] + ((at[ask] - at[won]) * scale) ** 2)
            near = {c: f[c if c == axis or c == "z" else f"near_{c}"].to_numpy(np.int32)[won] for c in AXES}
            yield out.assign(**{f"near_{c}": v for c, v in near.items()})

    return both.mapInPandas(settle, ", ".join([*head, "z int, y int, x int, distance double, near_z int, near_y int, near_x int"]))


# -- separable filters -------------------------------------------------------


def gaussian_taps(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    """Sampled Gaussian, or its first or second derivative, over +-truncate * sigma.

    The smoothing taps sum to 1; the first derivative's answer 1 to a slope of
    1, the second's 1 to x^2 / 2, both 0 to a constant.
    """
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    if order == 0:
        return g
    if order == 1:
        d = x * g
        return d / (d * x).sum()
    d = (x**2 - (x**2 * g).sum()) * g
    return d / (d * x**2).sum() * 2


def line_filter(image: DataFrame, axis: str, made: dict[str, tuple[str, np.ndarray]], keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds columns out = sum over k of taps[r + k] * column at position + k.

    ``made``: out -> (column, taps of odd length). Lines are taken from their
    first to their last voxel, absent ones between as 0, and mirrored at both
    ends (the end voxel repeated). ``keep`` names the columns that go on. Lines
    are dealt out by the columns ``by``, by all of their own if it is not given;
    if it is empty, partitions of the image hold whole lines already.
    """
    line = ["tomo", *[c for c in AXES if c != axis]]
    keep = [c for c in (image.columns if keep is None else keep) if c not in ["tomo", *AXES, *made]]
    types = dict(image.dtypes)
    schema = ", ".join(["tomo string, z int, y int, x int", *[f"`{c}` {types[c]}" for c in keep], *[f"`{o}` double" for o in made]])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, number in whole_lines(frames, line):
            pos = f[axis].to_numpy(np.int64)
            top = np.flatnonzero(np.diff(number, prepend=-1))
            lo, length = pos[top], pos[np.append(top[1:], len(pos)) - 1] - pos[top] + 1
            out = {o: np.zeros(len(f)) for o in made}
            for n in np.unique(length).tolist():  # lines of one length make a matrix
                mine = np.flatnonzero(length[number] == n)
                rows = np.unique(number[mine], return_inverse=True)[1]
                cols = pos[mine] - lo[number[mine]]
                for o, (column, taps) in made.items():
                    r = len(taps) // 2
                    a = np.zeros((rows[-1] + 1, n))
                    a[rows, cols] = f[column].to_numpy(np.float64)[mine]
                    a = np.pad(a, ((0, 0), (r, r)), "symmetric")
                    out[o][mine] = sum(t * a[:, k : k + n] for k, t in enumerate(taps))[rows, cols]
            yield f[["tomo", "z", "y", "x", *keep]].assign(**out)

    src = image.select("tomo", *[F.col(c).cast("int").alias(c) for c in AXES], *dict.fromkeys([*keep, *[c for c, _ in made.values()]]))
    return _dealt(src, line, axis, by).mapInPandas(work, schema)


def smooth(image: DataFrame, sigma: float, planar: bool = False, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Gaussian smoothing of the columns, in slices or in all three axes."""
    taps = gaussian_taps(sigma)
    for axis in "yx" if planar else "zyx":
        image = line_filter(image, axis, {c: (c, taps) for c in columns})
    return image


def derivatives(image: DataFrame, sigma: float, orders: dict[str, tuple[int, int, int]], planar: bool = False) -> DataFrame:
    """Columns of Gaussian derivatives of ``value``: name -> order along z, y, x.

    One pass an axis makes all that later passes need. Planar ones ignore z;
    others pass along z and y over one shuffle by planes of x, which Spark leaves
    out if the image is dealt out by those already.
    """
    by = None if planar else {"z": ["tomo", "x"], "y": []}
    taps = [gaussian_taps(sigma, o) for o in range(3)]
    have = {(): "value"}
    for k, axis in enumerate(AXES):
        if planar and axis == "z":
            have = {(0,): "value"}
            continue
        made, nxt = {}, {}
        for o in {tuple(v[: k + 1]) for v in orders.values()}:
            name = f"_d{''.join(map(str, o))}"
            made[name], nxt[o] = (have[o[:-1]], taps[o[-1]]), name
        image = line_filter(image, axis, made, keep=[], by=by and by.get(axis))
        have = nxt
    return image.select("tomo", *AXES, *[F.col(have[o]).alias(n) for n, o in orders.items()])
