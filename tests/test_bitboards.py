"""Bitboard expressions against plain loops over cells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import bitboards as bb
from driftloom.operators import label_maps


def boards():
    rng = random.Random(1)
    out = [0, bb.FULL, 1, 1 << 63, (1 << 63) | 1, bb.BORDER, bb.FULL ^ bb.BORDER, 0xAA55AA55AA55AA55, 0xFF01FF80FF01FF80 ^ 0]
    snake = sum(0xFF << (16 * r) for r in range(4)) | 1 << 15 | 1 << 24 | 1 << 47  # the longest way by sides
    out += [snake, sum(1 << (8 * y + x) for y in (0, 2, 4, 6) for x in (0, 2, 4, 6)), 0x00007E425A427E00, 0x0000001008100000 | 1 << 18]
    for density in (0.2, 0.4, 0.5, 0.6, 0.8):
        out += [sum(1 << i for i in range(64) if rng.random() < density) for _ in range(40)]
    return out


def grid(m):
    return np.array([m >> i & 1 for i in range(64)], bool).reshape(8, 8)


def number(g):
    return sum(1 << int(i) for i in np.flatnonzero(g.ravel()))


def signed(m):
    return m - (1 << 64) if m >> 63 else m


def plain_regions(g, corners):
    left, out = {tuple(map(int, p)) for p in np.argwhere(g)}, []
    for p in sorted(left):
        if p in left:
            todo, seen = [p], {p}
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        q = (y + dy, x + dx)
                        if (corners or not (dy and dx)) and q in left and q not in seen:
                            seen.add(q)
                            todo.append(q)
            left -= seen
            one = np.zeros((8, 8), bool)
            one[tuple(zip(*seen, strict=True))] = True
            out.append(one)
    return out


def plain_filled(g):
    out = g.copy()
    for r in plain_regions(~g, False):
        if not (r[0].any() or r[-1].any() or r[:, 0].any() or r[:, -1].any()):
            out |= r
    return out


def plain_moved(g, offsets, grow):
    out = np.zeros_like(g) if grow else np.ones_like(g)
    for y in range(8):
        for x in range(8):
            near = [g[y + dy, x + dx] for dx, dy in offsets if 0 <= y + dy < 8 and 0 <= x + dx < 8]
            out[y, x] = any(near) if grow else all(near)
    return out


def plain_area(g):
    total = 0.0
    for y in range(7):
        for x in range(7):
            total += {4: 1.0, 3: 0.5}.get(int(g[y : y + 2, x : x + 2].sum()), 0.0)
    return total


def test_sets_of_cells(spark):
    all_boards = boards()
    m = F.col("m")
    kernel = bb.ellipse(3)
    df = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(all_boards)], "i int, m long").repartition(4)
    got = df.select("i", bb.dilated(m, kernel).alias("grown"), bb.eroded(m, kernel).alias("shrunk"), bb.opened(m, bb.SQUARE).alias("opened"), bb.filled(m).alias("filled"), bb.area(m).alias("area"), bb.regions(m).alias("regions"), bb.regions(m, False).alias("by_sides"), bb.large_filled(m, 1.0).alias("large"), bb.cells(m).alias("cells")).collect()
    assert sorted(bb.ellipse(3)) == sorted(bb.CROSS) and len(bb.ellipse(5)) == 17
    for r in got:
        g = grid(all_boards[r["i"]])
        sets = {"grown": plain_moved(g, kernel, True), "shrunk": plain_moved(g, kernel, False), "opened": plain_moved(plain_moved(g, bb.SQUARE, False), bb.SQUARE, True), "filled": plain_filled(g)}
        large = [plain_filled(x) for x in plain_regions(g, True)]
        sets["large"] = np.any([x for x in large if plain_area(x) > 1.0] or [np.zeros((8, 8), bool)], axis=0)
        for name, want in sets.items():
            assert r[name] == signed(number(want)), (name, g.astype(int))
        assert r["area"] == plain_area(g)
        assert r["regions"] == [signed(number(x)) for x in plain_regions(g, True)]
        assert r["by_sides"] == [signed(number(x)) for x in plain_regions(g, False)]
        assert r["cells"] == g.ravel().astype(int).tolist()


def plain_box(a):
    p = np.pad(a, 1, mode="reflect")
    return sum(p[dy : dy + 8, dx : dx + 8] for dy in range(3) for dx in range(3)) / 9


def plain_labels(v, least_area):
    g = v.reshape(8, 8)
    c = np.sort(v)[[10, 32, 53]]
    for _ in range(label_maps.ROUNDS):
        near = np.abs(v[:, None] - c).argmin(1)
        c = np.array([v[near == k].mean() if (near == k).any() else c[k] for k in range(3)])
    w = np.exp(-np.abs(g[..., None] - c))
    w /= w.sum(-1, keepdims=True)
    fine = []
    for k in range(3):
        mg, mw = plain_box(g), plain_box(w[..., k])
        a = (plain_box(g * w[..., k]) - mg * mw) / (plain_box(g * g) - mg * mg + label_maps.GUIDED_EPS)
        fine.append(plain_box(a) * g + plain_box(mw - a * mg))
    pick = np.stack(fine, -1).argmax(-1)
    order = np.argsort([g[pick == k].mean() if (pick == k).any() else 0.0 for k in range(3)], kind="stable")
    raw = np.argsort(order)[pick]
    solid = np.any([x for x in map(plain_filled, plain_regions(raw == 0, True)) if plain_area(x) > least_area] or [np.zeros((8, 8), bool)], axis=0)
    out = raw.copy()
    out[solid] = 0
    opened = plain_moved(plain_moved(out == 1, bb.CROSS, False), bb.CROSS, True)
    out[(out == 1) & ~solid] = 2
    out[opened] = 1
    return c, np.stack(fine, -1).reshape(64, 3), raw, out


@pytest.mark.parametrize("least_area", [1.0, 4.0])
def test_labels_of_maps(spark, least_area):
    rng = np.random.default_rng(3)
    maps = [rng.normal(size=64) * 0.1 for _ in range(40)]
    y, x = np.mgrid[:8, :8]
    maps += [(np.hypot(y - cy, x - cx) % 3 / 10 + rng.normal(size=(8, 8)) * 0.02).ravel() for cy in range(0, 8, 3) for cx in range(0, 8, 3)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(maps)], "i int, v array<double>")
    for r in label_maps.spatial_labels(df, least_area=least_area).collect():
        c, weights, raw, out = plain_labels(maps[r["i"]], least_area)
        assert np.allclose(r["centres"], c) and np.allclose(r["weights"], weights, atol=1e-9)
        for k in range(3):
            assert r[f"raw{k}"] == signed(number(raw == k)) and r[f"set{k}"] == signed(number(out == k))


def test_no_python_worker(spark):
    df = spark.createDataFrame([(0, [0.0] * 64)], "i int, v array<double>")
    plan = label_maps.spatial_labels(df)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Exchange" not in plan
