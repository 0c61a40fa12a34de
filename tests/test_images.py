"""Grids, gathers, tiles of blobs and image files against dense numpy versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import lattice, resample


def cells_of(spark, cube, name="activity"):
    x, y, z = np.indices(cube.shape)
    rows = [(int(a), int(b), int(c), float(v)) for a, b, c, v in zip(x.ravel(), y.ravel(), z.ravel(), cube.ravel())]
    return spark.createDataFrame(rows, f"x long, y long, z long, {name} double")


def cube_of(df, shape, name="activity"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] += r[name]
    return out


def dense(cube, matrix, shape, linear):
    """Values at the target's places by looping over voxels; 0 outside the source's centres."""
    out = np.zeros(shape)
    for at in itertools.product(*map(range, shape)):
        p = np.round((matrix @ [*at, 1])[:3], 9)
        if (p < 0).any() or (p > np.array(cube.shape) - 1).any():
            continue
        if not linear:
            out[at] = cube[tuple(np.floor(p + 0.5).astype(int))]
            continue
        low = np.floor(p).astype(int)
        for corner in itertools.product((0, 1), repeat=3):
            w = np.prod([1 - (a - b) if k == 0 else a - b for a, b, k in zip(p, low, corner)])
            if w > 0:
                out[at] += w * cube[tuple(low + corner)]
    return out


TURNED = ((0.0, -1.4, 0.0, 5.0), (1.3, 0.0, 0.0, -2.0), (0.0, 0.1, 1.7, 3.0))
STRAIGHT = ((1.5, 0.0, 0.0, -7.0), (0.0, 1.5, 0.0, 4.0), (0.0, 0.0, -1.5, 20.0))


@pytest.mark.parametrize("affine", [TURNED, STRAIGHT])
@pytest.mark.parametrize("size", [2.0, 3.0])
def test_millimetre_grids(spark, affine, size):
    cube = np.random.default_rng(1).normal(size=(6, 5, 7))
    source = resample.Grid(cube.shape, affine)
    coarse = resample.in_millimetres(source, size)
    assert np.allclose(np.array(coarse.affine)[:, :3], np.eye(3) * size)
    m = np.linalg.inv(source.matrix()) @ coarse.matrix()
    got = cube_of(resample.resampled(cells_of(spark, cube), source, coarse), coarse.shape)
    assert np.allclose(got, dense(cube, m, coarse.shape, True))
    got = cube_of(resample.nearest(cells_of(spark, cube), source, coarse), coarse.shape)
    assert np.allclose(got, dense(cube, m, coarse.shape, False))
    back = resample.nearest(cells_of(spark, got), coarse, source)
    assert np.allclose(cube_of(back, source.shape), dense(got, np.linalg.inv(m), source.shape, False))


def test_ways_of_coarsening(spark):
    cube = np.random.default_rng(2).normal(size=(5, 4, 6))
    grid, cells = resample.Grid(cube.shape, STRAIGHT), cells_of(spark, cube)
    found, halved = resample.for_clustering(cells, grid, "2x")
    assert halved.shape == (3, 2, 3) and np.allclose(cube_of(found, halved.shape)[0, 0, 0], cube[:2, :2, :2].mean())
    assert resample.for_clustering(cells, grid, "") == (cells, grid)
    with pytest.warns(UserWarning, match="isn't known"):
        assert resample.for_clustering(cells, grid, "x2")[1] == grid
    keyed = cells.withColumn("frame", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("activity", F.col("activity") * F.col("frame"))
    found, coarse = resample.for_clustering(keyed, grid, "2mm", keys=["frame"])
    one = cube_of(found.where("frame = 1"), coarse.shape)
    assert np.allclose(cube_of(found.where("frame = 2"), coarse.shape), 2 * one) and np.abs(one).sum() > 0
    odd = spark.createDataFrame([(0, 0, 0, None), (None, 0, 0, 1.0)], "x int, y int, z int, activity double")
    assert resample.resampled(odd, grid, grid).collect() == [(0, 0, 0, 0.0)]
    assert resample.resampled(cells.limit(0), grid, grid).count() == 0


def test_masks_are_clipped_and_brought_to_the_data(spark):
    cube = np.random.default_rng(3).random((8, 8, 10)) < 0.4
    grid = resample.Grid(cube.shape, STRAIGHT)
    mask = cells_of(spark, cube.astype(float)).where("activity > 0").drop("activity")
    clipped = grid.clipped(2)
    coarse = resample.halved(clipped)
    assert resample.clip_of(grid, clipped) == 2 == resample.clip_of(grid, coarse) and resample.clip_of(grid, grid) == 0
    inside = lambda found, shape: cube_of(found.withColumn("activity", F.lit(1.0)), shape) > 0
    assert (inside(resample.mask_on(mask, grid, grid), grid.shape) == cube).all()
    assert (inside(resample.mask_on(mask, grid, clipped), clipped.shape) == cube[:, :, 2:]).all()
    assert (inside(resample.mask_on(mask, grid, coarse), coarse.shape) == cube[::2, ::2, 2::2]).all()
    atlas = resample.atlas_on(cells_of(spark, cube[::2, ::2, 2::2].astype(float)), coarse, clipped, 2)
    whole = cube_of(atlas, grid.shape)
    assert not whole[:, :, :2].any() and (whole[::2, ::2, 2::2] > 0).tolist() == cube[::2, ::2, 2::2].tolist()


def plain_blobs(places, gap):
    label = list(range(len(places)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(places)), 2):
            if label[i] != label[j] and max(abs(a - b) for a, b in zip(places[i], places[j])) <= gap:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


@pytest.mark.parametrize("gap", [1, 2])
@pytest.mark.parametrize("tile", [3, 5, 32])
def test_blobs_by_tiles(spark, gap, tile):
    rng = np.random.default_rng(gap * 100 + tile)
    rows, want = [], {}
    for key in ("a", "b"):
        places = [tuple(int(c) for c in p) for p in np.unique(rng.integers(0, 11, (90, 3)), axis=0)]
        snake = [(0, 0, i) for i in range(12, 24)] + [(0, i, 24) for i in range(0, 12)]
        places = list(rng.permutation(places + snake).tolist()) + [places[0]]  # one place twice
        for i, label in enumerate(plain_blobs(places, gap)):
            rows.append((key, i + 10, *map(int, places[i]), "rest"))
            want[key, i + 10] = label + 10
    rows.append((None, 5, 0, 0, 0, "rest"))
    cells = spark.createDataFrame(rows, "key string, vox_id long, x int, y int, z int, blob_of string")
    for df in (cells, cells.drop("blob_of")):
        found = lattice.blobs(df, ["key"], gap, tile)
        assert found.columns[-1] == "blob" and {(r["key"], r["vox_id"]): r["blob"] for r in found.collect()} == want
    assert lattice.blobs(cells.limit(0), ["key"]).count() == 0


def test_confetti_in_both_directions(spark):
    slices = [("a", z, n, 20) for z, n in ((0, 3), (5, 7), (11, 10))]
    bounds = {"low": 4, "high": 7, "weak": 3, "strong": 2, "floor": 1}
    up = lattice.confetti(spark.createDataFrame(slices, "k string, z int, n int, total int"), ["k"], "total", **{c: F.lit(v) for c, v in bounds.items()})
    down = spark.createDataFrame([(k, 11 - z, n, t) for k, z, n, t in slices], "k string, z int, n int, total int")
    mirrored = lattice.confetti(down, ["k"], "total", **{c: F.lit(11 - v) for c, v in bounds.items()}, direction=-1)
    assert up.first()["score"] == pytest.approx(3 / 20 * 2.5 - 7 / 20 * 5) == pytest.approx(mirrored.first()["score"])
    assert lattice.superior_axis((4, 4, 9), [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 3, -5]]) == (2, 1)
    assert lattice.superior_axis((4, 4, 9), [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, -3, 5]]) == (2, -1)
