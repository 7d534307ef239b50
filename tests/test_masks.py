"""Masks to surfaces: labels, closed surfaces, affines, orientation, smoothing and merging against NumPy and geometry."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from flowloom.operators import meshes, quality_control, voxels
from flowloom.sources import meshes as sources


def cloud(spark, masks):
    return spark.createDataFrame([(m, *map(int, p)) for m, at in masks.items() for p in at], "mask string, i int, j int, k int")


def ball(radius, middle):
    n = 2 * middle + 1
    at = np.argwhere(np.ones((n, n, n), bool))
    return at[((at - middle) ** 2).sum(axis=1) <= radius**2]


def test_components_cross_bricks_by_corners_too(spark):
    snake = [(i, i, i) for i in range(40)] + [(39, 39, 39 - i) for i in range(20)]
    masks = {"snake": sorted(set(snake)), "two": [(0, 0, 0), (0, 0, 1), (0, 0, 3)], "touch": [(31, 31, 31), (32, 32, 32), (31, 33, 31)]}
    got = voxels.labelled(cloud(spark, masks)).collect()
    of = lambda m: {(r.i, r.j, r.k): r.label for r in got if r["mask"] == m}
    assert len(set(of("snake").values())) == 1 and len(of("snake")) == len(masks["snake"])
    assert of("two") == {(0, 0, 0): 0, (0, 0, 1): 0, (0, 0, 3): 3}
    least = 31 << 42 | 31 << 21 | 31
    assert of("touch") == {(31, 31, 31): least, (32, 32, 32): least, (31, 33, 31): least}
    assert voxels.labelled(cloud(spark, {})).count() == 0


def test_a_balls_surface_is_closed_and_holds_its_volume(spark):
    masks = {"ball": ball(9, 11), "one": [(0, 0, 0)], "shell": [p for p in ball(9, 11) if ((p - 11) ** 2).sum() > 25]}
    faces = voxels.surface(cloud(spark, masks), brick=8).cache()
    told = {r["mask"]: r for r in quality_control.topology(faces, "mask").collect()}
    assert all(r.boundary_edges == 0 and r.nonmanifold_edges == 0 for r in told.values())
    assert told["ball"].euler_number == 2 and told["one"].euler_number == 2 and told["shell"].euler_number == 4
    at = voxels.surface_vertices(faces)
    volume = {r["mask"]: r.volume for r in meshes.volumes(faces, at, ["mask"]).collect()}
    assert abs(volume["ball"] / (4 / 3 * np.pi * 9**3) - 1) < 0.03
    inner = sum(((p - 11) ** 2).sum() <= 25 for p in ball(9, 11))
    assert abs(volume["shell"] / (len(masks["ball"]) - inner) - 1) < 0.03
    way = faces.join(at.withColumnRenamed("vertex", "a"), ["mask", "a"]).where("mask = 'one'").count()
    assert way == told["one"].n_faces


def test_turned_faces_are_turned_back(spark):
    faces = voxels.surface(cloud(spark, {"a": ball(3, 4), "b": ball(2, 4)}), brick=4).withColumnRenamed("mask", "mesh_id").cache()
    mixed = faces.selectExpr("mesh_id", "tri", "a", "if(a % 3 = 0, c, b) as b", "if(a % 3 = 0, b, c) as c")
    assert mixed.where("a % 3 = 0").count() > 20
    at = voxels.surface_vertices(faces, "mesh_id")
    back = meshes.turned_outwards(meshes.oriented(mixed), at)
    assert back.where("not orientable").count() == 0
    assert back.select("mesh_id", "tri", "a", "b", "c").exceptAll(faces.select("mesh_id", "tri", "a", "b", "c")).count() == 0


@pytest.mark.parametrize("keep", [False, True])
def test_smoothing_equals_numpy(spark, keep):
    faces = voxels.surface(cloud(spark, {"m": ball(3, 4)}), brick=4).withColumnRenamed("mask", "mesh_id").cache()
    at = voxels.surface_vertices(faces, "mesh_id").cache()
    names = sorted(r.vertex for r in at.collect())
    place = {v: n for n, v in enumerate(names)}
    x = np.zeros((len(names), 3))
    for r in at.collect():
        x[place[r.vertex]] = (r.x, r.y, r.z)
    tri = np.array([[place[v] for v in (r.a, r.b, r.c)] for r in faces.collect()])
    near = np.zeros((len(names), len(names)))
    for a, b in ((0, 1), (1, 2), (2, 0)):
        near[tri[:, a], tri[:, b]] = near[tri[:, b], tri[:, a]] = 1
    near /= near.sum(axis=1, keepdims=True)
    volume = lambda x: np.einsum("ij,ij->i", x[tri[:, 0]], np.cross(x[tri[:, 1]], x[tri[:, 2]])).sum() / 6
    first = volume(x)
    for _ in range(10):
        x = x + 0.5 * (near @ x - x)
        if keep:
            x = x * np.cbrt(first / volume(x))
    got = meshes.smoothed(at.select("mesh_id", "vertex", "x", "y", "z"), faces, 10, keep_volume=keep).collect()
    assert len(got) == len(names)
    assert np.allclose([(r.x, r.y, r.z) for r in sorted(got, key=lambda r: r.vertex)], x, atol=1e-9)


def image(values, rows=None, quaternion=None, sizes=(1.0, 1.0, 1.0), sign=1.0):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *values.shape, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 2)
    struct.pack_into("<4f", head, 76, sign, *sizes)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, int(quaternion is not None), int(rows is not None))
    if quaternion is not None:
        struct.pack_into("<6f", head, 256, *quaternion)
    if rows is not None:
        struct.pack_into("<12f", head, 280, *np.ravel(rows))
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(values, np.uint8).tobytes(order="F")


def test_places_follow_the_images_affine(spark, tmp_path):
    values = np.zeros((3, 4, 5))
    values[1, 0, 0], values[0, 2, 3] = 2, 5
    (tmp_path / "rows.nii").write_bytes(image(values, rows=[[-1, 0, 0, 90], [0, -1, 0, 126], [0, 0, 1, -72]], quaternion=(0, 0, 0, 7, 7, 7)))
    half = float(np.sqrt(0.5))  # a quarter turn about the third axis, of voxels of 2 x 3 x 4, third axis turned
    (tmp_path / "turn.nii").write_bytes(image(values, quaternion=(0, 0, half, 10, 20, 30), sizes=(2.0, 3.0, 4.0), sign=-1.0))
    (tmp_path / "plain.nii").write_bytes(image(values, sizes=(2.0, 3.0, 4.0)))
    got = {(r.path.rsplit("/", 1)[-1], int(r.value)): np.round((r.x, r.y, r.z), 5).tolist() for r in sources.read_masks(spark, f"file://{tmp_path}").collect()}
    assert got["rows.nii", 2] == [89, 126, -72] and got["rows.nii", 5] == [90, 124, -69]
    assert got["turn.nii", 2] == [10, 22, 30] and got["turn.nii", 5] == [10 - 6, 20, 30 - 12]
    assert got["plain.nii", 2] == [2, 0, 0] and got["plain.nii", 5] == [0, 6, 12]
    assert [int(r.value) for r in sources.read_masks(spark, f"file://{tmp_path}", "rows.nii", labels=[5.0, 9.0]).collect()] == [5]


def test_a_mirrored_images_surface_points_outwards(spark, tmp_path):
    values = np.zeros((9, 9, 9))
    values[tuple(ball(3, 4).T)] = 1
    values[0, 0, 0] = 1
    for name, first in (("mirror", -2), ("plain", 2)):
        (tmp_path / f"{name}.nii").write_bytes(image(values, rows=[[first, 0, 0, 5], [0, 1, 0, 0], [0, 0, 1, 0]]))
    faces, at = sources.mask_surfaces(spark, f"file://{tmp_path}", min_voxels=5, rounds=2)
    told = {r.mesh_id.rsplit("/", 1)[-1]: r for r in quality_control.topology(faces).join(meshes.volumes(faces, at, ["mesh_id"]), "mesh_id").collect()}
    assert set(told) == {"mirror.nii", "plain.nii"}
    assert all(r.is_watertight and r.euler_number == 2 and 0.8 < r.volume / (2 * len(ball(3, 4))) < 1.2 for r in told.values())


def test_walls_of_cells_of_every_type(spark):
    at = {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 0), 3: (0, 1, 0), 4: (0, 0, 1), 5: (1, 0, 1), 6: (1, 1, 1), 7: (0, 1, 1), 8: (0.5, 0.5, 2)}
    cells = [("hex", 12, [*range(8)]), ("hex", 14, [4, 5, 6, 7, 8]), ("wedges", 13, [0, 3, 1, 4, 7, 5]), ("wedges", 13, [1, 3, 2, 5, 7, 6]), ("tet", 10, [0, 1, 3, 4]), ("line", 3, [0, 1])]
    wall = meshes.wall_of_cells(spark.createDataFrame(cells, "mesh_id string, type int, nodes array<long>")).cache()
    spots = spark.createDataFrame([(m, v, *map(float, p)) for m in ("hex", "wedges", "tet") for v, p in at.items()], "mesh_id string, vertex long, x double, y double, z double")
    volume = {r.mesh_id: round(r.volume, 9) for r in meshes.volumes(wall, spots, ["mesh_id"]).collect()}
    assert volume == {"hex": round(1 + 1 / 3, 9), "wedges": 1.0, "tet": round(1 / 6, 9)}
    told = {r.mesh_id: r for r in quality_control.topology(wall).collect()}
    assert all(r.is_watertight and r.euler_number == 2 for r in told.values()) and told["hex"].n_faces == 10 + 4


def test_points_merge_over_cells_of_the_grid(spark):
    rng = np.random.default_rng(4)
    spots = rng.uniform(0, 3, (40, 3))
    rows = [("m", 100 * n + k, *map(float, p + rng.uniform(-0.004, 0.004, 3))) for n, p in enumerate(spots) for k in range(5)] + [("m", 9000 + n, 10 + 0.009 * n, 0.0, 0.0) for n in range(30)] + [("k", 1, 0.0, 0.0, 0.0), ("k", 2, 0.0, 0.0, 0.0), ("k", 3, 0.02, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "mesh_id string, vertex long, x double, y double, z double")
    got = {(r.mesh_id, r.vertex): r.into for r in meshes.merged_points(df, 0.01).collect()}
    at = {(m, v): np.array(p) for m, v, *p in rows}
    want = {}
    for key in at:  # grown from each point, by brute force
        seen, todo = {key}, [key]
        while todo:
            here = todo.pop()
            for other in at:
                if other not in seen and other[0] == key[0] and np.linalg.norm(at[other] - at[here]) <= 0.01:
                    seen.add(other)
                    todo.append(other)
        want[key] = min(v for _, v in seen)
    assert got == want
    assert {(r.mesh_id, r.vertex): r.into for r in meshes.merged_points(df.where("mesh_id = 'k'"), 0.0).collect()} == {("k", 1): 1, ("k", 2): 1, ("k", 3): 3}
