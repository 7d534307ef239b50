"""File formats, text formats, sinks and the stream, on fixtures written here."""

from __future__ import annotations

import base64
import gzip
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions.vectors import vec
from flowloom.operators import geometry, inference, quality_control
from flowloom.plans.geometry_queries import FACES
from flowloom.sources import files, meshes, sinks, solver_text
from flowloom.streaming.manifests import manifest_stream, status_counts


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["<f2", "<f4", "<f8", ">f8", "<i4"])
def test_npy_round_trip(spark, tmp_path, kind):
    array = (np.arange(12).reshape(4, 3) / 2).astype(kind)
    (tmp_path / "x_0.npy").write_bytes(npy(array))
    (tmp_path / "x_1.npy").write_bytes(npy(np.asfortranarray(array)))
    rows = files.read_npy(spark, f"file://{tmp_path}").orderBy("path", "row").collect()
    assert [list(r["values"]) for r in rows] == array.astype(float).tolist() * 2


def test_object_arrays_are_refused():
    with pytest.raises(ValueError):
        files.npy_array(npy(np.array([{}], dtype=object)))


def test_restart_file(spark, tmp_path):
    block = np.arange(20, dtype="<f8").reshape(5, 4)
    (tmp_path / "restart.5.gz").write_bytes(gzip.compress(b"# head\nsolution  : < 161 > 4 5 0\n" + block.tobytes() + b"\n"))
    (tmp_path / "none.gz").write_bytes(gzip.compress(b"nothing"))
    rows = files.read_restart(spark, f"file://{tmp_path}").orderBy("row").collect()
    assert [(r.p, r.u, r.v, r.w) for r in rows] == [tuple(block[:4, i]) for i in range(4)]


def stl(corners):
    out = b"\0" * 80 + struct.pack("<I", len(corners))
    return out + b"".join(struct.pack("<3f9fH", 0, 0, 0, *(x for p in t for x in p), 0) for t in corners)


def test_stl_cube_is_watertight_after_merging(spark, tmp_path):
    at = lambda v: (v & 1, v >> 1 & 1, v >> 2 & 1)
    (tmp_path / "cube.stl").write_bytes(stl([[at(v) for v in f] for f in FACES]))
    t = files.read_stl(spark, f"file://{tmp_path}").withColumn("mesh_id", F.lit("cube"))
    vertices, faces = files.indexed_mesh(t)
    assert vertices.count() == 8
    top, size = quality_control.topology(faces).first(), quality_control.measures(t).first()
    assert top.is_watertight and top.euler_number == 2 and abs(size.volume - 1) < 1e-6 and abs(size.surface_area - 6) < 1e-6


def test_listing_and_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.txt").write_text("1 2.5\n bad line x\n3\t4\n5 y\n")
    (tmp_path / "a" / "names.txt").write_text(" x \n\nx\ny\n")
    assert {(r.name, r.parent) for r in files.listing(spark, f"file://{tmp_path}", "*.txt").collect()} == {("t.txt", "a"), ("names.txt", "a")}
    assert sorted((r.p, r.q) for r in files.read_table(spark, f"file://{tmp_path}/a/t.txt", ["p", "q"]).collect()) == [(1.0, 2.5), (3.0, 4.0)]
    assert sorted(r.name for r in files.read_lines(spark, f"file://{tmp_path}/a/names.txt").collect()) == ["x", "y"]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a", "n": 1}\nnot json\n{"path": "b"}\n')
    (tmp_path / "m.csv").write_text("case_id,split\n007,train\n")
    assert {(r.path, r.n) for r in files.read_manifest_json(spark, f"file://{tmp_path}/m.jsonl", "path string, n int").collect()} == {("a", 1), ("b", None)}
    assert files.read_manifest_csv(spark, f"file://{tmp_path}/m.csv").first().case_id == "007"


def test_solver_settings(spark, tmp_path):
    (tmp_path / "solver.inp").write_text("Density: 1.1 g\nviscosity : x\nTime Step Size: 0.01\nno colon\ndensity: 1.2\n")
    (tmp_path / "empty.inp").write_text("\n")
    rows = {r.file.rsplit("/", 1)[1]: r for r in solver_text.solver_settings(solver_text.numbered_lines(spark, f"file://{tmp_path}/*.inp")).collect()}
    assert (rows["solver.inp"].density, rows["solver.inp"].viscosity, rows["solver.inp"].time_step_size) == (1.2, 0.04, 0.01)
    assert rows["empty.inp"].density == 1.06


def test_inflow_summary(spark):
    curve = spark.createDataFrame([("f", -2.0), ("f", 4.0)], "file string, flow double")
    r = solver_text.inflow_summary(curve).first()
    assert (r.flow_mean_abs, r.flow_peak_abs, r.flow_std_abs, r.flow_n) == (3.0, 4.0, 3.0, 2) and abs(r.flow_rms_abs - 10**0.5) < 1e-12


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2\n2\n10\n0.5\n20\n0 1\n1 1\n1\n5\n0.1\n7\n0 0\n", (2, 21.0, 0.3)),
        ("1\n2\n10\n0.5\n20\n0 1\n", (0, 0.0, 0.0)),  # the curve is cut off
        ("1\n1\n-10\n0.5\n20\n0 1\n", (0, 0.0, 0.0)),  # a negative value
        ("", (0, 0.0, 0.0)),
    ],
)
def test_resistance_blocks(spark, text, want):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line int, value string")
    r = solver_text.resistance_blocks(lines).first()
    assert (r.rcr_count, r.rcr_resistance_mean) == want[:2] and abs(r.rcr_capacitance_mean - want[2]) < 1e-12


def test_conditions(spark):
    row = dict(family_norm=0.5, flow_mean_abs=0.0, flow_rms_abs=0.0, flow_peak_abs=0.0, flow_pulsatility=9.0, viscosity=0.04, density=1.06, rcr_count=2, rcr_resistance_mean=0.0, rcr_capacitance_mean=0.0, scale=0.0, restart_step=-3)
    c = solver_text.territory_condition(spark.createDataFrame([tuple(row.values())], list(row))).first().cond
    assert len(c) == 12 and c[4] == 1.0 and c[7] == 0.2 and c[9] == 1.0 and c[11] == 0.0
    inlet = dict(m_value=0.002, inlet_mean=0.4, inlet_max=0.9, inlet_flow=0.0, case_id="x", n_points=0, scale=1.0)
    d = solver_text.inlet_condition(spark.createDataFrame([tuple(inlet.values())], list(inlet))).first().cond
    assert len(d) == 12 and d[2] == 0.5 and d[6] == 0.0 and d[11] == 1.0
    short = spark.createDataFrame([([3.0, 0.3, 0.0035],)], "c array<double>").select(solver_text.widened_condition(F.col("c")).alias("c")).first().c
    assert len(short) == 12 and short[1] == 0.3 and short[-1] == -1.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "key string, dataset string, v double")
    sinks.write_samples(rows, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    for _ in range(2):
        sinks.append_manifest(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 4
    qc = spark.createDataFrame([("a", "warn", "r")], "key string, status string, reasons string")
    assert {(r.key, r.qc_status) for r in sinks.with_qc(rows, qc, "key").collect()} == {("a", "warn"), ("b", None)}
    sinks.write_qc(qc, f"file://{tmp_path}/qc")
    assert spark.read.json(f"file://{tmp_path}/qc/qc_manifest_json").count() == 1


def test_only_stale_work_is_done_again(spark):
    done = spark.createDataFrame([("a", "20", 0.05), ("b", "19", 0.05), ("c", "20", 0.06), ("d", "20", 0.05 + 1e-10)], "key string, found_walks string, found_sigma double")
    reason = sinks.stale_reason({"walks": F.lit(20), "sigma": F.lit(0.05)})
    assert {(r.key, r.why) for r in done.withColumn("why", reason).collect()} == {("a", None), ("b", "walks"), ("c", "sigma"), ("d", None)}
    work = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    assert {r.key for r in sinks.still_to_do(work, done, "key", reason).collect()} == {"b", "c", "e"}


def test_stream_counts_a_manifest_once(spark, tmp_path):
    rows = [{"path": p, "dataset": "d", "status": "pass", "at": "2024-01-01T00:00:00Z"} for p in ("a", "a", "b")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text("\n".join(map(json.dumps, rows)))
    s = status_counts(manifest_stream(spark, f"file://{tmp_path}/in", "path string, dataset string, status string, at timestamp"), "at")
    q = s.writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) from counts").first()[0] == 2


def test_encoder_takes_flat_and_stepwise_trajectories():
    w = inference.seeded_weights(inference.trajectory_shapes(), 5)
    t = np.random.default_rng(0).normal(size=(5, 9))
    assert np.allclose(inference.encode_trajectory(w, t), inference.encode_trajectory(w, t.reshape(5, 3, 3)), atol=1e-12)
    with pytest.raises(ValueError):
        inference.encode_trajectory(w, t[:, :8])


def test_nearest_points_of_a_cylinder(spark):
    """A finely meshed tube against the exact wall distance."""
    n, half = 48, 2.0
    ring = [(np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n)) for k in range(n + 1)]
    tris = []
    for k in range(n):
        a, b = ring[k], ring[k + 1]
        tris += [((-half, *a), (half, *a), (half, *b)), ((-half, *a), (half, *b), (-half, *b))]
    t = spark.createDataFrame([("m", i, *(float(x) for p in tri for x in p)) for i, tri in enumerate(tris)], "mesh_id string, tri int, " + ", ".join(f"{p}_{x} double" for p in "abc" for x in "xyz"))
    rng = np.random.default_rng(1)
    pts = [("m", i, float(x), float(r * np.cos(f)), float(r * np.sin(f))) for i, (x, r, f) in enumerate(zip(rng.uniform(-1, 1, 60), rng.uniform(0.2, 0.95, 60), rng.uniform(0, 6.28, 60), strict=True))]
    p = spark.createDataFrame(pts, "mesh_id string, point_id int, x double, y double, z double")
    got = geometry.closest_points(geometry.cylinder_wall(p), t, ["mesh_id", "point_id"]).select("dist", "wall_dist", (vec("dir_").dot(vec("n"))).alias("c")).collect()
    assert all(abs(r.dist - r.wall_dist) < 0.005 and r.c > 0.95 for r in got)


def test_text_stl_with_two_solids(spark, tmp_path):
    facet = "facet normal 0 0 1\n outer loop\n  vertex 0 0 {z}\n  vertex 1e0 0 {z}\n  vertex 0 1 {z}\n endloop\nendfacet\n"
    (tmp_path / "a.stl").write_text("solid one\n" + facet.format(z=0) + "endsolid one\nsolid two\n" + facet.format(z=2.5) * 2 + "endsolid two\n")
    (tmp_path / "none.stl").write_text("solid empty\nendsolid empty\n")
    rows = files.read_stl(spark, str(tmp_path)).orderBy("tri").collect()
    assert [(r.tri, r.b_x, r.c_y, r.a_z) for r in rows] == [(0, 1.0, 1.0, 0.0), (1, 1.0, 1.0, 2.5), (2, 1.0, 1.0, 2.5)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.stl").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="neither"):
        files.read_stl(spark, str(tmp_path / "bad")).collect()


XYZ = np.arange(15, dtype="<f8").reshape(5, 3) / 2
NODES = np.array([30, 10, 50, 20, 40], dtype="<i4")


def packed(array, compressed):
    raw = array.tobytes()
    if not compressed:
        return struct.pack("<I", len(raw)), raw
    half = -(-len(raw) // 2)
    blocks = [zlib.compress(raw[:half]), zlib.compress(raw[half:])]
    return struct.pack("<5I", 2, half, len(raw) - half, *map(len, blocks)), b"".join(blocks)


def mesh_file(form, compressed=False):
    """A mesh of five points, as text, base64 or appended."""
    if form == "ascii":
        body = lambda a: ("", " ".join(map(str, a.ravel())))
    elif form == "binary":
        def body(a):
            head, data = packed(a, compressed)
            return "", (base64.b64encode(head) + base64.b64encode(data) if compressed else base64.b64encode(head + data)).decode()
    else:
        blob = []

        def body(a):
            at = sum(map(len, blob))
            blob.append(b"".join(packed(a, compressed)))
            return f' offset="{at}"', ""

    array = lambda a, kind, name, width: '<DataArray type="{}" Name="{}" NumberOfComponents="{}" format="{}"{}>{}</DataArray>'.format(kind, name, width, form, *body(a))
    text = f'<?xml version="1.0"?><VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt32"{" compressor=" + chr(34) + "vtkZLibDataCompressor" + chr(34) if compressed else ""}><UnstructuredGrid><Piece NumberOfPoints="5"><PointData>{array(NODES, "Int32", "GlobalNodeID", 1)}</PointData><Points>{array(XYZ, "Float64", "Points", 3)}</Points></Piece></UnstructuredGrid>'
    if form == "appended":
        return text.encode() + b'<AppendedData encoding="raw">_' + b"".join(blob) + b"</AppendedData></VTKFile>"
    return text.encode() + b"</VTKFile>"


@pytest.mark.parametrize(("form", "compressed"), [("ascii", False), ("binary", False), ("binary", True), ("appended", False), ("appended", True)])
def test_mesh_points_come_in_the_order_of_their_nodes(spark, tmp_path, form, compressed):
    (tmp_path / "m.vtu").write_bytes(mesh_file(form, compressed))
    rows = meshes.read_mesh_points(spark, f"file://{tmp_path}").orderBy("row").collect()
    order = np.argsort(NODES)
    assert [r.node for r in rows] == NODES[order].tolist() and [[r.x, r.y, r.z] for r in rows] == XYZ[order].tolist()


def test_surfaces_become_triangles(spark, tmp_path):
    square = '<VTKFile type="PolyData"><PolyData><Piece><Points><DataArray type="Float32" NumberOfComponents="3" format="ascii">0 0 0 1 0 0 1 1 0 0 1 0 2 0 0</DataArray></Points><Polys><DataArray type="Int64" Name="connectivity" format="ascii">0 1 2 3 0 1 4 1 2 4</DataArray><DataArray type="Int64" Name="offsets" format="ascii">4 7 10</DataArray></Polys></Piece></PolyData></VTKFile>'
    (tmp_path / "w.vtp").write_text(square)
    rows = meshes.read_surfaces(spark, f"file://{tmp_path}").orderBy("tri").collect()
    assert [(r.a_x, r.b_x, r.b_y, r.c_x, r.c_y) for r in rows] == [(0, 1, 0, 1, 1), (0, 1, 1, 0, 1), (1, 1, 1, 2, 0)]


def image(values, order="<", dims=3, slope=0.0):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, dims, *values.shape, *[2 if dims > 3 else 1] * (7 - values.ndim))
    struct.pack_into(order + "h", head, 70, 4)
    struct.pack_into(order + "4f", head, 76, 1, 0.5, 1, 2)
    struct.pack_into(order + "3f", head, 108, 352, slope, 0)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(order + "i2").tobytes(order="F")


def test_masks_give_their_voxels(spark, tmp_path):
    values = np.zeros((3, 4, 5), dtype=np.int16)
    values[1, 2, 3], values[2, 0, 4], values[0, 0, 0] = 7, 1, -3
    (tmp_path / "a.nii").write_bytes(image(values))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(image(values, ">", slope=2.0)))
    rows = sorted(tuple(r)[1:-1] for r in meshes.read_masks(spark, f"file://{tmp_path}").collect())
    assert rows == sorted([(1, 2, 3, v * s, 0.5, 2.0, 6.0) if v == 7 else (2, 0, 4, v * s, 1.0, 0.0, 8.0) for v in (7, 1) for s in (1.0, 2.0)])
    with pytest.raises(ValueError, match="three axes"):
        meshes.image_values(image(values, dims=4))
