"""Mesh and image files: points and surfaces of XML mesh files, voxels of image masks. A file must fit in a task."""

from __future__ import annotations

import base64
import gzip
import re
import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import meshes, voxels
from flowloom.session import cut_lineage
from flowloom.sources.files import decoded

_KINDS = {"Float32": "f4", "Float64": "f8", **{f"{u}Int{8 * n}": f"{k}{n}" for u, k in (("", "i"), ("U", "u")) for n in (1, 2, 4, 8)}}
#: Image data types by their code in the header (fixed values).
_IMAGE_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _unpacked(data: bytes, header: np.dtype, compressed: bool) -> bytes:
    """The bytes of an array that begins at ``data`` with its header of lengths."""
    if not compressed:
        n = int(np.frombuffer(data, header, 1)[0])
        return data[header.itemsize : header.itemsize + n]
    blocks = int(np.frombuffer(data, header, 1)[0])
    sizes = np.frombuffer(data, header, blocks, 3 * header.itemsize).astype(np.int64)
    at, out = (3 + blocks) * header.itemsize, []
    for size in sizes.tolist():
        out.append(zlib.decompress(data[at : at + size]))
        at += size
    return b"".join(out)


def _from_text(text: bytes, header: np.dtype, compressed: bool) -> bytes:
    """The same of base64; a compressed array's header is encoded apart from its blocks."""
    text = b"".join(text.split())
    if not compressed:
        return _unpacked(base64.b64decode(text), header, False)
    chars = lambda n: 4 * -(-n // 3)
    blocks = int(np.frombuffer(base64.b64decode(text[: chars(header.itemsize)])[: header.itemsize], header, 1)[0])
    size = chars((3 + blocks) * header.itemsize)
    return _unpacked(base64.b64decode(text[:size])[: (3 + blocks) * header.itemsize] + base64.b64decode(text[size:]), header, True)


def xml_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of an XML mesh file of one piece, as ``Section/name`` (points: ``Points``), whether text, base64 or appended, compressed by zlib or not."""
    tail = re.search(rb"<AppendedData[^>]*encoding\s*=\s*[\"'](\w+)[\"'][^>]*>\s*_", content)
    root = ElementTree.fromstring(content[: tail.start()] + b"</VTKFile>" if tail else content)
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    header = np.dtype(order + _KINDS[root.get("header_type", "UInt32")])
    compressed = root.get("compressor") is not None
    if compressed and "ZLib" not in root.get("compressor"):
        raise ValueError(f"{root.get('compressor')} is not read")
    pieces = root.findall(".//Piece")
    if len(pieces) != 1:
        raise ValueError(f"a mesh file must have one piece, not {len(pieces)}")
    out = {}
    for section in pieces[0]:
        for array in section.findall("DataArray"):
            kind, form = np.dtype(order + _KINDS[array.get("type")]), array.get("format", "ascii")
            if form == "ascii":
                values = np.array((array.text or "").split(), dtype=kind.newbyteorder("=")).astype(kind)
            elif form == "binary":
                values = np.frombuffer(_from_text((array.text or "").encode(), header, compressed), kind)
            else:
                data = content[tail.end() + int(array.get("offset")) :]
                raw = _unpacked(data, header, compressed) if tail[1] == b"raw" else _from_text(re.match(rb"[A-Za-z0-9+/=\s]*", data)[0], header, compressed)
                values = np.frombuffer(raw, kind)
            width = int(array.get("NumberOfComponents", 1))
            out["Points" if section.tag == "Points" else f"{section.tag}/{array.get('Name')}"] = values.reshape(-1, width) if width > 1 else values
    return out


def read_mesh_points(spark: SparkSession, path: str, pattern: str = "*.vtu") -> DataFrame:
    """path, row, node, x, y, z: the points of XML meshes in the order of their GlobalNodeID, which is that of a solution's rows.

    Without such an array the file's order counts, and nodes from 1.
    """

    def decode(p: str, content: bytes) -> pd.DataFrame:
        arrays = xml_arrays(content)
        xyz = arrays["Points"].astype(float)
        node = arrays.get("PointData/GlobalNodeID", np.arange(1, len(xyz) + 1)).astype(np.int64)
        order = np.argsort(node, kind="stable")
        return pd.DataFrame({"path": p, "row": np.arange(len(xyz), dtype=np.int64), "node": node[order], **{c: xyz[order, i] for i, c in enumerate("xyz")}})

    return decoded(spark, path, pattern, decode, "path string, row long, node long, x double, y double, z double")


def read_surfaces(spark: SparkSession, path: str, pattern: str = "*.vtp") -> DataFrame:
    """path, tri, a_*, b_*, c_*: the polygons of XML surfaces as triangles, each polygon as a fan from its first corner; those of no area are left out."""
    corners = [f"{p}_{x}" for p in "abc" for x in "xyz"]

    def decode(p: str, content: bytes) -> pd.DataFrame:
        arrays = xml_arrays(content)
        xyz, at, ends = arrays["Points"].astype(float), arrays["Polys/connectivity"].astype(np.int64), arrays["Polys/offsets"].astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        fans = np.maximum(ends - begins - 2, 0)
        first = np.repeat(begins, fans)
        k = np.arange(fans.sum()) - np.repeat(np.cumsum(fans) - fans, fans)
        t = xyz[at[np.stack([first, first + k + 1, first + k + 2], 1)]] if len(k) else np.zeros((0, 3, 3))
        t = t[np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) > 0]
        return pd.DataFrame({"path": p, "tri": np.arange(len(t), dtype=np.int32), **{c: t.reshape(-1, 9)[:, i] for i, c in enumerate(corners)}})

    return decoded(spark, path, pattern, decode, "path string, tri int, " + ", ".join(f"{c} double" for c in corners))


def _rotation(b: float, c: float, d: float) -> np.ndarray:
    """The rotation of a unit quaternion, given without its first part, which is at least 0."""
    a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
    if a < 1e-7:  # a half turn: the other parts may need scaling to length 1
        b, c, d = np.array([b, c, d]) / np.sqrt(b * b + c * c + d * d)
        a = 0.0
    return np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])


def image_affine(header: bytes, order: str) -> np.ndarray:
    """The matrix (3 x 4) from a voxel's indices to its place: the header's rows, else its quaternion, else (the format's first method) the voxels' sizes."""
    number = lambda form, at: struct.unpack_from(order + form, header, at)
    sizes = np.array(number("4f", 76))
    by_quaternion, by_rows = number("2h", 252)
    if by_rows > 0:
        return np.array(number("12f", 280)).reshape(3, 4)
    if by_quaternion > 0:
        turn = _rotation(*number("3f", 256)) * sizes[1:] * [1, 1, -1 if sizes[0] < 0 else 1]
        return np.column_stack([turn, number("3f", 268)])
    return np.column_stack([np.diag(sizes[1:]), np.zeros(3)])


def image_values(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A single-file NIfTI image, gzipped or not: its values (scaled as its header says) and its affine. It must have three axes."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:347] != b"n+1":
        raise ValueError("not a single-file NIfTI image")
    dim = struct.unpack(order + "8h", raw[40:56])
    shape = [n for n in dim[1 : dim[0] + 1]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if len(shape) != 3:
        raise ValueError(f"an image of shape {shape} has not three axes")
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in _IMAGE_KINDS:
        raise ValueError(f"image values of type {code} are not read")
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    values = np.frombuffer(raw, order + _IMAGE_KINDS[code], count=int(np.prod(shape)), offset=int(offset)).reshape(shape, order="F")
    scaled = values * slope + inter if slope not in (0.0, 1.0) or (slope and inter) else values
    return scaled, image_affine(raw[:348], order)


def read_masks(spark: SparkSession, path: str, pattern: str = "*.nii*", labels: list[float] | None = None) -> DataFrame:
    """path, i, j, k, value, x, y, z, affine: the voxels of image masks, placed by the image's affine (twelve numbers, row by row).

    Those whose value is above 0 or, with ``labels``, near one of these (to 1e-8 and a hundred-thousandth of it). An image
    without such voxels gives no row.
    """

    def decode(p: str, content: bytes) -> pd.DataFrame:
        values, affine = image_values(content)
        near = values > 0 if labels is None else np.any([np.isclose(values, x) for x in labels], axis=0) if labels else np.zeros(values.shape, bool)
        at = np.argwhere(near)
        place = at @ affine[:, :3].T + affine[:, 3]
        return pd.DataFrame({"path": p, **{c: at[:, n].astype(np.int32) for n, c in enumerate("ijk")}, "value": values[tuple(at.T)].astype(float), **{c: place[:, n] for n, c in enumerate("xyz")}, "affine": [affine.ravel().tolist()] * len(at)})

    return decoded(spark, path, pattern, decode, "path string, i int, j int, k int, value double, x double, y double, z double, affine array<double>")


def read_cells(spark: SparkSession, path: str, pattern: str = "*.vtu") -> DataFrame:
    """path, cell, type, nodes: the cells of XML volume meshes, nodes as numbers of points in the file's order from 0."""

    def decode(p: str, content: bytes) -> pd.DataFrame:
        arrays = xml_arrays(content)
        at, ends = arrays["Cells/connectivity"].astype(np.int64), arrays["Cells/offsets"].astype(np.int64)
        return pd.DataFrame({"path": p, "cell": np.arange(len(ends), dtype=np.int64), "type": arrays["Cells/types"].astype(np.int32), "nodes": [x.tolist() for x in np.split(at, ends[:-1])] if len(ends) else []})

    return decoded(spark, path, pattern, decode, "path string, cell long, type int, nodes array<long>")


def mask_surfaces(spark: SparkSession, path: str, pattern: str = "*.nii*", labels: list[float] | None = None, min_voxels: int = 0, min_fraction: float = 0.0, rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of image masks, by path: components that are large enough, closed surfaces around them, placed by the affine, smoothed ``rounds`` times.

    Where an affine mirrors space, faces are turned, so normals point outwards there too.
    """
    read = cut_lineage(read_masks(spark, path, pattern, labels).select(F.col("path").alias("mesh_id"), "i", "j", "k", "affine"))
    kept = voxels.kept_components(voxels.labelled(read, "mesh_id"), min_voxels, min_fraction, "mesh_id")
    found = cut_lineage(voxels.surface(kept, "mesh_id"))
    placed = read.groupBy("mesh_id").agg(F.first("affine").alias("affine"))
    m = lambda r, c: F.get("affine", F.lit(4 * r + c))
    minor = lambda r, s: m(1, r) * m(2, s) - m(1, s) * m(2, r)
    mirrors = m(0, 0) * minor(1, 2) - m(0, 1) * minor(0, 2) + m(0, 2) * minor(0, 1) < 0
    turned = found.join(placed.select("mesh_id", mirrors.alias("turn")), "mesh_id")
    faces = turned.select("mesh_id", "tri", "a", F.when(F.col("turn"), F.col("c")).otherwise(F.col("b")).alias("b"), F.when(F.col("turn"), F.col("b")).otherwise(F.col("c")).alias("c"))
    vertices = voxels.to_world(voxels.surface_vertices(found, "mesh_id").join(placed, "mesh_id"), F.col("affine")).select("mesh_id", "vertex", "x", "y", "z")
    return faces, meshes.smoothed(vertices, faces, rounds) if rounds else vertices
