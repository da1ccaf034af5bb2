"""Vector files as a data source: GeoJSON and shapefiles, read in parts of files and written by a commit.

`spark.read.format("vectors").option("path", ...)` gives rows (kind, geometry, properties): the kind of a geometry, its parts as arrays
of (x, y), and its attributes as a map of texts. A file is cut into parts of `split` bytes, which tasks read on their own; a
shapefile's records are found by its index. `df.write.format("vectors")` writes what has these columns, one file a task, which
a commit on the driver brings into place. Paths are of a file system that all machines share.
"""

from __future__ import annotations

import glob
import json
import math
import os
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "kind string, geometry array<array<struct<x:double,y:double>>>, properties map<string,string>"
SPLIT = 8 << 20
#: Numbers of kinds in shapefiles. Fixed values of the format.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
#: What begins a feature of a GeoJSON file that has one in each line.
_FEATURE = re.compile(rb'\s*\{.*"type"\s*:\s*"Feature"', re.S)
#: Bytes of an attribute in the table of a shapefile.
TEXT_WIDTH = 254


def _files(path: str, ending: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, f"*{ending}"))) if os.path.isdir(path) else [path]


def _parts_of(kind: str, coordinates: list) -> list[list[dict]]:
    """The coordinates of a GeoJSON geometry as parts of places."""
    place = lambda c: {"x": float(c[0]), "y": float(c[1])}
    if kind == "Point":
        return [[place(coordinates)]]
    if kind in ("LineString", "MultiPoint"):
        return [[place(c) for c in coordinates]]
    if kind in ("Polygon", "MultiLineString"):
        return [[place(c) for c in part] for part in coordinates]
    if kind == "MultiPolygon":
        return [[place(c) for c in ring] for polygon in coordinates for ring in polygon]
    raise ValueError(f"no geometry of kind {kind!r}")


def _coordinates(kind: str, parts: list) -> list:
    rows = [[[p["x"], p["y"]] for p in part] for part in parts]
    if kind == "Point":
        return rows[0][0]
    if kind in ("LineString", "MultiPoint"):
        return rows[0]
    return [rows] if kind == "MultiPolygon" else rows


def _feature(said: dict) -> tuple:
    geometry = said.get("geometry")
    kind = geometry["type"] if geometry else None
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    return kind, _parts_of(kind, geometry["coordinates"]) if geometry else None, {k: text(v) for k, v in (said.get("properties") or {}).items()}


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, way: str):
        super().__init__((path, start, end, way))
        self.path, self.start, self.end, self.way = path, start, end, way


def _geojson_parts(path: str, split: int) -> list[_Part]:
    """Parts of a file of features in lines, each cut at bytes; a file in another layout is one part, as only a parser knows where
    its features begin."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        lines = [f.readline(1 << 20) for _ in range(3)]
    if not any(_FEATURE.match(x) and x.rstrip().rstrip(b",").endswith(b"}") for x in lines):
        return [_Part(path, 0, size, "whole")]
    return [_Part(path, a, min(a + split, size), "lines") for a in range(0, size, split)] or [_Part(path, 0, 0, "lines")]


def _read_geojson(part: _Part) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        if part.way == "whole":
            said = json.loads(f.read())
            for x in said["features"] if said.get("type") == "FeatureCollection" else [said]:
                yield _feature(x)
            return
        f.seek(max(part.start - 1, 0))
        if part.start:
            f.readline()  # a line belongs to the part in which it begins
        while f.tell() < part.end and (line := f.readline()):
            if _FEATURE.match(line):
                yield _feature(json.loads(line.strip().rstrip(b",")))


def _dbf_fields(path: str) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """(bytes of the header, of a record, fields: name, kind, place, width) of a table of attributes."""
    with open(path, "rb") as f:
        head = f.read(32)
        header, record = struct.unpack("<HH", head[8:12])
        fields, at = [], 1
        while (one := f.read(32)) and one[0] != 0x0D:
            fields.append((one[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(one[11]), at, one[16]))
            at += one[16]
    return header, record, fields


def _shape_parts(path: str, split: int) -> list[_Part]:
    """Parts of a shapefile, as ranges of its index: eight bytes of the index stand for a record."""
    index = path[:-4] + ".shx"
    records = (os.path.getsize(index) - 100) // 8
    each = max(1, records * split // max(os.path.getsize(path), 1))
    return [_Part(path, a, min(a + each, records), "shapes") for a in range(0, records, each)]


def _read_shapes(part: _Part) -> Iterator[tuple]:
    table = part.path[:-4] + ".dbf"
    header, width, fields = _dbf_fields(table) if os.path.exists(table) else (0, 0, [])
    with open(part.path[:-4] + ".shx", "rb") as f:
        f.seek(100 + 8 * part.start)
        places = [2 * struct.unpack(">i", (x := f.read(8))[:4])[0] for _ in range(part.start, part.end)]
    attributes = open(table, "rb") if fields else None
    with open(part.path, "rb") as f:
        for number, place in enumerate(places, part.start):
            f.seek(place)
            body = f.read(2 * struct.unpack(">ii", f.read(8))[1])
            code = struct.unpack("<i", body[:4])[0]
            values = {}
            if attributes:
                attributes.seek(header + number * width)
                row = attributes.read(width)
                values = {n: row[a : a + w].decode("utf-8", "replace").strip() or None for n, _, a, w in fields}
            yield *_shape(code, body), values
    if attributes:
        attributes.close()


def _shape(code: int, body: bytes) -> tuple:
    if code == 0:
        return None, None
    if code not in SHAPES:
        raise ValueError(f"no shapes of kind {code}")
    places = lambda at, n: [{"x": x, "y": y} for x, y in struct.iter_unpack("<dd", body[at : at + 16 * n])]
    if code == 1:
        return "Point", [places(4, 1)]
    if code == 8:
        return "MultiPoint", [places(40, struct.unpack("<i", body[36:40])[0])]
    n, total = struct.unpack("<ii", body[36:44])
    starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), total]
    every = places(44 + 4 * n, total)
    kind = SHAPES[code] if n == 1 or code == 5 else "MultiLineString"
    return kind, [every[a:b] for a, b in zip(starts, starts[1:])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path, self.split = options["path"], int(options.get("split", SPLIT))
        self.shapes = options.get("layout", "shp" if path.endswith(".shp") else "geojson") == "shp"
        self.paths = _files(path, ".shp" if self.shapes else ".geojson")

    def partitions(self) -> list[InputPartition]:
        parts = [p for f in self.paths for p in (_shape_parts if self.shapes else _geojson_parts)(f, self.split)]
        return parts or [_Part("", 0, 0, "none")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.way != "none":
            yield from (_read_shapes if partition.way == "shapes" else _read_geojson)(partition)


class _Written(WriterCommitMessage):
    def __init__(self, name: str, files: list[tuple[str, str]]):
        self.name, self.files = name, files


class _Writer(DataSourceWriter):
    """Each task writes a file of its own under a name that readers pass over; the commit gives the files their names, a failed
    write takes them away. So a task that runs twice leaves one file, and nobody reads half of a write."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.shapes, self.overwrite = options.get("layout", "geojson") == "shp", overwrite
        self.run = uuid.uuid4().hex[:8]
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        draft = os.path.join(self.path, f"_{self.run}-{name}")
        endings = _write_shapes(draft, rows) if self.shapes else _write_geojson(draft, rows)
        return _Written(name, [(draft + e, e) for e in endings])

    def commit(self, messages: list) -> None:
        old = [f for e in (".geojson", ".shp", ".shx", ".dbf") for f in glob.glob(os.path.join(self.path, f"*{e}")) if not os.path.basename(f).startswith("_")]
        for i, m in enumerate(m for m in messages if m is not None):
            for draft, ending in m.files:
                os.replace(draft, os.path.join(self.path, f"part-{i:05d}-{m.name}{ending}"))
        if self.overwrite:
            for f in old:
                os.remove(f)
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        """Take away what tasks that were not committed have left."""
        for f in glob.glob(os.path.join(self.path, f"_{self.run}-*")):
            os.remove(f)


def _write_geojson(draft: str, rows: Iterator) -> list[str]:
    with open(draft + ".geojson", "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [\n')
        between = ""
        for r in rows:
            geometry = None if r["geometry"] is None else {"type": r["kind"], "coordinates": _coordinates(r["kind"], r["geometry"])}
            f.write(between + json.dumps({"type": "Feature", "geometry": geometry, "properties": dict(r["properties"] or {})}, ensure_ascii=False))
            between = ",\n"
        f.write("\n]}\n")
    return [".geojson"]


def _record(kind: str | None, parts: list | None) -> tuple[int, bytes, list[float]]:
    """(number of the kind, record, bounds) of a geometry in a shapefile."""
    if parts is None:
        return 0, struct.pack("<i", 0), []
    xs, ys = [p["x"] for part in parts for p in part], [p["y"] for part in parts for p in part]
    code = {v: k for k, v in SHAPES.items()}.get({"MultiLineString": "LineString", "MultiPolygon": "Polygon"}.get(kind, kind))
    if code is None:
        raise ValueError(f"no geometry of kind {kind!r}")
    box = [min(xs), min(ys), max(xs), max(ys)]
    places = b"".join(struct.pack("<dd", x, y) for x, y in zip(xs, ys))
    if code == 1:
        return code, struct.pack("<i", code) + places, box
    if code == 8:
        return code, struct.pack("<i4di", code, *box, len(xs)) + places, box
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return code, struct.pack(f"<i4dii{len(parts)}i", code, *box, len(parts), len(xs), *starts) + places, box


def _write_shapes(draft: str, rows: Iterator) -> list[str]:
    """A shapefile with its index and table of attributes. Its records are of one kind; names of attributes have ten bytes; texts
    longer than a field raise ValueError, as they would be cut."""
    names, records, bounds, code, size = None, 0, [math.inf, math.inf, -math.inf, -math.inf], 0, 100
    with open(draft + ".shp", "wb") as shp, open(draft + ".shx", "wb") as shx, open(draft + ".dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        for r in rows:
            values = dict(r["properties"] or {})
            if names is None:
                names = list(values)
                short = [n.encode()[:10] for n in names]
                if len(set(short)) < len(short):
                    raise ValueError("names of attributes are alike in their first ten bytes")
                dbf.write(b"\0" * (32 + 32 * len(names)) + b"\x0d")
            own, body, box = _record(r["kind"], r["geometry"])
            if own and code and own != code:
                raise ValueError("a shapefile holds geometries of one kind")
            code = code or own
            if box:
                bounds = [min(bounds[0], box[0]), min(bounds[1], box[1]), max(bounds[2], box[2]), max(bounds[3], box[3])]
            shx.write(struct.pack(">ii", size // 2, len(body) // 2))
            shp.write(struct.pack(">ii", records + 1, len(body) // 2) + body)
            size, records = size + 8 + len(body), records + 1
            texts = [("" if values.get(n) is None else str(values[n])).encode() for n in names]
            if any(len(t) > TEXT_WIDTH for t in texts):
                raise ValueError(f"an attribute has more than {TEXT_WIDTH} bytes")
            dbf.write(b" " + b"".join(t.ljust(TEXT_WIDTH) for t in texts))
        names = names or []
        if not records:
            dbf.write(b"\0" * 32 + b"\x0d")
        dbf.write(b"\x1a")
        bounds = bounds if records and code else [0.0] * 4
        for f, n in ((shp, size), (shx, 100 + 8 * records)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", 1000, code, *bounds, 0.0, 0.0, 0.0, 0.0))
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH20x", 3, 95, 7, 26, records, 33 + 32 * len(names), 1 + TEXT_WIDTH * len(names)))
        for n in names:
            dbf.write(n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([TEXT_WIDTH, 0]) + b"\0" * 14)
    return [".shp", ".shx", ".dbf"]


class Vectors(DataSource):
    """The data source; options: path, layout (geojson or shp), split (bytes of a part)."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(kind, geometry, properties) of the vector file, or of all files of the folder, at a path."""
    spark.dataSource.register(Vectors)
    return spark.read.format("vectors").options(path=path, **options).load()


def write(rows: DataFrame, path: str, layout: str = "geojson", mode: str = "overwrite") -> None:
    """Write rows (kind, geometry, properties) as files of a layout into the folder at a path."""
    rows.sparkSession.dataSource.register(Vectors)
    rows.select("kind", "geometry", "properties").write.format("vectors").options(path=path, layout=layout).mode(mode).save()
