"""Polyline shapefiles: read by a data source that splits them by their indexes, and written a file a slice, through pyarrow's file systems.

A shapefile is a header of 100 bytes and records of a number, a length and a shape; its attributes are in a dBase file of the
same name. Reading stops at the first record that makes no sense and keeps what came before, as the study's reader does.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siteward.catalog import query
from siteward.operators.network import SEGMENTS, segments
from siteward.operators.relations import R_MERCATOR
from siteward.session import materialize, scratch_root

# Fixed values of the formats.
MAGIC, VERSION, NULL_SHAPE, POLYLINE = 9994, 1000, 0, 3
HEADER, DBF_FIELD = 100, 32
MERCATOR = 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere"]'
DEGREES = 'GEOGCS["GCS_WGS_1984"]'
#: Web Mercator ends here; what lies beyond is kept in degrees.
MERCATOR_LAT = 85.0

#: Bytes that a reader asks a file for at a time.
BLOCK = 1 << 20


def shape_bytes(lines: list[list[list[tuple[float, float]]]]) -> bytes:
    """A polyline shapefile of features, each a list of parts; a feature without parts is a null shape."""
    records, box = [], [0.0, 0.0, 0.0, 0.0]
    points = [p for parts in lines for part in parts for p in part]
    if points:
        box = [min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)]
    for k, parts in enumerate(lines, 1):
        flat = [p for part in parts for p in part]
        if flat:
            starts = [sum(len(q) for q in parts[:j]) for j in range(len(parts))]
            own = (min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat))
            body = struct.pack("<i4dii", POLYLINE, *own, len(parts), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        else:
            body = struct.pack("<i", NULL_SHAPE)
        records.append(struct.pack(">2i", k, len(body) // 2) + body)
    body = b"".join(records)
    return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, (HEADER + len(body)) // 2) + struct.pack("<2i8d", VERSION, POLYLINE, *box, 0.0, 0.0, 0.0, 0.0) + body


def index_bytes(shapes: bytes) -> bytes:
    """The index of a shapefile: where each record is and how long, in words of two bytes."""
    entries, pos = [], HEADER
    while pos + 8 <= len(shapes):
        words = struct.unpack(">i", shapes[pos + 4 : pos + 8])[0]
        entries.append(struct.pack(">2i", pos // 2, words))
        pos += 8 + 2 * words
    return shapes[:24] + struct.pack(">i", (HEADER + 8 * len(entries)) // 2) + shapes[28:HEADER] + b"".join(entries)


def shape_of(body: bytes) -> list[list[tuple[float, float]]] | None:
    """A record's parts; None if it is of another kind or makes no sense."""
    kind = struct.unpack("<i", body[:4])[0]
    if kind == NULL_SHAPE:
        return []
    if kind != POLYLINE or len(body) < 44:
        return None
    parts, n = struct.unpack("<2i", body[36:44])
    if parts < 0 or n < 0 or 44 + 4 * parts + 16 * n > len(body):
        return None
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
    flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
    points = list(zip(flat[::2], flat[1::2]))
    return [points[a:b] for a, b in zip(starts, starts[1:])]


def records_of(file, pos: int, end: int, size: int) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The parts of the records from a place of an open shapefile of `size` bytes up to another, read as they are asked for; None,
    and no more, at the first that is cut off or makes no sense. An error if no record ends at `end`, but for the file's end."""
    file.seek(pos)
    held = b""

    def take(n: int) -> bytes:
        nonlocal held
        while len(held) < n and (more := file.read(max(BLOCK, n - len(held)))):
            held += more
        out, held = held[:n], held[n:]
        return out

    while pos < end and pos + 12 <= size:
        words = struct.unpack(">i", take(8)[4:])[0]
        shape = None
        if 4 <= 2 * words <= size - pos - 8:
            shape = shape_of(take(2 * words))
        yield shape
        if shape is None:
            return
        pos += 8 + 2 * words
    if pos != end and end < size:
        raise ValueError(f"the index names byte {end}, where no record begins")


def shapes_of(content: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """The features' parts, up to the first record that is cut off or of another kind."""
    if len(content) >= HEADER and struct.unpack(">i", content[:4])[0] == MAGIC:
        yield from (s for s in records_of(io.BytesIO(content), HEADER, len(content), len(content)) if s is not None)


def table_bytes(fields: list[tuple[str, int]], rows: list[list[str]]) -> bytes:
    """A dBase table of text fields (name, width)."""
    width = 1 + sum(w for _, w in fields)
    head = struct.pack("<4BIHH20x", 3, 26, 1, 1, len(rows), 33 + DBF_FIELD * len(fields), width)
    head += b"".join(struct.pack("<11sc4xB15x", name.encode()[:10], b"C", w) for name, w in fields) + b"\r"
    return head + b"".join(b" " + b"".join(v.encode("utf-8")[:w].ljust(w) for v, (_, w) in zip(row, fields)) for row in rows) + b"\x1a"


def layout_of(file) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Rows, bytes of the head and of a row, and fields (name, width) of an open dBase table; no rows where the head is cut off."""
    start = file.read(32)
    if len(start) < 32:
        return 0, 0, 0, []
    n, head, width = struct.unpack("<IHH", start[4:12])
    rest, fields, pos = file.read(max(0, head - 32)), [], 0
    while pos + DBF_FIELD <= len(rest) and rest[pos : pos + 1] != b"\r":
        fields.append((rest[pos : pos + 11].split(b"\0")[0].decode(), rest[pos + 16]))
        pos += DBF_FIELD
    return n, head, width, fields


def rows_from(file, first: int = 0) -> Iterator[dict[str, str | None]]:
    """An open dBase table's rows from one on, as trimmed texts, blanks as None, read as they are asked for; rows marked as deleted
    are kept, as they count for the shapes."""
    n, head, width, fields = layout_of(file)
    if not width:
        return
    file.seek(head + first * width)
    k, some = first, max(1, BLOCK // width)
    while k < n:
        block = file.read(min(some, n - k) * width)
        if len(block) < width:
            return
        for i in range(len(block) // width):
            row, out, at = block[i * width : (i + 1) * width], {}, 1
            for name, w in fields:
                out[name] = row[at : at + w].decode("utf-8", "replace").strip() or None
                at += w
            yield out
        k += len(block) // width


def rows_of(content: bytes) -> Iterator[dict[str, str | None]]:
    """The rows of a dBase table in memory."""
    return rows_from(io.BytesIO(content))


def folder_of(path: str):
    """pyarrow's file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_shapefiles(df: DataFrame, path: str, fields: dict[str, int], rows: int = 20_000, projection: str = MERCATOR) -> None:
    """df (seq, parts, others) as shapefiles of the features of `rows` consecutive seq each, with projection files beside them.
    fields: {column: width} of the attributes."""

    def put(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("seq")
        system, root = folder_of(path)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{int(batch['seq'].iloc[0]):012d}"
        lines = [[[(p["x"], p["y"]) for p in part] for part in (parts if parts is not None else ())] for parts in batch["parts"]]
        texts = [["" if v is None or v != v else str(v) for v in row] for row in batch[list(fields)].itertuples(index=False)]
        shapes = shape_bytes(lines)
        for end, content in (("shp", shapes), ("shx", index_bytes(shapes)), ("dbf", table_bytes(list(fields.items()), texts)), ("prj", projection.encode())):
            with system.open_output_stream(f"{name}.{end}") as out:
                out.write(content)
        return pd.DataFrame({"n": [len(batch)]})

    shaped = df.select("seq", F.col("parts"), *(F.col(c).cast("string").alias(c) for c in fields), F.floor(F.col("seq") / rows).alias("_file"))
    # pandas has no arrays of arrays of structs: parts travel as text.
    shaped = shaped.withColumn("parts", F.to_json("parts"))

    def decode(batch: pd.DataFrame) -> pd.DataFrame:
        batch["parts"] = [json.loads(p) if p else [] for p in batch["parts"]]
        return put(batch)

    shaped.groupBy("_file").applyInPandas(decode, "n long").write.format("noop").mode("overwrite").save()


@dataclass
class Split(InputPartition):
    """Records of a shapefile, the last one not included; None: all that follow."""

    base: str
    first: int
    last: int | None


class ShapeReader(DataSourceReader):
    """Splits files by their indexes, so that a task seeks its first record and holds one batch of features."""

    def __init__(self, options: dict):
        self.path, self.fields = options["path"], json.loads(options["fields"])
        self.records, self.faults = int(options["records"]), options["faults"] == "true"

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, root = folder_of(self.path)
        found = {i.path: i.size for i in system.get_file_info(fs.FileSelector(root)) if i.is_file}
        out = []
        for base in sorted(p[:-4] for p in found if p.endswith(".shp")):
            n = max(0, (found.get(f"{base}.shx", 0) - HEADER) // 8)
            firsts = list(range(0, n, self.records)) or [0]
            out += [Split(base, k, after) for k, after in zip(firsts, [*firsts[1:], None])]
        return out or [Split("", 0, None)]

    def read(self, split: Split) -> Iterator:
        import pyarrow as pa

        if not split.base:
            return
        system, _ = folder_of(self.path)
        there = lambda end: system.get_file_info(f"{split.base}.{end}").is_file
        name = split.base.rsplit("/", 1)[-1]
        with ExitStack() as files:
            open_ = lambda end: files.enter_context(system.open_input_file(f"{split.base}.{end}"))
            shp = open_("shp")
            size = shp.size()
            if size < HEADER or struct.unpack(">i", shp.read(4))[0] != MAGIC:
                return
            places = {0: HEADER, None: size}
            for k in {split.first, split.last} - set(places):
                index = open_("shx")
                index.seek(HEADER + 8 * k)
                places[k] = 2 * struct.unpack(">i", index.read(4))[0]
            shapes = enumerate(records_of(shp, places[split.first], places[split.last], size), split.first)
            if self.faults:
                bad = [k for k, shape in shapes if shape is None]
                if bad:
                    yield pa.RecordBatch.from_pylist([{"file": name, "number": bad[0]}], schema=pa.schema([("file", pa.string()), ("number", pa.int64())]))
                return
            mercator = there("prj") and b"Mercator" in open_("prj").read()
            rows = rows_from(open_("dbf"), split.first) if there("dbf") else iter(())
            points = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("points", points), *((f, pa.string()) for f in self.fields), ("mercator", pa.bool_())])
            held, n = [], 0
            for k, shape in shapes:
                if shape is None:
                    break
                row = next(rows, {})
                held.append({"file": name, "number": k, "points": [[{"x": x, "y": y} for x, y in part] for part in shape], "mercator": mercator} | {f: row.get(f) for f in self.fields})
                n += sum(map(len, shape))
                if len(held) == 5_000 or n > 50_000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)


class ShapeSource(DataSource):
    """Options: path (a folder), fields (a list as JSON), records (of a split), faults ("true": only the first bad record of each
    split)."""

    @classmethod
    def name(cls) -> str:
        return "siteward_shapes"

    def schema(self) -> str:
        if self.options["faults"] == "true":
            return "file string, number long"
        fields = "".join(f", `{f}` string" for f in json.loads(self.options["fields"]))
        return f"file string, number long, points array<array<struct<x:double,y:double>>>{fields}, mercator boolean"

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options)


def read_shapefiles(spark: SparkSession, path: str, fields: list[str], records: int = 50_000) -> DataFrame:
    """file, number, parts (array of arrays of lon, lat), and the fields as texts, of all shapefiles in a folder. Coordinates are
    brought to degrees where the projection file names Web Mercator. A task reads `records` records of a file with an index, or all
    of one without. What follows a file's first bad record is left out, whichever task it is in: a pass over the shapes alone looks
    for these first."""
    spark.dataSource.register(ShapeSource)
    load = lambda faults: spark.read.format(ShapeSource.name()).options(path=path, fields=json.dumps(fields), records=str(records), faults=faults).load()
    raw = load("false")
    bad = materialize(load("true").groupBy("file").agg(F.min("number").alias("bad")), "bad-shapes")
    if not bad.isEmpty():
        raw = raw.join(bad, "file", "left").where("bad IS NULL OR number < bad")
    degrees = lambda p: F.struct(F.when(F.col("mercator"), F.degrees(p["x"] / R_MERCATOR)).otherwise(p["x"]).alias("lon"), F.when(F.col("mercator"), F.degrees(F.atan(F.sinh(p["y"] / R_MERCATOR)))).otherwise(p["y"]).alias("lat"))
    return raw.select("file", "number", F.transform("points", lambda part: F.transform(part, degrees)).alias("parts"), *fields)


def _streets(spark, sf_dir: str) -> DataFrame:
    """The segments as shapefiles in Web Mercator, but for those beyond its latitudes, whose files are in degrees; read again: every
    seventh has two parts, every fortieth none."""
    path = f"{scratch_root(spark)}/siteward-shapes-{uuid.uuid4().hex}"
    meters = lambda p: F.struct((F.radians(p["lon"]) * R_MERCATOR).alias("x"), (F.log(F.tan(F.pi() / 4 + F.radians(p["lat"]) / 2)) * R_MERCATOR).alias("y"))
    inside = F.forall("pts", lambda p: F.abs(p["lat"]) <= MERCATOR_LAT)
    line = F.when(inside, F.transform("pts", meters)).otherwise(F.transform("pts", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    parts = F.when(F.col("seq") % 40 == 5, F.array().cast("array<array<struct<x:double,y:double>>>")).when(F.col("seq") % 7 == 0, F.array(line, F.reverse(line))).otherwise(F.array(line))
    s = segments(spark, sf_dir).select("seq", parts.alias("parts"), F.col("seq").alias("SEQ_ID"), F.when(F.col("seq") % 50 != 7, F.col("f_node")).alias("PDX_F_NODE"), F.col("t_node").alias("PDX_T_NODE"), F.col("name").alias("FULL_NAME"), F.col("type").alias("TYPE"), inside.alias("inside"))
    fields = {"SEQ_ID": 12, "PDX_F_NODE": 12, "PDX_T_NODE": 12, "FULL_NAME": 40, "TYPE": 6}
    for chosen, projection in ((F.col("inside"), MERCATOR), (~F.col("inside"), DEGREES)):
        write_shapefiles(s.where(chosen).drop("inside"), path, fields, projection=projection)
    read = read_shapefiles(spark, path, list(fields))
    return read.select(F.col("SEQ_ID").cast("long").alias("seq"), "parts", F.col("PDX_F_NODE").cast("long").alias("f_node"), F.col("PDX_T_NODE").cast("long").alias("t_node"), F.col("FULL_NAME").alias("name"), F.col("TYPE").cast("long").alias("type"))


@query("src_shapefile", f"WITH {SEGMENTS} SELECT seq, CASE WHEN seq % 40 = 5 THEN 0 WHEN seq % 7 = 0 THEN 2 ELSE 1 END AS parts, name, type, CASE WHEN seq % 40 <> 5 THEN round(pts[1].lon, 8) END AS lon, CASE WHEN seq % 40 <> 5 THEN round(pts[1].lat, 8) END AS lat FROM segments")
def src_shapefile(spark, sf_dir):
    first = F.get(F.get("parts", F.lit(0)), F.lit(0))
    return _streets(spark, sf_dir).select("seq", F.size("parts").alias("parts"), "name", "type", F.round(first["lon"], 8).alias("lon"), F.round(first["lat"], 8).alias("lat"))


@query("src_shapefile_py", f"WITH {SEGMENTS} SELECT seq, f_node, t_node, round(pts[-1].lon, 8) AS lon, round(pts[-1].lat, 8) AS lat FROM segments WHERE seq % 40 <> 5 AND seq % 50 <> 7 AND seq % 7 <> 0")
def src_shapefile_py(spark, sf_dir):
    """Features with points and both node ids, of one part."""
    s = _streets(spark, sf_dir).where("size(parts) = 1 AND f_node IS NOT NULL AND t_node IS NOT NULL")
    last = F.element_at(F.get("parts", F.lit(0)), -1)
    return s.select("seq", "f_node", "t_node", F.round(last["lon"], 8).alias("lon"), F.round(last["lat"], 8).alias("lat"))


@query("src_first_part", f"WITH {SEGMENTS} SELECT seq, len(pts) AS points, round(pts[-1].lon, 8) AS lon FROM segments WHERE seq % 40 <> 5")
def src_first_part(spark, sf_dir):
    """Of a feature with parts only the first counts."""
    part = F.get("parts", F.lit(0))
    return _streets(spark, sf_dir).where("size(parts) > 0").select("seq", F.size(part).cast("long").alias("points"), F.round(F.element_at(part, -1)["lon"], 8).alias("lon"))
