"""A Spark data source of image scans: NIfTI-1 and Analyze files as voxel rows, planned from headers, and a writer of scans.

Reading: partitions are slabs of one frame, cut by bytes from what the files' headers say, so a large image is never in one
task. The frames to read are options (first, last), which leave the other frames' bytes unread: Spark 4.1 keeps the filters
that a Python source has taken for all later uses of the same load, so filters aren't taken. Writing: each task writes its frames under a folder of its
own attempt; the driver only moves finished files into place, and none of a failed job's is ever seen.

    spark.dataSource.register(nifti.ImageScan)
    spark.read.format("imagescan").option("late", 40).load("/data/scan*.nii")
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of one slab of decoded values, about: a partition.
SLAB_BYTES = 16 << 20
#: A header's size, the place of the voxels in a single file, and the file format's codes of number types.
HEADER, VOXELS = 348, 352
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
SCHEMA = "path string, frame int, x int, y int, z int, activity double, use string"
_IMAGE = re.compile(r"\.(nii|img)(\.gz)?$")
_PART = re.compile(r"[._-](\d+)(?=[._-])")


@dataclass(frozen=True)
class Header:
    """What a file's header says; affine has three rows of four."""

    shape: tuple[int, int, int, int]
    kind: str
    start: int
    slope: float
    inter: float
    affine: tuple[tuple[float, ...], ...]


def parse_header(raw: bytes, detached: bool = False) -> Header:
    """A NIfTI-1 or Analyze header of either byte order. Files that give no affine have one of their voxel sizes."""
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == HEADER else ">"
    if struct.unpack_from(order + "i", raw, 0)[0] != HEADER:
        raise ValueError("neither a NIfTI-1 nor an Analyze header")
    dims = struct.unpack_from(order + "8h", raw, 40)
    shape = tuple([*dims[1 : dims[0] + 1], 1, 1, 1, 1][:4])
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in KINDS:
        raise ValueError(f"number type {code} isn't read")
    sizes = struct.unpack_from(order + "8f", raw, 76)
    is_nifti = raw[344:347] in (b"n+1", b"ni1")
    at, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    affine = np.zeros((3, 4))
    affine[:, :3] = np.diag([s or 1.0 for s in sizes[1:4]])
    qform, sform = struct.unpack_from(order + "2h", raw, 252) if is_nifti else (0, 0)
    if sform > 0:
        affine = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *offset = struct.unpack_from(order + "6f", raw, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.c_[turn * np.array([sizes[1], sizes[2], sizes[3] * (-1 if sizes[0] < 0 else 1)]), offset]
    start = 0 if detached else max(int(at), VOXELS)
    # An Analyze file has no intercept; a slope of 0 means that values are as they stand.
    return Header(shape, order + KINDS[code], start, slope or 1.0, inter if is_nifti and slope else 0.0, tuple(tuple(map(float, row)) for row in affine))


def build_header(shape: tuple[int, ...], affine: tuple[tuple[float, ...], ...]) -> bytes:
    """A NIfTI-1 header of little-endian doubles in millimetres and seconds."""
    head = bytearray(VOXELS)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", head, 70, 64, 64)
    sizes = np.sqrt((np.array(affine, float)[:, :3] ** 2).sum(0))
    struct.pack_into("<8f", head, 76, 1.0, *sizes, 1.0, 0.0, 0.0, 0.0)
    struct.pack_into("<3f", head, 108, float(VOXELS), 1.0, 0.0)
    head[123] = 2 | 8  # millimetres, seconds
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *[v for row in affine for v in row])
    head[344:348] = b"n+1\0"
    return bytes(head)


def _files(pattern: str) -> list[str]:
    """Image files of a folder or a pattern in its last part, in the order of the numbers in their names, then by name."""
    system, path = fs.FileSystem.from_uri(pattern) if "://" in pattern or pattern.startswith("file:") else (fs.LocalFileSystem(), pattern)
    folder, name = path.rsplit("/", 1)
    if not any(c in name for c in "*?["):
        if system.get_file_info(path).type == fs.FileType.File:
            return [path]
        folder, name = path, "*"
    found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch(f.base_name, name)]
    images = [f for f in found if _IMAGE.search(f) and not f.rsplit("/", 1)[1].startswith((".", "_"))]

    def order(path: str) -> tuple[float, str]:
        numbers = _PART.findall("." + _IMAGE.sub(".", path.rsplit("/", 1)[1]))
        return (int(numbers[-1]) if numbers else float("inf")), path

    return sorted(images, key=order)


def _open(path: str, system: fs.FileSystem):
    return gzip.GzipFile(fileobj=system.open_input_stream(path, compression=None)) if path.endswith(".gz") else system.open_input_file(path)


def _header(path: str, system: fs.FileSystem) -> Header:
    detached = re.search(r"\.img(\.gz)?$", path)
    beside = re.sub(r"\.img(\.gz)?$", lambda m: ".hdr" + (m[1] or ""), path) if detached else path
    if detached and system.get_file_info(beside).type != fs.FileType.File:
        beside = beside.removesuffix(".gz")
    with _open(beside, system) as file:
        return parse_header(file.read(VOXELS), bool(detached))


@dataclass
class Slab(InputPartition):
    """Slices low to high - 1 of one frame of a file (volume counts from 0 within it)."""

    path: str
    frame: int
    volume: int
    low: int
    high: int
    use: str
    header: Header


class ScanReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options["path"]
        self.late, self.slab = int(options.get("late", 0)), int(options.get("slabbytes", SLAB_BYTES))
        self.ignored = {int(v) for v in options.get("ignored", "").split(",") if v.strip()}
        self.first, self.last = int(options.get("first", 1)), int(options.get("last", 0))

    def partitions(self) -> list[InputPartition]:
        """Slabs of the frames from first to last. A 4-D file gives its own frames; several files stand one after the other."""
        system = fs.FileSystem.from_uri(self.pattern)[0] if "://" in self.pattern or self.pattern.startswith("file:") else fs.LocalFileSystem()
        files = _files(self.pattern)
        if not files:
            raise FileNotFoundError(f"no image at {self.pattern}")
        out, frame = [], 0
        for path in files:
            header = _header(path, system)
            nx, ny, nz, frames = header.shape
            # A compressed file can't be read from the middle, so a frame of it is one slab.
            rows = nz if path.endswith(".gz") else max(1, min(nz, self.slab // max(1, nx * ny * 8)))
            # Of several files, one with frames of its own counts by its last frame.
            volumes = range(frames) if len(files) == 1 else [frames - 1]
            for volume in volumes:
                frame += 1
                if frame < self.first or 0 < self.last < frame:
                    continue
                use = "ignored" if frame in self.ignored else "late" if 0 < self.late < frame else "used"
                out += [Slab(path, frame, volume, low, min(low + rows, nz), use, header) for low in range(0, nz, rows)]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        header = partition.header
        nx, ny, nz, _ = header.shape
        kind = np.dtype(header.kind)
        skip = header.start + (partition.volume * nz + partition.low) * nx * ny * kind.itemsize
        count = (partition.high - partition.low) * nx * ny
        system = fs.FileSystem.from_uri(self.pattern)[0] if "://" in self.pattern or self.pattern.startswith("file:") else fs.LocalFileSystem()
        with _open(partition.path, system) as file:
            file.seek(skip)
            raw = file.read(count * kind.itemsize)
        if len(raw) < count * kind.itemsize:
            raise ValueError(f"{partition.path} ends before its frame {partition.volume + 1} does")
        values = np.frombuffer(raw, kind).astype(np.float64) * header.slope + header.inter
        at = np.arange(count, dtype=np.int64)
        x, y, z = at % nx, at // nx % ny, at // (nx * ny) + partition.low
        for a in range(0, count, 1 << 16):
            part = slice(a, a + (1 << 16))
            n = len(values[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array(np.full(n, partition.frame, np.int32)), *[pa.array(c[part].astype(np.int32)) for c in (x, y, z)], pa.array(values[part]), pa.array([partition.use] * n)],
                ["path", "frame", "x", "y", "z", "activity", "use"],
            )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ScanWriter(DataSourceArrowWriter):
    """Rows (frame, x, y, z, activity), a frame whole in one task and after the one before, as frame_NNNNN.nii of the given grid."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].removeprefix("file:").rstrip("/"), overwrite
        self.shape, self.affine = tuple(json.loads(options["shape"])), tuple(map(tuple, json.loads(options["affine"])))
        self.attempt = f"{self.path}/_attempt-{uuid.uuid4().hex}"
        self.at = [schema.fieldNames().index(c) for c in ("frame", "x", "y", "z", "activity")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.LocalFileSystem(), f"{self.attempt}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        out, now, cube = [], None, None

        def close() -> None:
            if now is not None:
                with system.open_output_stream(f"{folder}/frame_{now:05d}.nii") as file:
                    file.write(build_header(self.shape, self.affine))
                    file.write(cube.astype("<f8").tobytes(order="F"))
                out.append(f"{folder}/frame_{now:05d}.nii")

        for batch in iterator:
            frame, x, y, z, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in self.at)
            edges = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                if frame[a] != now:
                    close()
                    now, cube = int(frame[a]), np.zeros(self.shape)
                cube[x[a:b], y[a:b], z[a:b]] = value[a:b]
        close()
        return Written(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system = fs.LocalFileSystem()
        new = {f.rsplit("/", 1)[1]: f for m in messages if m for f in m.files}
        for name, file in new.items():
            system.move(file, f"{self.path}/{name}")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(self.path)):
                if old.type == fs.FileType.File and old.base_name.startswith("frame_") and old.base_name not in new:
                    system.delete_file(old.path)
        system.delete_dir(self.attempt)
        with system.open_output_stream(f"{self.path}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if fs.LocalFileSystem().get_file_info(self.attempt).type == fs.FileType.Directory:
            fs.LocalFileSystem().delete_dir(self.attempt)


class ImageScan(DataSource):
    """Format imagescan. Options: path (a file, a folder, or a pattern in the last part of a path), first and last (of the frames that
    are read; 0 for all), late (the last frame that is used; 0 for all), ignored (frames, by commas), slabbytes. Column use
    is used, late or ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "imagescan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ScanReader:
        return ScanReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ScanWriter:
        return ScanWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(ImageScan)


def headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, nx, ny, nz, frames, affine: three rows of four as one array) of the files at pattern; only their headers are read."""
    system = fs.FileSystem.from_uri(pattern)[0] if "://" in pattern or pattern.startswith("file:") else fs.LocalFileSystem()
    found = [(path, h) for path in _files(pattern) for h in [_header(path, system)]]
    return spark.createDataFrame([(path, *h.shape, [v for row in h.affine for v in row]) for path, h in found], "path string, nx int, ny int, nz int, frames int, affine array<double>")


def majority_affine(found: DataFrame) -> DataFrame:
    """(affine, files): the affine that most files have, of equals the one whose first file comes first; affines may differ between files."""
    return found.groupBy("affine").agg(F.count("*").alias("files"), F.min("path").alias("first")).orderBy(F.desc("files"), "first").limit(1).select("affine", "files")


def write_scan(voxels: DataFrame, path: str, shape: tuple[int, int, int], affine: list[float], overwrite: bool = True) -> None:
    """voxels (frame, x, y, z, activity) as a folder of one NIfTI-1 file a frame, all with the same affine (12 numbers).

    Voxels without a row are 0. A frame is put together in one task: an image of one time, whose size a scanner bounds.
    """
    register(voxels.sparkSession)
    fs.LocalFileSystem().create_dir(path.removeprefix("file:"))
    rows = [list(map(float, affine[i : i + 4])) for i in (0, 4, 8)]
    dealt = voxels.select(F.col("frame").cast("int").alias("frame"), *[F.col(c).cast("int").alias(c) for c in "xyz"], F.col("activity").cast("double").alias("activity")).repartition("frame").sortWithinPartitions("frame")
    dealt.write.format("imagescan").mode("overwrite" if overwrite else "append").option("shape", json.dumps(list(shape))).option("affine", json.dumps(rows)).save(path)


def read_scan(spark: SparkSession, path: str, first: int = 1, last: int = 0, late: int = 0, ignored: tuple[int, ...] = ()) -> DataFrame:
    """(path, frame, x, y, z, activity, use) of a scan: a 4-D file, or a folder or pattern of numbered files."""
    register(spark)
    return spark.read.format("imagescan").option("first", first).option("last", last).option("late", late).option("ignored", ",".join(map(str, ignored))).load(path)
