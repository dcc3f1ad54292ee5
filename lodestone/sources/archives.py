"""Archives as tables of members: reading, packing, renaming.

Members are rows (archive, path, bytes).  They are packed as one zip an archive, in
pieces (`zips`), or into volumes, rows of (archive, volume, data) of about VOLUME_BYTES,
each a zip by itself: members are dealt out by ranges of (archive, path) and written
as they come, so a task holds one volume, whatever an archive holds.
"""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import zips

VOLUME_BYTES = 64 << 20
#: Bytes of unpacked members that are handed on at a time.
GIVEN_BYTES = 4 << 20
MEMBERS = "archive {kind}, volume bigint, idx bigint, path string, bytes binary, problem string"
#: The time that packed members carry, so that equal members give equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)


def is_zip(data: str) -> F.Column:
    return F.hex(F.substring(data, 1, 2)) == "504B"


def _safe(name: str) -> str | None:
    """A member's path with forward slashes; null if it leaves the archive."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if name.startswith(("/", "\\")) or ".." in parts or not parts else "/".join(parts)


def _zip_files(data: bytes) -> Iterator[tuple[str, Callable[[], bytes]]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, lambda i=info: z.read(i)


def _tar_files(data: bytes, mode: str) -> Iterator[tuple[str, Callable[[], bytes]]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        for info in t:
            if info.isfile():
                yield info.name, lambda i=info: t.extractfile(i).read()


def _files(kind: str | None, data: bytes) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """(name, reader) of an archive's files; the kind is told by the first bytes if it isn't given."""
    if kind == "zip" or (kind is None and data[:2] == b"PK"):
        return _zip_files(data)
    if kind == "tar.gz" or (kind is None and data[:2] == b"\x1f\x8b"):
        return _tar_files(data, "r|gz")
    if kind == "tar.xz" or (kind is None and data[:6] == b"\xfd7zXZ\0"):
        return _tar_files(data, "r|xz")
    return iter(())


def members(archives: DataFrame, key: str, data: str, contents: bool = True, kind: str | None = None, quarantine: bool = False) -> DataFrame:
    """File members in the order in which they lie: archive, volume, idx (in the volume), path, bytes, problem.

    zip, tar.gz and tar.xz are read; data that is none of them has no members.  A
    column `volume` numbers an archive's volumes; without it there is one.  `kind`
    names a column with the format.  A name that leaves its archive, and an archive
    that breaks off, are errors; with quarantine they give a row with a problem and
    without bytes instead, so that one archive doesn't end a job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "volume", "idx", "path", "bytes", "problem"]
        given = lambda kind, rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], names)
        for batch in batches:
            key_kind = batch.schema.field("archive").type
            for i in range(batch.num_rows):  # one volume at a time, of which there is one copy
                archive, volume, format_ = (batch.column(c)[i].as_py() for c in ("archive", "volume", "kind"))
                rows, size, idx = [], 0, 0
                try:
                    for name, content in _files(format_, batch.column("data")[i].as_py() or b""):
                        path = _safe(name)
                        if path is None and not quarantine:
                            raise ValueError(f"member leaves its archive: {name}")
                        got = content() if contents and path else None
                        rows.append((archive, volume, idx, path or name, got, None if path else "leaves its archive"))
                        idx += 1
                        size += len(got or b"")
                        if size >= GIVEN_BYTES or len(rows) >= 10000:
                            yield given(key_kind, rows)
                            rows, size = [], 0
                except (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError) as e:  # encrypted, an unknown compression, odd headers
                    if not quarantine:
                        raise
                    rows.append((archive, volume, idx, None, None, f"broken archive: {type(e).__name__}"))
                if rows:
                    yield given(key_kind, rows)

    volume = F.col("volume") if "volume" in archives.columns else F.lit(0).cast("long")
    own = archives.select(F.col(key).alias("archive"), volume.alias("volume"), F.col(data).alias("data"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"))
    return own.mapInArrow(read, MEMBERS.format(kind=own.schema["archive"].dataType.simpleString()))


def numbered(rows: DataFrame) -> DataFrame:
    """Members with idx counted over the whole archive instead of the volume; only counts by volume are summed up."""
    counts = rows.groupBy("archive", "volume").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("archive").orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("archive", "volume", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, ["archive", "volume"]).withColumn("idx", F.col("idx") + F.col("_first")).drop("_first")


def packed(rows: DataFrame, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """Archives of members (archive, path, bytes), stored without compression, in the order of their paths: archive, volume, data.

    A volume ends once its members have volume_bytes; volumes of an archive are in
    the order of their numbers, which have gaps.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, out, size = TaskContext.get().partitionId() << 32, None, None, 0

        def given(kind: pa.DataType) -> pa.RecordBatch:
            """The volume as it lies in the buffer, not copied."""
            out.close()
            data = pa.py_buffer(buffer.getbuffer())
            value = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, data.size], pa.int32()).buffers()[1], data])
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([number], pa.int64()), value], ["archive", "volume", "data"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("archive").type
            for i in range(batch.num_rows):
                archive, path, data = (batch.column(c)[i].as_py() for c in ("archive", "path", "bytes"))
                if out is not None and (archive != now or size >= volume_bytes):
                    yield given(kind)
                    number, out, buffer = number + 1, None, None
                if out is None:
                    buffer, now, size = io.BytesIO(), archive, 0
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                out.writestr(zipfile.ZipInfo(path, EPOCH), data)
                size += len(data)
        if out is not None:
            yield given(kind)

    own = rows.filter("archive is not null and path is not null").select("archive", "path", F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    ranged = own.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive", "path").sortWithinPartitions("archive", "path")
    return ranged.mapInArrow(write, f"archive {own.schema['archive'].dataType.simpleString()}, volume bigint, data binary")


def repacked(archives: DataFrame, key: str, data: str) -> DataFrame:
    """Archives read and packed again, one each, as pieces: stored, with plain paths, in their own order; what has a problem is left out."""
    return zips.assembled(members(archives, key, data).filter("problem is null"), order=["volume", "idx"])


def member_by_name(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (archive, name) the first exact member, else, for a name like `.ext`, the first that ends with it.

    Members meet names by equality: of the whole path, and of its ends from each dot.
    """
    parts = F.split("path", r"\.")
    ends = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    exact = rows.select("archive", "path", "idx", F.lit(0).alias("_c"), F.col("path").alias("name"))
    ending = rows.select("archive", "path", "idx", F.lit(1).alias("_c"), F.explode(ends).alias("name"))
    return wanted.distinct().join(exact.union(ending), ["archive", "name"]).groupBy("archive", "name").agg(F.min_by("path", F.struct("_c", "idx")).alias("path"))


def renamed(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Members with regex rules applied to the last part of their path, in order."""
    base, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    for find, replace in rules:
        base = F.regexp_replace(base, find, replace)
    return rows.withColumn("path", F.concat(folder, base))


def captured(files: DataFrame, specs: DataFrame) -> DataFrame:
    """What each output spec (run, output, pattern) captures of a run's files (run, path): how many, and the path if one.

    A pattern is a whole regex; none or several matches are told by n.
    """
    asked = specs.groupBy("run").agg(F.collect_list(F.struct("output", "pattern")).alias("specs"))
    hits = files.join(asked, "run").select("run", "path", F.explode(F.expr("filter(specs, s -> path rlike s.pattern)")).alias("s"))
    found = hits.groupBy("run", F.col("s.output").alias("output")).agg(F.count("*").alias("n"), F.min("path").alias("p"))
    return specs.select("run", "output").join(found, ["run", "output"], "left").select("run", "output", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("p")).alias("path"))


def export_report(rows: DataFrame) -> DataFrame:
    """Files and bytes of each archive."""
    return rows.groupBy("archive").agg(F.count("*").alias("files"), F.sum(F.octet_length("bytes")).alias("bytes"))


def xz_size(data: bytes) -> int:
    """The bytes that the index before the last footer adds up to; 0 if there is none."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    if len(data) < 32 or data[-2:] != b"YZ":
        return 0
    at = len(data) - 12 - 4 * (int.from_bytes(data[-8:-4], "little") + 1)
    if at < 12 or data[at]:
        return 0
    try:
        at += 1
        return sum((number(), number())[1] for _ in range(number()))
    except IndexError:
        return 0


def estimated_sizes(archives: DataFrame, key: str, kind: str, data: str) -> DataFrame:
    """Bytes that archives unpack to, told without unpacking them: archive, bytes.

    zip: the sum of its directory; tar.gz: the size in its trailer, modulo 2**32;
    tar.xz: the sizes in its streams' indexes; 0 for other kinds.  Where that can't
    be read, the archive's own size.
    """

    def size(kind: str | None, own: bytes) -> int:
        if kind == "zip":
            try:
                return sum(i.file_size for i in zipfile.ZipFile(io.BytesIO(own)).infolist())
            except zipfile.BadZipFile:
                return len(own)
        if kind == "tar.xz":
            return xz_size(own) or len(own)
        return (int.from_bytes(own[-4:], "little") or len(own)) if kind == "tar.gz" else 0

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"archive": frame["archive"], "bytes": [size(k, bytes(d or b"")) for k, d in zip(frame["kind"], frame["data"], strict=True)]})

    own = archives.select(F.col(key).alias("archive"), F.col(kind).alias("kind"), F.col(data).alias("data"))
    return own.mapInPandas(told, f"archive {own.schema['archive'].dataType.simpleString()}, bytes bigint")


def ordered_members(rows: DataFrame) -> DataFrame:
    """Members numbered by path."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("archive").orderBy("path")) - 1)


def imported(files: DataFrame, archive: F.Column) -> DataFrame:
    """Files of a folder (path, bytes), as scan_folder gives them, packed as archives."""
    return packed(files.select(archive.alias("archive"), "path", "bytes"))


#: What can be done with members (pack, volumes, rename) or archives (unpack, repack, list), by name.
ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "pack": lambda rows, folders=False: zips.assembled(zips.with_folders(rows) if folders else rows),
    "volumes": packed,
    "unpack": lambda archives: members(archives, "archive", "data"),
    "list": lambda archives: members(archives, "archive", "data", contents=False),
    "repack": lambda archives: repacked(archives, "archive", "data"),
    "rename": renamed,
}


def acted(action: str, rows: DataFrame, **options: object) -> DataFrame:
    """The result of an action on rows; an unknown one is an error that names what there is."""
    if action not in ACTIONS:
        raise ValueError(f"unknown archive action '{action}'; known are {', '.join(sorted(ACTIONS))}")
    return ACTIONS[action](rows, **options)
