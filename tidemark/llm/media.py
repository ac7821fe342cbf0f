"""Media columns in archives, written by tasks and read by a custom Spark data source.

Payloads are stored losslessly as 8-bit greyscale PNG images in ZIP archives (members stored as they are) under one
folder. Each writing task fills archives of about `archive_mb`; an archive gets its final name, made of partition and
number, only when it is whole, so a repeated task replaces its own archives and half-written ones are never listed.

The data source plans byte ranges over the archives: a partition owns the members whose local header starts in its range.
It yields payload batches through Arrow, and reads each member by itself at its offset: a failed or damaged read is tried
again for that member alone, with a file opened anew; after `retries` tries the member's row has an error in place of its
payload. Folders are opened with pyarrow's file systems, so that any store they know will do.

Defined results: null or empty text is one block of padding; repeated rows and null ids are members of their own; other
columns are ignored; empty input writes no archive and reads as no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.shared import work_dir

WIDTH, PAD = 576, 255
PNG = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes, block: int = WIDTH) -> bytes:
    """The bytes with bytes 255 up to a positive multiple of block."""
    return raw + bytes([PAD]) * (-len(raw) % block if raw else block)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """The payload as an 8-bit greyscale image; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(plain, level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an image that encode_png made, as rows. Damage raises ValueError."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, width = 8, b"", 0
    while at < len(media):
        size, kind = struct.unpack(">I", media[at : at + 4])[0], media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """A 64-bit average hash: the mean 24 x 24 tile in 8 x 8 blocks, each against the mean of all."""
    tile = samples.reshape(-1, 24, 24).mean(0).reshape(8, 3, 8, 3).mean((1, 3))
    return np.packbits((tile > tile.mean()).ravel()).tobytes().hex()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_mb: int = 32) -> None:
    """Writes each text's payload as a member named by its id and its unpadded size."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        number, member, archive, out, temp = 0, 0, None, None, ""

        def close() -> None:
            nonlocal archive, number
            archive.close()
            out.close()
            fs.move(temp, f"{base}/part-{task.partitionId():06d}-{number:04d}.zip")
            archive, number = None, number + 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    temp = f"{base}/_{task.partitionId()}-{number}-{task.taskAttemptId()}"
                    out = fs.open_output_stream(temp)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                raw = (text or "").encode("utf-8")
                name = f"{'null' if doc_id is None else doc_id}/{len(raw)}/{member}.png"
                archive.writestr(zipfile.ZipInfo(name), encode_png(pad(raw)))
                member += 1
                if out.tell() > archive_mb << 20:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([member], pa.int64())], names=["members"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows.mapInArrow(write, "members long").agg(F.sum("members")).collect()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_mb", "8")) << 20
        self.retries = int(options.get("retries", "3"))

    def partitions(self) -> list[Range]:
        fs, base = _open(self.folder)
        files = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        whole = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name.endswith(".zip") and not f.base_name.startswith("_"))
        found = [Range(path, a, min(a + self.range_bytes, size)) for path, size in whole for a in range(0, size, self.range_bytes)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows: list[tuple] = []
        held = 0
        source = fs.open_input_file(partition.path)
        for m in members:
            media, error = None, None
            for tried in range(self.retries):
                try:
                    if source.closed:
                        source = fs.open_input_file(partition.path)
                    media, error = self.member(source, m), None
                    break
                except (OSError, ValueError, struct.error) as e:  # this member alone is read again
                    error = f"offset {m.header_offset}: {e}"
                    source.close()
            name, size, _ = m.filename.split("/")
            rows.append((None if name == "null" else int(name), int(size), m.header_offset, media, error))
            held += len(media or b"")
            if held > 4 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        source.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def member(source: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
        """A stored member's bytes by its offset, checked by its checksum."""
        source.seek(m.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member starts here")
        source.seek(m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        media = source.read(m.compress_size)
        if len(media) != m.compress_size or zlib.crc32(media) != m.CRC:
            raise ValueError("damaged member")
        return media

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc_id", "n_bytes", "member_offset", "media", "error"])


class ArchiveSource(DataSource):
    """Reads a folder of archives. Options: path, range_mb, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, member_offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, range_mb: int = 8, retries: int = 3) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("range_mb", range_mb).option("retries", retries).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests and features of the stored bytes; a member that couldn't be read fails the job."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for media, error in zip(batch.column("media").to_pylist(), batch.column("error").to_pylist()):
                if media is None:
                    raise OSError(error)
                samples = decode_png(media)
                payload = samples.tobytes()
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as media in the shared folder, and returns the features read back from there."""
    folder = work_dir(docs.sparkSession, "media")
    write_archives(docs, folder, id_col, text_col)
    return media_features(read_archives(docs.sparkSession, folder))
