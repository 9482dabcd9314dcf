"""ZIP archives of any size: files are packed in parallel, places are prefix sums, and the directory comes last.

An archive is the concatenation of its parts: a local entry for each file, a directory record for each, and an end. Where an
entry begins is the sum of the bytes before it (a scan over parts of an archive, so that one archive may hold most files),
and the directory needs no more than that. So nothing holds an archive: not a row, a task's memory or the driver; writing
one streams its parts into a file, which appears under its name when it is whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.operators.lineage import cut
from docforge.operators.scan import Running, scan
from docforge.sources.sinks import unique_names

# The format's signatures, versions, flags (names are UTF-8), method (deflate), date (1980) and limits.
LOCAL, ENTRY, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION, VERSION64, UTF8, DEFLATE, DATE = 20, 45, 0x800, 8, 33
MOST16, MOST32 = 0xFFFF, 0xFFFFFFFF
#: About how many packed bytes a worker holds.
HELD = 64 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, name, place, content: the local entry, bytes, crc, packed, size) of (archive, name, place, content)."""
    for batch in batches:
        made, first = [], 0
        for row in range(batch.num_rows):
            name, content = batch.column(1)[row].as_py().encode(), batch.column(3)[row].as_py() or b""
            deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
            data = deflate.compress(content) + deflate.flush()
            crc = zlib.crc32(content)
            entry = struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, 0, DATE, crc, len(data), len(content), len(name), 0) + name + data
            made.append((entry, len(entry), crc, len(data), len(content)))
            if row + 1 == batch.num_rows or sum(m[1] for m in made[-64:]) > HELD // 64 or len(made) == 4096:
                columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), *[pa.int64()] * 4))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(made)) for c in batch.columns[:3]), *columns], ["archive", "name", "place", "content", "bytes", "crc", "packed", "size"])
                made, first = [], row + 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, section 1, n, content) of (archive, n, name, at, crc, packed, size): directory records."""
    for batch in batches:
        made = []
        for _, _, name, at, crc, packed, size in zip(*(c.to_pylist() for c in batch.columns)):
            raw, far = name.encode(), at >= MOST32
            extra = struct.pack("<HHQ", 1, 8, at) if far else b""
            version = VERSION64 if far else VERSION
            made.append(struct.pack("<IHHHHHHIIIHHHHHII", ENTRY, version, version, UTF8, DEFLATE, 0, DATE, crc, packed, size, len(raw), len(extra), 0, 0, 0, 0, MOST32 if far else at) + raw + extra)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(made), pa.int32()), batch.column(1), pa.array(made, pa.binary())], ["archive", "section", "n", "content"])


def end_of(files: int, at: int, size: int) -> bytes:
    """The end of an archive of so many files whose directory begins at a place and has a size."""
    out = b""
    if files >= MOST16 or at >= MOST32 or size >= MOST32:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, files, files, size, at) + struct.pack("<IIQI", LOCATOR, 0, at + size, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(files, MOST16), min(files, MOST16), min(size, MOST32), min(at, MOST32), 0)


def archive_parts(files: DataFrame, archive: str = "archive", name: str = "name", content: str = "content", order: str = "order") -> DataFrame:
    """(archive, section, n, content): the parts of each archive; in the order of section and n they are its file. Equal
    names are told apart (unique_names); a null content is an empty file."""
    kind = files.schema[archive].dataType.simpleString(), files.schema[order].dataType.simpleString()
    named = unique_names(files.select(F.col(archive).alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), F.col(order).alias("place")), "name", "place", ["archive"])
    packed = named.select("archive", F.col("archive_name").alias("name"), "place", "content").mapInArrow(_packed, f"archive {kind[0]}, name string, place {kind[1]}, content binary, bytes bigint, crc bigint, packed bigint, size bigint")
    placed = cut(scan(packed, ["archive"], ["place", "name"], {"at": Running(F.col("bytes"), "sum", before=True), "n": Running(F.lit(1).cast("bigint"))}).withColumn("at", F.coalesce("at", F.lit(0))))
    schema = f"archive {kind[0]}, section int, n bigint, content binary"
    entries = cut(placed.select("archive", "n", "name", "at", "crc", "packed", "size").mapInArrow(_entries, schema))
    sums = placed.groupBy("archive").agg(F.count("*").alias("files"), F.sum("bytes").alias("at")).join(entries.groupBy("archive").agg(F.sum(F.octet_length("content")).cast("bigint").alias("size")), "archive")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [end_of(*x) for x in zip(*(b.column(c).to_pylist() for c in range(1, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([2] * len(made), pa.int32()), pa.array([1] * len(made), pa.int64()), pa.array(made, pa.binary())], ["archive", "section", "n", "content"])

    return placed.select("archive", F.lit(0).alias("section"), "n", "content").unionByName(entries).unionByName(sums.mapInArrow(ends, schema))


def write_archives(parts: DataFrame, folder: str) -> DataFrame:
    """(archive, path, bytes) of what was written: a file <archive>.zip in a folder of any store that Arrow's file systems
    reach. Parts are sorted and streamed, a few in memory at a time. A task that is tried again writes its files anew, and
    a file gets its name only when it is whole."""
    kind = parts.schema["archive"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        now, out, done = object(), None, []

        def finish() -> None:
            out.close()
            store.move(f"{base}/.{now}.part", f"{base}/{now}.zip")
            done.append((now, f"{base}/{now}.zip", store.get_file_info(f"{base}/{now}.zip").size))

        for batch in batches:
            for row in range(batch.num_rows):
                if (name := batch.column(0)[row].as_py()) != now:
                    if out:
                        finish()
                    now, out = name, store.open_output_stream(f"{base}/.{name}.part")
                out.write(batch.column(3)[row].as_buffer())
        if out:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done]), pa.array([d[2] for d in done], pa.int64())], ["archive", "path", "bytes"])

    return cut(parts.repartition("archive").sortWithinPartitions("archive", "section", "n").mapInArrow(run, f"archive {kind}, path string, bytes bigint"))
