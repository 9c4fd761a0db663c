"""Binary files of frames as a data source that is written: HTK, float dumps and waves, one file a series.

`write_frames` deals the rows by series and sorts them; a task streams a
series' frames into a file of its own beside the target, and the files are
moved to their names when all tasks are done. A task or job that fails leaves
nothing. Folders are any that Arrow's file systems reach (file, s3, gs, hdfs).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CHUNK = 4 << 20


class _Htk:
    size, ending = 12, "htk"

    def __init__(self, options):
        self.period, self.kind = float(options.get("period", 0.01)), int(options.get("kind", 9))

    def head(self, rows: int, width: int) -> bytes:
        return struct.pack(">iihH", rows, round(self.period * 1e7), 4 * width, self.kind)

    def read_head(self, head: bytes) -> tuple[int, int]:
        rows, _, size, _ = struct.unpack(">iihH", head)
        return rows, size // 4

    def body(self, frame) -> bytes:
        return np.asarray(frame, ">f4").tobytes()


class _Dump:
    size, ending = 8, "dump"

    def __init__(self, options):
        pass

    def head(self, rows: int, width: int) -> bytes:
        return np.array([width, rows], "<f4").tobytes()

    def read_head(self, head: bytes) -> tuple[int, int]:
        width, rows = np.frombuffer(head, "<f4").astype(int)
        return int(rows), int(width)

    def body(self, frame) -> bytes:
        return np.asarray(frame, "<f4").tobytes()


class _Wave:
    """Frames are joined; a file's samples are 16 bits of one channel."""

    size, ending = 44, "wav"

    def __init__(self, options):
        self.rate = int(options.get("rate", 16000))

    def head(self, rows: int, width: int) -> bytes:
        data = 2 * rows * width
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + data, b"WAVE", b"fmt ", 16, 1, 1, self.rate, 2 * self.rate, 2, 16, b"data", data)

    def read_head(self, head: bytes) -> tuple[int, int]:
        return struct.unpack_from("<I", head, 40)[0] // 2, 1

    def body(self, frame) -> bytes:
        return np.clip(np.rint(np.asarray(frame, float) * 32767), -32768, 32767).astype("<i2").tobytes()


_FORMATS = {"htk": _Htk, "dump": _Dump, "wave": _Wave}


@dataclass
class _Written(WriterCommitMessage):
    files: list  # (made, name)


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.format = _FORMATS[options.get("how", "htk")](options)
        self.job = f"_writing-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if re.match(r"[a-z0-9]+://", self.path) else f"file://{re.sub('^file:', '', self.path)}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Rows (name, rows, width, frame) of whole series, each in order."""
        files, folder = self._at()
        task = TaskContext.get()
        part = f"{folder}/{self.job}/{task.partitionId()}-{task.attemptNumber()}"
        files.create_dir(part)
        made, name, sink, left = [], None, None, 0
        try:
            for row in iterator:
                if row[0] != name:
                    if left:
                        raise ValueError(f"{name}: {left} frames are missing")
                    if sink:
                        sink.close()
                    name, left = row[0], row[1]
                    own = f"{part}/{len(made)}"
                    made.append((own, self._name(name)))
                    sink = files.open_output_stream(own)
                    self._begin(files, f"{folder}/{self._name(name)}", sink, row[1], row[2])
                if len(row[3]) != row[2]:
                    raise ValueError(f"{name}: frames of different sizes")
                sink.write(self.format.body(row[3]))
                left -= 1
            if left:
                raise ValueError(f"{name}: {left} frames are missing")
        finally:
            if sink:
                sink.close()
        return _Written(made)

    def _name(self, name) -> str:
        """A file's name: characters that paths may not have are written as %XX."""
        return re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(name)).lstrip(".") + "." + self.format.ending

    def _begin(self, files, target: str, sink, rows: int, width: int) -> None:
        """The head; what the file has already stands ahead of what is added."""
        old = None if self.overwrite or files.get_file_info(target).type != fs.FileType.File else files.open_input_stream(target)
        if old is None:
            sink.write(self.format.head(rows, width))
            return
        with old:
            n, w = self.format.read_head(old.read(self.format.size))
            if isinstance(self.format, _Wave):
                sink.write(self.format.head(n + rows * width, 1))
            elif w != width:
                raise ValueError(f"{target} has frames of {w}, not {width}")
            else:
                sink.write(self.format.head(n + rows, width))
            while chunk := old.read(CHUNK):
                sink.write(chunk)

    def commit(self, messages) -> None:
        files, folder = self._at()
        new = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    files.delete_file(info.path)
        for made, name in new:
            files.move(made, f"{folder}/{name}")
        self._clear(files, folder)

    def abort(self, messages) -> None:
        self._clear(*self._at())

    def _clear(self, files, folder: str) -> None:
        if files.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


class FrameFiles(DataSource):
    """df.write.format("wavelathe_frames"): rows (name, rows, width, frame); options how (htk, dump, wave), period, kind, rate."""

    @classmethod
    def name(cls) -> str:
        return "wavelathe_frames"

    def schema(self) -> str:
        return "name string, rows long, width int, frame array<float>"

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def write_frames(df: DataFrame, path: str, name: str, order: str, frame: str, how: str = "htk", mode: str = "append", **options) -> None:
    """One file a series under path, its frames in order. append adds to files that are there; overwrite replaces all of the folder's.

    A series' frames stream through one task. Null frames are refused, as are
    frames of different sizes in a series; rows without a name are one series
    named null. No rows write no file.
    """
    df.sparkSession.dataSource.register(FrameFiles)
    rows = df.select(F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("name"), F.col(order).alias("_order"), F.col(frame).cast("array<float>").alias("frame"))
    facts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("frame")).alias("width"))
    dealt = rows.join(facts, "name").repartition("name").sortWithinPartitions("name", "_order")
    writer = dealt.select("name", "rows", F.col("width").cast("int").alias("width"), "frame").write.format("wavelathe_frames").option("how", how).mode(mode)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.save(path)
