"""Masked images as PNG files, one for each row, by a Spark data source.

``spark.dataSource.register(PngSink)``, then ``images.write.format("png_files").mode("append").save(folder)`` with rows
(path, height, width, channels, data in BGR). A task writes its files into a folder of its own under the job's staging
folder; the driver moves them to their names when all tasks have succeeded, and removes the staging folder when the job
fails, so a failing task leaves nothing. A file replaces one of its name, so a rerun gives the same folder; ``overwrite``
removes other PNG files first. A name is ``redacted_`` and the base of the path; rows of one name get a number each,
in the order of their paths. Rows with null data or without pixels are skipped.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of pixels (height, width, channels): one channel is gray, three are BGR, four BGRA."""
    h, w, c = pixels.shape
    rgb = pixels if c == 1 else pixels[:, :, [2, 1, 0, 3][:c]]
    lines = np.zeros((h, 1 + w * c), np.uint8)  # each begins with its filter: none
    lines[:, 1:] = rgb.reshape(h, w * c)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def base_name(path: str | None) -> str:
    name = posixpath.basename((path or "").rstrip("/"))
    return (name.rpartition(".")[0] or name) or "image"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[tuple[str, str]]  # (path of the image, file in the folder)


class PngWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.staging = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def _at(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        files, root = self._at()
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt
        files.create_dir(own, recursive=True)
        out = []
        for batch in iterator:
            for path, h, w, c, data in zip(*(batch.column(n).to_pylist() for n in ("path", "height", "width", "channels", "data")), strict=True):
                if data and h and w and c:
                    name = f"{len(out)}.png"
                    with files.open_output_stream(f"{own}/{name}") as f:
                        f.write(png(np.frombuffer(data, np.uint8).reshape(h, w, c)))
                    out.append((path or "", name))
        return Written(own, out)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, root = self._at()
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".png"):
                    files.delete_file(f.path)
        seen: dict[str, int] = {}
        for path, at in sorted((path, f"{m.folder}/{name}") for m in messages if m for path, name in m.files):
            base = base_name(path)
            seen[base] = seen.get(base, 0) + 1
            to = f"{root}/redacted_{base}{'' if seen[base] == 1 else f'-{seen[base]}'}.png"
            if files.get_file_info(to).type != fs.FileType.NotFound:
                files.delete_file(to)
            files.move(at, to)
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        files, root = self._at()
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class PngSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_files"

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"], overwrite)
