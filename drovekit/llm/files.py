"""Files in the shared folder, opened from tasks on any executor."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file; its folder is made if need be. Returns its bytes."""
    fs, path = located(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(path, compression=None) as f:
        for x in parts:
            f.write(x)
            n += len(x)
    return n


@contextmanager
def opened(uri: str) -> Iterator[pa.NativeFile]:
    """A file for reads at any place."""
    fs, path = located(uri)
    with fs.open_input_file(path) as f:
        yield f


class Ranges:
    """Byte ranges of shared files; each fetch takes some bytes more, for the neighbours that follow."""

    def __init__(self, ahead: int = 1 << 20):
        self.ahead, self.name, self.start, self.held, self.open = ahead, "", 0, b"", None

    def read(self, name: str, at: int, n: int) -> bytes:
        if name != self.name:
            self.close()
            self.open = opened(name)
            self.file, self.name, self.start, self.held = self.open.__enter__(), name, 0, b""
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.ahead))
        out = self.held[at - self.start : at - self.start + n]
        if len(out) != n:
            raise ValueError(f"{name} ends before byte {at + n}")
        return out

    def size(self, name: str) -> int:
        self.read(name, 0, 0)
        return self.file.size()

    def close(self) -> None:
        if self.open is not None:
            self.open.__exit__(None, None, None)
        self.open, self.name = None, ""
