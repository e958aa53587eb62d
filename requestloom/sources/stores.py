"""Stores that tasks open by themselves: a stream or a range of an object, and the entries of one folder.

Tasks have no access to Spark's own connectors, so objects are opened through pyarrow, under whose names the schemes of
Spark's connectors are looked up.  A store that pyarrow does not know is reached by giving an object with the same
methods; every reader of this package takes one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO, NamedTuple
from urllib.parse import urlsplit

# Fixed: schemes of Spark's connectors, and the names of the same stores in pyarrow.
ARROW_SCHEMES = {
    "": "file",
    "abfs": "abfs",
    "abfss": "abfss",
    "file": "file",
    "gcs": "gs",
    "gs": "gs",
    "hdfs": "hdfs",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "viewfs": "viewfs",
}


class Entry(NamedTuple):
    """What a folder holds: a name, its size in bytes (None: a folder), and when it was modified, in seconds."""

    name: str
    size: int | None
    modified: float | None


class ArrowStore:
    """Objects by URI, through pyarrow.  File systems are made in the task and kept per scheme and host."""

    def __init__(self):
        self._systems: dict = {}

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self._systems = {}

    @staticmethod
    def knows(uri: str) -> bool:
        return urlsplit(uri).scheme in ARROW_SCHEMES

    def _place(self, uri: str):
        """File system and path of a URI; paths are as they are written, without escapes."""
        from pyarrow import fs

        scheme, rest = uri.split(":", 1) if urlsplit(uri).scheme else ("", uri)
        if scheme not in ARROW_SCHEMES:
            raise ValueError(f"no store is known for {scheme}: {uri}")
        name = ARROW_SCHEMES[scheme]
        host, path = "", rest
        if rest.startswith("//"):
            host, slash, path = rest[2:].partition("/")
            path = slash + path
        if (name, host) not in self._systems:
            local = name == "file"
            self._systems[name, host] = fs.LocalFileSystem() if local else fs.FileSystem.from_uri(f"{name}://{host}/")[0]
        return self._systems[name, host], f"{host}{path}" if name in ("s3", "gs") else path

    def open(self, uri: str) -> IO[bytes]:
        system, path = self._place(uri)
        return system.open_input_stream(path)

    def read(self, uri: str, start: int, length: int) -> bytes:
        """A range of an object's bytes."""
        system, path = self._place(uri)
        with system.open_input_file(path) as file:
            file.seek(start)
            return file.read(length)

    @contextmanager
    def create(self, uri: str) -> Iterator[IO[bytes]]:
        """A stream whose bytes become the object when it is closed without an error; an older object is replaced."""
        system, path = self._place(uri)
        if system.type_name not in ("local", "hdfs"):  # the others show no object before it is whole
            with system.open_output_stream(path) as stream:
                yield stream
            return
        folder, _, name = path.rpartition("/")
        begun = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = system.open_output_stream(begun)
        try:
            with stream:
                yield stream
            if system.type_name == "hdfs" and system.get_file_info(path).is_file:
                system.delete_file(path)
            system.move(begun, path)
        except BaseException:
            system.delete_file(begun)
            raise

    def make_folder(self, uri: str) -> None:
        system, path = self._place(uri)
        system.create_dir(path, recursive=True)

    def entries(self, uri: str) -> Iterator[Entry]:
        """The entries of one folder, one after the other where the store can do that; none if there is no such folder."""
        from pyarrow import fs

        system, path = self._place(uri)
        if isinstance(system, fs.LocalFileSystem):
            yield from _local_entries(path)
            return
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            folder = info.type == fs.FileType.Directory
            yield Entry(info.base_name, None if folder else info.size, info.mtime.timestamp() if info.mtime else None)


def _local_entries(path: str) -> Iterator[Entry]:
    try:
        found = os.scandir(path)
    except FileNotFoundError:
        return
    with found:
        for item in found:
            try:
                about = item.stat()
            except FileNotFoundError:  # a link to nowhere
                yield Entry(item.name, None, None)
            else:
                yield Entry(item.name, None if item.is_dir() else about.st_size, about.st_mtime)


def store_errors() -> tuple[type[Exception], ...]:
    """What opening or reading an object may raise; everything else is a fault of the program."""
    import pyarrow as pa

    return (OSError, ValueError, pa.ArrowException)
