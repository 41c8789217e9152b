"""Files that Python workers write and read in the shared folder, through any file system that Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute local path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicOutput:
    """A file that appears under its name only when it is whole; a task that is tried again replaces it."""

    def __init__(self, uri: str):
        self.system, self.path = locate(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.system.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.temporary, self.path)

    def abandon(self) -> None:
        self.stream.close()
        self.system.delete_file(self.temporary)


def open_input(uri: str):
    """A seekable stream."""
    system, path = locate(uri)
    return system.open_input_file(path)
