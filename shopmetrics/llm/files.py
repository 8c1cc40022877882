"""Files in the shared folder, written under a temporary name and then moved."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder and the folder's path there."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class PendingFile:
    """A file that readers see only when it is complete.

    A task that runs twice writes the same bytes under another temporary name
    and moves them to the same place.
    """

    def __init__(self, uri: str, name: str):
        self.system, folder = open_folder(uri)
        self.system.create_dir(folder, recursive=True)
        self.path = f"{folder}/{name}"
        self.pending = f"{folder}/.pending-{uuid.uuid4().hex}-{name}"
        self.stream = self.system.open_output_stream(self.pending, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.pending, self.path)


def read_file(uri: str, name: str) -> bytes:
    system, folder = open_folder(uri)
    with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
        return stream.read()
