"""Reading and writing whole files from tasks, by URI, on whatever file system holds the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, prefix: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: only files that a finished task reports are ever read."""
    return f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    at, path = opened(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    return at.open_output_stream(path, compression=None)  # else a name in .gz is compressed again


def reader(uri: str):
    at, path = opened(uri)
    return at.open_input_file(path)
