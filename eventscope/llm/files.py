"""Raw files on shared storage, written and read by tasks (any store pyarrow can open)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_bytes(folder: str, name: str, *parts: bytes) -> str:
    """Write one file under a name no other attempt uses; returns its path.

    A task that is run again leaves an orphan; readers follow only paths in tables that
    Spark committed.
    """
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, local = _open(path)
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(local) as out:
        for part in parts:
            out.write(part)
    return path


def read_bytes(path: str, at: int = 0, n: int | None = None) -> bytes:
    fs, local = _open(path)
    with fs.open_input_file(local) as f:
        return f.read_at(f.size() - at if n is None else n, at)
