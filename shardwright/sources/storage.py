"""File access from tasks, by URI: local paths and any store Arrow reads
(``file:``, ``hdfs:``, ``s3:``, ``gs:``)."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it. ``file:/x`` and ``/x`` are local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_input(path: str):
    """Sequential binary reader of a file, bytes as stored."""
    store, name = resolve(path)
    return store.open_input_stream(name, compression=None)


def open_random(path: str):
    """Binary reader with seek."""
    store, name = resolve(path)
    return store.open_input_file(name)
