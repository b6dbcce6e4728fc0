"""Files in the shared folder, opened from any executor."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it. Works for file:, hdfs:, s3: and gs:."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)
