"""Flat files in the shared folder, written and range-read by tasks through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI (file, hdfs, s3, gs) or plain path, and its path there; makes the folder."""
    uri = uri if "://" in uri else f"file:///{uri.removeprefix('file:').lstrip('/')}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path
