"""Files in the shared folder, from executors and driver alike."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it. Any system Arrow knows
    (local or mounted folders, object stores, HDFS) serves."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ready(uri: str) -> tuple[fs.FileSystem, str]:
    """As ``open_fs``, with the folder of the file made."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system, path
