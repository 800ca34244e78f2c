"""Files of any store that Arrow can reach, for sources and sinks that run inside tasks."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        path = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def listing(path: str, ending: str) -> list[str]:
    """Files of a folder and the folders in it with an ending, in order; a file stands for itself."""
    fs, root = at(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ending)
                  and not f.base_name.startswith(("_", ".")))
