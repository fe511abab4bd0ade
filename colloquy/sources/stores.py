"""File systems of paths, for Python data sources that read or write single files in tasks."""

from __future__ import annotations

from pyarrow import fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; a path without scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
