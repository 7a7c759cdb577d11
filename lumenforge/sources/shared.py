"""Files of the shared folder as tasks open them."""

from __future__ import annotations

from pyarrow import fs


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; a plain path is a local one."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
