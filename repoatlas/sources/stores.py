"""Files of any store, opened inside tasks."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pafs

URI = re.compile(r"([A-Za-z][\w+.-]*):(?://([^/]*))?(/.*)?", re.DOTALL)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a qualified path as Spark shows it, which is not escaped."""
    found = URI.fullmatch(uri)
    if not found or found[1] == "file":
        return pafs.LocalFileSystem(), (found[3] or "/") if found else uri
    scheme = re.sub("^s3[an]$", "s3", found[1])
    store, top = pafs.FileSystem.from_uri(f"{scheme}://{found[2] or ''}/")
    return store, top.rstrip("/") + (found[3] or "/")


def read_range(file: pa.NativeFile, start: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``start`` on."""
    file.seek(start)
    return file.read(size)
