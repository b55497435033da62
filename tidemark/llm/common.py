"""What the operators of this subpackage share."""

from __future__ import annotations

import os

import pyarrow.fs as pafs

from tidemark.sources.tables import shared_dir, small_batches, table, written

__all__ = ["open_fs", "shared_dir", "small_batches", "table", "written"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
