"""Scratch tables and files in the folder that driver and executors share."""

from __future__ import annotations

from ledgerloom.lineage import fresh_folder, written  # noqa: F401


def file_system(uri: str):
    """pyarrow's file system and path for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
