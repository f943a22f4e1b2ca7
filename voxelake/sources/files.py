"""Files of foreign formats on the file systems that Arrow knows, written so that they are whole or absent."""

from __future__ import annotations

import uuid


def store_of(path: str):
    """(file system, path on it); paths without a scheme are local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def put(store, folder: str, name: str, *parts: bytes) -> None:
    """Written under a name of its own and moved, so two attempts leave one whole file."""
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for part in parts:
            f.write(part)
    store.move(own, f"{folder}/{name}")
