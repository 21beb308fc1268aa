"""Flat files in the shared folder, written and memory-mapped by the executors."""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path that this machine can open itself, or None for another kind of store."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


@contextmanager
def writing(uri: str):
    """A binary stream to a new file; its folder is made."""
    if path := local_path(uri):
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            yield out
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rsplit("/", 1)[0])
        with store.open_output_stream(path) as out:
            yield out


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the store has local paths, else read."""
    if path := local_path(uri):
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype)


def put(uri: str, data: bytes) -> None:
    """A whole file at once: it is there complete or not at all, and the last of several writers wins."""
    import uuid

    own = f"{uri}.{uuid.uuid4().hex}"
    with writing(own) as out:
        out.write(data)
    if path := local_path(uri):
        import os

        os.replace(local_path(own), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(fs.FileSystem.from_uri(own)[1], path)


def get(uri: str) -> bytes | None:
    """A whole file, or None if there is none."""
    if path := local_path(uri):
        try:
            with open(path, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(path) as f:
        return f.readall()
