"""Binary files by URI, for tasks on any executor: local mounts directly, other stores through Arrow."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlsplit


def local_path(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def write_whole(uri: str) -> Iterator[BinaryIO]:
    """A file to write that appears under its name only once it is complete, whoever else tries the same."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        attempt = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
        try:
            with open(attempt, "wb") as f:
                yield f
            os.replace(attempt, path)
        except BaseException:
            if os.path.exists(attempt):
                os.remove(attempt)
            raise
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(attempt) as f:
        yield f
    store.move(attempt, path)


def open_read(uri: str) -> BinaryIO:
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
