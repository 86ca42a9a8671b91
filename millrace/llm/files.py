"""Files in the shared folder, from Python tasks: any store that pyarrow can open, file:// paths among them."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextlib.contextmanager
def written(uri: str) -> Iterator:
    """A stream whose content appears under uri when the block ends, whole or not at all; a repeated task writes anew."""
    system, path = opened(uri)
    folder, name = posixpath.split(path)
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(hidden) as out:
            yield out
        system.move(hidden, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(hidden)
        raise


@contextlib.contextmanager
def readable(uri: str) -> Iterator:
    """A random-access file."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        yield f
