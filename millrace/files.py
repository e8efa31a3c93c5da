"""Files in the shared folder, opened on executors by URI: local paths directly, other schemes through pyarrow."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def create(uri: str):
    """A new file for writing; its folder is made."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def read(uri: str):
    """A file for reading, with seek()."""
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def publish(uri: str, write) -> None:
    """A new file that appears whole: write(file) to a hidden one beside it, then a rename."""
    folder, name = uri.rsplit("/", 1)
    hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with create(hidden) as out:
        write(out)
    if (path := _local(uri)) is not None:
        os.replace(_local(hidden), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(fs.FileSystem.from_uri(hidden)[1], path)


def listed(uri: str) -> list[str]:
    """The files of a folder that aren't hidden; none where there is no such folder."""
    if (path := _local(uri)) is not None:
        names = sorted(os.listdir(path)) if os.path.isdir(path) else []
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.is_file)
    return [f"{uri}/{n}" for n in names if n[0] not in "._"]
