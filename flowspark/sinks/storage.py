"""Access to shared storage from inside tasks."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs as arrow_fs


# Hadoop's names of stores that go by another name here.
SAME_STORE = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
LISTABLE = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def _scheme(uri: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    return SAME_STORE.get(found[1], found[1]) if found else "file"


def listable(uri: str) -> bool:
    """Whether tasks can open the store of this URI by themselves."""
    return _scheme(uri) in LISTABLE


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI; a plain path or ``file:`` is local or mounted storage."""
    scheme = _scheme(uri)
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri
    return arrow_fs.FileSystem.from_uri(f"{scheme}:{uri.split(':', 1)[1]}")


def put(store: arrow_fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a whole file so that readers and task retries never see a part of one."""
    folder, name = posixpath.split(path)
    temporary = f"{folder}/.{name[:100]}.{uuid.uuid4().hex}.tmp"
    put_aside(store, temporary, content)
    store.move(temporary, path)


def put_aside(store: arrow_fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file that nothing reads yet. Its folder is made where it is missing, not asked for with every file."""
    try:
        out = store.open_output_stream(path)
    except OSError:
        store.create_dir(posixpath.dirname(path), recursive=True)
        out = store.open_output_stream(path)
    with out:
        out.write(content)


def moved(store: arrow_fs.FileSystem, source: str, target: str) -> bool:
    """Moves a file, into a new folder too; False if there is none."""
    try:
        store.move(source, target)
    except OSError:
        if not exists(store, source):
            return False
        store.create_dir(posixpath.dirname(target), recursive=True)
        store.move(source, target)
    return True


def get(store: arrow_fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as content:
        return content.read()


def head(store: arrow_fs.FileSystem, path: str, size: int) -> bytes:
    """The first ``size`` bytes of a file; no more are read."""
    with store.open_input_file(path) as content:
        return content.read_at(min(size, content.size()), 0)


def exists(store: arrow_fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != arrow_fs.FileType.NotFound


def entries(folder: str, wanted: Callable[[str], bool], descend: Callable[[str], bool] | None = None) -> Iterator[tuple[str, int, int]]:
    """Path below the folder, time (nanoseconds) and length of the files whose names are ``wanted``; in a mounted folder only
    these are looked at any closer. Only with ``descend`` also those of sub-folders, where it takes their names."""
    store, root = open_store(folder)
    inner = [""]
    while inner:
        below = inner.pop()
        if isinstance(store, arrow_fs.LocalFileSystem):
            with os.scandir(f"{root}/{below}") as found:
                for entry in found:
                    try:
                        if entry.is_dir():
                            if descend and descend(entry.name):
                                inner.append(f"{below}{entry.name}/")
                        elif wanted(entry.name) and entry.is_file():
                            state = entry.stat()
                            yield below + entry.name, state.st_mtime_ns, state.st_size
                    except FileNotFoundError:  # gone meanwhile
                        continue
            continue
        for entry in store.get_file_info(arrow_fs.FileSelector(f"{root.rstrip('/')}/{below}".rstrip("/"))):
            if entry.type == arrow_fs.FileType.Directory and descend and descend(entry.base_name):
                inner.append(f"{below}{entry.base_name}/")
            elif entry.type == arrow_fs.FileType.File and wanted(entry.base_name):
                yield below + entry.base_name, entry.mtime_ns, entry.size


def children(store: arrow_fs.FileSystem, folder: str) -> list[str]:
    """Names directly below a folder; none where it does not exist."""
    found = store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return [entry.base_name for entry in found]
