"""Files by path, for the data sources that read and write them in Python: local paths, and the stores that Arrow reaches."""

from __future__ import annotations

import re

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """(store, the path in it); a path without a scheme is local."""
    local = re.match(r"file:/*", path)
    if local:
        return fs.LocalFileSystem(), "/" + path[local.end() :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether Arrow has a store for the path's scheme; Spark's own readers may reach others."""
    try:
        at(path)
    except Exception:  # noqa: BLE001  an unknown scheme, or a store whose library is not installed
        return False
    return True


def exists(path: str) -> bool:
    store, inner = at(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def files_in(path: str, ending: str = "") -> list[str]:
    """The visible files of a folder, or the file itself, with their scheme, in order; none where there is nothing."""
    store, inner = at(path)
    info = store.get_file_info(inner)
    scheme = "file:" if isinstance(store, fs.LocalFileSystem) else path[: path.index("://") + 3]
    if info.type == fs.FileType.File:
        return [scheme + inner]
    if info.type == fs.FileType.NotFound:
        return []
    found = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name.endswith(ending)]
    return sorted(scheme + f.path for f in found if not f.base_name.startswith(("_", ".")))


def folders_in(path: str) -> list[str]:
    store, inner = at(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def make(path: str) -> None:
    store, inner = at(path)
    store.create_dir(inner, recursive=True)


def move(source: str, target: str) -> None:
    """Renames a file; what has been moved before is left alone."""
    store, inner = at(source)
    if exists(source):
        store.move(inner, at(target)[1])


def remove(path: str) -> None:
    """Deletes a file or a folder, if it is there."""
    store, inner = at(path)
    kind = store.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        store.delete_dir(inner)
    elif kind == fs.FileType.File:
        store.delete_file(inner)


def write(path: str, content: bytes) -> None:
    """A whole file, under its name only once it is complete."""
    store, inner = at(path)
    folder, _, name = inner.rpartition("/")
    hidden = f"{folder}/.{name}.part"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, inner)


def read(path: str) -> bytes:
    store, inner = at(path)
    with store.open_input_file(inner) as f:
        return f.read()
