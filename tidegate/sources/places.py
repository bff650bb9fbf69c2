"""Files by path, folder, glob or store URI.

A path without a scheme is opened as it is, on storage that all executors see; one with a scheme through the file
systems of Arrow, on the driver and on the executors alike.
"""

from __future__ import annotations

import fnmatch
import glob
import io
import os
from typing import BinaryIO

WILD = "*?["


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def has_scheme(path: str) -> bool:
    return "://" in path


def expand(path: str) -> list[str]:
    """The files that a path stands for, in the order of their names: a file, those of a folder (but for hidden ones), or those that a pattern of the last part fits."""
    shown = lambda p: os.path.basename(p)[:1] not in ("", ".", "_")
    if not has_scheme(path):
        if any(c in path for c in WILD) and not os.path.exists(path):
            return sorted(p for p in glob.glob(path) if os.path.isfile(p) and shown(p))
        if os.path.isdir(path):
            return sorted(e.path for e in os.scandir(path) if e.is_file() and shown(e.path))
        return [path]
    from pyarrow import fs

    head, _, last = path.rpartition("/")
    wild = any(c in last for c in WILD)
    store, inner = _store(head if wild else path)
    if not wild and store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    infos = store.get_file_info(fs.FileSelector(inner))
    base = head if wild else path.rstrip("/")
    return sorted(f"{base}/{i.base_name}" for i in infos if i.type == fs.FileType.File and shown(i.path) and (not wild or fnmatch.fnmatchcase(i.base_name, last)))


def opened(path: str) -> BinaryIO:
    """A seekable file of bytes."""
    if not has_scheme(path):
        return open(path, "rb")
    store, inner = _store(path)
    return io.BufferedReader(store.open_input_file(inner), 1 << 20)


def size_of(path: str) -> int:
    if not has_scheme(path):
        return os.path.getsize(path)
    store, inner = _store(path)
    return store.get_file_info(inner).size
