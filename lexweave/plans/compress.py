"""Compression of finished outputs: what a sink doesn't compress itself."""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

OPEN = {"plain": open, "gz": gzip.open, "bz2": bz2.open, "lzma": lzma.open, "gzip": gzip.open, "bzip2": bz2.open}
FIXED_TIME = (1980, 1, 1, 0, 0, 0)


@contextmanager
def beside(path: str) -> Iterator[str]:
    """A place for the plain form of ``path``, in a folder of its own that goes afterwards."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    try:
        yield os.path.join(folder, os.path.splitext(os.path.basename(path))[0])
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def compress(path: str, to: str, compression: str) -> None:
    """Write the file (or, for zip, the file or folder and its resources) at ``path`` compressed to ``to``."""
    if compression == "zip":
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for top in (path, f"{path}_res"):
                for file in _files(top):
                    name = os.path.relpath(file, path if os.path.isdir(path) else os.path.dirname(path) or ".")
                    with open(file, "rb") as source, z.open(zipfile.ZipInfo(name, FIXED_TIME), "w") as out:
                        shutil.copyfileobj(source, out)
        return
    if os.path.isdir(path):
        raise ValueError(f"a folder can't be compressed with {compression}")
    with open(path, "rb") as source, OPEN[compression](to, "wb") as out:
        shutil.copyfileobj(source, out)


def _files(top: str) -> list[str]:
    if os.path.isfile(top):
        return [top]
    return sorted(os.path.join(folder, name) for folder, _, names in os.walk(top) for name in names)
