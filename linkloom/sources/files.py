"""Files opened inside tasks, on any store that pyarrow reaches."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import NativeFile, fs

#: Names that Hadoop has for schemes.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """Store of a path as Spark's file sources name it, the path inside it, and what precedes that in Spark's form.

    A path without a scheme and ``file:`` are local, or mounted by every
    executor; other schemes go to the store of that name.
    """
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?=/))?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub(r"^/+", "/", rest) if scheme else rest, "file:" if scheme else ""
    store, inside = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}")
    whole = f"{scheme}:{rest}"
    return store, inside, whole[: len(whole.rstrip("/")) - len(inside.rstrip("/"))]


def opened(path: str) -> NativeFile:
    """The file behind a path, for reads at any place."""
    store, inside, _ = store_of(path)
    return store.open_input_file(inside)
