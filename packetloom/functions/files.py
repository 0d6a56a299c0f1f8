"""Files opened inside tasks, for formats Spark has no reader for."""

from __future__ import annotations

import re

from pyarrow import fs


def open_file(path: str):
    """A file of this machine or of any store Arrow knows, for reads by position or in a stream."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
