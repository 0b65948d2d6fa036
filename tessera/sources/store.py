"""Files of the shared store, opened by tasks: seek, stream, put in place.

A mounted folder (no scheme, or file:) is opened directly; any other store through Arrow's file
systems. Nothing here holds a whole file.
"""

from __future__ import annotations

import os
import uuid
from typing import BinaryIO
from urllib.parse import unquote, urlparse

#: Bytes that a stream is read or copied by.
CHUNK = 1 << 20


def local_path(path: str) -> str | None:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        return None
    return unquote(url.path) if url.scheme else path


def open_input(path: str) -> BinaryIO:
    """A file that can be read and sought."""
    here = local_path(path)
    if here is not None:
        return open(here, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


class Output:
    """A file that is there whole once the block has ended, or not at all."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        here = local_path(self.path)
        if here is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            self.draft, self.here = os.path.join(os.path.dirname(here), f".{uuid.uuid4().hex}"), here
            self.file = open(self.draft, "wb")
        else:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(self.path)
            store.create_dir(os.path.dirname(at))
            self.draft, self.file = None, store.open_output_stream(at)
        return self.file

    def __exit__(self, failed, *_):
        self.file.close()
        if self.draft is not None:
            if failed:
                os.unlink(self.draft)
            else:
                os.replace(self.draft, self.here)


def exists(path: str) -> bool:
    here = local_path(path)
    if here is not None:
        return os.path.exists(here)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def chunks(file: BinaryIO, size: int = CHUNK):
    while block := file.read(size):
        yield block
