"""Files in a folder that only a file system URI names (local, HDFS or object store)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def write_atomic(uri: str):
    """A sink that becomes the file at ``uri`` only when it has been written whole.

    A task that is run twice writes the same bytes; the last rename wins, and a
    task that dies leaves no file of that name.
    """
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as sink:
            yield sink
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)
        raise


def open_read(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)
