"""Binary files that tasks write and read as streams in the shared folder.

A task writes to a name of its own and hands the name on as a row, so of several
attempts at a task only the one whose rows Spark keeps counts; files of lost
attempts are never read. pyarrow opens ``file:`` folders and, where its
libraries are installed, ``hdfs:``, ``s3:`` and ``gs:`` ones.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, stem: str, suffix: str):
    """(path, output stream) of a new file."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    return f"{folder}/{name}", where.open_output_stream(f"{path}/{name}", compression=None)


def open_input(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_stream(inner, compression=None)


def open_file(path: str):
    """For readers that seek, as Parquet's."""
    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)
