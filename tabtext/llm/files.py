"""Files that tasks write and read in the shared folder.

A task writes under a name of its own and returns it in its rows; the rows are written as a table, so only the
files of the tasks that count are named there.  Files of lost or repeated tasks are never read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, as a URI that every executor can open."""
    path = scratch_path(spark, name)
    return path if ":" in path else f"file://{path}"


def opened(uri: str):
    """(file system, path) of a URI: local, HDFS or an object store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_bytes(folder: str, stem: str, parts) -> str:
    """Write the byte strings of ``parts`` to a new file of ``folder`` and return its URI."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}"
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)
    return uri


def read_stream(uri: str):
    store, path = opened(uri)
    return store.open_input_stream(path, compression=None)
