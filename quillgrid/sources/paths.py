"""Files of shared folders from Python tasks, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs

#: Hadoop's names of file systems that pyarrow opens by URI, and its own names of them.
OWN = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it; schemes that pyarrow doesn't know go through Hadoop's client library."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    if scheme in OWN:
        return fs.FileSystem.from_uri(f"{OWN[scheme]}://{rest}")
    authority, _, path = rest.partition("/")
    return fs.HadoopFileSystem(f"{scheme}://{authority}"), f"/{path}"


def put(uri: str, data: bytes) -> None:
    """A file that appears under its name when it is whole."""
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temp) as out:
        out.write(data)
    system.move(temp, path)


def names(uri: str) -> list[str]:
    """The names in a folder that don't begin with a dot, sorted; none if it isn't there."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if not x.base_name.startswith("."))


def get(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def remove(uri: str) -> None:
    """Remove a file, if it's there."""
    system, path = opened(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)
