"""Files of a shared folder from Python workers, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


#: Hadoop's names of file systems that pyarrow has of its own under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "s3": "s3", "file": "file"}


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path within it.

    Schemes that pyarrow doesn't know go through Hadoop's own client library.
    """
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    if scheme in SCHEMES:
        return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{rest}")
    authority, _, path = rest.partition("/")
    return fs.HadoopFileSystem(f"{scheme}://{authority}"), f"/{path}"


class Atomic:
    """A file that appears under its name only when it is whole.

    A task that dies leaves a hidden file at most. Names have to differ between
    attempts of a task; a manifest, which Spark commits, says which ones count.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = system(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.final

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)
