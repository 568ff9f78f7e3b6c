"""Files in the shared folder, written and read by executors through its URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path within it."""
    return fs.FileSystem.from_uri(uri)


class AtomicWriter:
    """Write beside the target and move into place on success, so that a task that is
    lost or repeated never leaves half a file under the final name."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append; gives the offset at which ``data`` begins."""
        began = self.at
        self.out.write(data)
        self.at += len(data)
        return began

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)
