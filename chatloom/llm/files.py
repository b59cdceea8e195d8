"""Files written and read inside tasks, by URI, on any store pyarrow knows."""

from __future__ import annotations

import posixpath
import uuid


def place(uri: str):
    """File system and path of a URI; ``file:/x`` and plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that appears under its name only when complete.

    A task that is run again writes the same bytes under the same name; what a lost one left behind
    keeps a hidden name that nothing reads.
    """

    def __init__(self, folder: str, name: str):
        self.store, path = place(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.hidden = posixpath.join(path, name), posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
        self.uri = f"{folder.rstrip('/')}/{name}"

    def __enter__(self):
        self.stream = self.store.open_output_stream(self.hidden, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.store.move(self.hidden, self.path)
        else:
            self.store.delete_file(self.hidden)
