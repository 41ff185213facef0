"""Small files that tasks write while they run, each once whatever the attempts: in a folder that all machines see."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Folder:
    """``uri``: a path or the address of any store that ``pyarrow`` opens.  It travels to tasks as its address alone."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.uri) if ":" in self.uri.split("/")[0] else (fs.LocalFileSystem(), self.uri)
        return store, f"{base}/{name}"

    def get(self, name: str) -> bytes | None:
        """What is under ``name``; None if nothing is."""
        store, path = self._at(name)
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        """Stores ``data`` under ``name`` unless something is there; readers see it whole or not at all."""
        store, path = self._at(name)
        if store.get_file_info(path).type == fs.FileType.File:
            return
        folder, file = path.rsplit("/", 1)
        store.create_dir(folder, recursive=True)
        draft = f"{folder}/.{file}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(data)
        store.move(draft, path)
