"""Single files of a folder, read and written inside tasks: on any file system that Arrow knows."""

from __future__ import annotations

import os
import uuid


def _opened(folder: str):
    from pyarrow import fs

    if "://" not in folder:
        folder = os.path.abspath(folder.removeprefix("file:"))
    system, base = fs.FileSystem.from_uri(folder)
    return system, base.rstrip("/")


def read_file(folder: str, name: str) -> bytes | None:
    """The content of a file, None where there is none."""
    from pyarrow import fs

    system, base = _opened(folder)
    path = f"{base}/{name}"
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def write_file(folder: str, name: str, content: bytes) -> None:
    """Writes a file beside its place and moves it there, so that a task which runs again, or twice, leaves one whole file."""
    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    beside = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as f:
        f.write(content)
    system.move(beside, f"{base}/{name}")
