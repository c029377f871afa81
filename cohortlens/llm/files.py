"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; one without a scheme is a local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_once(folder: str, name: str, content) -> str:
    """Runs ``content(stream)`` on a new file of ``folder``; returns its address.

    Every call has a name of its own, so a task that runs again, or twice at a
    time, never touches what another attempt wrote. Readers go by the addresses
    that the finished attempts return, and never list the folder.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    stem, dot, suffix = name.partition(".")
    unique = f"{stem}-{uuid.uuid4().hex}{dot}{suffix}"
    with system.open_output_stream(f"{path}/{unique}", compression=None) as stream:
        content(stream)
    return f"{folder.rstrip('/')}/{unique}"


def open_input(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
