"""File access by URI, alike on the driver and on executors; discovery of inputs."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow.fs as pafs

from readloom.errors import ReadloomError


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))
    if fs.get_file_info(path).type != pafs.FileType.File:
        raise ReadloomError("file_not_found", f"{uri} is not a file")
    return fs.open_input_file(path)


def read_prefix(uri: str, size: int = 8192) -> bytes:
    with open_input(uri) as f:
        return f.read(size)


def file_size(uri: str) -> int:
    with open_input(uri) as f:
        return f.size()


def read_all(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()


def tail(uri: str, size: int) -> bytes:
    """The last bytes of a file, fewer if it has fewer."""
    with open_input(uri) as f:
        f.seek(max(f.size() - size, 0))
        return f.read()


def remove_folder(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.delete_dir(path)


def atomic_write(path: str, parts, force: bool = False, source: str | None = None) -> None:
    """Write byte parts to a temporary sibling, then rename; never over an input, over a file only with ``force``."""
    if source is not None and os.path.abspath(source) == os.path.abspath(path):
        raise ReadloomError("invalid_argument", "output is the input")
    if os.path.exists(path) and not force:
        raise ReadloomError("output_exists", f"{path} exists", hint="use force to replace it")
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "wb") as f:
            for part in parts:
                f.write(part)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


@dataclass(frozen=True)
class Discovered:
    path: str
    format: str
    container: str


def discover(paths: list[str], recursive: bool = False) -> list[Discovered]:
    """Files in the order given; a directory's files by name, its directories only if recursive; links are skipped."""
    from readloom.sources.probe import probe

    found: list[str] = []

    def walk(directory: str) -> None:
        for name in sorted(os.listdir(directory)):
            path = os.path.join(directory, name)
            if os.path.islink(path):
                continue
            if os.path.isdir(path):
                if recursive:
                    walk(path)
            else:
                found.append(path)

    for path in paths:
        if os.path.isdir(path):
            walk(path)
        elif os.path.isfile(path):
            found.append(path)
        else:
            raise ReadloomError("file_not_found", path)
    probes = [(p, probe(p)) for p in found]
    return [Discovered(p, r.format, r.container) for p, r in probes]


def format_counts(files: list[Discovered]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for f in files:
        counts[f.format] = counts.get(f.format, 0) + 1
    return counts
