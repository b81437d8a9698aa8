"""Files on local disks, mounted folders and object stores, from the driver and from tasks."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow.fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    return pafs.FileSystem.from_uri(path) if _is_uri(path) else (pafs.LocalFileSystem(), path)


def _is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def make_folder(path: str) -> None:
    fs, p = at(path)
    fs.create_dir(p, recursive=True)


def put(path: str, data: bytes) -> None:
    """Write a file as a whole."""
    fs, p = at(path)
    with fs.open_output_stream(p) as f:
        f.write(data)


def names(folder: str) -> list[str]:
    """Names of the files directly in a folder; none where there is no such folder."""
    fs, p = at(folder)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if i.type == pafs.FileType.File)


def join(folder: str, name: str) -> str:
    """Path of a name in a folder; in a URI the name is quoted."""
    return folder.rstrip("/") + "/" + (quote(name) if _is_uri(folder) else name)
