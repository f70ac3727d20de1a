"""Addresses of files for pyarrow's file systems."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs


def locate(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it.

    An address without a scheme is a local path; ``file:/x`` is what Spark calls ``file:///x``. Names are as they are, not encoded.
    """
    if "://" not in address or address.startswith("file:"):
        return fs.LocalFileSystem(), address.removeprefix("file:").removeprefix("//") if address.startswith("file:") else address
    scheme, _, rest = address.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@?&=')}")


def is_file(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == fs.FileType.File
