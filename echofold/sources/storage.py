"""Stores as tasks see them: folders listed and files read where the work is, never on the driver.

A path is taken apart as text, so blanks, ``%`` and ``#`` in a key mean themselves. ``file:`` paths and
plain ones are local (or mounted) folders; others go to the store of their scheme.

Names of local files are bytes. Those that are UTF-8 are that text; bytes that are not stand in the text
as the private characters U+EF80 to U+EFFF (0x80 to 0xFF), and so do the bytes of such characters in a
name. ``bytes_of`` gives back the name exactly, so any file that is listed can be opened.
"""

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pandas as pd

LISTED = "root string, full_path string, is_dir boolean, is_link boolean, identity string, size_bytes bigint, " \
    "date_modified_utc timestamp_ntz, list_error_type string, list_error string, is_fatal boolean"
HASH_RESULTS = "root string, full_path string, content_hash string, error string"

_BLOCK = 1 << 20
_ROWS = 4_096
_OBJECT_STORES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs"}


# A raw byte as a private character, and as Python's own stand-in for it.
_PRIVATE, _ESCAPED = 0xEF00, 0xDC00


def text_of(name: bytes) -> str:
    """A local name as text."""
    def private(found: re.Match) -> str:
        raw = found[0].encode("utf-8", "surrogateescape")
        return "".join(chr(_PRIVATE + byte) for byte in raw)

    return re.sub("[\udc80-\udcff\uef80-\uefff]", private, name.decode("utf-8", "surrogateescape"))


def bytes_of(text: str) -> bytes:
    """The local name that ``text_of`` gave as text."""
    escaped = re.sub("[\uef80-\uefff]", lambda c: chr(ord(c[0]) - _PRIVATE + _ESCAPED), text)
    return escaped.encode("utf-8", "surrogateescape")


def local_name(path: str) -> str | None:
    """The name of a path in the file system of the task; null for other stores."""
    if path.startswith("dbfs:/"):
        return "/dbfs/" + path.removeprefix("dbfs:").lstrip("/")
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else path


def full_form(root: str) -> str:
    """A root as its files' paths begin: with a scheme and without a final separator."""
    name = local_name(root)
    if name is None or root.startswith("dbfs:"):
        return root.rstrip("/")
    return "file:" + text_of(os.path.abspath(bytes_of(name))).rstrip("/")


def place_of(path: str) -> tuple[str, str]:
    """The address of a path's store and the path's name in it."""
    scheme, authority, rest = re.fullmatch(r"([^:]+)://([^/]*)/?(.*)", path, re.DOTALL).groups()
    if scheme in _OBJECT_STORES:
        return f"{_OBJECT_STORES[scheme]}:", f"{authority}/{rest}".rstrip("/")
    return f"{scheme}://{authority}/", f"/{rest}"


@lru_cache(maxsize=64)
def _store(address: str):
    from pyarrow import fs

    if address in ("s3:", "gs:"):
        return fs.S3FileSystem() if address == "s3:" else fs.GcsFileSystem()
    return fs.FileSystem.from_uri(address)[0]


def _identity(facts: os.stat_result) -> str:
    """The same for every path that leads to one folder."""
    return f"{facts.st_dev}:{facts.st_ino}"


def _children(folder: str) -> Iterator[tuple]:
    """(path, is_dir, is_link, identity, size, modified) of what lies directly in a folder, whatever its name.

    An entry whose facts cannot be read is left out alone. A link is a folder if it leads to one.
    """
    name = local_name(folder)
    if name is None:
        from pyarrow import fs

        address, key = place_of(folder)
        for info in _store(address).get_file_info(fs.FileSelector(key)):
            modified = info.mtime and info.mtime.astimezone(UTC).replace(tzinfo=None)
            yield f"{folder}/{info.base_name}", info.type == fs.FileType.Directory, False, None, info.size, modified
        return
    with os.scandir(bytes_of(name or "/")) as found:
        for entry in found:
            path = f"{folder}/{text_of(entry.name)}"
            try:
                link, is_dir = entry.is_symlink(), entry.is_dir()
                if is_dir:
                    try:
                        identity = _identity(entry.stat())
                    except OSError:
                        # Listing it will tell what is wrong.
                        identity = None
                    yield path, True, link, identity, None, None
                else:
                    facts = entry.stat(follow_symlinks=False)
                    modified = datetime.fromtimestamp(facts.st_mtime, UTC).replace(tzinfo=None)
                    yield path, False, link, None, facts.st_size, modified
            except OSError:
                continue


def identify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The identity of each root; null where there is none to read."""
    def of(folder: str) -> str | None:
        name = local_name(folder)
        try:
            return None if name is None else _identity(os.stat(bytes_of(name or "/")))
        except OSError:
            return None

    for batch in batches:
        yield batch.assign(identity=[of(folder) for folder in batch["full_path"]])


def list_folders(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each folder; one that cannot be listed is a row with its error.

    An error of the store, such as a missing folder or right, skips the folder. Any other one is
    fatal for the root: what lies beneath it cannot be relied on.
    """
    names = [part.split()[0] for part in LISTED.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"size_bytes": "Int64", "date_modified_utc": "datetime64[us]"})

    for batch in batches:
        rows = []
        for root, folder in zip(batch["root"], batch["full_path"], strict=True):
            try:
                for path, *facts in _children(folder):
                    rows.append((root, path, *facts, None, None, False))
                    if len(rows) >= _ROWS:
                        yield frame(rows)
                        rows = []
            except Exception as error:
                # A root goes by the name it was given.
                shown = root if folder == full_form(root) else folder
                fatal = not isinstance(error, OSError)
                rows.append((root, shown, True, False, None, None, None, type(error).__name__, str(error), fatal))
        yield frame(rows)


def _digest(path: str) -> tuple[str | None, str | None]:
    try:
        digest = hashlib.sha256()
        name = local_name(path)
        if name is None:
            address, key = place_of(path)
            stream = _store(address).open_input_stream(key, buffer_size=_BLOCK)
        else:
            stream = open(bytes_of(name), "rb", buffering=0)
        with stream:
            while block := stream.read(_BLOCK):
                digest.update(block)
        return digest.hexdigest(), None
    except Exception as error:
        return None, f"{type(error).__name__}: {error}"


def hash_files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash each file block by block; a file that cannot be read yields its error instead."""
    for batch in batches:
        results = [_digest(path) for path in batch["full_path"]]
        yield batch[["root", "full_path"]].assign(
            content_hash=[digest for digest, _ in results], error=[error for _, error in results]
        )
