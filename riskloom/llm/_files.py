"""Files in the shared folder, as tasks see them: written under a hidden name, then moved into place."""

from __future__ import annotations

from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def make_folder(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the finished files of a folder."""
    store, path = at(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(suffix) and x.base_name[0] not in "._")


def rows(uri: str, names: list[str]) -> list[tuple]:
    """Columns of a folder of Parquet files, row by row, in order."""
    store, path = at(uri)
    files = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet")]
    table = pa.concat_tables(pq.read_table(x, columns=names, filesystem=store) for x in files)
    return sorted(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def total(uri: str) -> int:
    """Bytes of all files of a folder."""
    store, path = at(uri)
    return sum(x.size for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file)


@contextmanager
def writing(uri: str, name: str, token: str):
    """A stream whose file gets its name only when all is written; a repeated attempt replaces it."""
    store, path = at(uri)
    hidden = f"{path}/.{name}.{token}"
    stream = store.open_output_stream(hidden)
    try:
        yield stream
        stream.close()
        store.move(hidden, f"{path}/{name}")
    except BaseException:
        with suppress(Exception):
            stream.close()
            store.delete_file(hidden)
        raise
