"""Sorted arrays in files of the shared folder, which workers map into memory."""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

#: Files that a worker keeps open.
OPEN_FILES = 4096


def firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What puts keys in order, and where in that order each begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, as wide as the greatest one needs."""
    return x if x.dtype == np.uint64 else x.astype(np.min_scalar_type(int(x.max(initial=0))))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if m := re.fullmatch(r"file:/+(.*)", uri):
        return fs.LocalFileSystem(), "/" + m[1]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """A file of arrays, a set for each shard, and at its end where they are. It gets its name only when it is whole: a task
    that is run again just writes the same file."""

    def __init__(self, folder: str, name: str):
        self.store, path = place(folder)
        self.store.create_dir(path, recursive=True)
        self.part, self.path = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"
        self.out, self.at, self.index = self.store.open_output_stream(self.part), 0, {}

    def add(self, shard: int, **arrays: np.ndarray) -> None:
        own = self.index[shard] = {}
        for name, x in arrays.items():
            x = x if x.dtype == np.uint32 else narrow(x)  # 32 bits may be those of a float
            own[name] = (self.at, len(x), x.dtype.itemsize)
            raw = x.tobytes() + b"\0" * (-x.nbytes % 8)
            self.out.write(raw)
            self.at += len(raw)

    def close(self) -> None:
        end = json.dumps(self.index).encode()
        self.out.write(end + len(end).to_bytes(8, "little"))
        self.out.close()
        try:
            self.store.move(self.part, self.path)
        except OSError:  # some stores do not move onto a file that an earlier try has left: it is the same
            if self.store.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.store.delete_file(self.part)


class Reader:
    """The arrays of a file: mapped, or, from a store that cannot be mapped, read when they are asked for."""

    def __init__(self, folder: str, name: str):
        store, path = place(folder)
        path = f"{path}/{name}"
        self.mapped = np.memmap(path, np.uint8, "r") if isinstance(store, fs.LocalFileSystem) and os.path.getsize(path) else None
        self.file = None if self.mapped is not None else store.open_input_file(path)
        size = len(self.mapped) if self.file is None else self.file.size()
        n = int.from_bytes(self.bytes(size - 8, 8), "little")
        self.index = {int(k): v for k, v in json.loads(self.bytes(size - 8 - n, n)).items()}

    def bytes(self, at: int, n: int) -> bytes:
        return self.mapped[at : at + n].tobytes() if self.file is None else self.file.read_at(n, at)

    def arrays(self, shard: int) -> dict[str, np.ndarray]:
        out = {}
        for name, (at, n, width) in self.index.get(shard, {}).items():
            raw = self.mapped[at : at + n * width] if self.file is None else np.frombuffer(self.file.read_at(n * width, at), np.uint8)
            out[name] = raw.view(f"u{width}")
        return out


@lru_cache(maxsize=OPEN_FILES)
def reader_of(folder: str, name: str) -> Reader | None:
    try:
        return Reader(folder, name)
    except FileNotFoundError:  # nothing came to its shards
        return None
