"""Arrays in files of the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np

_MAPS: dict[str, np.ndarray] = {}


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def save_array(folder: str, name: str, values: np.ndarray) -> str:
    """Store an array under a name of its own, so repeated tasks never share a file."""
    filesystem, at = _opened(f"{folder}/{name}-{uuid.uuid4().hex}.npy")
    filesystem.create_dir(os.path.dirname(at), recursive=True)
    with filesystem.open_output_stream(at) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(values))
        out.write(np.ascontiguousarray(values).data if len(values) else b"")
    return f"{folder}/{os.path.basename(at)}"


def mapped(path: str) -> np.ndarray:
    """The array, mapped into memory. Files of a remote store are mapped from a nameless copy."""
    if path not in _MAPS:
        from pyarrow import fs

        filesystem, at = _opened(path)
        if isinstance(filesystem, fs.LocalFileSystem):
            with open(at, "rb") as f:
                _MAPS[path] = _map(f)
        else:
            with filesystem.open_input_stream(at) as source, tempfile.TemporaryFile() as f:
                while block := source.read(1 << 22):
                    f.write(block)
                f.seek(0)
                _MAPS[path] = _map(f)
    return _MAPS[path]


def _map(f) -> np.ndarray:
    np.lib.format.read_magic(f)
    shape, _, dtype = np.lib.format.read_array_header_1_0(f)
    if not shape[0]:
        return np.zeros(0, dtype)
    return np.memmap(f, dtype=dtype, mode="r", offset=f.tell(), shape=shape)


def forget(keep: str) -> None:
    """Close the maps of all other folders."""
    for path in [p for p in _MAPS if not p.startswith(keep)]:
        del _MAPS[path]


def in_planes(values: np.ndarray) -> bytes:
    """Bytes of whole numbers with equal places side by side: leading zeros compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)
