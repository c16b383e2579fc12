"""Arrays and words as compact bytes, for rows that carry many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Integers as differences from the smallest, in as many bytes as these need, and floats as they are; all first bytes, then all second ones and so on."""
    heads, bodies = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            low, width, value = 0, -a.dtype.itemsize, np.ascontiguousarray(a)
        else:
            low = int(a.min()) if len(a) else 0
            value = a.astype(np.int64) - low
            width = (int(value.max()).bit_length() + 7) // 8 if len(a) else 0
        heads += [len(a), low, width]
        bodies.append(value.view(np.uint8).reshape(len(a), value.itemsize)[:, : abs(width)].T.tobytes() if len(a) else b"")
    return squeezed(np.array(heads, np.int64).tobytes() + b"".join(bodies))


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack was given: floats in their width, integers in 32 bits if they fit."""
    raw = unsqueezed(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    heads = np.frombuffer(raw, np.int64, 3 * k, 8).reshape(k, 3).tolist()
    out, at = [], 8 + 24 * k
    for n, low, width in heads:
        planes = np.frombuffer(raw, np.uint8, n * abs(width), at).reshape(abs(width), n)
        at += planes.size
        if width < 0:
            kind = np.dtype(f"f{-width}")
        else:
            kind = np.dtype(np.int32 if width < 4 and abs(low) < 1 << 30 else np.int64)
        whole = np.zeros((n, kind.itemsize), np.uint8)
        whole[:, : abs(width)] = planes.T
        value = whole.view(kind).reshape(n)
        out.append(value if width < 0 else value + kind.type(low))
    return out


def pack_words(words: np.ndarray) -> bytes:
    """Words hold no line feed."""
    return squeezed("\n".join(words).encode())


def unpack_words(data: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([unsqueezed(data).decode()], pa.string()), pattern="\n").flatten()
