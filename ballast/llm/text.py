"""Words of texts as UTF-8 bytes. All of these take whole texts; null has no words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(
    _LOWER[b] if b >= 128 or chr(b).isalnum() else 32
    for b in range(256)
)


def lower_alnum(text: bytes) -> bytes:
    """``text`` with A-Z lowered and a space for each ASCII byte that is no digit or letter; as long as ``text``."""
    return text.translate(_ALNUM)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and non-ASCII characters."""
    return text.translate(_ALNUM).split() if text else []


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z lowered."""
    return text.translate(_LOWER).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def spans_of(text: bytes) -> tuple[list[int], list[int]]:
    """Where the white-space-separated words of ``text`` start and end, in bytes."""
    ends, at, starts = [], 0, []
    for w in text.split():
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    return starts, ends


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values, another one for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of up to ``size`` of ``rows``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
