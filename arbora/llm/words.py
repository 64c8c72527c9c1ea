"""Word splitting on UTF-8 bytes, shared by the operators that work on words."""

from __future__ import annotations

from collections.abc import Iterator

#: Texts are split into slices of about this many bytes, so that a very long text never becomes one huge list.
BLOCK_BYTES = 1 << 22

_SPACE = b" \t\n\x0b\x0c\r"


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Slices of ``data`` that end where a word ends; a single word longer than ``size`` stays whole."""
    start, n = 0, len(data)
    while n - start > size:
        end = start + size
        while end < n and data[end] not in _SPACE:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_lists(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Runs of bytes other than space, tab, LF, VT, FF and CR: ``bytes.split`` splits on just these."""
    for part in blocks(data, size):
        yield part.split()
