"""Texts as streams of pieces, for texts that no task should hold as one value."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from tempfile import SpooledTemporaryFile

#: Bytes of a group of values that are held in memory, and characters of a piece.
IN_MEMORY, PIECE = 32 << 20, 1 << 16


class SlotValues:
    """The values of named slots, each added in pieces and read any number of times.

    What does not fit into memory goes to a file of the task that nothing else reads.
    """

    def __init__(self, in_memory: int = IN_MEMORY):
        self.file = SpooledTemporaryFile(in_memory)
        self.spans: dict[str, list[tuple[int, int]]] = {}
        self.end = 0

    def add(self, slot: str, text: str) -> None:
        data = text.encode()
        self.file.seek(self.end)
        self.file.write(data)
        spans = self.spans.setdefault(slot, [])
        if spans and spans[-1][1] == self.end:
            spans[-1] = (spans[-1][0], self.end + len(data))
        else:
            spans.append((self.end, self.end + len(data)))
        self.end += len(data)

    def is_empty(self, slot: str) -> bool:
        return not any(end > start for start, end in self.spans.get(slot, ()))

    def pieces(self, slot: str) -> Iterator[str]:
        for start, end in self.spans.get(slot, ()):
            decoder = codecs.getincrementaldecoder("utf-8")()
            while start < end:
                self.file.seek(start)
                data = self.file.read(min(PIECE, end - start))
                start += len(data)
                yield decoder.decode(data, final=start == end)

    def close(self) -> None:
        self.file.close()


def replaced(pieces: Iterable[str], token: str, value: Callable[[], Iterable[str]]) -> Iterator[str]:
    """The text with each ``token`` replaced, also where it lies across pieces.

    As with `str.replace`, tokens are found in the text that comes in, not in what goes out.
    """
    held = ""
    for piece in pieces:
        text, at = held + piece, 0
        while (hit := text.find(token, at)) >= 0:
            yield text[at:hit]
            yield from value()
            at = hit + len(token)
        cut = text.find(token[0], max(at, len(text) - len(token) + 1))
        while cut >= 0 and not token.startswith(text[cut:]):
            cut = text.find(token[0], cut + 1)
        cut = len(text) if cut < 0 else cut
        if cut > at:
            yield text[at:cut]
        held = text[cut:]
    if held:
        yield held


def folded(pieces: Iterable[str]) -> Iterator[str]:
    """The text with three or more newlines folded to two, also across pieces."""
    newlines = 0
    for piece in pieces:
        rest = piece.lstrip("\n")
        newlines += len(piece) - len(rest)
        if rest:
            yield "\n" * min(newlines, 2)
            body = rest.rstrip("\n")
            newlines = len(rest) - len(body)
            yield re.sub("\n{3,}", "\n\n", body)
    yield "\n" * min(newlines, 2)


def evenly(pieces: Iterable[str], size: int = PIECE) -> Iterator[str]:
    """The same text in pieces of ``size`` characters; the last is shorter, none is empty."""
    held: list[str] = []
    length = 0
    for piece in pieces:
        held.append(piece)
        length += len(piece)
        if length >= size:
            text = "".join(held)
            full = length - length % size
            for at in range(0, full, size):
                yield text[at : at + size]
            held, length = [text[full:]], length - full
    if length:
        yield "".join(held)
