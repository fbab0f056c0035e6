"""Cutting texts into chunks that tokenise independently.

With the pre-tokenising pattern of the public byte-level vocabularies, a single space between two
other characters always begins a new piece, and a single newline between two of them is a piece of
its own. So most texts can be cut there without the pattern, and each distinct chunk be
encoded once for a worker. Texts with any other white space go the ordinary way as a whole.
"""

from __future__ import annotations

#: White space other than single spaces and newlines, and what marks a line's first chunk.
_IRREGULAR = ["  ", "\n\n", " \n", "\n ", *"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", *map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def chunks(text: str) -> list[str] | None:
    """The text cut at its spaces and newlines, a line's first chunk marked by a null character; None if it has to be taken whole."""
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n":
        return None
    for odd in _IRREGULAR:  # much faster than a pattern
        if odd in text:
            return None
    return ("\0" + text.replace("\n", " \n \0")).split(" ")


def spelled(chunk: str) -> str:
    """What a chunk stands for: the space before it belongs to it, unless it begins a line or is a newline."""
    return chunk[1:] if chunk[0] == "\0" else chunk if chunk == "\n" else " " + chunk


class Cache:
    """Values by chunk, filled by ``make``, in two generations of ``limit`` entries together.

    When the younger is full it becomes the older, and what has stayed in the older unasked for is dropped: common chunks
    stay however many rare ones pass, and a worker's memory is bounded.
    """

    def __init__(self, make, limit: int = 500_000):
        self.make, self.most, self.young, self.old = make, limit // 2, {}, {}

    def of(self, texts: list[list[str]]) -> dict:
        """A table with the values of these texts' chunks, good until the next call; what is missing is made in one call."""
        found = set().union(*texts)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = found.difference(young)
        if missing:
            if old:
                young.update([(c, old[c]) for c in missing if c in old])
            missing = list(missing.difference(old))
            young.update(zip(missing, self.make(missing)))
        return young
