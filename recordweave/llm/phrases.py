"""Prefix-free parsing of byte texts by rolling-hash triggers.

A trigger is the position of the least rolling hash (leftmost on ties) among the TRIGGER-byte strings of a window of
MATCH bytes.  Consecutive windows with one trigger make a phrase: the bytes that these windows cover.  Whatever MATCH
bytes two texts share, both parse them with the same trigger at the same place, so equal windows always lie in phrases
of one trigger string, and comparing phrases trigger by trigger misses nothing.

A string that very many phrases would have as their trigger makes a poor one.  Such strings can be given as ``common``:
they come last in the order, so a window has one as its trigger only where it holds nothing else.  The trigger still
follows from the window's bytes alone.
"""

from __future__ import annotations

MATCH, TRIGGER = 50, 20
_WINDOW = MATCH - TRIGGER + 1
_BASE = 0x9E3779B97F4A7C15
#: Bytes parsed at a time.  A longer text is parsed in pieces that overlap by MATCH - 1 bytes: a phrase may end at their
#: border, which only makes two phrases of one trigger out of one.
PIECE = 1 << 22
_PLACE_BITS = 23


class Parser:
    """Parses many texts at once; arrays for powers grow with the longest buffer."""

    def __init__(self, seed: int = 77, common=()):
        import numpy as np

        self.common = np.sort(np.asarray(common, np.uint64))
        draw = np.random.default_rng(seed)
        self.codes = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int):
        import numpy as np

        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down

    def sums(self, data):
        """Prefix sums from which the hash of any substring follows."""
        import numpy as np

        _, down = self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * down[: len(data)], out=out[1:])
        return out

    def hashes(self, sums, start, length):
        """Hashes of the substrings at ``start`` (array) of ``length`` (number or array)."""
        import numpy as np

        x = (sums[start + length] - sums[start]) * self.up[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def parse(self, texts: list[bytes]):
        """(text index, start in the text, windows, trigger hash, phrase hash) of all phrases, in order; all arrays.

        Texts of less than MATCH bytes have none.  Together the texts hold PIECE bytes at most, or it is one text.
        """
        import numpy as np

        if len(texts) == 1 and len(texts[0]) > PIECE:
            parts = []
            for at in range(0, len(texts[0]) - MATCH + 1, PIECE - MATCH + 1):
                text, start, *rest = self._parse([texts[0][at : at + PIECE]])
                parts.append((text, start + at, *rest))
            return tuple(map(np.concatenate, zip(*parts, strict=True)))
        return self._parse(texts)

    def _parse(self, texts: list[bytes]):
        import numpy as np

        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        begin = np.cumsum(lengths) - lengths
        if n < MATCH:
            none = np.empty(0, np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        sums = self.sums(data)
        grams = n - TRIGGER + 1
        x = (sums[TRIGGER:] - sums[:grams]) * self.up[:grams]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        place = np.uint64((1 << _PLACE_BITS) - 1)
        least = (x & ~place) | np.arange(grams, dtype=np.uint64)
        if len(self.common):
            near = self.common[np.minimum(np.searchsorted(self.common, x), len(self.common) - 1)] == x
            least[near] |= ~place
        width = 1
        while 2 * width <= _WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = _WINDOW - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        trigger = (least & place).view(np.int64)
        windows = n - MATCH + 1
        inside = np.zeros(windows + 1, np.int8)
        long = lengths >= MATCH
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, (begin + lengths)[long] - MATCH + 1, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        fresh = np.empty(windows, bool)
        fresh[0] = True
        fresh[1:] = (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1])
        edges = np.append(np.flatnonzero(fresh), windows)
        start, count = edges[:-1], np.diff(edges)
        keep = inside[start]
        start, count = start[keep], count[keep]
        size = count + (MATCH - 1)
        phrase = self.hashes(sums, start, size) ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        text = np.searchsorted(begin, start, "right") - 1
        return text, start - begin[text], count, x[trigger[start]], phrase


def suffixes_of(pieces: list[bytes]):
    """The suffixes of MATCH bytes and more of the pieces: their first MATCH bytes, and the piece and offset of each."""
    import numpy as np

    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - MATCH + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(piece):
        return np.empty((0, 7), ">u8"), piece, offset
    head = np.zeros((len(piece), 56), np.uint8)
    head[:, :MATCH] = np.lib.stride_tricks.sliding_window_view(data, MATCH)[begin[piece] + offset]
    return head.view(">u8"), piece, offset
