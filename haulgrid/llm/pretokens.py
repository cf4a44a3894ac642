"""Memo of text pieces shared by the two encoders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import repeat

#: Unicode white space, as the pattern's engines have it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class PieceMemo:
    """Little-endian unsigned 32-bit ids of whole texts, as bytes.

    A text is cut before every blank and line end. Where white space stands alone, no pre-token
    of the pattern crosses such a cut, so a piece (one blank or line end, then no white space)
    has the same ids whatever surrounds it; ``encode_pieces`` encodes those not held yet. A text
    with other white space or a run of it goes to ``encode_whole``, as does one that holds a
    string of ``apart``. Every text is given a line
    end in front, whose ids are taken off again, so its first piece is like any other.

    The memo is a pure speed-up of bounded size, in two generations: full, it becomes the old
    one, from which frequent pieces come back, and the former old one goes.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], encode_whole: Callable[[str], bytes],
                 limit: int = 200_000, apart: tuple[str, ...] = ()):
        self.apart = apart
        self.whole = re.compile(f"\n?[^{WHITE}]+").fullmatch
        self.encode_pieces, self.encode_whole, self.limit = encode_pieces, encode_whole, limit
        self.lead = len(encode_whole("\n"))
        self.known, self.old = {}, {}

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        return self.ids_many([text])[0]

    def ids_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; new pieces are encoded together for all of them."""
        if self.apart and (odd := {k for k, t in enumerate(texts) if any(a in t for a in self.apart)}):
            plain = iter(self.ids_many([t for k, t in enumerate(texts) if k not in odd]))
            return [self.encode_whole(t) if k in odd else next(plain) for k, t in enumerate(texts)]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old, get = self.known, self.old, self.known.get
        # the keys: pieces as they are after a line end, without their blank otherwise
        parts = [("\n" + t).replace("\n", " \n")[1:].split(" ") for t in texts]
        got = [[*map(get, p, repeat(b""))] for p in parts]
        holes = {k: [i for i, one in enumerate(ids) if not one] for k, ids in enumerate(got) if not all(ids)}
        fresh = []
        for p in dict.fromkeys([parts[k][i] for k, at in holes.items() for i in at]):
            if p in old:
                known[p] = old[p]
            elif self.whole(p):
                fresh.append(p)
        for k in range(0, len(fresh), 4096):
            some = fresh[k:k + 4096]
            known.update(zip(some, self.encode_pieces([p if p[0] == "\n" else " " + p for p in some]), strict=True))
        out = []
        for k, ids in enumerate(got):
            own = parts[k]
            for i in holes.get(k, ()):
                if (one := get(own[i])) is None:
                    out.append(self.encode_whole(texts[k]))
                    break
                ids[i] = one
            else:
                out.append(b"".join(ids)[self.lead:])
        return out


def in_groups(texts: list[str], chars: int = 300_000):
    """Consecutive slices of a list of texts, each of about so many characters or of one text."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[start:k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield texts[start:]
