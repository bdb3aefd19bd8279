"""Word rules that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import memo

#: A-Z in lower case; 0-9, a-z and all bytes beyond ASCII as they are; a space for the rest.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MEMO = 1 << 16
_ids = memo()


def plain_words(text: bytes) -> list[bytes]:
    """Maximal runs outside 00-2F, 3A-60 and 7B-7F, A-Z lower-cased."""
    return text.translate(PLAIN).split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; the memo is emptied when it is large."""
    if len(_ids) > MEMO:
        _ids.clear()
    out = []
    for w in words:
        h = _ids.get(w)
        if h is None:
            h = _ids[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)
