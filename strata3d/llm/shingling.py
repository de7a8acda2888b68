"""Word shingles of a text and their digests."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Salts that spread the rows of one value.
SALTS = 64
#: ASCII capitals to small letters, as a byte table; UTF-8 keeps other characters out of its way.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, size: int) -> list[bytes]:
    """UTF-8 shingles; bytes.split() cuts at exactly \\x20 and \\x09 to \\x0D."""
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def digests(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)], np.uint64)
