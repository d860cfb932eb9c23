"""Hashed word n-grams of batches of texts, for the language models."""

from __future__ import annotations

FACTOR = 0x9E3779B97F4A7C15 | 1


def word_hashes(texts):
    """(hashes of all words of the texts in order, number of words of each text). A word is
    a run without white space (space, U+0009..U+000D); a null text has none."""
    import numpy as np
    import xxhash

    parts = []
    for t in texts:  # one text's words at a time, as they take far more room than hashes
        words = (t or "").encode("utf-8", "surrogatepass").split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


def mix(x):
    """A bijection of 64-bit numbers that spreads their bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_keys(hashes, order: int):
    """64-bit keys of the n-grams that end at each word, regardless of text borders: the
    first ``order - 1`` words of a text have none that count."""
    import numpy as np

    out = np.full(len(hashes), order, np.uint64)
    for back in range(order - 1, -1, -1):
        word = hashes if back == 0 else np.concatenate([np.zeros(min(back, len(hashes)), np.uint64), hashes[:-back]])
        out = out * np.uint64(FACTOR) + word
    return mix(out)


def places(sizes):
    """Place of each word in its text, from 0."""
    import numpy as np

    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first, sizes)


def distinct(x):
    """Sorted distinct numbers. Where no indices are asked for, np.unique hashes, which takes
    many times as long as a sort."""
    import numpy as np

    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def grouped(x):
    """Sorted distinct numbers, the place of every number in them, and the index of one of each."""
    import numpy as np

    order = x.argsort()
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], at, order[new]
