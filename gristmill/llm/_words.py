"""Words of texts as arrays: `[^\\x20\\x09-\\x0D]+`, over bytes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the different words, the number of each word among them in order, how many words each text has).

    Texts together must be below 2 GiB. Different words have different numbers: words are compared, not hashes of them."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    blank = _BLANK[data]
    word = ~blank
    first = np.flatnonzero(word & np.append(True, blank[:-1])[: len(data)])
    after = np.flatnonzero(word & np.append(blank[1:], True)[: len(data)]) + 1
    offsets = np.append(0, np.cumsum(after - first)).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())])
    coded = own.dictionary_encode()
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    counts = np.diff(np.searchsorted(first, ends), prepend=0) if len(texts) else np.empty(0, np.int64)
    return coded.dictionary, coded.indices.to_numpy(), counts
