"""Sets of hashed word shingles, straight from text bytes.

Words are runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles of ``k`` words; a text
with fewer words has one shingle of all of them, a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textarrays import mix, word_hashes

_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; ``at`` starts at 0 and ends at ``len(data)``."""
    hashes, first = word_hashes(data, at)
    n = len(hashes)
    if n >= k:
        joined = hashes[: n - k + 1] * _STEPS[0]
        for i in range(1, k):
            joined += hashes[i : n - k + 1 + i] * _STEPS[i]
        joined = mix(joined)
    for a, e in zip(first[:-1], first[1:], strict=True):
        if e - a >= k:
            out = joined[a : e - k + 1].copy()
            out.sort()
            yield out[np.concatenate([[True], out[1:] != out[:-1]])]
        elif e > a:
            yield mix(np.array([(hashes[a:e] * _STEPS[: e - a]).sum(dtype=np.uint64) + np.uint64(e - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)

