"""Buckets of op7: anchors are dealt evenly, and buckets grow in number with the text."""

from __future__ import annotations

import numpy as np

from driftloom.llm import repeats


def test_leading_bits_deal_anchors_evenly():
    data = np.random.default_rng(0).integers(97, 123, 400_000).astype(np.uint8)
    anchor = repeats.anchors(data, np.array([0, len(data)]))[3]
    share = np.bincount((anchor >> np.uint64(58)).astype(np.int64), minlength=64) / len(anchor)
    assert share.max() < 0.03  # the smallest of 27 hashes begins with six zeros in a third of the windows


def test_buckets_do_not_grow_with_the_text():
    for size in (10**9, 6 * 10**9, 10**11):
        assert size / 2 ** repeats.bucket_bits(size, 12) <= repeats.BUCKET
    assert repeats.bucket_bits(0, 1) == 6
