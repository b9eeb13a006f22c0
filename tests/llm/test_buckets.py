"""op3: what a group of counts holds in a worker."""

import time

import numpy as np

from lodestar.llm import suffix_tree_lm as L


def test_a_bucket_of_counts_is_small():
    assert L.BUCKET <= 1 << 20  # a group of four million tokens took hundreds of megabytes of a worker


def test_packed_codes_are_small_and_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000, 100_000):
        codes = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (L._codes(L._packed(codes, 8), 8) == codes).all()
        assert (L._codes(L._packed(codes)) == codes >> np.uint64(16) << np.uint64(16)).all()
        values = rng.random(n).astype("<f4")
        assert (L._values(L._packed_values(values)) == values).all()
    assert len(L._packed(codes)) < 5 * n  # six bytes each before


def test_distinct_codes_by_sorting():
    """A million distinct codes; np.unique hashes them and takes seconds."""
    codes = np.random.default_rng(2).integers(0, 1 << 64, 3_000_000, dtype=np.uint64)
    start = time.process_time()
    assert len(L._set(np.append(codes, codes))) == len(codes) and len(L._set(codes[:0])) == 0
    assert time.process_time() - start < 2


def test_values_are_counted_in_double_precision():
    held = L.Codes(np.array([1 << 40, 1 << 50, 1 << 60], np.uint64), np.array([1, 3, 7], np.float32))
    found = held.get(np.array([1 << 50, 5, 1 << 60], np.uint64), 0.0)
    assert found.dtype == np.float64 and found.tolist() == [3, 0, 7]


def test_keys_go_by_bucket_and_keep_48_bits():
    tree = L.Tree([(L.END, 3)], 5 * L.BUCKET, 9, 1, 1)
    codes = np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64)
    bucket = np.arange(1000, dtype=np.uint64) % np.uint64(tree.buckets)
    keys = tree.keys(codes, bucket)
    bits = np.uint64(tree.buckets.bit_length())
    assert tree.buckets == 6 and (keys >> np.uint64(64) - bits == bucket).all()
    assert (keys << bits >> np.uint64(16) == codes >> np.uint64(16)).all()
