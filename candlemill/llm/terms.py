"""Hashed terms of texts, and rows of them as index arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlemill.llm.common import labelled, per_batch, texts

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
KNOWN_WORDS = 500_000


class Known(dict):
    """A memory of what has been worked out for a word; it starts anew when full, which changes no result."""

    def __init__(self, find: Callable[[bytes], object], most: int = KNOWN_WORDS):
        self.find, self.most = find, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.find(word)
        return found


def bucket(term: bytes, seed: int = 0) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(term, seed) >> (32 - BUCKET_BITS)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, terms_of) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms and labels of a bounded sample (see ``labelled``), in the order of their ids."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.array([terms_of(t).astype(np.int32) for t in texts(batch)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), rows, batch.column(2)], ["id", "terms", "label"])

    found = labelled(docs, labels, label, most).mapInArrow(per_batch(run), "id string, terms array<int>, label int").toArrow()
    order = np.argsort(np.array(found["id"].to_pylist(), str), kind="stable")
    y = np.array(found["label"].to_pylist(), float)
    if not len(y):
        return [], y
    lists = found["terms"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[ends[i] : ends[i + 1]] for i in order], y[order]


def frequent(rows: list[np.ndarray], least: int) -> np.ndarray:
    """The buckets that occur in at least ``least`` of the rows, sorted."""
    if not rows:
        return np.zeros(0, np.int64)
    found, counts = np.unique(np.concatenate(rows), return_counts=True)
    return found[counts >= least]


def compact(rows: list[np.ndarray], vocabulary: np.ndarray) -> list[np.ndarray]:
    """The rows as places in the vocabulary; what is not in it goes."""
    place = np.full(BUCKETS, -1, np.int64)
    place[vocabulary] = np.arange(len(vocabulary))
    return [p[p >= 0] for p in (place[r] for r in rows)]
