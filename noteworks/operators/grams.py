"""Word runs of texts, made a batch of texts at a time: words are found in one walk over the characters of all texts
of a batch, and runs are numbers of words until they leave.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteworks import config

SLICE = 1 << 21  # bytes of text that are walked at once, a longer text alone
SLOT_BITS = 26  # slots of the hash of phrases that are kept
MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Rows from and to, so that a slice holds at most ``most`` bytes or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last


def find_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Text, start, end and word of each word. A word runs from the first to the last letter between characters that
    are no letters, apostrophes or hyphens; offsets count characters."""
    joined = "\n".join(t or "" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | ((code >= 192) & (code <= 255))
    run = np.zeros(len(code) + 2, np.int8)
    run[1:-1] = letter | (code == 39) | (code == 45)
    edge = np.diff(run)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(letter)
    first, last = np.searchsorted(at, start), np.searchsorted(at, stop)
    some = first < last  # runs without any letter hold no word
    start, stop = at[first[some]], at[last[some] - 1] + 1
    lengths = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    row = np.searchsorted(begins, start, side="right") - 1
    # The bytes of the words in a row, and where each begins among them.
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    mark = np.zeros(len(code) + 1, np.int8)
    mark[start] += 1
    mark[stop] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)[np.repeat(inside, width)]
    bytes_to = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    offsets = np.concatenate(([0], np.cumsum(bytes_to[stop] - bytes_to[start]))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return row, start - begins[row], stop - begins[row], words.dictionary_encode()


def _runs(row: np.ndarray, codes: np.ndarray, vocabulary: pa.Array, n: int) -> np.ndarray:
    """Places of the first words of the runs of ``n`` words that stay within a text; lone skip words are left out."""
    if n > 1:
        return np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    skip = np.array([w.lower() in config.SKIP_WORDS for w in vocabulary.to_pylist()], dtype=bool)
    return np.flatnonzero(~skip[codes]) if len(codes) else np.zeros(0, np.int64)


def _joined(vocabulary: pa.Array, parts: list[np.ndarray]) -> pa.Array:
    taken = [vocabulary.take(pa.array(p)) for p in parts]
    return pc.binary_join_element_wise(*taken, " ") if len(parts) > 1 else taken[0]


def _slots(hashes: list[np.ndarray]) -> np.ndarray:
    """Slot of a run from the hashes of its words."""
    mixed = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        mixed = (mixed + h + np.uint64(1)) * MIX
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in vocabulary.to_pylist()], dtype=np.uint64)


def phrase_batches(max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: texts to the phrases in them, each once a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for first, last in slices(texts):
                row, _, _, words = find_words(texts.slice(first, last - first).to_pylist())
                codes, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
                for n in range(1, max_n + 1):
                    at = _runs(row, codes, vocabulary, n)
                    key, parts = codes[at], [codes[at]]
                    for i in range(1, n):
                        # Numbers of runs are made dense before they are multiplied, so that no product overflows.
                        _, key = np.unique(key, return_inverse=True)
                        key, parts = key * len(vocabulary) + codes[at + i], [*parts, codes[at + i]]
                    once = np.unique(key, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([_joined(vocabulary, [p[once] for p in parts])], ["phrase"])

    return work


def gram_batches(max_n: int, slots: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: rows of key and text to ``(key, phrase, span_start, span_end)``. With ``slots``, one bit a slot
    of the hash, only phrases whose slot is set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                row, start, end, words = find_words(texts.slice(first, last - first).to_pylist())
                codes, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
                hashes = _hashes(vocabulary)[codes] if slots is not None and len(codes) else None
                for n in range(1, max_n + 1):
                    at = _runs(row, codes, vocabulary, n)
                    if hashes is not None:
                        slot = _slots([hashes[at + i] for i in range(n)])
                        at = at[(slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(row[at] + first)), _joined(vocabulary, [codes[at + i] for i in range(n)]),
                        pa.array(start[at].astype(np.int32)), pa.array(end[at + n - 1].astype(np.int32)),
                    ], [batch.schema.names[0], "phrase", "span_start", "span_end"])

    return work


def phrase_slots(phrases: DataFrame) -> np.ndarray:
    """The slots of the ``phrases``, one bit each. They are put together where the phrases are; 8 MB come back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(0), " ")
            many, flat = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
            hashes = _hashes(flat.dictionary)[flat.indices.to_numpy()]
            first = np.cumsum(many) - many
            for n in np.unique(many):
                of = first[many == n]
                yield pa.RecordBatch.from_arrays([pa.array(_slots([hashes[of + i] for i in range(n)]))], ["slot"])

    found = phrases.select("phrase").mapInArrow(work, "slot long")
    # Spark's bitmaps count from one and keep the first bit of a byte lowest.
    bits = found.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    slots = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for r in bits.collect():
        at = (r["bucket"] - 1) * 4096
        slots[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return slots
