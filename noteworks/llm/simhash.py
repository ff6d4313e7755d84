"""SimHash near-dedup with pivot distance tables.

References are fingerprints with known distances to all others. Two families are used:

* block references differ from a base only inside one of ``BLOCKS`` blocks of bits, so the difference of a
  fingerprint's distances to the two is its distance inside the block. Fingerprints that differ in ``REACH``
  bits agree in at least ``BLOCKS - REACH`` whole blocks, hence in all their coordinates there; each choice of
  blocks is a table, and only rows that share a table's coordinates can link.
* wide references cover all bits: by the triangle inequality a pair is discarded as soon as one coordinate
  differs by more than ``REACH``. What survives is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteworks.operators.clustering import connected_components
from noteworks.session import cut_lineage

SHINGLE = 3
SEED = 42
REACH = 3
BLOCKS = 6
WIDE_REFERENCES = 32
HASH_STEP = 1 << 15


def _bit_sums(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document (its hashes end at ``ends``) how many hashes have each bit."""
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.zeros((len(ends), 64), np.int64)
    for low in range(0, len(hashes), HASH_STEP):
        part = hashes[low : low + HASH_STEP]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(part), "left")
        for d in range(first, last):
            a, b = max(starts[d], low) - low, min(ends[d], low + len(part)) - low
            if b > a:
                sums[d] += bits[a:b].sum(axis=0, dtype=np.uint32)
    return sums


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of the shingle hashes have it; no word: zero."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    ends = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower and split touch ASCII only
        if len(parts) > SHINGLE:
            whole = b" ".join(parts)
            stops = np.cumsum([len(p) + 1 for p in parts]) - 1
            starts = np.concatenate(([0], stops[:-1] + 1))
            cuts = zip(starts[: len(parts) - SHINGLE + 1].tolist(), stops[SHINGLE - 1 :].tolist())
            hashes += [digest(whole[a:b], SEED) for a, b in cuts]
        elif parts:
            hashes.append(digest(b" ".join(parts), SEED))
        ends[row] = len(hashes)
    counts = np.diff(ends, prepend=0)
    bits = 2 * _bit_sums(np.array(hashes, np.uint64), ends) > counts[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        parts = [fingerprints_of(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
        prints = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(prints.view(np.int64))], [*batch.schema.names[1:], "print"])


def add_fingerprints(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every document and its fingerprint ``print`` as a signed long. Null text counts as empty."""
    picked = docs.select(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`") for c in columns])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(_fingerprint_batches, f"{ddl}, print long")


def block_masks() -> list[int]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def references(count: int = WIDE_REFERENCES) -> np.ndarray:
    """Wide references: fixed pseudo-random fingerprints."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, np.uint64)


def distance(prints: np.ndarray, reference: int) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(reference)).astype(np.int16)


def block_coordinates(prints: np.ndarray) -> np.ndarray:
    """Per block one number: the fingerprint's distances to the block's references, as digits.

    Each bit of a block has a reference; with the base they give (d(x, base) - d(x, ref) + 1) / 2 per bit.
    """
    base = distance(prints, 0)
    out = np.zeros((len(prints), BLOCKS), np.int64)
    for b, mask in enumerate(block_masks()):
        for bit in (i for i in range(64) if mask >> i & 1):
            inside = (base - distance(prints, 1 << bit) + 1) // 2
            out[:, b] = out[:, b] * 2 + inside
    return out


def table_keys(prints: np.ndarray) -> np.ndarray:
    """One key per table (choice of blocks that agree) for each fingerprint."""
    digits, keys = block_coordinates(prints), []
    for number, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - REACH)):
        key = np.full(len(prints), number, np.int64)
        for b in blocks:
            key = key << 11 | digits[:, b]
        keys.append(key)
    return np.stack(keys, axis=1)


def _keyed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = table_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(prints, keys.shape[1]))], ["key", "print"])


def spanning_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links that join, for each run of equal keys, what pairs within ``REACH`` join; at most one a row.

    Rows are compared at growing offsets inside their run. Runs that are already joined drop out, and a pair
    is verified only if no reference tells it apart.
    """
    label = np.arange(len(keys))
    marks = np.stack([distance(prints, int(r)) for r in references()], axis=1)
    run = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))) if len(keys) else label
    sizes = np.bincount(run)
    open_rows, step = np.flatnonzero(sizes[run] > 1), 1
    while len(open_rows):
        left = open_rows[open_rows + step < len(keys)]
        left = left[run[left] == run[left + step]]
        open_rows = left
        left = left[label[left] != label[left + step]]
        for column in marks.T:
            left = left[np.abs(column[left] - column[left + step]) <= REACH]
        left = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= REACH]
        for a, b in zip(left.tolist(), (left + step).tolist()):
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
        if len(left):
            while (label[label] != label).any():
                label = label[label]
            open_rows = open_rows[~_joined_runs(label, sizes)[run[open_rows]]]
        step += 1
    changed = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([prints[changed], prints[label[changed]]], axis=1)


def _joined_runs(label: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether all rows of a run have one label."""
    starts = np.cumsum(sizes) - sizes
    return np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by key; the last run of a batch waits for the next one."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def out(links: np.ndarray) -> pa.RecordBatch:
        pairs = np.ascontiguousarray(links).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(parts) for parts in zip(*waiting))

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        last = np.searchsorted(keys, keys[-1], "left")
        if waiting and (last or keys[0] != waiting[0][0][0]):  # the run that waits ends here
            begun = np.searchsorted(keys, waiting[0][0][0], "right") if keys[0] == waiting[0][0][0] else 0
            waiting.append((keys[:begun], prints[:begun]))
            yield out(spanning_links(*joined()))
            waiting.clear()
            if begun < last:
                yield out(spanning_links(keys[begun:last], prints[begun:last]))
        elif last:
            yield out(spanning_links(keys[:last], prints[:last]))
        waiting.append((keys[last:], prints[last:]))
    if waiting:
        yield out(spanning_links(*joined()))


def link_prints(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``print`` to ``print, root``: the least fingerprint reachable by links."""
    keyed = prints.select("print").mapInArrow(_keyed_batches, "key long, print long")
    mates = F.count("*").over(Window.partitionBy("key"))
    met = keyed.withColumn("_n", mates).where("_n > 1").select("key", "print")
    links = cut_lineage(met.mapInArrow(_link_batches, "a long, b long").distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = connected_components(cut_lineage(ends), links)
    return prints.join(labels.withColumnRenamed("id", "print"), "print", "left").select(
        "print", F.coalesce("label", "print").alias("root"))


def near_duplicates(docs: DataFrame, columns: list[str] = ["doc_id"], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``columns`` (with ``key``) of every document, its fingerprint in hex and the least key of its component.

    Equal fingerprints link like any others, so copies share a component without being paired. Null and empty
    texts have fingerprint zero. Null keys are never the least; repeated rows are kept. An empty table gives no
    rows.
    """
    marked = cut_lineage(add_fingerprints(docs, columns, text))
    firsts = cut_lineage(marked.groupBy("print").agg(F.min(key).alias("_first")))
    roots = cut_lineage(firsts.join(link_prints(firsts), "print"))
    least = roots.groupBy("root").agg(F.min("_first").alias("component_id"))
    component = roots.join(least, "root").select("print", "component_id")
    return marked.join(component, "print").select(
        *columns, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
