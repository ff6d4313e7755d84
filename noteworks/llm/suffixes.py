"""Exact removal of repeated byte strings by induced suffix sorting, dealt to tasks by anchors.

Only order up to ``LENGTH`` bytes matters, so suffixes are sorted to that depth. Sampled suffixes come first: of
each window of ``LENGTH`` bytes the ``GRAM``-byte string with the least hash is its anchor, so equal windows have
equal anchors at equal offsets, and windows of one anchor can be sorted apart from all others. Inside an anchor's
class the suffixes that start at anchors are sorted, with their common prefixes; the order of suffixes one byte
further to the left is induced from the byte and the order before, recursively, until all windows are named.
Spark's external sort brings classes to the tasks in order, so a shard may be far larger than memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteworks.operators.ranking import global_index
from noteworks.session import cut_lineage

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
PIECE = 1 << 20  # bytes of a text in work at a time
HOLD = 1_000_000  # rows in work at a time


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``GRAM`` bytes."""
    word = data.astype(np.uint64)
    for shift in (1, 2, 4):
        word = word[:-shift] | (word[shift:] << np.uint64(8 * shift))
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for step in range(0, GRAM, 8):
        out = (out ^ word[step : step + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows with one anchor: hash of the anchor, first window, number of windows, place of the anchor."""
    hashes = gram_hashes(data)
    low = np.uint64((1 << 21) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    count = np.diff(np.concatenate((first, [len(place)])))
    anchor = place[first]
    return hashes[anchor].view(np.int64), first, count, anchor


NAMES = ["kind", "h", "whole", "pos", "start", "n", "back"]
ROW_TYPE = "kind int, h long, whole long, pos long, start long, n int, back int"
ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, ARROW[1:]))], NAMES)


def _merged(pos: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching or overlapping ranges of one text as one."""
    order = np.lexsort((start, pos))
    pos, start, end = pos[order], start[order], end[order]
    fresh = np.concatenate(([True], pos[1:] != pos[:-1])) if len(pos) else np.zeros(0, bool)
    group = np.cumsum(fresh)
    shift = group * (1 << 40)
    reach = np.maximum.accumulate(end + shift)
    fresh[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(pos)])) - 1
    return pos[first], start[first], (reach - shift)[last]


def _split_repeats(h, whole, pos, start, n, back) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that are equal as a whole the earliest, and the others."""
    order = np.lexsort((start, pos, n, back, whole, h))
    same = np.concatenate(([False], np.all([c[order][1:] == c[order][:-1] for c in (h, whole, back, n)], axis=0))) if len(h) else np.zeros(0, bool)
    return order[~same], order[same]


def _removed(pos, start, n) -> pa.RecordBatch:
    """Rows of kind 1: ranges to remove. Their hash is that of the text's place, to spread them."""
    p, s, e = _merged(pos, start, start + n + LENGTH - 1)
    zero = np.zeros(len(p), np.int64)
    return _rows(1, p * np.int64(0x5851F42D4C957F2D), zero, p, s, e - s, zero)


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all texts. Equal runs inside the task leave as one, the others are ranges to remove at once."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        keep, again = _split_repeats(*columns)
        yield _rows(0, *(c[keep] for c in columns))
        if len(again):
            yield _removed(*(c[again] for c in columns[2:5]))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for pos, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                raw = (text or "").encode()
                for low in range(0, len(raw) - LENGTH + 1, PIECE):
                    piece = raw[low : low + PIECE + LENGTH - 1]
                    h, first, count, anchor = runs(np.frombuffer(piece, np.uint8))
                    ends = (first + count + LENGTH - 1).tolist()
                    whole = np.array([digest(piece[a:b]) for a, b in zip(first.tolist(), ends)], np.uint64).view(np.int64)
                    held.append([h, whole, np.full(len(h), pos, np.int64), first + low, count, anchor - first])
                    size += len(h)
            if size >= HOLD:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _groups(batches: Iterator[pa.RecordBatch], key: str, hold: int) -> Iterator[pa.Table]:
    """Whole classes of equal keys, many at a time, from batches that come sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= hold:
            keys = rest.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield rest.slice(0, cut)
                rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all tasks: equal runs but the earliest go (kind 1); anchors with several different runs are sorted (kind 2)."""
    for table in _groups(batches, "h", 200_000):
        c = {n: table.column(n).to_numpy() for n in NAMES}
        ranges, run = c["kind"] == 1, c["kind"] == 0
        if ranges.any():
            yield _rows(1, *(c[n][ranges] for n in NAMES[1:]))
        columns = [c[n][run] for n in NAMES[1:]]
        keep, again = _split_repeats(*columns)
        if len(again):
            yield _removed(*(x[again].astype(np.int64) for x in columns[2:5]))
        kept = [x[keep] for x in columns]
        if len(keep):
            _, place, count = np.unique(kept[0], return_inverse=True, return_counts=True)
            several = count[place] > 1
            if several.any():
                yield _rows(2, *(x[several] for x in kept))


def _bytes_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the bytes of the wanted runs out of their texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for pos, blob, wanted in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                raw = unpack.decompress(blob)
                out += [(w["h"], pos, w["start"], w["n"], w["back"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in wanted]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["h", "pos", "start", "n", "back", "piece"])


def induce(h: np.ndarray, pieces: list[bytes], n: np.ndarray, back: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``[row, d]``: whether the window that starts ``d`` bytes before the row's anchor has an equal, earlier one."""
    rows, far = len(h), WINDOW
    right = [p[b:] for p, b in zip(pieces, back.tolist())]
    size = np.array([len(r) for r in right])
    wide = np.zeros((rows, LENGTH), np.uint8)
    for i, r in enumerate(right):
        wide[i, : min(len(r), LENGTH)] = np.frombuffer(r[:LENGTH], np.uint8)
    order = np.lexsort((*[wide[:, j : j + 4].copy().view(">u4").ravel() for j in range(LENGTH - 4, -1, -4)], h))
    h, wide, size, n, back, rank = h[order], wide[order], np.minimum(size[order], LENGTH), n[order], back[order], rank[order]
    differ = wide[1:] != wide[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.where(h[1:] == h[:-1], common, 0)
    left = np.zeros((rows, far), np.uint8)  # the bytes before the anchor, nearest first
    for row, i in enumerate(order.tolist()):
        b = int(back[row])
        left[row, :b] = np.frombuffer(pieces[i][:b], np.uint8)[::-1]
    name = np.zeros(rows, np.int64)
    out = np.zeros((rows, far), bool)
    for d in range(far):
        if d:
            _, name = np.unique(name << 8 | left[:, d - 1], return_inverse=True)  # induced: the byte, then the order before
        here = np.flatnonzero((back >= d) & (back - n < d))
        if not len(here):
            continue
        depth = LENGTH - d
        tail = np.concatenate(([0], np.cumsum((common < depth) | (h[1:] != h[:-1]))))
        key = tail[here] * rows + name[here]
        by = np.lexsort((rank[here], key))
        again = np.concatenate(([False], key[by][1:] == key[by][:-1]))
        out[here[by[again]], d] = True
    back_to = np.empty_like(order)
    back_to[order] = np.arange(rows)
    return out[back_to]


def _induce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, "h", 50_000):
        h, pos, start, n, back = (table.column(c).to_numpy() for c in ("h", "pos", "start", "n", "back"))
        place = np.lexsort((start + back, pos))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        found = induce(h, table.column("piece").to_pylist(), n.astype(np.int64), back.astype(np.int64), rank)
        row, d = np.nonzero(found)
        if len(row):
            first = start[row] + back[row] - d
            yield _removed(pos[row], first, np.ones(len(row), np.int64))


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            blobs = [pack.compress((t or "").encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), *part.columns[2:]], ["pos", "blob", *part.schema.names[2:]])


def cut_ranges(raw: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many runs."""
    out, at, gone, spans = [], 0, 0, 0
    for a, b in sorted((r["start"], r["start"] + r["n"]) for r in ranges or []):
        if a > at or not spans:
            out.append(raw[at:a])
            spans += 1
            at = a
        if b > at:
            gone += b - at
            at = b
    return b"".join([*out, raw[at:]]), gone, spans


OUT_TYPE = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_batches(keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for blob, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = unpack.decompress(blob)
                    kept, gone, spans = cut_ranges(raw, ranges)
                    out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_text]
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return work


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Per document what is left without bytes that lie in a repeated string of ``LENGTH`` bytes.

    The first occurrence (least key, then least place) stays. Texts are UTF-8 bytes, null is empty; what is left
    need not be valid UTF-8, so ``keep_text`` adds it as binary ``kept``. If keys repeat or are null, rows follow
    each other by key (null last) and text, and each row is a document of its own: the second of two equal rows
    goes whole. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    n, keys = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == keys and dict(rows.dtypes)["doc_id"] in ("int", "bigint", "smallint", "tinyint"):
        placed = rows.withColumn("pos", F.col("doc_id").cast("long"))
    else:
        placed = global_index(rows, [F.col("doc_id").asc_nulls_last(), "text"], "pos")
    found = placed.select("pos", "text").mapInArrow(_run_batches, ROW_TYPE)
    sorted_rows = found.repartition("h").sortWithinPartitions("h")
    classes = cut_lineage(sorted_rows.mapInArrow(_class_batches, ROW_TYPE))
    wanted = classes.where("kind = 2").groupBy("pos").agg(F.collect_list(F.struct("h", "start", "n", "back")).alias("wanted"))
    id_type = dict(rows.dtypes)["doc_id"]
    packed = placed.select("pos", "text", "doc_id").mapInArrow(_pack_batches, f"pos long, blob binary, doc_id {id_type}")
    pieces = packed.join(wanted, "pos").select("pos", "blob", "wanted").mapInArrow(
        _bytes_batches, "h long, pos long, start long, n int, back int, piece binary")
    induced = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_induce_batches, ROW_TYPE)
    ranges = classes.where("kind = 1").unionByName(induced).groupBy("pos").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    whole = packed.join(ranges, "pos", "left").select("doc_id", "blob", "ranges")
    return whole.mapInArrow(_cut_batches(keep_text), OUT_TYPE.format(id_type) + ", kept binary" * keep_text)
