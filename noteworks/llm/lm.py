"""LM scoring by deleted interpolation of unigram and bigram estimates.

Documents are read once into blocks: token ids and the hashes of the block's distinct tokens. Each block asks the
owners of its n-grams (n-grams are dealt by hash) for their counts in all training texts; asks carry each distinct
n-gram of a block once, sorted and packed, and answers are aligned with them. With the answers a block is complete:
it yields the statistics for the weights, and then the scores. Mixture weights depend on the context's frequency
bucket and are learned by expectation-maximisation on counts from which the event itself is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteworks.session import cut_lineage

BLOCK_TOKENS = 2_000_000
OWNER_KEYS = 1_000_000
BUCKETS = 64
STEPS = 2  # of a doubling, for the ratios that expectation-maximisation sees
OFFSET = 128
ROUNDS = 100
END_HASH = np.uint64(0x5BD1E9955BD1E995)


def _zip(array: np.ndarray) -> bytes:
    """Packed by byte planes, so that high bytes, which are mostly zero, take no room."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


BLOCK_TYPE = "block long, docs array<long>, held array<boolean>, sizes array<int>, ids binary, vocab binary"


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0

    def packed(docs, held, sizes, ids, words):
        vocab = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        vocab[0] = END_HASH
        row = {"block": [part << 24 | number], "docs": [docs], "held": [held], "sizes": [sizes],
               "ids": [_zip(np.concatenate(ids))], "vocab": [vocab.tobytes()]}
        return pa.RecordBatch.from_pydict(row, pa.schema([
            ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("vocab", pa.binary())]))

    docs, held, sizes, ids, words, tokens = [], [], [], [], _Ids({b"": 0}), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for doc, out, text in zip(*(c.to_pylist() for c in piece.columns)):
                parts = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(np.array([*map(words.__getitem__, parts), 0], np.int32))
                docs.append(doc)
                held.append(out)
                sizes.append(len(parts) + 1)
                tokens += len(parts) + 1
                if tokens >= BLOCK_TOKENS:
                    yield packed(docs, held, sizes, ids, words)
                    docs, held, sizes, ids, words, tokens = [], [], [], [], _Ids({b"": 0}), 0
                    number += 1
    if docs:
        yield packed(docs, held, sizes, ids, words)


class Block:
    """The n-grams of a block. A text begins in the context of an end, as the one before it ended."""

    def __init__(self, row: dict):
        self.docs, self.held, self.sizes = row["docs"], np.array(row["held"], bool), np.array(row["sizes"])
        self.tokens, vocab = _unzip(row["ids"], np.int32).astype(np.int64), np.frombuffer(row.get("vocab", b""), np.uint64)
        context = np.concatenate(([0], self.tokens[:-1]))
        learn = np.repeat(~self.held, self.sizes)
        width = len(vocab) if "vocab" in row else int(row["width"])
        codes, self.pair = np.unique(context * width + self.tokens, return_inverse=True)
        self.first, self.second = codes // width, codes % width
        self.counts = {1: np.bincount(self.tokens[learn], minlength=width), 2: np.bincount(self.pair[learn], minlength=len(codes))}
        if "vocab" not in row:  # the counts in all texts are there, so hashes have served their purpose
            self.totals = {1: _unzip(row["one"], np.int64), 2: _unzip(row["two"], np.int64)}
            return
        a, b = vocab[self.first], vocab[self.second]
        mixed = (a * np.uint64(0x9E3779B185EBCA87)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        self.keys = {1: vocab, 2: (mixed ^ (mixed >> np.uint64(32))) & ~np.uint64(255)}  # pairs: 56 bits
        self.order = {k: np.argsort(v, kind="stable") for k, v in self.keys.items()}

    def sums(self, answers: list[dict]) -> dict[int, np.ndarray]:
        """Counts in all training texts, from the answers of all owners."""
        out = {}
        for kind in (1, 2):
            parts = [_unzip(a["extra"], np.int64) for a in sorted(answers, key=lambda a: a["owner"]) if a["kind"] == kind]
            total = self.counts[kind].copy()
            total[self.order[kind]] += np.concatenate(parts)
            out[kind] = total
        return out


def _ask_batches(owner_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out = Block(row), []
                for kind in (1, 2):
                    order = block.order[kind]
                    keys, counts = block.keys[kind][order], block.counts[kind][order].astype(np.int64)
                    owner = (keys >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for k, n, o in zip(np.split(keys, cuts), np.split(counts, cuts), owner[np.concatenate(([0], cuts))]):
                        gaps = np.concatenate((k[:1], np.diff(k)))
                        out.append((int(o), kind, row["block"], _zip(gaps), _zip(n)))
                names = ["owner", "kind", "block", "keys", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names)

    return work


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """One owner: sum the counts of its n-grams over all blocks; each block gets what the others have."""
    out = []
    owner = int(group["owner"].iloc[0])
    for kind, rows in group.groupby("kind"):
        keys = [np.cumsum(_unzip(b, np.uint64), dtype=np.uint64) for b in rows["keys"]]
        counts = [_unzip(b, np.int64) for b in rows["counts"]]
        flat = np.concatenate(counts)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=flat, minlength=len(distinct)).astype(np.int64)
        extra = total[place] - flat
        at = 0
        for block, n in zip(rows["block"], map(len, keys)):
            out.append((int(block), owner, int(kind), _zip(extra[at : at + n]), 0, 0))
            at += n
        if kind == 1:
            out.append((-1, owner, 1, b"", int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(out, columns=["block", "owner", "kind", "extra", "known", "tokens"])


READY_TYPE = "docs array<long>, held array<boolean>, sizes array<int>, ids binary, width long, one binary, two binary"


def _ready_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their n-grams in all training texts, in place of hashes and answers."""
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            row = part.to_pylist()[0]
            total = Block(row).sums(row["answers"])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("docs", "held", "sizes", "ids")), pa.array([len(total[1])], pa.int64()),
                 pa.array([_zip(total[1])], pa.binary()), pa.array([_zip(total[2])], pa.binary())],
                ["docs", "held", "sizes", "ids", "width", "one", "two"])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of the binary logarithm of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _statistic_batches(tokens: int, known: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(share: np.ndarray) -> np.ndarray:
            ratio = share * (known + 1)
            return np.where(ratio > 0, np.round(STEPS * np.log2(np.maximum(ratio, 1e-15))) + OFFSET, 0).astype(np.int64)

        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                t, n = b.totals, b.counts[2]
                c1, c2 = t[1][b.first] - 1, t[1][b.second] - 1  # the event itself is deleted
                two = np.where(c1 > 0, (t[2] - 1) / np.maximum(c1, 1), 0)
                code = (bucket(c1) << 20 | step(two) << 10 | step(c2 / max(tokens - 1, 1)))[n > 0]
                kinds, place = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(place, weights=n[n > 0]).astype(np.int64))], ["code", "n"])

    return work


def learn_weights(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of uniform, unigram and bigram estimates for each bucket, by expectation-maximisation."""
    def ratio(step: np.ndarray) -> np.ndarray:
        return np.where(step > 0, 2.0 ** ((step - OFFSET) / STEPS), 0.0)

    parts = np.stack([np.ones(len(codes)), ratio(codes & 1023), ratio(codes >> 10 & 1023)], axis=1)
    at = codes >> 20
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen = np.bincount(at, weights=counts, minlength=BUCKETS) > 0
    for _ in range(ROUNDS):
        share = parts * weights[at]
        share *= (counts / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(at, weights=share[:, i], minlength=BUCKETS) for i in range(3)], axis=1)
        weights[seen] = np.maximum(sums[seen] / sums[seen].sum(axis=1, keepdims=True), 1e-9)
    for empty in np.flatnonzero(~seen):
        near = np.flatnonzero(seen)
        weights[empty] = weights[near[np.abs(near - empty).argmin()]] if len(near) else (1.0, 0.0, 0.0)
    weights[0, 2] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def _score_batches(tokens: int, known: int, weights: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                t = b.totals
                c1, c2 = t[1][b.first], t[1][b.second]
                w = weights[bucket(c1)]
                p = w[:, 0] / (known + 1) + w[:, 1] * c2 / max(tokens, 1) + w[:, 2] * t[2] / np.maximum(c1, 1)
                starts = np.concatenate(([0], np.cumsum(b.sizes)[:-1]))
                score = np.add.reduceat(np.log10(p)[b.pair], starts)
                base = np.add.reduceat(np.log10((t[1] + 1) / (tokens + known + 1))[b.tokens], starts)
                met = np.add.reduceat((t[1] > 0)[b.tokens].astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.docs, pa.int64()), pa.array(b.held), pa.array(b.sizes, pa.int64()), pa.array(met),
                     pa.array(np.full(len(b.docs), tokens)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return work


def score_texts(docs: DataFrame) -> DataFrame:
    """``docs`` has ``doc_id`` (long), ``text`` and ``held_out``; learns from the others, scores all.

    Null counts as empty, which is the one token that ends every text; null ids and repeated rows are rows like
    others; with nothing to learn from all tokens are equally unlikely; an empty table gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce("held_out", F.lit(False)), F.col("text").cast("string"))
    blocks = cut_lineage(picked.mapInArrow(_block_batches, BLOCK_TYPE))
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    owner_bits = max(0, math.ceil(math.log2(max(size, 1) / OWNER_KEYS)))
    asks = blocks.mapInArrow(_ask_batches(owner_bits), "owner long, kind int, block long, keys binary, counts binary")
    answers = cut_lineage(asks.groupBy("owner").applyInPandas(
        _answer, "block long, owner long, kind int, extra binary, known long, tokens long"))
    known, tokens = (int(v or 0) for v in answers.where("block < 0").agg(F.sum("known"), F.sum("tokens")).first())
    given = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("owner", "kind", "extra")).alias("answers"))
    ready = cut_lineage(blocks.join(given, "block").mapInArrow(_ready_batches, READY_TYPE))
    # At most BUCKETS * 1024 * 1024 kinds, in practice a few ten thousand: rounded ratios, whatever the corpus.
    kinds = ready.mapInArrow(_statistic_batches(tokens, known), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(kinds["code"].to_numpy(np.int64), kinds["n"].to_numpy(np.float64))
    return ready.mapInArrow(_score_batches(tokens, known, weights),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
