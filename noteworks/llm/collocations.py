"""Phrase collocations from FM-indexes of word ids.

Texts of one language are cut into shards of word ids. A shard's index is the Burrows-Wheeler transform of its ids and
that of the reversed ids, sorted to the depth of the longest phrase. A phrase is a pair of row intervals, one in each;
it grows by a word on either side by a step in one transform, and the other interval follows. Shards list phrases with
their counts and Spark adds them up. A phrase can only be frequent if its words and word pairs are, so shards first
report words, then pairs of frequent words, then phrases of three words made of frequent pairs, and so on: nothing
frequent is lost, and what is not frequent is a gap before the transforms are made. Before the round of three words
every shard counts its windows of three words in slots of a hash; a window whose slot stays below the threshold in the
whole language is not frequent and is a gap, too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteworks.session import cut_lineage

DEPTH = 5
LEAST = 100
TOP = 2000
SHARD_WORDS = 1 << 21
UNKNOWN = "und"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"

BREAK = 0  # the id between pieces; words count from 1
SHARD_BITS, WORD_BITS = 12, 25
SLOT_SIZE = 3  # words of the windows that are counted in slots
SLOT_BITS, SLOT_WORDS = (16, 24), 4  # least and most slots (as powers of two), and words of a language a slot
PART_BITS = 16  # slots that travel in one row, at most

SHARD = "shard long, lang string, words long, vocab array<binary>, counts array<long>, ids binary, marks binary"


def _table() -> bytes:
    """Bytes folded: A-Z lowered, tabs to spaces, separators to line feeds."""
    out = bytearray(range(256))
    out[65:91] = bytes(range(97, 123))
    out[9] = 32
    for c in SEPARATORS:
        out[c] = 10
    return bytes(out)


def sort_rows(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Start positions sorted by their next ``depth`` ids (breaks follow the end), by doubling."""
    place, done = ids.astype(np.int64), 1

    def after(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((x[by:], np.zeros(min(by, len(x)), np.int64)))

    order = np.arange(len(ids))
    while done < depth:
        by = min(done, depth - done)
        key = place * (int(place.max(initial=0)) + 1) + after(place, by)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) if len(ids) else 0
        done += by
    return order


def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each start position, in row order."""
    return np.roll(ids, 1)[sort_rows(ids)].astype(np.int32)


class Intervals:
    """Phrases of one length: words (a row each), and the first row and row count in both transforms."""

    def __init__(self, words: np.ndarray, forward: np.ndarray, backward: np.ndarray, count: np.ndarray):
        self.words, self.forward, self.backward, self.count = words, forward, backward, count

    def keep(self, which: np.ndarray) -> Intervals:
        return Intervals(self.words[which], self.forward[which], self.backward[which], self.count[which])


class Index:
    """Transforms of a shard's ids, each made when first asked for: ``left`` has the id before a row's text, ``right``
    (of the reversed ids) the id after it."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.base = int(ids.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=self.base))))
        self._before: dict[str, np.ndarray] = {}
        self._next: dict[str, np.ndarray] = {}

    def before(self, side: str) -> np.ndarray:
        if side not in self._before:
            self._before[side] = transform(self.ids if side == "left" else self.ids[::-1])
        return self._before[side]

    def step(self, side: str) -> np.ndarray:
        """Row to which the id of each row leads (its rank among equal ids, behind all smaller ids)."""
        if side not in self._next:
            order = np.argsort(self.before(side), kind="stable")
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            self._next[side] = to
        return self._next[side]

    def words(self, which: np.ndarray) -> Intervals:
        """The intervals of single words."""
        first, count = self.starts[which], self.starts[which + 1] - self.starts[which]
        return Intervals(which[:, None], first, first, count)

    def neighbours(self, phrases: Intervals, side: str, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words (of those ``wanted``) next to each phrase: place of the phrase, word, count, the rows of the
        phrase's interval with smaller ids, and the first row that has the word."""
        own = phrases.forward if side == "left" else phrases.backward
        group = np.repeat(np.arange(len(own)), phrases.count)
        before = np.cumsum(phrases.count) - phrases.count
        rows = np.arange(len(group)) - np.repeat(before, phrases.count) + np.repeat(own, phrases.count)
        key, first, count = np.unique(group * self.base + self.before(side)[rows], return_index=True, return_counts=True)
        place, word = np.divmod(key, self.base)
        smaller = np.cumsum(count) - count - before[place]
        live = wanted[word]
        return place[live], word[live], count[live], smaller[live], rows[first][live]

    def extend(self, phrases: Intervals, side: str, wanted: np.ndarray) -> Intervals:
        """All phrases with one of the wanted words more on ``side``; both intervals stay in step."""
        place, word, count, smaller, row = self.neighbours(phrases, side, wanted)
        led = self.step(side)[row]
        old = phrases.words[place]
        if side == "right":
            return Intervals(np.column_stack((old, word)), phrases.forward[place] + smaller, led, count)
        return Intervals(np.column_stack((word, old)), led, phrases.backward[place] + smaller, count)


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def _shard_batches(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        table, number = _table(), TaskContext.get().partitionId() << SHARD_BITS
        ids: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        vocab: dict[str, defaultdict] = {}

        def fresh(lang: str) -> None:
            names = defaultdict()
            names.default_factory = names.__len__
            names[b"\n"], names[b""] = 0, 1  # the break, and what lies between two spaces
            vocab[lang], ids[lang], size[lang] = names, [np.zeros(1, np.int64)], 0

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            text = np.concatenate(ids[lang])
            names = [*vocab[lang]][2:]
            counts = np.bincount(text, minlength=len(names) + 1)[1:]
            marks = np.fromiter(map(xxhash.xxh32_intdigest, names), np.uint32, len(names))
            row = [number, lang, int(counts.sum()), names, counts, _pack(text), marks.tobytes()]
            number += 1
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names_ = [c.split()[0] for c in SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names_)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in vocab:
                    fresh(lang)
                words = text.translate(table).replace(b"\n", b" \n ").split(b" ")
                got = np.fromiter(map(vocab[lang].__getitem__, words), np.int64, len(words))
                got = got[got != 1]
                ids[lang] += [np.where(got > 1, got - 1, BREAK), np.zeros(1, np.int64)]
                size[lang] += len(got) + 1
                if size[lang] >= limit:
                    yield out(lang)
                    fresh(lang)
        for lang in vocab:
            if size[lang]:
                yield out(lang)

    return work


def slots_of(ids: np.ndarray, marks: bytes, bits: int) -> np.ndarray:
    """The slot (of 2 to the power of ``bits``) of each window of ``SLOT_SIZE`` ids, by the marks of its words."""
    mark = np.concatenate((np.zeros(1, np.uint64), np.frombuffer(marks, np.uint32).astype(np.uint64)))[ids]
    windows = max(0, len(ids) - SLOT_SIZE + 1)
    out = np.zeros(windows, np.uint64)
    for i in range(SLOT_SIZE):
        out = (out ^ mark[i : i + windows]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _slot_batches(bits: int, least: int):
    """The slots that a shard's windows take with their counts (to ``least``), a row for each part of the slots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, packed, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = _unpack(packed)
                slots = slots_of(ids, marks, bits)
                whole = np.logical_and.reduce([ids[i : i + len(slots)] != BREAK for i in range(SLOT_SIZE)])
                slot, count = np.unique(slots[whole], return_counts=True)
                count = np.minimum(count, least)
                part, first = np.unique(slot >> PART_BITS, return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(slot)]))
                inside = slot & ((1 << PART_BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int64()),
                     pa.array([_pack(inside[a:z]) for a, z in cuts], pa.binary()),
                     pa.array([_pack(count[a:z]) for a, z in cuts], pa.binary())], ["lang", "part", "slots", "counts"])

    return work


def _full_slots(least: int):
    """One bit a slot of a part: whether all shards of the language count ``least`` windows there."""

    def work(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, np.int64)
        for slots, counts in zip(rows.column("slots"), rows.column("counts")):
            total[_unpack(slots.as_py())] += _unpack(counts.as_py())  # a shard names a slot once
        full = np.packbits(total >= least).tobytes()
        return pa.table({"lang": rows.column("lang")[:1], "part": rows.column("part")[:1], "full": pa.array([full], pa.binary())})

    return work


def full_slots(shards: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``shard, part, full``: the slots of its language in which windows of a shard may be frequent, and how many bits
    a slot has. Slots grow with the largest language up to a bound; fuller ones only rule out less."""
    largest = shards.groupBy("lang").agg(F.sum("words").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    bits = min(max((largest // SLOT_WORDS).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    counted = shards.select("lang", "ids", "marks").mapInArrow(_slot_batches(bits, least), "lang string, part long, slots binary, counts binary")
    full = cut_lineage(counted.groupBy("lang", "part").applyInArrow(_full_slots(least), "lang string, part long, full binary"))
    return shards.select("shard", "lang").join(full, "lang").select("shard", "part", "full"), bits


def without_gaps(ids: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The ids with breaks where ``kept`` is false, one break a gap and one at either end."""
    out = np.concatenate(([BREAK], np.where(kept, ids, BREAK), [BREAK]))
    return out[np.concatenate(([True], (out[1:] != BREAK) | (out[:-1] != BREAK)))]


def _read_shard(shard: pa.Table, side: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a shard, the global id of each of its words (0: not frequent), and its frequent phrases of ``size``
    words by local ids, a row each."""
    ids = _unpack(shard.column("ids")[0].as_py())
    at = side.column("at").to_numpy()
    words, phrases = side.filter(pa.array(at > 0)), side.filter(pa.array(at == 0))
    names = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    names[words.column("at").to_numpy()] = words.column("g1").to_numpy()
    order = np.argsort(names, kind="stable")
    grams = [phrases.column(f"g{i + 1}").to_numpy() for i in range(size)]
    return ids, names, np.column_stack([order[np.searchsorted(names, g, sorter=order)] for g in grams])


def _pairs(shard: pa.Table, side: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard by global ids, with counts."""
    if not len(shard) or not len(side):
        return pa.table({c: pa.array([], pa.int64()) for c in ("shard", "g1", "g2", "n")})
    ids, names, _ = _read_shard(shard, side, 1)
    wanted = names > 0
    index = Index(without_gaps(ids, wanted[ids]))
    words = index.words(np.flatnonzero(wanted[: index.base]))
    place, second, count, _, _ = index.neighbours(words, "right", wanted)
    return pa.table({"shard": pa.repeat(shard.column("shard")[0], len(count)), "g1": names[words.words[place, 0]], "g2": names[second], "n": count})


class Known:
    """Whether rows of word ids are among some phrases: two words make a number, and the numbers' places another."""

    def __init__(self, grams: np.ndarray, base: int):
        self.base = base
        self.sorted = [np.unique(c) for c in self._numbers(grams)]
        self.keys = np.unique(self._places(grams)[0])

    def _numbers(self, rows: np.ndarray) -> list[np.ndarray]:
        wide = np.zeros((len(rows), 4), np.int64)
        wide[:, : rows.shape[1]] = rows
        return [wide[:, 0] * self.base + wide[:, 1], wide[:, 2] * self.base + wide[:, 3]]

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, fits = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for own, number in zip(self.sorted, self._numbers(rows)):
            at = np.minimum(np.searchsorted(own, number), max(len(own) - 1, 0))
            fits &= (own[at] == number) if len(own) else False
            key = key * max(1, len(own)) + at
        return key, fits

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        key, fits = self._places(rows)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return fits & (self.keys[at] == key) if len(self.keys) else fits & False


def _may_be_frequent(ids: np.ndarray, marks: bytes, side: pa.Table, bits: int) -> np.ndarray:
    """Whether the slot of each window of ``SLOT_SIZE`` ids is full in the shard's language."""
    full = np.zeros((max(1, 1 << bits >> PART_BITS), 1 << PART_BITS >> 3), np.uint8)
    parts = side.filter(pa.array(side.column("at").to_numpy() < 0))
    for part, own in zip(parts.column("part").to_pylist(), parts.column("full")):
        full[part] = np.frombuffer(own.as_py(), np.uint8)
    slots = slots_of(ids, marks, bits)
    return (full.ravel()[slots >> 3] << (slots & 7) & 128) > 0


def _grown(length: int, bits: int):
    """Phrases of ``length`` words of a shard whose first and last ``length - 1`` words are frequent phrases, and
    (of ``SLOT_SIZE`` words) whose slot is full. Odd lengths grow to the right, even ones to the left."""

    def work(shard: pa.Table, side: pa.Table) -> pa.Table:
        fields = ["shard", *(f"g{i}" for i in range(1, length + 1)), "n"]
        if not len(shard) or not len(side):
            return pa.table({c: pa.array([], pa.int64()) for c in fields})
        ids, names, grams = _read_shard(shard, side, length - 1)
        known, wanted = Known(grams, len(names)), names > 0
        windows = len(ids) - length + 2
        found = known(np.column_stack([ids[i : i + windows] for i in range(length - 1)])) if windows > 0 else np.zeros(0, bool)
        found = found[:-1] & found[1:]
        if length == SLOT_SIZE:
            found &= _may_be_frequent(ids, shard.column("marks")[0].as_py(), side, bits)
        cover = np.zeros(len(ids), bool)
        for i in range(length):
            cover[i : i + len(found)] |= found
        index = Index(without_gaps(ids, cover))
        live = index.words(np.flatnonzero(wanted[: index.base]))
        live = live.keep(live.count > 0)
        for size in range(2, length):
            live = index.extend(live, "right" if size % 2 else "left", wanted)
        live = index.extend(live.keep(known(live.words)), "right" if length % 2 else "left", wanted)
        live = live.keep(known(live.words[:, :-1]) & known(live.words[:, 1:]))
        if length == SLOT_SIZE:  # gaps of other windows may leave some of them whole
            live = live.keep(_may_be_frequent(live.words.ravel(), shard.column("marks")[0].as_py(), side, bits)[::length])
        columns = names[live.words].T if len(live.count) else np.zeros((length, 0), np.int64)
        return pa.table([pa.repeat(shard.column("shard")[0], len(live.count)), *columns, live.count], names=fields)

    return work


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows whose counts ``n`` add up to ``least`` over their keys, with the sum as ``f``. A key has one row a shard."""
    return rows.withColumn("f", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("f") >= least)


def _keyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Phrases as ``g`` (their word ids) and ``a`` (their count)."""
    return rows.select(F.filter(F.array(*columns), lambda x: x > 0).alias("g"), F.col("f").alias("a"))


def index_shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its words with their counts, and its ids. Dealt by shard and checkpointed, so that later
    joins on the shard move only the other side."""
    narrow = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(narrow.mapInArrow(_shard_batches(shard_words), SHARD).repartition(parts, "shard"))


def count_phrases(shards: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``depth`` words that occur ``least`` times in a language, and the names of word ids.

    Returns ``(g, a)`` and ``(ident, lang, word)``. A word's id is its first place in any shard of its language, so
    ids are exact and tell languages apart.
    """
    listed = shards.select("shard", "lang", F.posexplode(F.arrays_zip("vocab", "counts")).alias("at", "w")).select(
        "shard", "lang", (F.col("at") + 1).cast("long").alias("at"), F.col("w.vocab").alias("word"), F.col("w.counts").alias("n"))
    own = F.shiftleft("shard", WORD_BITS).bitwiseOR(F.col("at"))
    words = cut_lineage(_frequent(listed, ["lang", "word"], least).withColumn(
        "g1", F.min(own).over(Window.partitionBy("lang", "word"))).select("shard", "lang", "at", "word", "f", "g1"))
    names = words.groupBy(F.col("g1").alias("ident")).agg(*[F.first(c).alias(c) for c in ("lang", "word", "f")])
    columns = [f"g{i}" for i in range(1, depth + 1)]
    side, texts = words.select("shard", "at", "g1"), shards.select("shard", "ids", "marks").groupBy("shard")
    slots, bits = full_slots(shards, least) if depth >= SLOT_SIZE else (None, 0)
    parts, last = [_keyed(names, ["ident"])], None
    for length in range(2, depth + 1):
        own = columns[:length]
        given = side if last is None else side.unionByName(last.drop("f").withColumn("at", F.lit(0).cast("long")), allowMissingColumns=True)
        if length == SLOT_SIZE:
            given = given.unionByName(slots.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
            given = given.select(*[F.col(c).alias(c) for c in given.columns])  # columns of its own, since it meets the shards again
        found = texts.cogroup(given.groupBy("shard")).applyInArrow(
            _pairs if length == 2 else _grown(length, bits), ", ".join(["shard long", *(f"{c} long" for c in own), "n long"]))
        last = cut_lineage(_frequent(found, own, least).select("shard", *own, "f"))
        parts.append(_keyed(last.groupBy(*own).agg(F.first("f").alias("f")), own))
    return cut_lineage(reduce(DataFrame.unionByName, parts)), names.select("ident", "lang", "word")


def _whole_quotient(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact: counts up to 10^15 keep the products within 38 digits."""
    wide = [c.cast("decimal(38,0)") for c in (a, n, l, r)]
    top = (wide[0] * wide[1]).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, text: str = "text", lang: str = "lang",
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``depth`` words is a candidate if it occurs ``least`` times; its score is that of its worst
    cut; it is dropped if some longer candidate that contains it occurs as often. It is enough to look at candidates
    one word longer, since what lies between two equally frequent phrases is equally frequent. Null texts are empty,
    a null language is ``und``; repeated rows count each; a shard holds ``shard_words`` words and at most one text
    more; an empty table gives no rows. A shard's rows, never those of a language, meet in a task.
    """
    shards = index_shards(docs, text, lang, shard_words)
    totals = shards.groupBy("lang").agg(F.sum("words").alias("n"))
    phrases, names = count_phrases(shards, least, depth)
    size = F.size("g")
    longer = phrases.where(size >= 3).select(F.explode(F.array(F.slice("g", 1, size - 1), F.slice("g", 2, size - 1))).alias("g"), "a")
    cover = longer.groupBy("g").agg(F.max("a").alias("cover"))
    cut = phrases.where(size >= 2).join(cover, "g", "left").where("cover IS NULL OR 100 * cover < 100 * a").select(
        "g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cut.select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("first"), F.slice("g", F.col("k") + 1, size).alias("rest"))
    left = phrases.select(F.col("g").alias("first"), F.col("a").alias("l"))
    right = phrases.select(F.col("g").alias("rest"), F.col("a").alias("r"))
    met = parts.join(left, "first").join(right, "rest")
    home = names.select(F.col("ident").alias("head"), "lang").join(totals, "lang")
    placed = met.withColumn("head", F.get("g", F.lit(0))).join(home, "head")
    scored = placed.withColumn("score", _whole_quotient(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "g", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(
        "lang", "g", "a", "n", "c.l", "c.r", "c.score")
    near = cut_lineage(best.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= top))
    spelt = near.select("g", F.posexplode("g").alias("at", "ident")).join(names.drop("lang"), "ident").groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    named = near.join(spelt, "g").withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    order = Window.partitionBy("lang").orderBy("_rank", "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
