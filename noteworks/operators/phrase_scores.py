"""Scores of the phrases of a note, made for many notes at once: words and phrases are numbers, groups are sorted
numbers, and a task holds a slice of notes. All rows of a note come one after another.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 1 << 18  # words of the notes that are scored at once; a note of more words alone


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values, nulls too, as equal numbers."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def whole_notes(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no note (column 0, sorted) lies in two of them and each holds about ``WORDS`` words."""
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size, note = sizes(batch), _codes(batch.column(0))
        new = np.flatnonzero(np.concatenate(([True], note[1:] != note[:-1])))
        if held and held[-1].column(0)[-1].as_py() == batch.column(0)[0].as_py():
            new = new[1:]  # the first note goes on
        ends = np.concatenate(([0], np.cumsum(size)))
        first = 0
        for at in new:  # a note begins here: what lies before may leave
            if words + ends[at] - ends[first] >= WORDS:
                held.append(batch.slice(first, at - first))
                yield pa.concat_batches(held)
                held, words, first = [], 0, at
        held.append(batch.slice(first))
        words += int(ends[-1] - ends[first])
    if held:
        yield pa.concat_batches(held)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a group begins, in rows sorted by ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as decimal numbers are, half up."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 10.0**digits


_LG = (6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01,
       1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01)


def _strict_log(x: float) -> float:
    """Logarithm of a positive number to the last bit as Spark takes it (fdlibm), since weights may tie up to rounding."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    k, high = (bits >> 52) - 1023, bits >> 32 & 0xFFFFF
    i = high + 0x95F64 & 0x100000
    k += i >> 20
    f = struct.unpack("<d", struct.pack("<q", (high | i ^ 0x3FF00000) << 32 | bits & 0xFFFFFFFF))[0] - 1.0
    up, low = k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
    if (2 + high & 0xFFFFF) < 3:
        r = f * f * (0.5 - 0.33333333333333333 * f)
        return up + low if f == 0 else up - ((r - low) - f)
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (_LG[0] + w * (_LG[2] + w * (_LG[4] + w * _LG[6]))) + w * (_LG[1] + w * (_LG[3] + w * _LG[5]))
    if (high - 0x6147A | 0x6B851 - high) > 0:
        half = 0.5 * f * f
        return f - (half - s * (half + r)) if k == 0 else up - ((half - (s * (half + r) + low)) - f)
    return f - s * (f - r) if k == 0 else up - ((s * (f - r) - low) - f)


def _log(x: np.ndarray) -> np.ndarray:
    values, place = np.unique(x, return_inverse=True)
    return np.array([_strict_log(float(v)) for v in values.tolist()])[place] if len(x) else np.zeros(0)


def _spread(of: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """Population deviation of ``x`` in each group, value by value in the given order as Spark does it."""
    order = np.argsort(of, kind="stable")
    of, x = of[order], x[order].astype(np.float64)
    begin = _first(of) if len(of) else np.zeros(0, np.int64)
    size, group = np.diff(np.append(begin, len(of))), of[begin]
    by = np.argsort(-size, kind="stable")
    begin, size, group = begin[by], size[by], group[by]
    mean, square = np.zeros(len(begin)), np.zeros(len(begin))
    left = len(begin)
    for n in range(int(size[0]) if len(size) else 0):
        while size[left - 1] <= n:
            left -= 1
        delta = x[begin[:left] + n] - mean[:left]
        step = delta / (n + 1.0)
        mean[:left] += step
        square[:left] += delta * (delta - step)
    out = np.zeros(groups)
    out[group] = np.sqrt(square / np.maximum(size, 1))
    return out


def rake_batches(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: rows ``(note, language, runs of words)`` to the best phrases of each note."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        note, language = _codes(batch.column(0)), _codes(batch.column(1))
        runs = batch.column(2)
        row = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
        lists = runs.flatten()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), lists.flatten())  # of a type that can be joined
        names = pc.binary_join(lists, " ").dictionary_encode()
        code = names.indices.to_numpy().astype(np.int64)
        once = np.sort(np.unique(row * (len(names.dictionary) + 1) + code, return_index=True)[1])  # a phrase counts once a text
        lists, row, code = lists.take(pa.array(once)), row[once], code[once]
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        phrase = np.repeat(np.arange(len(n)), n)
        key = note[row][phrase] * (len(words.dictionary) + 1) + words.indices.to_numpy()
        place = np.unique(key, return_inverse=True)[1]
        weight = np.bincount(place, n[phrase]) / np.bincount(place)
        own = np.bincount(phrase, weight[place], minlength=len(n))
        order = np.lexsort((code, language[row], note[row]))
        begin = _first(note[row][order], language[row][order], code[order])
        raw = _half_up(np.add.reduceat(own[order], begin), 6)
        head = order[begin]
        found = pa.RecordBatch.from_arrays(
            [pa.array(note[row][head]), pa.array(raw), names.dictionary.take(pa.array(code[head])), pa.array(row[head])], ["note", "raw", "phrase", "row"])
        found = found.take(pc.sort_indices(found, [("note", "ascending"), ("raw", "descending"), ("phrase", "descending")]))
        begin = _first(found.column(0).to_numpy())
        rank = np.arange(found.num_rows) - np.repeat(begin, np.diff(np.append(begin, found.num_rows)))
        raw = found.column(1).to_numpy()
        best = np.repeat(raw[begin], np.diff(np.append(begin, found.num_rows)))
        shown = np.divide(raw, best, out=np.zeros(len(raw)), where=best > 0)
        kept = pa.array(np.flatnonzero(rank < top))
        rows = found.column(3).take(kept)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), found.column(2).take(kept), pa.array(shown).take(kept)],
            ["note_id", "language", "candidate", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sizes(batch: pa.RecordBatch) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        for batch in whole_notes(batches, sizes):
            if sizes(batch).sum():
                yield score(batch)

    return work


def yake_batches(max_words: int, stop: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: rows ``(note, language, words of each sentence, lower words, flags)`` to all phrases of a note and
    language with their weights, the least first. Of the flags, 1 is an acronym, and 1 and 2
    behind the first word of a sentence are proper names."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        notes, languages = _codes(batch.column(0)), _codes(batch.column(1))
        many = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
        size = batch.column(2).flatten().to_numpy().astype(np.int64)  # words of each sentence
        line_row = np.repeat(np.arange(len(many)), many)
        sentence = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
        line = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        words = batch.column(3).flatten().dictionary_encode()
        vocabulary, w = words.dictionary, words.indices.to_numpy().astype(np.int64)
        flag = batch.column(4).flatten().to_numpy()
        if not len(w):
            return None
        row, sent = line_row[line], sentence[line]
        note = notes[row]
        order = np.lexsort((pos, sent, note))  # the rows of one note are one text, sentence by sentence
        row, sent, note, pos, w, flag = (x[order] for x in (row, sent, note, pos, w, flag))
        joined = (note[1:] == note[:-1]) & (sent[1:] == sent[:-1])  # with the next word in the same sentence
        wide = len(vocabulary) + 1
        keys, g = np.unique(note * wide + w, return_inverse=True)  # words of a note
        total = len(keys)
        tf = np.bincount(g, minlength=total)
        acronyms, propers = np.bincount(g, flag == 1, total), np.bincount(g, (flag > 0) & (pos > 0), total)
        by = np.lexsort((sent, g))
        begin = np.cumsum(tf) - tf
        middle = (sent[by][begin + (tf - 1) // 2] + sent[by][begin + tf // 2]) / 2
        lines = np.bincount(g[by][_first(g[by], sent[by])], minlength=total)

        def beside(of: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pairs = np.unique(of * wide + other)
            return np.bincount(pairs // wide, minlength=total), np.bincount(of, minlength=total)

        at = np.flatnonzero(joined)
        dl, nl = beside(g[at + 1], w[at])
        dr, nr = beside(g[at], w[at + 1])
        own = keys // wide  # note of each word
        stops = pc.is_in(vocabulary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
        content = ~stops[keys % wide]
        n_notes = int(own.max()) + 1
        max_tf, max_sent = np.zeros(n_notes, np.int64), np.zeros(n_notes, np.int64)
        np.maximum.at(max_tf, own, tf)
        np.maximum.at(max_sent, own, lines)
        count = np.maximum(np.bincount(own[content], minlength=n_notes), 1)
        mean = np.bincount(own[content], tf[content], n_notes) / count
        c = np.flatnonzero(content)
        rank = np.empty(len(vocabulary), np.int64)
        rank[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
        by = c[np.lexsort((rank[keys[c] % wide], own[c]))]  # in the order of words
        std = _spread(own[by], tf[by], n_notes)
        of = own[c]
        case = np.maximum(acronyms, propers)[c] / (1 + _log(tf[c]))
        place = _log(_log(3 + middle[c]))
        freq = tf[c] / (mean[of] + std[of])
        wl = np.divide(dl[c], nl[c], out=np.zeros(len(c)), where=nl[c] > 0)
        wr = np.divide(dr[c], nr[c], out=np.zeros(len(c)), where=nr[c] > 0)
        related = 1 + (wl + wr) * (tf[c] / max_tf[of]) + (dl[c] + dr[c]) / max_tf[of]
        spread = lines[c] / max_sent[of]
        h = np.full(total, np.nan)  # not a number for stop words
        h[c] = place * related / (case + freq / related + spread / related)
        ends = np.flatnonzero(np.concatenate((~joined, [True])))
        run = ends[np.searchsorted(ends, np.arange(len(w)))] - np.arange(len(w))  # words that follow in the sentence
        kinds, weights, phrases = [], [], []
        pair = notes * (int(languages.max()) + 1) + languages  # note and language of each row
        for n in range(max_words):
            start = np.flatnonzero(run >= n)
            start = start[content[g[start]] & content[g[start + n]]]
            if not len(start):
                continue
            key = pair[row[start]] * total + g[start]
            for i in range(1, n + 1):  # made dense before it is multiplied, so that no product overflows
                key = np.unique(key, return_inverse=True)[1] * total + g[start + i]
            _, head, times = np.unique(key, return_index=True, return_counts=True)
            head = start[head]
            product, added = np.ones(len(head)), np.zeros(len(head))
            for i in range(n + 1):
                x = h[g[head + i]]
                product, added = np.where(np.isnan(x), product, product * x), np.where(np.isnan(x), added, added + x)
            kinds.append(row[head])
            weights.append(product / (times * (1 + added)))
            taken = [vocabulary.take(pa.array(w[head + i])) for i in range(n + 1)]
            phrases.append(pc.binary_join_element_wise(*taken, " ") if n else taken[0])
        if not kinds:
            return None
        of = np.concatenate(kinds)
        found = pa.RecordBatch.from_arrays([pa.array(pair[of]), pa.array(np.concatenate(weights)), pa.concat_arrays(phrases), pa.array(of)],
                                           ["pair", "weight", "phrase", "row"])
        found = found.take(pc.sort_indices(found, [("pair", "ascending"), ("weight", "ascending"), ("phrase", "ascending")]))
        begin = _first(found.column(0).to_numpy())
        rows = found.column(3).take(pa.array(begin))
        items = pa.StructArray.from_arrays([found.column(1), found.column(2)], ["weight", "phrase"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, found.num_rows).astype(np.int32)), items)
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], ["note_id", "language", "list"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_notes(batches, lambda b: pc.list_value_length(b.column(3)).to_numpy().astype(np.int64)):
            made = score(batch)
            if made is not None:
                yield made

    return work
