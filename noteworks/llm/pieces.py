"""SentencePiece encoding and decoding by a max-plus parallel scan.

An encoding is the best-scoring way to cut a text into vocabulary pieces. Scores are integers, so sums do not
depend on their order. A chunk of a giant text is a matrix in the (max, +) semiring: entry ``[i, j]`` is the
best score of the chunk if a piece from before covers its first ``i`` characters and its last piece reaches
``j`` characters beyond its end. Matrices combine associatively; the states at the chunk borders follow from the
products, and each chunk is then traced back on its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteworks.session import cut_lineage

CHUNK = 1 << 15
CHUNK_ROWS = 32
SCAN_GROUP = 64
UNIT = 1_000_000  # scores are in millionths of a nat
NEVER = -(1 << 60)
MEMO_UNITS = 100_000
LANES = 8_192  # units of up to LANE_CHARS characters that one table of best scores holds side by side
LANE_CHARS = 48
SLICE_CHARS = 1 << 20


def load_pieces(path: str) -> tuple[list[bytes], dict[int, int], list[str | None], list[float]]:
    """Of each id its bytes, its piece with a plain space as word mark (null if it is none) and the file's score;
    and the ids of byte pieces by value."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts, normal, by_value = [b""] * size, [None] * size, {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            by_value[value], texts[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal[i] = piece.replace("▁", " ")
            texts[i] = normal[i].encode()
    return texts, by_value, normal, [model.get_score(i) for i in range(size)]


class Vocabulary:
    """Pieces of a SentencePiece file, with their word mark as a plain space, so that a mark that is itself in
    a text is no piece and falls back to bytes: every text comes back as it was.

    ``scores="zipf"``: log-probability by rank, for files that hold merge ranks; ``"file"``: the file's own.
    Characters without a piece become byte pieces, each ten nats below the worst piece.
    """

    def __init__(self, path: str, scores: str = "zipf"):
        _, by_value, pieces, file_scores = load_pieces(path)
        self.byte_ids = [by_value.get(value, 0) for value in range(256)]
        normal = [i for i, piece in enumerate(pieces) if piece is not None]
        self.ids = {pieces[i]: i for i in normal}
        total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        self.score = [0] * len(pieces)
        for rank, i in enumerate(normal):
            value = -math.log(rank + 1) - total if scores == "zipf" else file_scores[i]
            self.score[i] = round(value * UNIT)
        worst = min((self.score[i] for i in normal), default=0) - 10 * UNIT
        for i in self.byte_ids:
            self.score[i] = worst
        self.worst = worst
        self.longest = max(map(len, self.ids), default=1)
        # All prefixes of pieces, so that a search stops where no piece goes on.
        self.begun = {p[:n]: (-1, NEVER) for p in self.ids for n in range(1, len(p))}
        self.begun |= {p: (i, self.score[i]) for p, i in self.ids.items()}
        self.score_of = np.array(self.score)
        self._arrays()
        alphabet = set("".join(self.ids))
        # White space that no piece holds stands alone; a space starts a unit, since no piece has one further in.
        self.breaks = "".join(c for c in "\n\t\r\v\f" if c not in alphabet)
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("pieces with a space inside need units of another kind")
        gap = re.escape(self.breaks)
        self.units = re.compile(f" +[^ {gap}]*|[^ {gap}]+|[{gap}]" if gap else " +[^ ]*|[^ ]+")

    def _arrays(self) -> None:
        """The prefixes as arrays. Node 0 is dead; nodes up to ``inner`` go on, by ``follow[node, character class]``."""
        inner = list(dict.fromkeys(p[:-1] for p in self.begun if len(p) > 1))
        goes_on = set(inner)
        node = {p: n for n, p in enumerate([*inner, *(p for p in self.begun if p not in goes_on)], 1)}
        later = sorted({p[-1] for p in node if len(p) > 1})
        rank = {c: i for i, c in enumerate([*later, *sorted({p for p in node if len(p) == 1} - set(later))], 1)}
        self.inner, self.later = len(inner), len(later)
        self.char_class = np.zeros(0x110000, np.min_scalar_type(len(rank)))
        self.char_class[[ord(c) for c in rank]] = list(rank.values())
        number = np.min_scalar_type(len(node))
        self.first = np.zeros(len(rank) + 1, number)
        self.follow = np.zeros((len(inner) + 1, len(later) + 1), number)
        self.node_id, self.node_score = np.full(len(node) + 1, -1, np.int32), np.full(len(node) + 1, NEVER, np.int64)
        for p, n in node.items():
            if len(p) == 1:
                self.first[rank[p]] = n
            else:
                self.follow[node[p[:-1]], rank[p[-1]]] = n
            self.node_id[n], self.node_score[n] = self.begun[p]

    def lanes(self, units: list[str]) -> dict[str, bytes]:
        """``unit`` for many short texts at once: one array step per place and piece length, over all texts."""
        units = sorted(units, key=len, reverse=True)
        sizes = np.array([len(u) for u in units])
        n, width = len(units), int(sizes[0])
        code = np.zeros((width, n), np.uint32)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        lane = np.repeat(np.arange(n), sizes)
        code[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lane] = flat
        kind = self.char_class[code]
        cell = np.where(kind <= self.later, kind, 0)
        best = np.full((width + 1, n), NEVER, np.int64)
        back, ids = np.zeros((width + 1, n), np.int8), np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        for p in range(width):
            live = np.arange(np.searchsorted(-sizes, -p))  # lanes are sorted: those longer than p
            here, state, end = best[p], self.first[kind[p, live]], p
            missing = self.node_id[state] < 0
            if missing.any():
                at, c = live[missing], code[p, live[missing]]
                score = here[at] + self.worst * (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
                at, score = at[score > best[p + 1, at]], score[score > best[p + 1, at]]
                best[p + 1, at], back[p + 1, at], ids[p + 1, at] = score, 1, -1
            while len(live):
                end += 1
                score = here[live] + self.node_score[state]
                better = (self.node_id[state] >= 0) & (score > best[end, live])
                at = live[better]
                best[end, at], back[end, at], ids[end, at] = score[better], end - p, self.node_id[state[better]]
                if end == width:
                    break
                on = (state > 0) & (state <= self.inner)
                live, state = live[on], state[on]
                state = self.follow[state, cell[end, live]]
                live, state = live[state > 0], state[state > 0]
        on_way, z, lane = np.zeros((n, width + 1), bool), sizes.copy(), np.arange(n)
        while len(lane):
            on_way[lane, z] = True
            z = z - back[z, lane]
            lane, z = lane[z > 0], z[z > 0]
        found = ids.T[on_way]
        ends = np.cumsum(on_way.sum(axis=1))
        raw = found.tobytes()
        out = {u: raw[4 * a : 4 * b] for u, a, b in zip(units, [0, *ends[:-1].tolist()], ends.tolist())}
        for i in np.unique(np.searchsorted(ends, np.nonzero(found < 0)[0], side="right")):  # ways with byte pieces
            out[units[i]] = self.unit(units[i])
        return out

    def steps(self, s: str, p: int) -> list[tuple[int, int, int]]:
        """Pieces that start at ``p``: (end, id, score); id -1 stands for the bytes of one character."""
        get, out = self.begun.get, []
        for end in range(p + 1, len(s) + 1):
            found = get(s[p:end])
            if found is None:
                break
            if found[0] >= 0:
                out.append((end, *found))
        if not out or out[0][0] != p + 1:
            out.append((p + 1, -1, self.worst * len(s[p].encode("utf-8", "replace"))))
        return out

    def forward(self, s: str, a: int, stop: int, reach: int) -> tuple[list[int], list]:
        """Best scores from ``a`` to all ends up to ``reach``, over pieces that start before ``stop``."""
        best, back = [NEVER] * (reach - a + 1), [None] * (reach - a + 1)
        best[0] = 0
        for p in range(a, min(stop, reach)):
            here = best[p - a]
            if here == NEVER:
                continue
            for end, i, score in self.steps(s, p):
                if end <= reach and here + score > best[end - a]:
                    best[end - a], back[end - a] = here + score, (p, i)
        return best, back

    def trace(self, s: str, a: int, z: int, stop: int | None = None) -> bytes:
        """Ids (int32) of the best way from ``a`` to ``z``."""
        _, back = self.forward(s, a, z if stop is None else stop, z)
        out: list[int] = []
        while z > a:
            p, i = back[z - a]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(s[p:z].encode("utf-8", "replace"))]
            z = p
        return np.array(out[::-1], np.int32).tobytes()

    def unit(self, s: str) -> bytes:
        """``trace`` over a whole short text, in one loop."""
        n, get = len(s), self.begun.get
        best, back, ids = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for p in range(n):
            here, end = best[p], p + 1
            while end <= n and (found := get(s[p:end])) is not None:
                if here + found[1] > best[end] and found[0] >= 0:
                    best[end], back[end], ids[end] = here + found[1], p, found[0]
                end += 1
            if s[p] not in self.ids:
                score = here + self.worst * len(s[p].encode("utf-8", "replace"))
                if score > best[p + 1]:
                    best[p + 1], back[p + 1], ids[p + 1] = score, p, -1
        out: list[int] = []
        while n:
            p = back[n]
            out += [ids[n]] if ids[n] >= 0 else [self.byte_ids[b] for b in reversed(s[p:n].encode("utf-8", "replace"))]
            n = p
        return np.array(out[::-1], np.int32).tobytes()

    def borders(self, s: str, limit: int) -> tuple[int, int] | None:
        """First and last place in ``1 .. limit`` that no piece can cross, whatever stands before."""

        def safe(p: int) -> bool:
            return p == len(s) or s[p] in self.breaks or s[p - 1] in self.breaks or (s[p] == " " and s[p - 1] != " ")

        limit = min(limit, len(s))
        first = next((p for p in range(1, limit + 1) if safe(p)), None)
        return None if first is None else (first, next(p for p in range(limit, 0, -1) if safe(p)))


class Memo(dict):
    """Units met so far and their ids. Emptied when full, so memory is bounded by MEMO_UNITS and one slice of texts."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMO_UNITS:
            self.clear()
        ids = self[unit] = self.vocabulary.unit(unit)
        return ids

    def learn(self, units: set[str]) -> None:
        new = units - self.keys()
        if len(self) + len(new) > MEMO_UNITS:
            self.clear()
            new = units
        short = [u for u in new if len(u) <= LANE_CHARS]
        for at in range(0, len(short), LANES):
            self.update(self.vocabulary.lanes(short[at : at + LANES]))

    def encode(self, s: str) -> bytes:
        return b"".join(map(self.__getitem__, self.vocabulary.units.findall(s)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self.vocabulary.units.findall(s) for s in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, units)) for units in cut]

    def score(self, s: str) -> int:
        return int(self.vocabulary.score_of[np.frombuffer(self.encode(s), np.int32)].sum())


def slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about SLICE_CHARS characters."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def transfer(memo: Memo, s: str, length: int, last: bool) -> np.ndarray:
    """Matrix of a chunk: ``s`` holds its ``length`` characters and the next ones that a piece may reach."""
    v, states = memo.vocabulary, memo.vocabulary.longest
    out = np.full((states, states), NEVER, np.int64)
    exits = [length] if last else range(length, min(length + states, len(s) + 1))
    found = v.borders(s, length)
    if found is None:
        for i in range(min(states, length + 1)):
            best, _ = v.forward(s, i, length, exits[-1])
            for j, end in enumerate(exits):
                out[i, j] = best[end - i] if end >= i else NEVER
        return out
    first, end = found
    middle = memo.score(s[first:end])
    tail, _ = v.forward(s, end, length, exits[-1])
    for i in range(min(states, first + 1)):
        head = v.forward(s, i, first, first)[0][-1]
        for j, place in enumerate(exits):
            if head > NEVER and tail[place - end] > NEVER:
                out[i, j] = head + middle + tail[place - end]
    return out


def trace_chunk(memo: Memo, s: str, length: int, entry: int, exit_: int) -> bytes:
    v = memo.vocabulary
    found = v.borders(s, length)
    if found is None or found[0] < entry:
        return v.trace(s, entry, length + exit_, length)
    first, end = found
    return v.trace(s, entry, first) + memo.encode(s[first:end]) + v.trace(s, end, length + exit_, length)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) semiring."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def walk(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """States at all borders of the best way through the chunks, both ends included."""
    reach = [np.where(np.arange(len(matrices[0])) == entry, 0, NEVER)]
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), NEVER))
    states = [exit_]
    for m, before in zip(matrices[::-1], reach[-2::-1]):
        states.append(int(np.argmax(before + m[:, states[-1]])))
    return states[::-1]


def _unpack(column: pd.Series) -> list[np.ndarray]:
    flat = [np.frombuffer(x, np.int64) for x in column]
    return [m.reshape(math.isqrt(len(m)), -1) for m in flat]


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    matrices = _unpack(group["matrix"])
    total = matrices[0]
    for m in matrices[1:]:
        total = times(total, m)
    return pd.DataFrame({"key": [group["key"].iloc[0]], "part": [group["part"].iloc[0]], "matrix": [total.tobytes()]})


def _part_states(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    states = walk(_unpack(group["matrix"]), 0, 0)
    return pd.DataFrame({"key": group["key"], "part": group["part"], "entry": states[:-1], "exit": states[1:]})


def _chunk_states(chunks: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("chunk")
    states = walk(_unpack(chunks["matrix"]), int(ends["entry"].iloc[0]), int(ends["exit"].iloc[0])) if len(chunks) else [0]
    return pd.DataFrame({"key": chunks["key"], "chunk": chunks["chunk"], "entry": states[:-1], "exit": states[1:]})


def _ids_array(blobs: list[bytes | None]) -> pa.ListArray:
    sizes = np.array([0 if b is None else len(b) // 4 for b in blobs], np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), np.int32))
    mask = pa.array([b is None for b in blobs], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _encode_batches(path: str, scores: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Vocabulary(path, scores))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(0).to_pylist()
                blobs: list[bytes | None] = []
                for some in slices(texts):
                    ids = iter(memo.encode_all([" " + t for t in texts[some] if t]))
                    blobs += [None if t is None else next(ids) if t else b"" for t in texts[some]]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _ids_array(blobs)], [*part.schema.names[1:], "ids"])

    return work


def _matrix_batches(path: str, scores: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Vocabulary(path, scores))
        for batch in (b.slice(at, CHUNK_ROWS) for b in batches for at in range(0, b.num_rows, CHUNK_ROWS)):
            rows = batch.to_pydict()
            memo.learn({u for s in rows["s"] for u in memo.vocabulary.units.findall(s)})
            blobs = [transfer(memo, s, n, last).tobytes() for s, n, last in zip(rows["s"], rows["length"], rows["last"])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(blobs, pa.binary())], ["key", "chunk", "matrix"])

    return work


def _trace_batches(path: str, scores: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Vocabulary(path, scores))
        for batch in (b.slice(at, CHUNK_ROWS) for b in batches for at in range(0, b.num_rows, CHUNK_ROWS)):
            rows = batch.to_pydict()
            memo.learn({u for s in rows["s"] for u in memo.vocabulary.units.findall(s)})
            blobs = [trace_chunk(memo, *x) for x in zip(rows["s"], rows["length"], rows["entry"], rows["exit"])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), _ids_array(blobs)], ["key", "chunk", "ids"])

    return work


def _encode_giants(giants: DataFrame, path: str, scores: str, chunk: int) -> DataFrame:
    """Distinct giant texts ``key, whole`` to ``key, ids``."""
    states = Vocabulary(path, scores).longest
    s = F.concat(F.lit(" "), F.col("whole"))
    cuts = giants.select("key", F.length(s).alias("n"), s.alias("s")).select(
        "key", "n", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int")),
            lambda k: F.substring(F.col("s"), k * chunk + 1, F.lit(chunk + states)))).alias("chunk", "s"))
    left = F.col("n") - F.col("chunk") * chunk
    chunks = cut_lineage(cuts.select("key", "chunk", "s", F.least(left, F.lit(chunk)).cast("int").alias("length"), (left <= chunk).alias("last"))
                         .repartition("key", "chunk"))
    matrices = cut_lineage(chunks.mapInArrow(_matrix_batches(path, scores), "key long, chunk int, matrix binary")
                           .withColumn("part", F.floor(F.col("chunk") / SCAN_GROUP)))
    products = matrices.groupBy("key", "part").applyInPandas(_product, "key long, part long, matrix binary")
    ends = products.groupBy("key").applyInPandas(_part_states, "key long, part long, entry int, exit int")
    states_of = matrices.groupBy("key", "part").cogroup(ends.groupBy("key", "part")).applyInPandas(
        _chunk_states, "key long, chunk int, entry int, exit int")
    ready = chunks.join(states_of, ["key", "chunk"]).select("key", "chunk", "s", "length", "entry", "exit")
    traced = ready.mapInArrow(_trace_batches(path, scores), "key long, chunk int, ids array<int>")
    whole = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, text: str = "text", scores: str = "zipf", chunk: int = CHUNK) -> DataFrame:
    """``docs`` without the text, with its piece ids as ``ids array<int>``.

    Texts of up to ``chunk`` characters are one chunk and are encoded where they are read. Longer ones are cut,
    each distinct one once, and their chunks spread over the tasks. The score does not depend on ``chunk``; of
    equally good ways through a word that a cut divides, another one may be taken. Null gives null, an empty text no ids;
    repeated rows stay; a column that is itself called ``ids`` is replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "ids")]
    typed = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in rest])
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in typed.schema.fields[1:])
    giant = F.coalesce(F.length("_text") > chunk - 1, F.lit(False))
    done = typed.where(~giant).mapInArrow(_encode_batches(path, scores), f"{ddl}ids array<int>")
    key = F.xxhash64("_text")
    distinct = typed.where(giant).select(key.alias("key"), F.col("_text").alias("whole")).dropDuplicates(["key"])
    encoded = _encode_giants(distinct, path, scores, chunk)
    long = typed.where(giant).withColumn("_key", key).drop("_text").join(encoded, F.col("_key") == F.col("key"))
    return done.unionByName(long.select(*[F.col(f"`{c}`") for c in rest], "ids"))


def _decode_batches(path: str, ids: str, keep: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = load_pieces(path)[0]
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = []
                for row in part.column(at):
                    if not row.is_valid:
                        out.append(None)
                        continue
                    raw = b"".join([texts[i] for i in row.values.to_numpy().tolist()])
                    out.append(raw.decode("utf-8", "replace").removeprefix(" "))
                rest = [i for i in range(len(part.columns)) if keep or i != at]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(out, pa.string())],
                                                 [*(part.schema.names[i] for i in rest), "text"])

    return work


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: bool = False) -> DataFrame:
    """The text of each row of ids (which ``keep`` keeps); null stays null. Other columns are carried along."""
    fields = [f for f in encoded.schema.fields if f.name not in (ids, "text") or (keep and f.name == ids)]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    names = [*(f.name for f in fields), *([] if keep else [ids])]
    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(_decode_batches(path, ids, keep), f"{ddl}text string")
