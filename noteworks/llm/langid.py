"""Language ID by error-correcting output codes.

Every language has a codeword. A binary n-gram classifier predicts each bit of it; loss-weighted decoding, with
weights from how well each classifier does on each language, picks the nearest codeword and flags a close call.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.session import cut_lineage

FEATURES = 1 << 15
SMOOTHING = 0.5
CLOSE_CALL = 0.2
EXHAUSTIVE_UP_TO = 7
UNKNOWN = "und"


_TABLES: dict[str, np.ndarray] = {}  # filled once a process; a plain dictionary travels to workers by value


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _TABLES["letters"]


def ngrams(text: str | None) -> np.ndarray:
    """Hashed letters, pairs and triples of the folded text; runs of other characters count as one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    first_gap = ~is_letter & np.concatenate(([True], is_letter[:-1]))
    kept = np.where(is_letter, codes, 32)[is_letter | first_gap].astype(np.uint32)
    kept = np.concatenate((np.array([32], np.uint32), kept, np.array([32], np.uint32)))
    one = kept * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x55555555)) * np.uint32(0x85EBCA6B) + kept[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + kept[2:] * np.uint32(0x165667B1)
    return np.concatenate([(h ^ (h >> np.uint32(13))) % np.uint32(FEATURES) for h in (one, two, three)]).astype(np.int64)


def codebook(languages: int) -> np.ndarray:
    """One row of +1/-1 per language: all splits for few languages, else the best of some fixed random codes."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE_UP_TO:
        splits = np.arange(1, 1 << (languages - 1))
        return np.stack([np.where(splits >> i & 1, 1.0, -1.0) for i in range(languages)])
    bits, best, apart = 10 * math.ceil(math.log2(languages)), None, -1.0
    for seed in range(100):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        near = ((bits - code @ code.T) / 2 + np.eye(languages) * bits).min()
        if near > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, near
    return best


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = sums.setdefault(lang, np.zeros(FEATURES, np.int64))
            row += np.bincount(ngrams(text), minlength=FEATURES)
    for lang, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "feature", "n"])


class Model:
    """``weights[f, b]``: log-odds of n-gram ``f`` for bit ``b``; ``trust[l, b]``: weight of bit ``b`` for language ``l``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codebook(len(languages))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if languages else counts
        sides = [np.maximum((self.code == sign).T.astype(float), 0) for sign in (1, -1)]
        odds = [np.log((s @ share) / np.maximum(s.sum(axis=1, keepdims=True), 1) + 1e-12) for s in sides]
        self.weights = (odds[0] - odds[1]).T.astype(np.float32)
        self.trust = np.ones_like(self.code)
        self.scale = np.ones(self.code.shape[1])

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log-odds per bit, None without a letter."""
        grams = ngrams(text)
        if not len(grams):
            return None
        return np.bincount(grams, minlength=FEATURES).astype(np.float32) @ self.weights / len(grams)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, its share of the belief, and whether the call is close."""
        f = np.clip(margins / self.scale, -3, 3)
        loss = np.einsum("lb,nlb->nl", self.trust, np.exp(-self.code[None] * f[:, None]))
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 2)
        belief /= belief.sum(axis=1, keepdims=True)
        ranked = np.sort(belief, axis=1)
        gap = ranked[:, -1] - ranked[:, -2] if belief.shape[1] > 1 else np.ones(len(belief))
        return loss.argmin(axis=1), ranked[:, -1], gap < CLOSE_CALL


def _margin_batches(model: Model, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rows = [model.margins(t) if model.languages else None for t in batch.column(at).to_pylist()]
            margins = pa.array([None if r is None else r.astype(np.float64) for r in rows], pa.list_(pa.float64()))
            rest = [i for i in range(len(batch.columns)) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), margins], [*(batch.schema.names[i] for i in rest), "margins"])

    return work


def _decode_frames(model: Model):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = frame["margins"].notna().to_numpy()
            names, score = np.full(len(frame), UNKNOWN, object), np.zeros(len(frame))
            close = np.ones(len(frame), bool)
            if known.any():
                best, belief, near = model.decode(np.stack(frame["margins"][known].to_numpy()))
                names[known], score[known], close[known] = np.array(model.languages, object)[best], belief, near
            yield frame.drop(columns=["margins", "_learn", "_lang"]).assign(lang_pred=names, score=score, ambiguous=close)

    return work


def identify(docs: DataFrame, columns: list[str], learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """``columns`` of every document with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Learns from the rows where ``learn`` holds and the language is known: n-gram counts of each language are
    summed over all their whole texts, so rows come in as counts of at most ``FEATURES`` a language. Predictions
    see the text only. Null texts and texts without a letter are ``und`` with score 0, as is everything if
    nothing could be learned; repeated rows are judged alike; ties go to the first language by name.
    """
    typed = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang"),
                        F.coalesce(learn, F.lit(False)).alias("_learn"), *[F.col(f"`{c}`") for c in columns])
    labelled = typed.where(F.col("_learn") & F.col("_lang").isNotNull()).select("_lang", "_text")
    sums = labelled.mapInArrow(_count_batches, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    for row, name in enumerate(languages):
        own = table[table["lang"] == name]
        counts[row, own["feature"].to_numpy()] = own["n"].to_numpy()
    model = Model(languages, counts)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in typed.schema.fields[1:])
    measured = cut_lineage(typed.mapInArrow(_margin_batches(model, "_text"), f"{ddl}margins array<double>"))
    if languages:
        bits = range(model.code.shape[1])
        m = [F.get("margins", b) for b in bits]
        stats = measured.where(F.col("_learn") & F.col("_lang").isNotNull() & F.col("margins").isNotNull()).groupBy("_lang").agg(
            F.count("*").alias("n"), *[F.avg((m[b] > 0).cast("int")).alias(f"p{b}") for b in bits], *[F.avg(F.abs(m[b])).alias(f"s{b}") for b in bits])
        rows = {r["_lang"]: r for r in stats.collect()}
        right = np.full(model.code.shape, 0.5)
        size = np.zeros_like(right)
        for place, name in enumerate(languages):
            if name in rows:
                up = np.array([rows[name][f"p{b}"] for b in bits])
                right[place] = np.where(model.code[place] > 0, up, 1 - up)
                size[place] = [rows[name][f"s{b}"] for b in bits]
        right = np.maximum(right, 1e-3)
        model.trust = right / right.sum(axis=1, keepdims=True)
        model.scale = np.maximum(size.mean(axis=0), 1e-9)
    fields = [f for f in typed.schema.fields if not f.name.startswith("_")]
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return measured.mapInPandas(_decode_frames(model), f"{out}lang_pred string, score double, ambiguous boolean")
