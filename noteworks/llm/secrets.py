"""Secret scans: keyword automaton, anchored patterns at its hits, checksums inside the token."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns. Letters of the keywords match in either case, ASCII only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Further kinds: their tokens carry a checksum or a structure that is verified.
PREFIXED = {"ghp_": 36, "gho_": 36, "ghu_": 36, "ghs_": 36, "ghr_": 36, "npm_": 36}
PREFIX_BODY = re.compile(r"[A-Za-z0-9]+")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
SIGNED_RUN = re.compile(r"[A-Za-z0-9_-]*")
# Header lines such as Proc-Type may stand before the body of a key.
PRIVATE_KEY = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[\x20\t\r]*\n?((?:[A-Za-z0-9-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
OPENSSH_MAGIC = b"openssh-key-v1\0"
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checksum", "signed", "private_key")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def crc_tail(body: str) -> bool:
    """The last six characters are the CRC32 of the rest, in base 62."""
    value, tail = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        tail = DIGITS62[digit] + tail
    return tail == body[-6:]


def _base64_bytes(text: str) -> bytes | None:
    try:
        return base64.b64decode("".join(text.split()), validate=True)
    except (binascii.Error, ValueError):
        return None


def whole_der(blob: bytes | None) -> bool:
    """The outer sequence of a key states its own length; a torn or invented block does not fit it."""
    if not blob or len(blob) < 4 or blob[0] != 0x30:
        return False
    if blob[1] < 0x80:
        return len(blob) == blob[1] + 2
    n = blob[1] & 0x7F
    return len(blob) == int.from_bytes(blob[2 : 2 + n], "big") + 2 + n


def whole_openssh(blob: bytes | None) -> bool:
    """The magic, then fields that state their lengths: cipher, key derivation and its options, the number of keys,
    each public key, and the private part, which ends the block."""
    if not blob or not blob.startswith(OPENSSH_MAGIC):
        return False
    at, keys = len(OPENSSH_MAGIC), 0

    def field() -> None:
        nonlocal at
        at += 4 + int.from_bytes(blob[at : at + 4], "big")

    for _ in range(3):
        field()
    keys, at = int.from_bytes(blob[at : at + 4], "big"), at + 4
    while keys and at < len(blob):
        field()
        keys -= 1
    field()
    return keys == 0 and at == len(blob)


def whole_key(headers: str, body: str) -> bool:
    """An encrypted body (it has header lines) must be whole blocks; others state their own length."""
    blob = _base64_bytes(body)
    return (bool(blob) and len(blob) % 8 == 0) if "ENCRYPTED" in headers else whole_der(blob) or whole_openssh(blob)


def signed_header(token: str) -> bool:
    part = token.partition(".")[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # no header is nested a thousand deep
        return False
    return isinstance(head, dict) and "alg" in head


def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in (*ASSIGN_WORDS, "akia", *PREFIXED, "eyj", "-----begin "):
        machine.add_word(word, word)
    machine.make_automaton()
    return machine


def scan(text: str, machine) -> list[Span]:
    """All spans of one text in code points, sorted by start and then kind."""
    spans: list[Span] = []
    for m in HEX.finditer(text):  # has no keyword: one linear pass
        if m.end() - m.start() >= LEAST["hex"]:
            spans.append((m.start(), 2, m.end()))
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII only, so offsets stay
    hits = sorted({(end + 1 - len(word), word) for end, word in machine.iter(folded)})
    done = [0] * len(KINDS)
    for at, word in hits:
        if word in ASSIGN_WORDS:
            kind, found = 0, ASSIGN.match(text, at) if at >= done[0] else None
            good = found and found.end(2) - found.start(2) >= LEAST["assign"]
        elif word == "akia":
            kind, found = 1, ACCESS.match(text, at) if at >= done[1] else None
            good = found and found.end() - found.start() >= LEAST["access"]
        elif word in PREFIXED:
            body = PREFIX_BODY.match(text, at + len(word)) if text.startswith(word, at) and at >= done[3] else None
            kind, found = 3, body
            good = body and len(body[0]) == PREFIXED[word] and crc_tail(body[0])
        elif word == "eyj":
            kind, found = 4, SIGNED.match(text, at) if at >= done[4] else None
            good = found and signed_header(found[0])
            if not found and at >= done[4] and text.startswith("eyJ", at):  # then nothing in the rest of this run matches
                done[4] = SIGNED_RUN.match(text, at).end()
        else:
            kind, found = 5, PRIVATE_KEY.match(text, at) if at >= done[5] else None
            good = found and whole_key(found[2], found[3])
        if found:
            done[kind] = found.end()
            if good:
                spans.append((at, kind, found.end()))
    return sorted(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with each run of touching or overlapping spans replaced by the mask."""
    out, at, reach = [], 0, -1
    for a, _, b in spans:
        if a > reach:
            out += [text[at:a], mask]
        reach = max(reach, b)
        at = reach
    return "".join([*out, text[at:]]) if spans else text


FOUND = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_checked", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("clean_text", pa.string()),
])
FOUND_DDL = ("secrets struct<n_assign:long,n_access:long,n_hex:long,n_checked:long,base_sha256:string,spans:string,"
             "clean_text:string>")


def _scanner(text: str, mask: str | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)):
                whole = value.as_py()
                spans = scan(whole or "", machine)
                base = [s for s in spans if s[1] < 3]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                clean = None if mask is None or whole is None else masked(whole, spans, mask)
                rows.append((*n, len(spans) - len(base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), clean))
            cols = [pa.array([r[i] for r in rows], FOUND.field(i).type) for i in range(len(FOUND))]
            keep = [i for i, f in enumerate(batch.schema.names) if mask is not None or f != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.StructArray.from_arrays(cols, fields=list(FOUND))],
                [*(batch.schema.names[i] for i in keep), "secrets"])

    return work


def scan_secrets(docs: DataFrame, text: str = "text", mask: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``secrets``: counts, spans in code points, and with ``mask`` a masked text.

    One pass per text, no shuffle, each row for itself. Null counts as empty (its masked text stays null); an
    own column called ``secrets`` is replaced. Without ``mask`` the text column itself is left out, so that it
    need not come back from Python.
    """
    rest = [c for c in docs.columns if c not in (text, "secrets")]
    narrow = docs.select(F.col(f"`{text}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in rest])
    fields = narrow.schema.fields if mask is not None else narrow.schema.fields[1:]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), FOUND_DDL])
    return narrow.mapInArrow(_scanner(text, mask), ddl)
