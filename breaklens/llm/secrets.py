"""Secret scans: an Aho-Corasick prefilter on keywords, anchored expressions at its hits, then checksums.

Kinds: assign (keyword, separator, value), access (key ids), hex (long hexadecimal runs), and two that carry
their own checksum and are reported only where it holds: forge (prefix, 30 base-62 digits, and the CRC-32 of
those as 6 base-62 digits) and card (16 digits that pass the Luhn test).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm import text as T

# The keywords and expressions of the base kinds, and the prefixes of checksummed tokens.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS_WORD = "AKIA"
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
FORGE_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
FORGE = re.compile(rb"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "forge", "card")
MIN_VALUE, MIN_ACCESS, MIN_HEX, CARD_DIGITS = 12, 18, 16, 16

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


@cache
def _keywords() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD.lower(),)), ("forge", FORGE_WORDS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def forge_checks(body: bytes, check: bytes) -> bool:
    crc, digits = zlib.crc32(body), b""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d : d + 1] + digits
    return digits == check


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least `least` true values, cut at text boundaries."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1]
    inside = cut[(cut > 0) & (cut < len(mask))]
    inside = np.unique(inside[mask[inside - 1] & mask[inside]])
    start, end = np.sort(np.concatenate([start, inside])), np.sort(np.concatenate([end, inside]))
    keep = end - start >= least
    return start[keep], end[keep]


def keyword_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Byte spans of the kinds that begin with a keyword, each kind leftmost and without overlap."""
    out, upto = [], {"assign": 0, "access": 0, "forge": 0}
    lower = raw.lower().decode("latin-1")  # one character per byte; only A-Z change
    for last, (kind, size) in sorted(_keywords().iter(lower), key=lambda h: h[0] - h[1][1]):
        at = last - size + 1
        if at < upto[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "forge": FORGE}[kind].match(raw, at)
        if not m:
            continue
        upto[kind] = m.end()
        good = {
            "assign": lambda m: len(m[1]) >= MIN_VALUE,
            "access": lambda m: len(m[0]) >= MIN_ACCESS,
            "forge": lambda m: forge_checks(m[1], m[2]),
        }[kind](m)
        if good:
            out.append((kind, at, m.end()))
    return out


def _scan(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans of every text, in code points, by start and then kind."""
    spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()
    hex_start, hex_end = _runs(_HEX[data], offsets, MIN_HEX)
    num_start, num_end = _runs(_DIGIT[data], offsets, CARD_DIGITS)
    for kind, start, end in (("hex", hex_start, hex_end), ("card", num_start, num_end)):
        text = np.searchsorted(offsets, start, "right") - 1
        for t, a, b in zip(text.tolist(), start.tolist(), end.tolist()):
            if kind == "hex" or (b - a == CARD_DIGITS and luhn(raw[a:b])):
                spans[t].append((kind, a, b))
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        spans[t] += [(k, a + x, a + y) for k, x, y in keyword_spans(raw[a:b])]
        if spans[t]:
            lead = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
            points = [(k, int(lead[x - a]), int(lead[y - a])) for k, x, y in spans[t]]
            spans[t] = sorted(points, key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Positions are code points, ends exclusive. A null or empty text has no spans: counts 0, spans '' and the
    digest of nothing. Repeated ids are rows of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in T.blocks(batch.column(1)):
                found = _scan(data, offsets)
                base = [[s for s in spans if s[0] in KINDS[:3]] for spans in found]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
                digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
                every = pa.array([_joined(s) for s in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(found)), *counts, digest, every],
                    names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    out = base.mapInArrow(run, f"_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)
