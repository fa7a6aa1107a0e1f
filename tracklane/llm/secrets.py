"""Secrets in texts: known forms, and strings of high entropy.

Known forms are those of the fixed expressions below.  Beyond them, each maximal
run of candidate characters, less the known forms in it, is searched for windows
of high Shannon entropy: all its windows as base64, and those of each stretch of
hex digits in it as hex.  As the window moves, one count rises and one falls, and
with them the sum of c log c.  The windows of a piece above the threshold are
reported as one span.  Pieces and stretches on the allow-list (UUIDs, dates and
versions, words, numbers, paths of such words) are left out.  Letters alone are words
only with the case of words: single-case keys of letters alone can't be told from them.

Positions are in code points, ends exclusive.  Input: doc_id and text, others
ignored or handed on; a null text is empty; repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel

#: The known forms, their kinds in order, and least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Candidate classes of the entropy scan: window, least entropy in bits a character.
CLASSES = {"hex": (24, 3.0), "base64": (20, 3.7)}
ALLOWED = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9.,:/_+-]+")
#: Letters, in one or several parts, which are on the allow-list if each part has the case of words.
LETTERS = re.compile(rb"[A-Za-z]+([-_/.=+]+[A-Za-z]+)*")
#: A run of this form is on the allow-list if each of its segments looks like words.
PATH = re.compile(rb"/?([\w.-]+/)+[\w.-]*")

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX_STRETCH = re.compile(rb"[0-9a-fA-F]{%d,}" % CLASSES["hex"][0])
_LETTERS_AND_NUMBER = re.compile(rb"([A-Za-z]*)[0-9]*|[0-9]*([A-Za-z]*)")
_CASE_CHANGE = re.compile(rb"[a-z](?=[A-Z])|[A-Z](?=[a-z])")
_NAME_PART = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")


def _word_like(part: bytes) -> bool:
    """Letters with the case of words or of names of several, with at most one number before or behind them; or of four different characters at most."""
    if len(set(part)) <= 4:
        return True
    m = _LETTERS_AND_NUMBER.fullmatch(part)
    letters = m and (m[1] or m[2] or b"")
    return letters is not None and (len(_CASE_CHANGE.findall(letters)) <= max(3, len(letters) / 3) or len(_NAME_PART.findall(letters)) <= len(letters) / 4)


def allowed(run: bytes) -> bool:
    """Whether a run is on the allow-list: as a whole, or as a path whose segments all are or consist of words."""
    if ALLOWED.fullmatch(run):
        return True
    if LETTERS.fullmatch(run):
        return all(map(_word_like, re.findall(rb"[A-Za-z]+", run)))
    return bool(PATH.fullmatch(run)) and all(ALLOWED.fullmatch(x) or all(map(_word_like, re.split(rb"[._-]", x))) for x in run.split(b"/"))


def entropy_windows(run: bytes, window: int, least: float) -> tuple[int, int] | None:
    """First and last + 1 character of the windows whose entropy is ``least`` at least."""
    if len(run) < window:
        return None
    counts: dict[int, int] = {}
    x_log_x = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    total, first, last, whole = 0.0, None, 0, math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += x_log_x[n + 1] - x_log_x[n]
        counts[c] = n + 1
        if i >= window - 1:
            if whole - total / window >= least:
                first, last = (i - window + 1 if first is None else first), i + 1
            old = run[i - window + 1]
            n = counts[old]
            total += x_log_x[n - 1] - x_log_x[n]
            counts[old] = n - 1
    return None if first is None else (first, last)


def entropy_span(piece: bytes) -> tuple[int, int] | None:
    """First and last + 1 character of a piece's windows of high entropy, of either class."""
    if allowed(piece):
        return None
    hits = [entropy_windows(piece, *CLASSES["base64"])]
    for m in _HEX_STRETCH.finditer(piece):
        if not allowed(m[0]) and (hit := entropy_windows(m[0], *CLASSES["hex"])):
            hits.append((m.start() + hit[0], m.start() + hit[1]))
    hits = [hit for hit in hits if hit]
    return (min(a for a, _ in hits), max(b for _, b in hits)) if hits else None


def _runs(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of candidate characters of ``least`` bytes at least."""
    inside = _CANDIDATE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    cut = np.searchsorted(offsets, starts, "right") - 1
    if len(starts) and (offsets[cut + 1] < ends).any():  # a run that crosses documents
        pairs = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")].tolist()
            points = [a, *inner, b]
            pairs += [(x, y) for x, y in zip(points[:-1], points[1:], strict=True) if y - x >= least]
        starts, ends = np.array(pairs, np.int64).reshape(-1, 2).T
    return starts, ends


def spans(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, end, kind) in bytes of the flat texts, by document, start and kind."""
    out: list[tuple[int, int, int, int]] = []
    data = raw.tobytes()
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out += [(d, m.start(), m.end(), 0) for m in ASSIGN.finditer(data, a, b) if len(m[2]) >= 8]
        out += [(d, m.start(), m.end(), 1) for m in ACCESS.finditer(data, a, b) if len(m[0]) >= 16]
        out += [(d, m.start(), m.end(), 2) for m in HEX.finditer(data, a, b)]
    begins, closes = [], []  # the known spans, those that overlap as one
    for _, a, b, _ in sorted(out, key=lambda x: x[1]):
        if closes and a <= closes[-1]:
            closes[-1] = max(closes[-1], b)
        else:
            begins.append(a)
            closes.append(b)
    shortest = min(window for window, _ in CLASSES.values())
    starts, ends = _runs(raw, offsets, shortest)
    docs = np.searchsorted(offsets, starts, "right") - 1
    for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True):
        inner = slice(bisect_right(closes, a), bisect_left(begins, b))
        for x, y in [*zip(begins[inner], closes[inner], strict=True), (b, b)]:
            if x - a >= shortest and (hit := entropy_span(data[a:x])):
                out.append((d, a + hit[0], a + hit[1], 3))
            a = max(a, y)
    return sorted(out, key=lambda x: (x[0], x[1], x[3]))


def _points(raw: np.ndarray, offsets: np.ndarray, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same spans in code points of their documents."""
    if not found:
        return []
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [(d, int(before[a] - before[offsets[d]]), int(before[b] - before[offsets[d]]), k) for d, a, b, k in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i, j, raw, offsets in textkernel.texts(batch["text"]):
            rows: list[list[dict]] = [[] for _ in range(j - i)]
            for d, a, b, k in _points(raw, offsets, spans(raw, offsets)):
                rows[d].append({"kind": KINDS[k], "start": a, "end": b})
            yield pa.record_batch([batch["doc_id"].slice(i, j - i), pa.array(rows, kind)], ["doc_id", "spans"])


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and kind."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i, j, raw, offsets in textkernel.texts(batch["text"]):
            part = batch.slice(i, j - i)
            found = spans(raw, offsets)
            if found:
                data, pieces, done = raw.tobytes(), [[] for _ in range(j - i)], {}
                for d, a, b, _ in found:
                    last = done.get(d, int(offsets[d]))
                    if a >= last:
                        pieces[d] += [data[last:a], b"[SECRET]"]
                    done[d] = max(last, b)
                texts = part["text"].to_pylist()
                for d, last in done.items():
                    texts[d] = (b"".join(pieces[d]) + data[last : int(offsets[d + 1])]).decode("utf-8", "replace")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            yield part


def mask_secrets(documents: DataFrame) -> DataFrame:
    """All rows and columns, with each secret in text replaced by [SECRET]; a null text stays null."""
    return documents.mapInArrow(_masked, documents.schema)
