"""Token ids of texts by a tokenizers file, with each distinct chunk encoded once.

The pre-tokenizers used here never join characters across the edge from a
non-space to a space, nor across one between an ASCII letter and ASCII
punctuation other than the apostrophe.  So a text's ids are those of its chunks
(spaces and what stands behind them up to the next such edge) one after the
other.  A chunk table in each Python worker maps chunk hashes to ids, and each
chunk's bytes are compared with the table's; numpy expands them.  Texts with other than ASCII spaces, or with the content of an added
token (such as <|endoftext|>, which is one id), go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from . import textkernel

#: Unicode white space beyond ASCII, and the ASCII separators that some regular expressions count as space.
_ODD = re.compile(b"\xc2\xa0|\xc2\x85|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_MAY_BE_ODD = np.zeros(256, bool)
_MAY_BE_ODD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: 1: ASCII letters, 2: ASCII punctuation but the apostrophe, 0: all else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[39] = 0
_KIND[65:91] = _KIND[97:123] = 1
#: Chunks that a table keeps; where more come, the half that was met in most calls stays.
MOST_CHUNKS = 500_000
#: Chunks that the tokenizer gets in one call: its encodings are far larger than the ids.
AT_ONCE = 10_000
#: Chunks that are one text for the tokenizer, with an added token behind each: a text of its own costs half as much again.
JOINED = 30


def _ranges(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` values from each ``first`` on, one range after the other."""
    ends = np.cumsum(count)
    at = np.repeat(first - (ends - count), count)
    at += np.arange(len(at))
    return values[at]


def _longer(values: np.ndarray, n: int) -> np.ndarray:
    """The same values with room for ``n`` at least."""
    if n <= len(values):
        return values
    out = np.zeros(max(n, len(values) * 3 // 2), values.dtype)
    out[: len(values)] = values
    return out


def _borderless(x: str) -> bool:
    return not any(x[:k] == x[-k:] for k in range(1, len(x)))


class ChunkTable:
    """Ids of chunks by their hashes, found through slots: from the one that its lower bits name on, a key has the first that was free."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the tokenizer would spin
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        contents = [t.content for t in added.values() if t.content]
        #: Contents of added tokens, in any case: a normalizer may lower texts before it looks for them.
        self.added = re.compile(b"|".join(re.escape(c.encode()) for c in contents), re.I) if contents else None
        self.contents = [c.encode().lower() for c in contents]
        #: An added token (id, content) that parts a text wherever it stands and can't overlap itself.
        plain = {i: t.content.encode() for i, t in added.items() if not (t.single_word or t.lstrip or t.rstrip or t.normalized) and t.content and _borderless(t.content)}
        self.separator = min(plain.items(), default=None)
        self.clear()

    def clear(self) -> None:
        self.size = self.n_ids = self.n_raw = 0
        self.keys = np.zeros(1, np.uint64)
        self.first, self.count, self.starts, self.ends, self.met = (np.zeros(1, np.int32) for _ in range(5))
        self.ids = np.zeros(0, np.uint32)
        self.raw = np.zeros(0, np.uint8)
        self.slots = np.full(1 << 12, -1, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without added tokens' contents one after the other, and each one's number of ids."""
        if self.separator is not None:
            own, content = self.separator
            texts = [content.join([*chunks[k : k + JOINED], b""]).decode("utf-8", "replace") for k in range(0, len(chunks), JOINED)]
            ids = np.fromiter(chain.from_iterable(self.encode(texts)), np.uint32)
            cuts = np.flatnonzero(ids == own)
            if len(cuts) == len(chunks):  # fewer: a chunk's end and the separator's start are another added token
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1
        found = self.encode([c.decode("utf-8", "replace") for c in chunks])
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Enter chunks with their keys, which the table has not."""
        for i in range(0, len(chunks), AT_ONCE):
            some = chunks[i : i + AT_ONCE]
            ids, count = self.encode_chunks(some)
            self._append(keys[i : i + AT_ONCE], ids, count, np.frombuffer(b"".join(some), np.uint8), np.fromiter(map(len, some), np.int64, len(some)))

    def _append(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, length: np.ndarray) -> None:
        a, b = self.size, self.size + len(keys)
        ends = self.n_raw + np.cumsum(length)
        for name, new in (("keys", keys), ("first", self.n_ids + np.cumsum(count) - count), ("count", count), ("starts", ends - length), ("ends", ends), ("met", 0)):
            setattr(self, name, _longer(getattr(self, name), b))
            getattr(self, name)[a:b] = new
        self.ids, self.raw = _longer(self.ids, self.n_ids + len(ids)), _longer(self.raw, self.n_raw + len(raw))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.raw[self.n_raw : self.n_raw + len(raw)] = raw
        self.size, self.n_ids, self.n_raw = b, self.n_ids + len(ids), self.n_raw + len(raw)
        if 2 * b > len(self.slots):
            self.slots = np.full(1 << (2 * b).bit_length(), -1, np.int32)
            a = 0
        place = np.arange(a, b, dtype=np.int32)
        slot = self._slot(self.keys[a:b])
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]  # of several for one slot one stays
            rest = self.slots[slot] != place
            place, slot = place[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the table, -1 where it is not there."""
        slot = self._slot(keys)
        place = self.slots[slot]
        rest = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            place[rest] = self.slots[slot[rest]]
            rest = rest[(place[rest] >= 0) & (self.keys[place[rest]] != keys[rest])]
        return place

    def make_room(self) -> None:
        """Keep the half of MOST_CHUNKS that was met in most calls; older calls count half."""
        keep = np.arange(self.size)
        if self.size > MOST_CHUNKS // 2:
            keep = np.sort(np.argpartition(-self.met[: self.size], MOST_CHUNKS // 2)[: MOST_CHUNKS // 2])
        keys, count, length, met = self.keys[keep], self.count[keep], (self.ends - self.starts)[keep], self.met[keep] // 2
        ids, raw = _ranges(self.ids, self.first[keep], count), _ranges(self.raw, self.starts[keep], length)
        self.clear()
        self._append(keys, ids, count, raw, length)
        self.met[: self.size] = met

    def places(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """Places of chunks [starts, ends) of ``data`` with these keys; unknown ones are learned."""
        place = self.lookup(keys)
        new = np.flatnonzero(place < 0)
        distinct, index = np.unique(keys[new], return_index=True)
        if self.size + len(distinct) > MOST_CHUNKS:
            self.make_room()
            place = self.lookup(keys)
            new = np.flatnonzero(place < 0)
            distinct, index = np.unique(keys[new], return_index=True)
        if len(new):
            index = new[index]
            self.learn(distinct, [data[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
            place[new] = self.lookup(keys[new])
        self.met[place] += 1
        return place


@lru_cache(maxsize=4)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def vocabulary(path: str) -> int:
    """One more than the greatest id of a tokenizer."""
    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def _chunks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each chunk: texts' starts, each space that follows a non-space, and each edge of letter and punctuation."""
    space, kind = textkernel._SPACE[raw], _KIND[raw]
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = (space[1:] & ~space[:-1]) | (kind[1:] * kind[:-1] == 2)
    start[offsets[:-1]] = True
    start[len(raw)] = False
    return np.flatnonzero(start)


def encode_flat(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's first id (n + 1)."""
    table = chunk_table(path)
    n = len(offsets) - 1
    data = raw.tobytes()
    some = np.unique(np.searchsorted(offsets, np.flatnonzero(_MAY_BE_ODD[raw]), "right") - 1)
    odd = {d for d in some.tolist() if _ODD.search(data, int(offsets[d]), int(offsets[d + 1]))}
    lowered = data.lower()
    if any(c in lowered for c in table.contents):
        odd |= {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in table.added.finditer(data)}
    starts = _chunks(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
    if odd:
        keep = ~np.isin(doc, sorted(odd))
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
    place = table.places(textkernel.word_hashes(raw, starts, ends), starts, ends, data)
    right = textkernel.equal_spans(raw, starts, ends, table.raw[: table.n_raw], table.starts[place], table.ends[place])
    if not right.all():  # another chunk has the same hash: those texts go whole
        odd |= set(doc[~right].tolist())
        keep = ~np.isin(doc, sorted(odd))
        doc, place = doc[keep], place[keep]
    odd = sorted(odd)
    count = table.count[place]
    ids = _ranges(table.ids, table.first[place], count)
    sizes = np.bincount(doc, weights=count, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    if odd:
        whole = table.encode([data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in odd])
        bounds = np.r_[0, np.cumsum(sizes)]
        parts, last = [], 0
        for d, own in zip(odd, whole, strict=True):
            parts += [ids[last : bounds[d]], np.array(own, np.uint32)]
            last = bounds[d]
            sizes[d] = len(own)
        ids = np.concatenate((*parts, ids[last:]))
    return ids, np.r_[0, np.cumsum(sizes)]


def with_end(ids: np.ndarray, firsts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id behind each text's ids."""
    n = len(firsts) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    out[np.arange(len(ids)) + doc] = ids
    return out, firsts + np.arange(n + 1)
