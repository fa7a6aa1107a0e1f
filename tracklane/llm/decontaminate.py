"""Benchmark passages in documents, re-parameterised ones included.

Texts become templates: numbers, units and names turn into typed placeholders,
other words are lower-cased and stripped of punctuation.  A unit counts only
behind a number, or attached to one; names that follow each other are one.  A
capitalised word that begins a sentence is read both ways, as a plain word and as
a name, on both sides.  Windows of WINDOW template words of the benchmark are
hash-joined with those of the documents.  A document holds an item if a share of
the item's windows (``share``) lies together in it and their slots are consistent:
where the item repeats a value, the document repeats one too, and different values
stay different, over all the windows.  Windows lie together if they are as far
from each other as in the item, or if that differs by less than NEAR words, or by
less than half the item's length.  Windows without a plain word tell nothing and
count on neither side, so that tables of numbers meet nothing.  Of an item with fewer than WINDOW words the whole template is its one
window, and documents are searched for windows of that length too; without a
plain word in it, its own values must be there.  An item without a word is never
held.

The benchmark's windows are sent to the tasks when their number, and that of the
rows that name their items, is within ``broadcast_windows`` (both are counted
first); beyond it both sides are shuffled.

Input: documents with doc_id and text, benchmark with item_id and text; others
are ignored.  Null texts are empty.  Rows with a null doc_id hold nothing.
Repeated rows are judged together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import Scratch, small_batches

U = np.uint64
WINDOW = 5
SHARE = 0.8
BROADCAST_WINDOWS = 2_000_000
NEAR = 8
#: Bytes of text that are read at once (or one longer document), and documents that a Python worker gets at once.
CHUNK, DOCUMENTS = 1 << 19, 2000

#: Units of measure that become one placeholder.
UNITS = tuple(
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hours minutes seconds days weeks years "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres "
    "percent dollars euros cents usd eur c f k w kw v a hz khz mhz ghz mph kmh".split()
)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ONES = rb"one|two|three|four|five|six|seven|eight|nine"
_TENS = rb"twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
_OTHER = rb"zero|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|hundred|thousand|million|billion"
_NUMBER_WORDS = frozenset(b"|".join((_ONES, _TENS, _OTHER)).split(b"|"))
_NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/]*%?|(" + _TENS + rb")-(" + _ONES + rb")")
_WITH_UNIT = re.compile(rb"([+-]?[$]?\d[\d.,:/]*)(" + "|".join(sorted(UNITS, key=len, reverse=True)).encode() + rb")")
_UNIT_SET = frozenset(u.encode() for u in UNITS)

_LETTER, _MARK, _CLOSES = (np.isin(np.arange(256), list(chars)) for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _PUNCTUATION, b".!?:"))

# An opening is a capitalised word that begins a sentence: it is read as a plain word and as a name.
_PLAIN, _NUM, _UNIT, _NAME, _OPENING = range(5)
_PLACEHOLDER = np.arange(5, dtype=np.uint64) * U(0x9E3779B97F4A7C15)


def classify(w: bytes) -> tuple[bytes, bytes, bool, bool, bool, bool, bool, bool]:
    """Plain word, unit attached to it, and whether it is a number, a unit, capitalised, ends a sentence, is closed before, and behind."""
    core = w.strip(_PUNCTUATION)
    if core.isascii():
        plain, capital = core.lower(), core[:1].isupper()
    else:
        text = core.decode("utf-8", "replace")
        plain, capital = text.lower().encode(), text[:1].isupper()
    attached, number = b"", False
    if plain.isalpha():
        number = plain in _NUMBER_WORDS
    elif plain[:1].isdigit() or b"-" in plain:
        if m := _WITH_UNIT.fullmatch(plain):
            plain, attached = m[1], m[2]
        number = bool(_NUMBER.fullmatch(plain))
    return plain, attached, number, plain in _UNIT_SET, capital, w[-1:] in b".!?:", w[:1] != core[:1], w[-1:] != core[-1:]


def _classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the hashes of its plain word and of the unit attached to it, and what :func:`classify` tells.

    Letters with punctuation behind them, most of all words, are told by their bytes
    at once; only the distinct ones of the rest are looked at singly.
    """
    letters, marks = (np.concatenate(([0], np.cumsum(table[raw]))) for table in (_LETTER, _MARK))
    n = letters[ends] - letters[starts]
    core = starts + n
    simple = (n > 0) & (letters[core] - letters[starts] == n) & (marks[ends] - marks[core] == ends - core)
    plain_hash, unit_hash = np.zeros(len(starts), np.uint64), np.full(len(starts), _hashes([b""])[0], np.uint64)
    flags = np.zeros((len(starts), 8), bool)
    at = np.flatnonzero(simple)
    plain_hash[at] = textkernel.word_hashes(textkernel.lower(raw), starts[at], core[at])
    last = raw[ends[at] - 1]
    number, unit = (np.isin(plain_hash[at], _hashes(sorted(names))) for names in (_NUMBER_WORDS, _UNIT_SET))
    for k, flag in enumerate((True, False, number, unit, raw[starts[at]] <= ord("Z"), _CLOSES[last], False, ends[at] > core[at])):
        flags[at, k] = flag
    at = np.flatnonzero(~simple)
    if len(at):
        _, index, inverse = np.unique(textkernel.word_hashes(raw, starts[at], ends[at]), return_index=True, return_inverse=True)
        data, own = raw.tobytes(), at[index]
        found = [classify(data[a:b]) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
        plain_hash[at], unit_hash[at] = (_hashes([x[k] for x in found])[inverse] for k in (0, 1))
        flags[at] = np.array([(bool(x[0]), bool(x[1]), *x[2:]) for x in found], bool)[inverse]
    return plain_hash, unit_hash, flags


class Templates:
    """Template words of a run of texts: hash, kind, value, document, and place in it.

    Names that follow each other are one.  ``joins``: an opening that is one name
    with the next word when it is read as a name; that word shares its place.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        starts, ends, firsts = textkernel.words(raw, offsets)
        plain_hash, unit_hash, flags = _classes(raw, starts, ends)
        word, attached, number, unit, capital, closes, before, behind = flags.T
        n = len(word)
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        # a word begins a sentence if the last word with letters before it ends one or is in another document
        last = np.maximum.accumulate(np.where(word | closes, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        previous = np.r_[-1, last[:-1]] if n else last
        begins = (previous < 0) | (closes[previous] | (doc[previous] != doc))
        # a number with its unit is two words
        at = np.repeat(np.arange(n), word.astype(np.int64) + (word & attached))
        second = np.r_[False, at[1:] == at[:-1]] if len(at) else np.zeros(0, bool)
        doc, number = doc[at], number[at] & ~second
        same = np.r_[False, doc[1:] == doc[:-1]] if len(at) else np.zeros(0, bool)
        after_number = np.r_[False, number[:-1]] & same if len(at) else number
        capital = capital[at]
        kind = np.where(number, _NUM, np.where(second | (unit[at] & after_number), _UNIT, np.where(capital, np.where(begins[at], _OPENING, _NAME), _PLAIN)))
        value = textkernel.mix(np.where(second, unit_hash[at], plain_hash[at]))
        # names that follow each other without punctuation between them
        adjacent = same & np.r_[False, (at[1:] == at[:-1] + 1) & ~behind[at[:-1]] & ~before[at[1:]]] if len(at) else same
        more = adjacent & (kind == _NAME)
        more[1:] &= kind[:-1] == _NAME
        head = np.flatnonzero(~more)
        joined = (adjacent & (kind == _NAME) & np.r_[False, kind[:-1] == _OPENING])[head] if len(at) else more
        self.value = np.add.reduceat(value, head) if len(head) else value
        self.kind, self.doc = kind[head], doc[head]
        self.hash = np.where(self.kind == _PLAIN, self.value, _PLACEHOLDER[self.kind])
        self.joined, self.joins = joined, np.append(joined[1:], False) if len(head) else joined
        self.firsts = np.searchsorted(self.doc, np.arange(len(offsets)))
        rank = np.cumsum(~joined) - 1
        self.place = rank - rank[self.firsts[:-1][self.doc]] if len(head) else rank

    def _read(self, c: np.ndarray, as_name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and value (zero: none) of the words at ``c``, and the next words' indexes."""
        kind = self.kind[c]
        opening = kind == _OPENING
        named = opening & as_name
        joins = named & self.joins[c]
        h = np.where(opening, np.where(named, _PLACEHOLDER[_NAME], self.value[c]), self.hash[c])
        value = self.value[c] + np.where(joins, self.value[np.minimum(c + 1, len(self.value) - 1)], U(0))
        return h, np.where((kind == _PLAIN) | (opening & ~named), U(0), value | U(1)), c + 1 + joins

    def windows(self, sizes: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, readings (a bit for each word), words, hash and end of each window.

        ``sizes``: the numbers of words that are wanted; None: WINDOW, and fewer
        where they are the whole text.  Each opening in a window is read both ways.
        """
        start = np.arange(len(self.kind))
        c, bits, h = start.copy(), np.zeros(len(start), np.int64), np.zeros(len(start), U)
        end = self.firsts[1:][self.doc] if len(start) else start
        out = []
        for step in range(WINDOW):
            inside = c < end[start]
            start, c, bits, h = start[inside], c[inside], bits[inside], h[inside]
            two = np.flatnonzero(self.kind[c] == _OPENING)
            start, c, h = (np.concatenate((x, x[two])) for x in (start, c, h))
            bits = np.concatenate((bits, bits[two] | (1 << step)))
            word, _, c = self._read(c, (bits >> step & 1).astype(bool))
            h = textkernel.mix(h * U(0x9E3779B97F4A7C15) + word + U(step + 1))
            size = step + 1
            if sizes is not None and size in sizes or size == WINDOW and sizes is None:
                out.append((start, bits, np.full(len(start), size), h, c))
            elif sizes is None:
                whole = (start == self.firsts[:-1][self.doc[start]]) & (c == end[start])
                out.append((start[whole], bits[whole], np.full(whole.sum(), size), h[whole], c[whole]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def slots(self, start: np.ndarray, bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values of the placeholders of windows (zero: no placeholder)."""
        out, c = np.zeros((len(start), WINDOW), np.uint64), start.copy()
        for step in range(WINDOW):
            on = np.flatnonzero(size > step)
            _, out[on, step], c[on] = self._read(c[on], (bits[on] >> step & 1).astype(bool))
        return out


def _hashes(plains: list[bytes]) -> np.ndarray:
    if not plains:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b"".join(plains), np.uint8)
    at = np.r_[0, np.cumsum([len(p) for p in plains])]
    return textkernel.word_hashes(raw, at[:-1], at[1:])


def _windows(only: np.ndarray | None, name: str, sizes: tuple[int, ...] | None):
    """Rows of windows: id, place, hash, words, slot values, openings read as names; ``only``: sorted hashes that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch[name].to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                t = Templates(raw, offsets)
                start, bits, size, h, _ = t.windows(sizes)
                if only is not None:
                    at = np.minimum(np.searchsorted(only, h), max(len(only) - 1, 0))
                    wanted = only[at] == h if len(only) else np.zeros(len(h), bool)
                else:
                    wanted = ~t.joined[start] if sizes is None else np.ones(len(h), bool)  # an item's place is counted once
                start, bits, size, h = start[wanted], bits[wanted], size[wanted], h[wanted]
                slots = t.slots(start, bits, size).view(np.int64)
                telling = (size < WINDOW) | (slots == 0).any(axis=1)
                start, bits, size, h, slots = start[telling], bits[telling], size[telling], h[telling], slots[telling]
                lists = pa.ListArray.from_arrays(np.arange(0, slots.size + 1, WINDOW, dtype=np.int32), pa.array(slots.ravel()))
                readings = sum(bits >> k & 1 for k in range(WINDOW)) + WINDOW * t.joined[start]  # the whole name rather than its rest
                columns = [ids[i:j][t.doc[start]], t.place[start], h.view(np.int64), size, lists, readings]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [name, "place", "h", "size", "slots", "named"])

    return run


#: A window is consistent if equal slots of the item are equal in the document, and different ones differ.
_CONSISTENT = (
    "forall(sequence(0, {n} - 2), i -> forall(sequence(i + 1, {n} - 1), k -> slots[i] = 0 OR slots[k] = 0 OR item_slots[i] = 0 OR item_slots[k] = 0 "
    "OR ((slots[i] = slots[k]) = (item_slots[i] = item_slots[k]))))"
).format(n=WINDOW)
#: A short item without a plain word would be in every document with a number or name.
_TELLING = f"size = {WINDOW} OR exists(slice(slots, 1, CAST(size AS INT)), x -> x = 0) OR slots = item_slots"
#: Groups of windows by how far they lie from their places in the item: exactly, and in ranges that overlap by half.
_GROUPS = (
    "transform(array(struct(0 AS wide, 1L AS half, 0 AS odd), struct(1 AS wide, {near} AS half, 0 AS odd), struct(1 AS wide, {near} AS half, 1 AS odd), "
    "struct(2 AS wide, {long} AS half, 0 AS odd), struct(2 AS wide, {long} AS half, 1 AS odd)), "
    "g -> struct(g.wide AS wide, g.odd AS odd, CAST(floor((place - item_place + g.odd * g.half) / (IF(g.wide = 0, 1, 2) * g.half)) AS LONG) AS n))"
).format(near=f"{NEAR}L", long=f"greatest({NEAR}L, item_windows div 2)")


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, exact) for each item that a document holds.

    ``windows`` counts the places of the item whose windows are found together, ``exact``
    those whose slot values are the item's own.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    schema = "{} long, place long, h long, size long, slots array<long>, named long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    items = scratch.put(items.mapInArrow(_windows(None, "item_id", None), schema.format("item_id")), "items")
    item_windows = items.groupBy("item_id").agg(F.countDistinct("place").alias("item_windows"))
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))
    wanted = items.select("h").distinct()
    n = wanted.count()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    only = np.sort(wanted.toPandas()["h"].to_numpy(np.int64).view(np.uint64)) if n <= broadcast_windows else None
    found = docs.mapInArrow(_windows(only, "doc_id", sizes), schema.format("doc_id"))
    per_item = items.select("item_id", F.col("place").alias("item_place"), "h", F.col("slots").alias("item_slots"), F.col("named").alias("item_named")).distinct()
    per_item = scratch.put(per_item.join(item_windows, "item_id"), "windows")
    joined = found.join(F.broadcast(per_item) if per_item.count() <= broadcast_windows else per_item, "h").where(F.expr(_CONSISTENT)).where(F.expr(_TELLING))
    # of several readings of the same words the one with the fewest openings read as names
    where = ["doc_id", "item_id", "item_windows", "item_place", "place"]
    hits = joined.groupBy(where).agg(F.min(F.struct(F.expr("named + item_named").alias("n"), "slots", "item_slots")).alias("best"))
    with small_batches(spark, DOCUMENTS):
        hits = scratch.put(hits.select(*where, "best.slots", "best.item_slots"), "hits")
    # too few windows at whatever places: never held
    enough = hits.groupBy("doc_id", "item_id", "item_windows").agg(F.countDistinct("item_place").alias("n")).where(F.col("n") >= share * F.col("item_windows"))
    grouped = hits.join(enough.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").withColumn("group", F.explode(F.expr(_GROUPS)))
    group = ["doc_id", "item_id", "item_windows", "group"]
    at = grouped.groupBy(*group, "item_place").agg(F.max(F.expr("slots = item_slots")).alias("same"))
    counts = at.groupBy(group).agg(F.count("*").alias("windows"), F.count_if("same").alias("exact")).where(F.col("windows") >= share * F.col("item_windows"))
    pairs = grouped.select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("p")).where("p.item_slots <> 0 AND p.slots <> 0")
    pairs = pairs.select(*group, F.col("p.item_slots").alias("ours"), F.col("p.slots").alias("theirs")).distinct()
    torn = pairs.groupBy(*group, "ours").agg(F.count("*").alias("n")).where("n > 1").select(group)
    torn = torn.unionByName(pairs.groupBy(*group, "theirs").agg(F.count("*").alias("n")).where("n > 1").select(group)).distinct()
    held = counts.join(torn, group, "left_anti").groupBy("doc_id", "item_id", "item_windows").agg(F.max(F.struct("windows", "exact")).alias("best"))
    return held.select("doc_id", "item_id", "best.windows", "item_windows", "best.exact")


def contamination(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document row: doc_id, contaminated, n_items, items (sorted item_ids it holds)."""
    leaks = find_leaks(documents, benchmark, share).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left")
    return out.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )
