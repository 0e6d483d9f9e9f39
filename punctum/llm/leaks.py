"""Evaluation passages in corpus texts, verbatim, altered or with other slot fillers.

1. Template canonicalisation: the words of passages and texts (``punctum.llm.words``) become templates in which
   numbers, units and names are typed placeholders. A name is a word that no passage uses in lower case.
2. Windows of three words are joined by hash, of their template if two of the three are ordinary words. A stretch of at least 15 words with at most one edit in five keeps
   at least four of its windows (13 of them, less three for each of three edits), so a text and an item that share
   fewer can't be a case. The hash table of a block of items has a bounded size and is sent to all tasks; texts stay where they are.
3. The templates of the pairs left are aligned, with at most one edit in five. Equal words have equal templates, so no case is lost.
4. The slots of what aligned are checked. Where the fillers agree but for what the edits allow, the passage is held; where
   each filler is replaced by one other throughout, it is re-parameterised.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from punctum.llm.words import words
from punctum.plans.spread import spread

#: Words of a passage that a case holds at least, and words for each of which one may be an edit.
STRETCH, PER_EDIT = 15, 5
#: Template words of a window.
WINDOW = 3
#: Windows that every case shares: see the module's text.
SHARED = (STRETCH - WINDOW + 1) - WINDOW * (STRETCH // PER_EDIT)
#: Items of which an opening sentence is the instruction and no part of the passage.
INSTRUCTED = 5
#: Units of measure in passages and texts; fixed list.
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years micrometre micrometres micron microns nanometre nanometres millimetre millimetres metre metres kilometre kilometres gram grams kilogram kilograms milligram milligrams litre litres millilitre millilitres degree degrees percent".split())

_NUMBER, _UNIT, _NAME = "<number>", "<unit>", "<name>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def opening(passage: str | None) -> str:
    """The words of the passage's first sentence."""
    return " ".join(words(_SENTENCE.split((passage or "").strip())[0]))


def passage_words(passage: str | None, instructed: bool) -> list[str]:
    """The words of a passage, without its first sentence if that is an instruction."""
    s = _SENTENCE.split((passage or "").strip())
    return words(" ".join(s[1:] if instructed else s))


def vocabulary(passages: list[str | None]) -> frozenset[str]:
    """The words that some passage writes in lower case: its ordinary words, not its names."""
    return frozenset(w for p in passages for raw in re.findall(r"\S+", p or "") if raw[:1].islower() for w in words(raw))


def template(ws: list[str], ordinary: frozenset[str]) -> list[str]:
    """``ws`` with typed placeholders for numbers, units and names."""
    return [_NUMBER if w[0].isdigit() else _UNIT if w in UNITS else w if w in ordinary else _NAME for w in ws]


#: Hashes of words kept in a worker between texts, at most about CODES.
_CODES: dict[str, int] = {}
CODES = 500_000


def window_hashes(ws: list[str], ordinary: frozenset[str]) -> np.ndarray:
    """A 64-bit hash for each window of ``WINDOW`` words: of its template if that has two ordinary words, else of the words.

    A window of placeholders says nothing, so it is compared by its words; equal words give equal hashes either way.
    """
    n = len(ws) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(_CODES) > CODES:
        _CODES.clear()
    code = lambda w: _CODES.get(w) or _CODES.setdefault(w, xxhash.xxh64_intdigest(w))
    ts = template(ws, ordinary)
    own, typed = np.array([code(w) for w in ws], np.uint64), np.array([code(t) for t in ts], np.uint64)
    plain = np.array([t[0] != "<" for t in ts], np.int8)
    by_words = sum(plain[k : k + n] for k in range(WINDOW)) < 2
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = (out ^ np.where(by_words, own[k : k + n], typed[k : k + n])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _codes(*lists: list[str]) -> list[np.ndarray]:
    seen: dict[str, int] = {}
    return [np.array([seen.setdefault(w, len(seen)) for w in ws], np.int32) for ws in lists]


def holds_stretch(passage: np.ndarray, text: np.ndarray) -> bool:
    """True if ``text`` holds a stretch of at least ``STRETCH`` words of ``passage`` with at most one edit for ``PER_EDIT`` of them.

    An edit changes, leaves out or puts in a word. It is enough to look at stretches of under twice the length: of two
    halves of a longer one, one has no more edits for its length than the whole. All starts advance
    together, a passage word at a time, over all places of the text.
    """
    n = len(text)
    starts = len(passage) - STRETCH + 1
    if starts <= 0 or not n:
        return False
    cost = np.zeros((starts, n + 1), np.int16)
    places = np.arange(n + 1, dtype=np.int16)
    for length in range(1, 2 * STRETCH):
        alive = min(starts, len(passage) - length + 1)
        if alive <= 0:
            return False
        cost = cost[:alive]
        word = passage[length - 1 : length - 1 + alive]
        step = cost + np.int16(1)
        np.minimum(step[:, 1:], cost[:, :-1] + (word[:, None] != text[None, :]), out=step[:, 1:])
        cost = np.minimum.accumulate(step - places, axis=1) + places
        if length >= STRETCH and cost.min() <= length // PER_EDIT:
            return True
    return False


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True for the values in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _near(ts: np.ndarray, wanted: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Parts of a text, as (from, to), around ``SHARED`` of its windows that are in ``wanted`` and within ``reach`` of each other.

    Parts that touch are one; a stretch is in one of them, as it has so many shared windows itself.
    """
    hits = np.flatnonzero(_among(ts, np.unique(wanted)))
    ends = SHARED - 1
    close = np.flatnonzero(hits[ends:] - hits[: len(hits) - ends] <= reach)
    parts: list[tuple[int, int]] = []
    for i in close.tolist():
        lo, hi = max(0, int(hits[i]) - reach), int(hits[i + ends]) + WINDOW + reach
        if parts and lo <= parts[-1][1]:
            parts[-1] = (parts[-1][0], hi)
        else:
            parts.append((lo, hi))
    return parts


#: Words around a shared window that a stretch through it can reach: nearly twice STRETCH, and its insertions.
REACH = 2 * STRETCH + 2 * STRETCH // PER_EDIT


def _blocks(parts: list[tuple[int, int]], size: int = 2048) -> Iterator[tuple[int, int]]:
    """``parts`` in overlapping pieces, so that a long text needs no wide matrix and no stretch is cut."""
    for lo, hi in parts:
        while hi - lo > size:
            yield lo, lo + size
            lo += size - REACH
        yield lo, hi


def compare(item: list[str], text: list[str], ordinary: frozenset[str], hashes: np.ndarray | None = None) -> tuple[bool, bool]:
    """(held, varied): ``text`` holds a stretch of the item's words; or of its template, with other fillers throughout.

    Templates are aligned first, in the parts of the text around shared windows; then their slots decide, in which
    other fillers are edits. Varied texts replace names, numbers or units one for one: a filler of the item always by the
    same filler, and two by two different ones. ``hashes`` are the text's windows, if they are known.
    """
    parts = _near(window_hashes(text, ordinary) if hashes is None else hashes, window_hashes(item, ordinary), REACH)
    if not parts:
        return False, False
    ti, tt = template(item, ordinary), template(text, ordinary)
    ki, kt = _codes(ti, tt)
    aligned = [(lo, hi) for lo, hi in _blocks(parts) if holds_stretch(ki, kt[lo:hi])]
    if not aligned:
        return False, False
    ci, ct = _codes(item, text)
    if any(holds_stretch(ci, ct[lo:hi]) for lo, hi in aligned):
        return True, False
    return False, any(_consistent(item, ti, text[lo:hi], tt[lo:hi]) for lo, hi in aligned)


def _consistent(item: list[str], ti: list[str], text: list[str], tt: list[str]) -> bool:
    """True if aligned slots map fillers one to one, but for one in five, and not all to themselves."""
    pairs = [(item[m.a + i], text[m.b + i]) for m in SequenceMatcher(None, ti, tt, autojunk=False).get_matching_blocks() for i in range(m.size) if ti[m.a + i][0] == "<"]
    there, back = {}, {}
    clashes = sum(there.setdefault(a, b) != b or back.setdefault(b, a) != a for a, b in pairs)
    return bool(pairs) and clashes <= len(pairs) // PER_EDIT and any(a != b for a, b in pairs)


#: Windows of a block of items: its table of 32 bytes a window is sent to every executor.
BLOCK = 1_000_000
#: Results of texts kept in a worker, so that copies of a text are compared once for each task.
KEPT = 50_000


class ItemBlock:
    """Items with the hash table of their windows."""

    def __init__(self, ids: list, passages: list[str | None], per_item: list[list[str]]):
        self.ids, self.words, self.ordinary = ids, per_item, vocabulary(passages)
        hashes = [np.unique(window_hashes(ws, self.ordinary), return_counts=True) for ws in per_item]
        flat = np.concatenate([np.zeros(0, np.int64), *(h for h, _ in hashes)])
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in hashes)])[order]
        self.item = np.repeat(np.arange(len(ids)), np.array([len(h) for h, _ in hashes], np.int64))[order]

    def sharing(self, hashes: np.ndarray) -> np.ndarray:
        """The items that share at least ``SHARED`` windows with a text of these distinct windows: the hash join."""
        lo, hi = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        lo, size = lo[hi > lo], (hi - lo)[hi > lo]
        if not len(lo):
            return lo
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.flatnonzero(np.bincount(self.item[at], self.times[at], len(self.ids)) >= SHARED)

    def found(self, text: str) -> list[tuple[int, bool, bool]]:
        ws = words(text)
        hashes = window_hashes(ws, self.ordinary)
        rows = ((i, *compare(self.words[i], ws, self.ordinary, hashes)) for i in self.sharing(np.unique(hashes)).tolist())
        return [r for r in rows if r[1] or r[2]]


def _searched(block, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seen = block.value, OrderedDict()
        for batch in batches:
            who, which, held, varied = [], [], [], []
            for n, text in enumerate(batch["text"].to_pylist()):
                key = xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))
                if key not in seen:
                    seen[key] = items.found(text)
                    if len(seen) > KEPT:
                        seen.popitem(last=False)
                for i, a, b in seen[key]:
                    who.append(n)
                    which.append(items.ids[i])
                    held.append(a)
                    varied.append(b)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(who, pa.int64())), pa.array(which, item_type), pa.array(held, pa.bool_()), pa.array(varied, pa.bool_())], ["id", "item_id", "held", "varied"])

    return run


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["item_id"], batch["passage"], pa.array([opening(p) for p in batch["passage"].to_pylist()], pa.string())], ["item_id", "passage", "opening"])


def item_blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """The items (item_id, passage) in blocks of at least one item and, unless that is longer, at most ``BLOCK`` windows.

    A first sentence that at least ``INSTRUCTED`` items share is their instruction; these are counted in Spark. The driver
    reads a partition of items and keeps a block at a time, so their number has no bound.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    opened = items.distinct().mapInArrow(_openings, f"item_id {kind}, passage string, opening string")
    shared = opened.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= INSTRUCTED)
    rows = opened.join(shared, "opening", "left").select("item_id", "passage", F.col("n").isNotNull().alias("instructed"))
    ids, passages, per_item, size = [], [], [], 0
    for r in rows.toLocalIterator():
        ws = passage_words(r["passage"], r["instructed"])
        if size and size + len(ws) > BLOCK:
            yield ItemBlock(ids, passages, per_item)
            ids, passages, per_item, size = [], [], [], 0
        ids.append(r["item_id"])
        passages.append(r["passage"])
        per_item.append(ws)
        size += len(ws)
    yield ItemBlock(ids, passages, per_item)


def leaked_items(documents: DataFrame, items: DataFrame, *, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(row_id, item_id, held, varied) for every document and item whose passage it holds, or holds with other slot fillers.

    NULL, empty and blank texts and passages hold nothing, passages under 15 words are no cases; repeated rows give one
    row. Texts are read once for each block of items and never shuffled, but for a few files spread over the cores. A name
    is a word that no passage of its block writes in lower case; that matters to ``varied`` alone.
    """
    sc = documents.sparkSession.sparkContext
    known = items.select(F.col(item_id).alias("item_id"), F.col(passage).cast("string").alias("passage"))
    docs = documents.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND length(text) > 0")
    types = [docs.schema["id"].dataType, known.schema["item_id"].dataType]
    schema = f"id {types[0].simpleString()}, item_id {types[1].simpleString()}, held boolean, varied boolean"
    docs, found = spread(docs), None
    for block in item_blocks(known):
        here = docs.mapInArrow(_searched(sc.broadcast(block), *map(to_arrow_type, types)), schema)
        found = here if found is None else found.unionByName(here)
    return found.distinct().select(F.col("id").alias(row_id), F.col("item_id").alias(item_id), "held", "varied")
