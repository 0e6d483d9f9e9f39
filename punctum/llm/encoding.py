"""Token ids of a whole corpus, with chunks that documents share encoded once.

1. A rolling hash over the bytes cuts every text into chunks wherever the last bytes say so, so that a passage in two
   texts gives the same chunks in both, whatever stands before it.
2. Equal chunks are brought together, and each is encoded once, on its own, for all texts that have it.
3. Where two chunks of a text join, the words around the join are encoded again, from the last word start that the
   chunk before it has for certain, word by word, until a word start of the next chunk is met. From there on both readings
   agree: splitting a text into words from a word start depends only on what follows it.

The ids are those of encoding each text as a whole; special tokens are never made, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from punctum.plans.shared import written_once
from punctum.plans.spread import spread

#: Bytes that the rolling hash sees.
WINDOW = 16
#: Smallest and largest chunk in bytes; on average a chunk has about LEAST + 2 ** BITS.
LEAST, BITS, MOST = 64, 8, 4096
#: A word that ends so many characters before the end of what is known doesn't depend on what follows: the longest
#: fixed word of the pattern has three characters, and runs look one character ahead.
AHEAD = 4

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``, never inside a character; equal bytes give equal cuts."""
    n = len(data)
    if n <= LEAST:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    gear = _GEAR[raw]
    h = gear.copy()
    for k in range(1, WINDOW):
        h[k:] += gear[:-k] << np.uint32(k)
    mask = np.uint32(((1 << BITS) - 1) << (32 - BITS))
    whole = np.ones(n + 1, bool)
    whole[:n] = (raw & 0xC0) != 0x80
    marks = np.flatnonzero((h & mask) == 0) + 1
    marks = marks[whole[marks]]
    ends, start = [], 0
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            end = start + MOST
            while not whole[end]:
                end -= 1
            ends.append(end)
            start = end
        if m - start >= LEAST or m == n:
            if m > start:
                ends.append(m)
            start = m
    return ends


@lru_cache(maxsize=4)
def _encoder(vocabulary: str):
    """(encode, word pattern, decode to bytes) of a rank file; the pattern is the one that its package names."""
    import regex
    import tiktoken

    pattern = importlib.import_module("public_tokenizers").PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, regex.compile(pattern), encoding.decode_bytes


def default_vocabulary() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.tiktoken")


class Joiner:
    """Puts the ids of a text's chunks together."""

    def __init__(self, vocabulary: str):
        self.encode, self.word, self.bytes_of = _encoder(vocabulary)

    def last_start(self, text: str, ids: list[int]) -> tuple[int, int]:
        """The last word start of ``text`` that is certain if it begins at one, and the number of its ids before it; -1 if there is none."""
        last = -1
        for m in self.word.finditer(text):
            if m.start() > len(text) - AHEAD:
                break
            last = m.start()
        return (last, len(ids) - len(self.encode(text[last:]))) if last >= 0 else (-1, 0)

    def _meet(self, known: str, size: int, text: str, last: int) -> tuple[list[str], int, int | None, int]:
        """Reads ``known``, of which ``text`` begins at ``size``, and ``text`` itself word by word until both have a word start in common.

        Gives the words of ``known`` before it and where they end, and the common start in ``text`` (None if there is none up to
        ``last``) with the number of ids before it.
        """
        words, at, n = [], 0, 0
        own = self.word.finditer(text)
        mine = next(own, None)
        for m in self.word.finditer(known):
            while mine is not None and mine.start() + size < m.start():
                n += len(self.encode(mine.group()))
                mine = next(own, None)
            if mine is not None and mine.start() + size == m.start() and mine.start() <= last:
                return words, at, mine.start(), n
            if m.end() > len(known) - AHEAD:
                break
            at = m.end()
            words.append(m.group())
        return words, at, None, 0

    def join(self, chunks: list) -> list[int]:
        """Ids of the text made of ``chunks``: (ids, last certain word start, ids before it) of each.

        Ids decode to the chunk's text exactly. Words are encoded each on its own, as a run of white space cut short
        would be split anew.
        """
        out: list[int] = []
        pending: list[str] = []  # text from the last certain word start on
        size, tried = 0, 0
        for k, (ids, last, before_last) in enumerate(chunks):
            text = self.bytes_of(ids).decode()
            sync, before = (0, 0) if k == 0 and last >= 0 else (None, 0)
            if k and size + len(text) >= 2 * tried:
                known = "".join(pending) + text
                words, at, sync, before = self._meet(known, size, text, last)
                for w in words:
                    out += self.encode(w)
                if sync is None:
                    pending, size = [known[at:]], len(known) - at
                    tried = size if size > 4 * MOST else 0
            elif sync is None:
                pending.append(text)
                size += len(text)
            if sync is not None:
                out += ids[before:before_last]
                pending, size, tried = [text[last:]], len(text) - last, 0
        out += self.encode("".join(pending))
        return out


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, no, chunk = [], [], []
        for i, t in enumerate(batch["text"].to_pylist()):
            data = t.encode()
            start = 0
            for j, end in enumerate(chunk_ends(data)):
                row.append(i)
                no.append(j)
                chunk.append(data[start:end].decode())
                start = end
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["uid"].take(at), pa.array(no, pa.int32()), pa.array(chunk, pa.string())], ["id", "uid", "no", "chunk"])


def _encode_rows(vocabulary: str):
    """Ids of each chunk; rows come sorted by chunk, so equal ones are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(vocabulary)
        known, ids, last = None, [], (-1, 0)
        for batch in batches:
            out = []
            for chunk in batch["chunk"].to_pylist():
                if chunk != known:
                    known, ids = chunk, joiner.encode(chunk)
                    last = joiner.last_start(chunk, ids)
                out.append((ids, *last))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["uid"], batch["no"], *columns], ["id", "uid", "no", "ids", "last", "before"])

    return run


def _join_rows(vocabulary: str, id_type: pa.DataType):
    """Chunks in order of text and place, as a stream: one text is held at a time, whatever the batches."""

    def whole(names: list, ids: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(vocabulary)
        current, name, parts = None, None, []
        for batch in batches:
            names, ids = [], []
            for ident, uid, *part in zip(*(batch[c].to_pylist() for c in ("id", "uid", "ids", "last", "before"))):
                if uid != current and parts:
                    names.append(name)
                    ids.append(joiner.join(parts))
                    parts = []
                current, name = uid, ident
                parts.append(part)
            yield whole(names, ids)
        if parts:
            yield whole([name], [joiner.join(parts)])

    return run


def encode_corpus(documents: DataFrame, *, row_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(row_id, ids) for every row of ``documents``: the ids of its text by the rank file ``vocabulary``.

    A NULL and an empty text have no ids. Rows may repeat; each comes out. Chunks are shuffled twice, as text and as ids.
    A partition of very many equal chunks is split by size, and such a chunk encoded once in each part. A text is put
    together in one task, which needs memory for that text alone.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = documents.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid"))
    kind = rows.schema["id"].dataType
    full = rows.where("text IS NOT NULL AND text <> ''")
    chunks = spread(full).mapInArrow(_chunk_rows, f"id {kind.simpleString()}, uid long, no int, chunk string")
    chunks = written_once(chunks, "chunks")  # uids stay as they are, whatever is run again
    alike = chunks.withColumn("h", F.xxhash64("chunk")).hint("rebalance", "h").sortWithinPartitions("chunk").drop("h")
    encoded = alike.mapInArrow(_encode_rows(vocabulary), f"id {kind.simpleString()}, uid long, no int, ids array<int>, last int, before int")
    ordered = encoded.repartition("uid").sortWithinPartitions("uid", "no").select("id", "uid", "ids", "last", "before")
    ids = ordered.mapInArrow(_join_rows(vocabulary, to_arrow_type(kind)), f"id {kind.simpleString()}, ids array<int>")
    none = documents.where(F.col(text).isNull() | (F.col(text) == "")).select(F.col(row_id).alias("id"), F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(none).select(F.col("id").alias(row_id), "ids")
