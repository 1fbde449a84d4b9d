"""Packing token sequences by bounded-space online best-fit.

Documents are read, tokenised and placed in one pass, partition by partition: each task keeps a fixed number of open
bins in a bitset keyed by free space, puts a piece into the open bin that it fills best, and closes the fullest bin
when a new one is needed and none may be opened. The rows of an Arrow batch are placed longest first. What is left
open at the end of a task, at most the fixed number of bins, is packed once more in larger groups, whole bins being
the pieces, so that tasks leave no more half-empty sequences than one task would. Texts are never shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise

OPEN_BINS = 1024
#: Open bins that are packed together in the second pass.
BINS_A_TASK = 50_000
#: Words whose ids a Python worker remembers.
REMEMBERED = 250_000
_TASK_BITS = 36
#: Runs of blanks, or of anything else, that the merging library can't be given; texts shorter than this hold none.
LONG = 50_000
LONG_RUN = re.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")


#: How a byte-level tokenizer cuts a text before it merges bytes (fixed value).
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file, or None where its merges don't come in the order of ids.

    Such a file writes each byte as one character: printable ones as themselves, the others as those from 256 on.
    """
    model = json.loads(Path(path).read_text())["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(map(to_byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a byte-level BPE tokenizer file.

    The tokenizer cuts a text before a space that stands between two other characters, whatever surrounds them. So a
    text with single spaces only is the ids of its first word and of each later word with its space, and the ids of
    words can be remembered. Other texts are encoded as a whole. Merging by rank gives the ids that the tokenizers
    library gives, several times as fast; a file whose ids aren't ranks is left to that library, and so is a text with a
    very long run of blanks or without blanks, for which cutting by the pattern may need more stack than there is.

    Strings of the file's added tokens are those tokens, as by the library's default: a text is cut at them first.
    """

    _kept: ClassVar[dict[str, "Tokens"]] = {}

    def __init__(self, path: str) -> None:
        self.known: dict[str, bytes | None] = {}
        tokens = json.loads(Path(path).read_text()).get("added_tokens") or []
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in tokens}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Tokens that take more or less than their string are left to the library, which then gets texts as a whole.
        self.whole = any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word"))
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        by_library = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not self.whole and (ranks := byte_ranks(path)):
            import tiktoken

            plain = tiktoken.Encoding(Path(path).stem, pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.encode = lambda text: by_library(text) if len(text) >= LONG and LONG_RUN.search(text) else np.array(plain(text), dtype="<u4").tobytes()
        else:
            self.encode = by_library

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _new(self, word: str) -> bytes | None:
        """What the word adds after a space, None if the space may belong elsewhere."""
        ids = self.encode(" " + word) if word and not word[0].isspace() and not word[-1].isspace() else None
        if len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.whole:
            return self.encode(text)
        if self.cuts is None or not self.cuts.search(text):
            return self._words(text)
        return b"".join(self.added[part] if i % 2 else self._words(part) for i, part in enumerate(self.cuts.split(text)))

    def _words(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not rest or not head or head[-1].isspace():
            return self.encode(text)
        known = self.known
        ids = [known[w] if w in known else self._new(w) for w in rest]
        return self.encode(text) if None in ids else b"".join([self.encode(head), *ids])


class BestFit:
    """Open bins by free space; place() gives the bin and the offset of a piece and tells nothing of closed bins."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.bins, self.open = capacity, most, 0, 0
        self.mask, self.by_free = 0, defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.bins
            self.bins += 1
            if self.open >= self.most and size < self.capacity:
                self._take((self.mask & -self.mask).bit_length() - 1)
        if left := free - size:
            self.by_free[left].append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        return [(b, self.capacity - free) for free, bins in self.by_free.items() for b in bins]


def pieces(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or whole capacities with what is over in front."""
    head = tokens % capacity or min(tokens, capacity)
    return [(0, head), *((s, capacity) for s in range(head, tokens, capacity))]


def pack(documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of documents.

    A document is its ids and end_id. Only one of more than ``capacity`` tokens is cut, and into as few pieces as can
    be. The string of an added token in a text is that token. A null or empty text is its end_id alone. Repeated rows
    are documents of their own; a null id is kept; an empty table gives no rows. sequence_id is not negative for bins
    of the first pass and negative for those of the second. A task that runs again gives the same bins, as no other task knows of them. Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    stop = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << _TASK_BITS
        encode, kind = Tokens.of(tokenizer_path), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            cut: list[tuple[int, int, int, int, int]] = []
            for i in range(0, len(batch), 256):
                for j, t in enumerate(batch.column("text").slice(i, 256).to_pylist(), i):
                    ids = encode(t or "") + stop
                    cut += [(j, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])) for k, (start, n) in enumerate(pieces(len(ids) // 4, capacity))]
            cut.sort(key=lambda x: -x[3])
            where = [fit.place(x[3]) for x in cut]
            at, piece, start, length, sums = (np.array(x) for x in zip(*cut, strict=True)) if cut else (np.zeros(0, int),) * 5
            bins, offset = (np.array(x) for x in zip(*where, strict=True)) if cut else (np.zeros(0, int),) * 2
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, sums, bins + base, offset))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if kind is not None and (left := fit.left()):
            # a bin that is still open: no piece, its fill as the length
            bins, fill = (np.array(x) for x in zip(*left, strict=True))
            none = lambda t: pa.nulls(len(left), t)
            yield pa.RecordBatch.from_arrays([none(kind), none(pa.int32()), none(pa.int64()), pa.array(fill, pa.int64()), none(pa.int64()), pa.array(bins + base, pa.int64()), none(pa.int64())], names=names)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            where = [fit.place(n) for n in batch.column("length").to_pylist()]
            bins, offset = (np.array(x) for x in zip(*where, strict=True)) if where else (np.zeros(0, int),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array(-1 - (bins + base), pa.int64()), pa.array(offset, pa.int64())], names=["bin", "to", "shift"])

    placed = rows.mapInArrow(first_pass, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, bin long, offset long")
    placed = materialise(placed, "pack-pieces")
    left = placed.filter("piece is null").select("bin", "length")
    groups = max(1, -(-left.count() // BINS_A_TASK))
    left = left.repartition(groups, "bin").sortWithinPartitions(F.desc("length"), "bin")
    moved = materialise(left.mapInArrow(second_pass, "bin long, to long, shift long"), "pack-bins")
    joined = placed.filter("piece is not null").join(moved, "bin", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
