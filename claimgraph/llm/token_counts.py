"""Token counts by a tokenizer file compiled into finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE file. The first reads classes of characters and marks
where the pieces begin that are merged by themselves (words with their space, numbers, signs, white space). It has few
states, so its maps from states to states form a small set with a table of compositions: a text is cut into chunks, all
chunks step through their maps at once, the maps are composed by a parallel prefix scan, and each chunk then runs from
its own state.

The second reads the bytes of a piece. The tokens of a piece's beginning end in one last token, and what a further byte
changes depends only on those ends of the piece that begin some token and on the last token before each. That is the
state; each transition is annotated with the change of the token count. Which token comes last is decided by pairs: a
row of tokens is what merging gives if each two neighbours are. States and transitions are compiled as texts need them
and thrown away when they take too much room; counts of common pieces are remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that are looked at together, and in each chunk that has a map of its own.
PIECE, CHUNK = 1 << 20, 256
#: States of the second transducer, pairs of tokens, and pieces of at most so many characters, that a worker remembers.
STATES, PAIRS, KNOWN, KNOWN_CHARS = 1 << 17, 1 << 20, 250_000, 64

#: Classes: space, other white space, apostrophe, the letters that contractions are made of, other letters, numbers, others, and the end of a text.
SPACE, BLANK, QUOTE, STMD, RV, E, L, LETTER, NUMBER, OTHER, END = range(11)
OF_CONTRACTIONS = {**dict.fromkeys("stmd", STMD), **dict.fromkeys("rv", RV), "e": E, "l": L}
#: States by what has been read: nothing of a piece, letters, numbers, other signs, one blank or more with a space or another one last, an apostrophe that may begin a contraction, the same and r or v, or l.
FRESH, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, QUOTED, WANTS_E, WANTS_L = range(11)
#: What a transition tells: a piece begins at this character, at the one before.
HERE, BEFORE = 1, 2


def _rule(state: int, kind: int) -> tuple[int, int]:
    """Next state and what is told, of the cutting that byte-level files do before merging."""
    if state in (WANTS_E, WANTS_L):
        if kind == (E if state == WANTS_E else L):
            return FRESH, 0
        if kind == END:
            return FRESH, BEFORE
        to, told = _rule(LETTERS, kind)  # the apostrophe stands alone, letters began after it
        return to, told | BEFORE
    if kind == END:
        return FRESH, 0
    if kind in (SPACE, BLANK):
        if state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
            return (MORE_SPACE if kind == SPACE else MORE_BLANK), 0
        return (ONE_SPACE if kind == SPACE else ONE_BLANK), HERE
    told = BEFORE if state in (MORE_SPACE, MORE_BLANK) else 0
    joined = state in (ONE_SPACE, MORE_SPACE)
    if kind == NUMBER:
        return NUMBERS, told if joined or state == NUMBERS else told | HERE
    if kind in (QUOTE, OTHER):
        if joined or state in (OTHERS, QUOTED):
            return OTHERS, told
        return (QUOTED if kind == QUOTE else OTHERS), told | HERE
    if state == QUOTED and kind in (STMD, RV, L):
        return {STMD: FRESH, RV: WANTS_E, L: WANTS_L}[kind], 0
    return LETTERS, told if joined or state == LETTERS else told | HERE


class Cutter:
    """The first transducer, its state maps, and how they compose."""

    def __init__(self) -> None:
        n = self.classes = 11
        table = [[_rule(s, k) for k in range(n)] for s in range(n)]
        self.next = np.array([x[0] for row in table for x in row])
        self.told = np.array([x[1] for row in table for x in row], np.uint8)
        by_class = [tuple(table[s][k][0] for s in range(n)) for k in range(n)]
        maps, at, i = [tuple(range(n))], {tuple(range(n)): 0}, 0
        after: list[list[int]] = []
        while i < len(maps):
            after.append([])
            for g in by_class:
                m = tuple(g[s] for s in maps[i])
                if m not in at:
                    at[m] = len(maps)
                    maps.append(m)
                after[i].append(at[m])
            i += 1
        self.maps = np.array(maps)
        #: The map after one more character, and after a whole further map.
        self.after = np.array(after).ravel()
        self.composed = np.array([[at[tuple(b[s] for s in a)] for b in maps] for a in maps])

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character, from the classes of characters; a text starts in FRESH."""
        n, m = len(kinds), self.classes
        chunks = n // CHUNK + 1  # one class more than there are characters: the last one tells of the last character
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.int64)
        of = np.zeros(chunks, np.int64)
        for row in grid:
            of = self.after[of * m + row]
        step = 1
        while step < chunks:
            of[step:] = self.composed[of[:-step], of[step:]]
            step *= 2
        state = np.zeros(chunks, np.int64)
        state[1:] = self.maps[of[:-1], FRESH]
        told = np.empty((CHUNK, chunks), np.uint8)
        for i, row in enumerate(grid):
            at = state * m + row
            told[i], state = self.told[at], self.next[at]
        told = told.T.ravel()
        return (told[:n] & HERE > 0) | (told[1 : n + 1] & BEFORE > 0)


class Merges:
    """The second transducer: states are compiled as they are met; a state's transitions are kept by byte."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.vocab, self.ranks = vocab, ranks
        self.beginnings = {t[:i] for t in vocab for i in range(1, len(t) + 1)}
        self.longer = {t[:i] for t in vocab for i in range(1, len(t))}
        self.text = {i: t for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        #: A state: the longest end of what was read that begins a token; for each shorter end that begins a longer token, the last token before it and the count there.
        self.states: list[tuple[bytes, tuple]] = [(b"", ((-1, 0),))]
        self.at = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """What merging gives for a short run of bytes: the pair of the lowest rank first."""
        ids = [self.vocab[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            rank, i = min((self.ranks.get(p, (len(self.ranks), 0))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == len(self.ranks):
                break
            ids[i : i + 2] = [self.ranks[ids[i], ids[i + 1]][1]]
        return ids

    def _stands(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: nothing) in what merging gives."""
        pair = before, token
        if pair not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.text[token] if before < 0 else self.text[before] + self.text[token]
            self.pairs[pair] = self.merged(both) == ([token] if before < 0 else [before, token])
        return self.pairs[pair]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        tail, ends = self.states[state]
        tail += bytes((byte,))
        while tail not in self.beginnings:
            tail = tail[1:]
        for size in range(len(tail), 0, -1):
            token, end = self.vocab.get(tail[-size:]), ends[size - 1]
            if token is not None and end is not None and self._stands(end[0], token):
                break
        else:
            raise ValueError("the file's merges don't cover all bytes")
        change = end[1] + 1
        kept = [(token, 0)]
        for i, old in enumerate(ends[: len(tail)], 1):
            alive = old is not None and tail[-i:] in self.longer
            kept.append((old[0], old[1] - change) if alive else None)
        made = tail, tuple(kept)
        if made not in self.at:
            self.at[made] = len(self.states)
            self.states.append(made)
        return self.steps.setdefault(state << 8 | byte, (self.at[made], change))

    def count(self, raw: bytes) -> int:
        state = total = 0
        for byte in raw:
            step = self.steps.get(state << 8 | byte)
            if step is None:
                if len(self.states) >= STATES:
                    here = self.states[state]
                    self._clear()
                    self.states.append(here)
                    self.at[here] = state = len(self.states) - 1
                step = self._compile(state, byte)
            state, change = step
            total += change
        return total


class _Known(dict):
    """Counts of pieces; those that aren't remembered are counted."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(self) < KNOWN and len(piece) <= KNOWN_CHARS:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the tokenizers library does, without begin, end or added special tokens.

    Strings of the file's added tokens in a text are one token each, as by the library's default. Only files whose text
    is cut and merged at byte level are compiled; others are an error. Classes of characters are asked of the library,
    each once.
    """

    _kept: ClassVar[dict[str, "TokenCounter"]] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        told = json.loads(Path(path).read_text())
        model, cut, added = told["model"], told["pre_tokenizer"] or {}, told.get("added_tokens") or []
        plain = (model.get("type") or "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not told["normalizer"]
        if not plain or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        self.cutter = Cutter()
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        raw = lambda t: bytes(map(to_byte.__getitem__, t))
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.known = _Known(Merges(vocab, ranks))
        self.kinds = np.full(0x110000, 255, np.uint8)

    @classmethod
    def of(cls, path: str) -> "TokenCounter":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _kind(self, c: str) -> int:
        """A character's class: it makes one piece with a letter, a number or a sign, or is white space."""
        if c in " '":
            return SPACE if c == " " else QUOTE
        for beside, kind in (("a", OF_CONTRACTIONS.get(c, LETTER)), ("1", NUMBER), ("!", OTHER)):
            if len(self.cut(beside + c)) == 1:
                return kind
        return BLANK

    def _begins(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin, given where characters that only end a text stand."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        if (new := np.unique(points[kinds == 255])).size:
            self.kinds[new] = [self._kind(chr(p)) for p in new]
            kinds = self.kinds[points]
        kinds[ends] = END
        return self.cutter.begins(kinds)

    def _count(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts without added tokens, looked at together."""
        joined = "\0".join([*texts, ""])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = self._begins(joined, ends)
        begins[ends] = True
        bounds = np.flatnonzero(begins)
        stops = bounds.tolist()
        n = np.fromiter((self.known[joined[a:b]] for a, b in zip(stops, [*stops[1:], len(joined)])), np.int64, len(stops))
        place = np.searchsorted(bounds, ends)
        n[place] = 0
        return np.diff(np.concatenate([[0], np.cumsum(n)[place]]))

    def _front(self, text: str, at: int) -> tuple[int, int]:
        """Tokens of the beginning of a long text from a place on, and the place after it, where a piece begins."""
        size = PIECE
        while at + size < len(text):
            part = text[at : at + size]
            last = np.flatnonzero(self._begins(part, np.zeros(0, np.int64)))[-1]
            if last > 0:
                return int(self._count([part[:last]])[0]), at + int(last)
            size *= 2
        return int(self._count([text[at:]])[0]), len(text)

    def __call__(self, texts: list[str]) -> np.ndarray:
        total, of, held, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            parts = self.added.split(text) if self.added else [text]
            total[i] += len(parts) - 1
            for part in filter(None, parts):
                if len(part) > PIECE:
                    at = 0
                    while at < len(part):
                        n, at = self._front(part, at)
                        total[i] += n
                    continue
                of.append(i)
                held.append(part)
                size += len(part)
                if size >= PIECE:
                    np.add.at(total, of, self._count(held))
                    of, held, size = [], [], 0
        if held:
            np.add.at(total, of, self._count(held))
        return total


def count_tokens(documents: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of documents.

    A null or empty text has no bytes and no tokens. Repeated rows are counted alike; null ids are kept; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(tokenizer_path)
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(counter(batch.column("text").slice(i, 256).to_pylist()) for i in range(0, len(batch), 256))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
