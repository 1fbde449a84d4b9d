"""URL filter: all glob rules run at once over each canonical URL as one multiword Shift-And automaton.

A glob is plain text with two wild cards: ``*`` stands for any run without a slash, ``**`` for any run at all.
Each pattern byte owns one bit of a mask; a wild card lends its byte range to the bit before it as a loop. All
patterns lie end to end in words of 64 bits, so one shift, one AND and one OR per byte of the URL move every
pattern on. The masks hold the rules alone: their size doesn't depend on the table, and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.columns import text_bytes

#: Words of 64 bits that the states of all texts of a run take.
STATE_WORDS = 1 << 20
UPPER, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict for urls whose host is that of text, or below it, and whose path begins with that of text."""

    text: str
    verdict: str

    def globs(self) -> list[str]:
        return [f"{self.text}**", f"*.{self.text}**"]


class ShiftAnd:
    """The automaton of a list of globs; matches() tells for each text which of them fit all of it."""

    def __init__(self, globs: list[str]) -> None:
        parts = [self._states(g) for g in globs]
        bits = sum(len(p) + 1 for p in parts)
        self.words = max(1, -(-bits // 64))
        step, loop = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        start, self.accept, at = np.zeros(bits, bool), np.zeros(len(globs), int), 0
        for k, states in enumerate(parts):
            # bit at: nothing read yet; bit at + i: the first i bytes have been read
            start[at] = True
            for i, (byte, gap) in enumerate(states):
                if byte is not None:
                    step[byte, at + i + 1] = True
                if gap is not None:
                    loop[:, at + i] |= gap
            self.accept[k] = at + len([b for b, _ in states if b is not None])
            at += len(states) + 1
        self.step, self.loop, self.start = (self._pack(x) for x in (step, loop, start[None]))

    @staticmethod
    def _states(glob: str) -> list[tuple[int | None, np.ndarray | None]]:
        """(next byte, bytes that may be read before it); the last entry may have no byte."""
        raw, out, gap, i = glob.encode(), [], None, 0
        while i < len(raw):
            if raw[i] == 0x2A:
                wide = raw[i : i + 2] == b"**"
                here = np.ones(256, bool)
                here[0x2F] = wide
                gap = here if gap is None else gap | here
                i += 1 + wide
                continue
            out.append((raw[i], gap))
            gap, i = None, i + 1
        return [*out, (None, gap)]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def matches(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each glob. So many texts run at once as a bounded state allows."""
        step, n = max(1, STATE_WORDS // self.words), len(at) - 1
        parts = [self._run(data, at[i : min(n, i + step) + 1]) for i in range(0, n, step)]
        return np.vstack(parts) if parts else np.zeros((0, len(self.accept)), bool)

    def _run(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts side by side, longest first, byte by byte."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        sorted_size, begin = size[order], at[:-1][order]
        state = np.repeat(self.start, len(size), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(sorted_size[0]) if len(size) else 0):
            n = int(np.searchsorted(-sorted_size, -i, side="left"))
            byte, now = data[begin[:n] + i], state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.zeros((len(size), len(self.accept)), bool)
        out[order] = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & one == one
        return out


def canonical(url) -> tuple:
    """(host, path) columns: host in ASCII lower case after the first ``://``; path without query and fragment."""
    scheme = F.instr(url, "://")
    rest = F.when(scheme > 0, F.substring(url, scheme + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER_LETTERS)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], blocked: list[str], *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    The longest rule that fits gives rule and verdict. Where none fits, rule is null and the verdict is block if one
    of the globs ``blocked`` fits host and path, else ``default``. A null url, or one without ``://``, has an empty
    host and path, which no rule fits. An empty table gives no rows; repeated rows are judged alike; other columns
    are ignored. A URL of any length is read whole.
    """
    host, path = canonical(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    ranked = sorted(rules, key=lambda r: -len(r.text.encode()))
    globs = [g for r in ranked for g in r.globs()] + list(blocked)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        names = np.array([r.text for r in ranked] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in ranked], dtype=object)
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            joined = pc.binary_join_element_wise(host, path, "")
            hit = automaton.matches(*text_bytes(joined))
            by_rule = hit[:, : 2 * len(ranked)].reshape(len(hit), len(ranked), 2).any(axis=2)
            none = np.full((len(hit), 1), True)
            first = np.argmax(np.hstack([by_rule, none]), axis=1)
            bad = hit[:, 2 * len(ranked) :].any(axis=1)
            verdict = np.where(bad, "block", default).astype(object)
            ruled = first < len(ranked)
            verdict[ruled] = verdicts[first[ruled]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), host, path, pa.array(names[first], pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string")
