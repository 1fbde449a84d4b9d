"""Language ID by hyperdimensional profiles.

Each letter, of whatever script, has a random vector of +1 and -1 drawn from its code point. A run of three letters is
bound into one vector: the letters' vectors, rotated by their place, multiplied. A text is the bundle (sum) of all its
runs, a language the bundle of all its training texts, and a text's language is the prototype of the largest cosine.
Everything that is no letter is one gap. Runs are bound as they come, those of a chunk of texts once, so that no table
of all runs is needed, and a long text is bound in parts. Bundles are linear and made of whole numbers: tasks bundle what they read, Spark sums the parts
of each language exactly, and only one vector for each language reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDECIDED = "und"
#: Bits that a code point takes in the name of a run.
BITS = 21
#: Characters of text whose runs are bound together, unless one text alone is longer.
CHUNK = 1 << 18
#: Runs that are bound or added up at once.
ROWS = 4096


class Profiles:
    """Vectors of letters and runs, and the runs of texts."""

    _kept: dict = {}

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letter = np.array([chr(i).isalpha() for i in range(1 << BITS) if i < 0x110000])
        self.row, self.letters = np.full(len(self.letter), -1, np.int32), np.zeros((0, dimensions), np.int8)

    @classmethod
    def of(cls, dimensions: int, seed: int) -> "Profiles":
        if (dimensions, seed) not in cls._kept:
            cls._kept[dimensions, seed] = cls(dimensions, seed)
        return cls._kept[dimensions, seed]

    def vector(self, point: int) -> np.ndarray:
        """The vector of a letter; that of the gap is the one of point 0."""
        return np.random.default_rng([self.seed, point]).choice(np.array([-1, 1], np.int8), self.dimensions)

    def _of_letters(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.row[points] < 0])
        if len(new):
            self.row[new] = len(self.letters) + np.arange(len(new))
            self.letters = np.vstack([self.letters, *(self.vector(int(p)) for p in new)])
        return self.letters[self.row[points]]

    def bind(self, runs: np.ndarray) -> np.ndarray:
        """The vectors of runs."""
        out, mask = np.empty((len(runs), self.dimensions), np.int8), (1 << BITS) - 1
        for i in range(0, len(runs), ROWS):
            first, second, third = (self._of_letters(runs[i : i + ROWS] >> (BITS * k) & mask) for k in (2, 1, 0))
            out[i : i + ROWS] = np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third
        return out

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some texts at a time: the first, the one after the last, whether this ends them, distinct runs, and for (text, run) how often.

        A text longer than CHUNK comes by itself, in parts whose bundles add up.
        """
        i = 0
        while i < len(texts):
            if len(texts[i] or "") > CHUNK:
                yield from ((i, i + 1, *part) for part in self._parts(texts[i].lower()))
                i += 1
                continue
            j, held = i, 0
            while j < len(texts) and held < CHUNK and len(texts[j] or "") <= CHUNK:
                held += len(texts[j] or "")
                j += 1
            yield i, j, True, *self._runs([(t or "").lower() for t in texts[i:j]])
            i = j

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return np.where(self.letter[points], points, 0)

    def _parts(self, text: str) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The runs of one long text, CHUNK characters at a time; the last two symbols of a part begin the next."""
        before = np.zeros(1, np.int64)
        for at in range(0, len(text), CHUNK):
            points, last = self._points(text[at : at + CHUNK]), at + CHUNK >= len(text)
            points = np.concatenate([before, points, [0] if last else []]).astype(np.int64)
            keep = (points > 0) | (np.concatenate([[1], points[:-1]]) > 0)
            keep[: len(before)] = True
            points = points[keep]
            inside = (points[1:-1] > 0) | ((points[:-2] > 0) & (points[2:] > 0))
            runs, times = np.unique(((points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:])[inside], return_counts=True)
            yield last, runs, np.zeros(len(runs), np.int64), np.arange(len(runs)), times
            before = points[-2:]

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        points = self._points("\0\0".join(texts))
        # two gaps lie between texts: no run spans them, and the first belongs to the text before
        of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(points)]
        points, of = np.concatenate([[0], points, [0]]), np.concatenate([[0], of, [len(texts) - 1]])
        keep = (points > 0) | (np.concatenate([[1], points[:-1]]) > 0)
        points, of = points[keep], of[keep]
        runs = (points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:]
        inside = points[1:-1] > 0
        inside |= (points[:-2] > 0) & (points[2:] > 0) & (of[:-2] == of[2:])
        runs, inverse = np.unique(runs[inside], return_inverse=True)
        pairs, times = np.unique(of[1:-1][inside] * max(1, len(runs)) + inverse, return_counts=True)
        return runs, pairs // max(1, len(runs)), pairs % max(1, len(runs)), times

    def bundle(self, runs: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for i in range(0, len(runs), ROWS):
            out += times[i : i + ROWS].astype(float) @ self.bind(runs[i : i + ROWS]).astype(float)
        return out


def learn(training: DataFrame, *, dimensions: int = 512, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from training (lang, text); rows without a language don't count."""
    rows = training.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles.of(dimensions, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, _, runs, of, run, times in profiles.chunks(batch.column("text").to_pylist()):
                names, at = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    here = at[of] == k
                    total = np.bincount(run[here], weights=times[here], minlength=len(runs))
                    found = np.flatnonzero(total)
                    sums[name] = sums.get(name, 0) + profiles.bundle(runs[found], total[found])
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(total.astype(np.int64))], names=["lang", "at", "value"])

    sums = rows.mapInArrow(tally, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sorted(sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("vector")).collect())
    vectors = np.array([r["vector"] for r in found], float).reshape(len(found), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [r["lang"] for r in found], vectors / np.where(norms > 0, norms, 1)


def identify(documents: DataFrame, languages: list[str], prototypes: np.ndarray, *, dimensions: int = 512, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the largest cosine, 0 at least) of every row of documents, from its text alone.

    A null text, one without letters, and every text if no language was learned, is ``und`` with score 0. Of equal
    cosines the first language in order wins. Repeated rows are judged alike; an empty table gives no rows; null ids
    are kept; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles.of(dimensions, seed)
        for batch in batches:
            best, score = np.full(len(batch), UNDECIDED, object), np.zeros(len(batch))
            held = np.zeros(dimensions)  # of the parts of a long text so far
            for i, j, ends, runs, of, run, times in profiles.chunks(batch.column("text").to_pylist()):
                if not ends:
                    held += profiles.bundle(runs, times)
                    continue
                bound = profiles.bind(runs)
                first = np.searchsorted(of, np.arange(j - i + 1))
                for k in range(j - i if languages else 0):
                    a, b = first[k], first[k + 1]
                    vector, held = held, np.zeros(dimensions)
                    for c in range(a, b, ROWS):
                        d = min(b, c + ROWS)
                        vector += times[c:d].astype(np.float32) @ bound[run[c:d]].astype(np.float32)
                    if a == b and not vector.any():
                        continue
                    cosine = prototypes @ vector / (np.linalg.norm(vector) or 1.0)
                    at = int(np.argmax(cosine))
                    best[i + k], score[i + k] = languages[at], min(1.0, max(0.0, float(cosine[at])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judge, f"doc_id {id_type}, lang_pred string, score double")
