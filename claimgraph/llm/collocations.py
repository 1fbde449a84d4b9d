"""Phrase collocations by SON: shards are mined completely, their phrases united, and candidates counted exactly.

A shard is a block of words that a task holds at once. If a phrase occurs ``least`` times in all, then in some shard it
occurs at least ``least`` times that shard's share of all bytes; a shard tells all phrases of that local support, with
their counts, and no phrase that reaches the global one is lost. The union keeps phrases whose told counts, and what
shards may have left untold, can reach it. Shards are mined by length: words first, then pairs of words that can be
frequent, then phrases of three and four words whose pairs can be; with many shards the local support is one, and this
is what keeps the union small.

Mining goes by hashes of phrases. What shards tell travels as sorted hashes, packed by range of hashes, a few bytes a
phrase; a range is united in one task, and there are as many ranges as keep each small. The union reaches the tasks of
the next pass as a bitmap of fixed size, which says yes to some other phrases too, never no to one of the union. The last pass counts every phrase that
the bitmap lets through, by its text, so counts and everything made of them are exact.

A hot language or phrase gives each shard one row a phrase, whatever its number of occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm.columns import LOWER, WordHasher, mix, text_bytes
from claimgraph.llm.ranks import join_hot

LONGEST = 4
#: Words of a shard, and bytes of text whose words are hashed at once; words of more bytes are hashed by themselves.
SHARD_WORDS, PART_BYTES, LONG_WORD = 1 << 19, 1 << 19, 1 << 16
#: Bits of the hashes that travel, and of the bitmap (16 MB).
HASH_BITS, BITS = 40, 27
#: Phrases that a task packs together, and ranges of hashes: 2^8 at least, and one for so many bytes of text.
PACKED, SEGMENT_BYTES = 1 << 21, 5 << 20
#: Texts that are read, and phrases that are handed on, at once.
TEXTS, HANDED = 256, 20_000
UNDECIDED = "und"

#: White space that parts words, and characters that end a piece, beyond which no phrase goes.
GAPS, STOPS = b" \t", b".,;:!?\n\v\f\r"
APART, STOP = np.zeros(256, bool), np.zeros(256, bool)
APART[list(GAPS + STOPS)] = STOP[list(STOPS)] = True
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_OTHER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of bytes of about PART_BYTES that end where a text or a word does, and long words by themselves."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + PART_BYTES, n)
        if hi < n:
            text = int(at[np.searchsorted(at, hi, side="right") - 1])
            back = np.flatnonzero(APART[data[lo:hi]]) if text <= lo else None
            if back is None:
                hi = text
            elif len(back):
                hi = lo + int(back[-1]) + 1
            else:
                stop = int(at[np.searchsorted(at, lo, side="right")])
                while hi < stop and not APART[data[hi]]:
                    far = APART[data[hi : min(hi + PART_BYTES, stop)]]
                    hi += int(np.argmax(far)) if far.any() else len(far)
        yield lo, hi
        lo = hi


def _hash_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


class Shard:
    """Words of a shard: their hashes, the number of the piece and of the language of each, and where they stand."""

    def __init__(self) -> None:
        self.words, self.pieces, self.langs, self.starts, self.ends, self.data = ([] for _ in range(6))
        #: Words and bytes, and how many of each were carried over from the shard before.
        self.size = self.held = self.carried = self.carried_bytes = 0

    def add(self, words, pieces, langs, starts, ends, data) -> None:
        for to, what in ((self.words, words), (self.pieces, pieces), (self.langs, langs), (self.starts, starts + self.held), (self.ends, ends + self.held), (self.data, data)):
            to.append(what)
        self.size += len(words)
        self.held += len(data)

    def seal(self) -> "Shard":
        """Lists become arrays; gives the shard to follow, which begins with the last words so that phrases go on."""
        self.words, self.pieces, self.langs, self.starts, self.ends, self.data = (np.concatenate(x) for x in (self.words, self.pieces, self.langs, self.starts, self.ends, self.data))
        after, few = Shard(), min(LONGEST - 1, len(self.words))
        if few:
            base = int(self.starts[-few])
            after.add(self.words[-few:], self.pieces[-few:], self.langs[-few:], self.starts[-few:] - base, self.ends[-few:] - base, self.data[base:])
            after.carried, after.carried_bytes, after.size = few, after.held, 0
        return after

    def phrases(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all phrases of k words that end in this shard, and their hashes; codes are of languages."""
        n = len(self.words)
        first = np.arange(max(0, self.carried - k + 1), n - k + 1) if n >= k else np.zeros(0, np.int64)
        first = first[self.pieces[first] == self.pieces[first + k - 1]]
        return first, self._hashes(first, k, codes, _PLACE)

    def _hashes(self, first: np.ndarray, k: int, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        h = codes[self.langs[first]] * np.uint64(2 * k + 1)
        for i in range(k):
            h += self.words[first + i] * place[i]
        return mix(h)

    def told_apart(self, first: np.ndarray, hashes: np.ndarray, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first places and the counts of distinct phrases, by 128 bits."""
        other = self._hashes(first, k, codes, _OTHER)
        by = np.lexsort((other, hashes))
        h, o = hashes[by], other[by]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
        return first[by[new]], np.diff(np.append(new, len(by)))

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + k)).decode()


class Reader:
    """Cuts the texts of a task into shards."""

    def __init__(self, shard_words: int = SHARD_WORDS) -> None:
        self.hasher, self.shard, self.piece, self.shard_words = WordHasher(), Shard(), 0, shard_words
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def codes(self) -> np.ndarray:
        return np.array([_hash_of(x.encode()) for x in self.names], np.uint64)

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            langs = batch.column("lang").to_pylist()
            for name in dict.fromkeys(langs):
                if name not in self.number:
                    self.number[name] = len(self.names)
                    self.names.append(name)
            of = np.array([self.number[x] for x in langs], np.int32)
            data, at = text_bytes(batch.column("text"))
            for lo, hi in _parts(data, at):
                self._read(LOWER[data[lo:hi]], at, lo, of)
                if self.shard.size >= self.shard_words:
                    done = self.shard
                    self.shard = done.seal()
                    yield done
            self.piece += 1  # batches end texts
        if self.shard.size:
            self.shard.seal()
            yield self.shard

    def _read(self, part: np.ndarray, at: np.ndarray, lo: int, of: np.ndarray) -> None:
        inside = ~APART[part]
        edge = np.zeros(len(part) + 1, bool)
        inner = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + len(part), side="left")] - lo
        edge[inner] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        stops = np.cumsum(STOP[part] | edge[:-1])
        pieces = self.piece + stops[starts]
        self.piece += int(stops[-1])
        langs = of[np.searchsorted(at, lo + starts, side="right") - 1] if len(starts) else np.zeros(0, np.int32)
        if len(starts) == 1 and ends[0] - starts[0] > LONG_WORD:
            words = np.array([_hash_of(part[starts[0] : ends[0]].tobytes())], np.uint64)
        else:
            long = np.flatnonzero(ends - starts > LONG_WORD)
            words = self.hasher(part, starts, ends)
            for i in long:
                words[i] = _hash_of(part[starts[i] : ends[i]].tobytes())
        self.shard.add(words, pieces, langs, starts, ends, part)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _supported(hashes: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray]:
    found, times = np.unique(hashes, return_counts=True)
    return found[times >= support], times[times >= support]


def _summed(hashes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sum of each one's counts."""
    h, t = np.concatenate(hashes), np.concatenate(times)
    by = np.argsort(h, kind="stable")
    h, t = h[by], t[by]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(t, new) if len(new) else t


def pack(hashes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 and counts, by differences, byte planes and Zstandard."""
    planes = [np.diff(hashes, prepend=0).astype("<u4"), times.astype("<i8")]
    return zstandard.compress(b"".join(p.view(np.uint8).reshape(len(p), p.itemsize).T.tobytes() for p in planes), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = len(raw) // 12
    plane = lambda part, kind: np.ascontiguousarray(part.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()
    return np.cumsum(plane(raw[: 4 * n], "<u4"), dtype=np.uint64), plane(raw[4 * n :], "<i8")


def _mined(rows: DataFrame, lengths: list[int], may_hold, least: int, total: int, shard_words: int, segments: int) -> DataFrame:
    """(segment, packed, untold): phrases of local support of some shards and how often they are there, by range of hashes.

    may_hold, a broadcast bitmap or None, rules out phrases whose words (of pairs) or pairs (of longer ones) can't be
    frequent. A shard's share is that of its bytes, without those carried over from the one before. untold is what
    these shards may have left untold of any phrase; each range tells it.
    """
    inside = HASH_BITS - segments

    def packed(hashes: list[np.ndarray], times: list[np.ndarray], untold: int) -> pa.RecordBatch:
        h, t = _summed(hashes, times)
        cuts = np.searchsorted(h >> np.uint64(inside), np.arange((1 << segments) + 1, dtype=np.uint64))
        h = h & np.uint64((1 << inside) - 1)
        made = [pack(h[a:b], t[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        columns = [pa.array(np.arange(len(made), dtype=np.int32)), pa.array(made, pa.binary()), pa.array(np.full(len(made), untold))]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "packed", "untold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = Reader(shard_words), {1: 0, 2: 1}.get(lengths[0], 2)
        hashes, times, untold = [], [], 0
        for shard in reader.shards(batches):
            codes, support = reader.codes(), max(1, -(-least * (shard.held - shard.carried_bytes) // total))
            untold += support - 1
            if part:
                first, found = shard.phrases(part, codes)
                good = np.zeros(len(shard.words), bool)
                good[first] = _passes(may_hold.value, found)
                # words carried over begin no phrase of part words that ends here, but longer ones do
                good[: shard.carried] = True
            for k in lengths:
                first, found = shard.phrases(k, codes)
                if part:
                    found = found[np.logical_and.reduce([good[first + i] for i in range(k - part + 1)])]
                found, n = _supported(found >> np.uint64(64 - HASH_BITS), support)
                hashes.append(found)
                times.append(n)
            if sum(map(len, hashes)) >= PACKED:
                yield packed(hashes, times, untold)
                hashes, times, untold = [], [], 0
        if hashes:
            yield packed(hashes, times, untold)

    return rows.mapInArrow(run, "segment int, packed binary, untold long")


def _united(mined: DataFrame, least: int, segments: int) -> list:
    """Parts of the bitmap (segment, bits) of all phrases that can reach the support."""

    def unite(part: pa.Table) -> pa.Table:
        bits = np.zeros(1 << (BITS - segments - 3), np.uint8)
        told = [unpack(p) for p in part.column("packed").to_pylist()]
        hashes, times = _summed([h for h, _ in told], [t for _, t in told])
        at = hashes[times >= least - pc.sum(part.column("untold")).as_py()] >> np.uint64(HASH_BITS - BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return pa.table({"segment": part.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    return mined.groupBy("segment").applyInArrow(unite, "segment int, bits binary").collect()


def _counted(rows: DataFrame, may_hold, shard_words: int) -> DataFrame:
    """(lang, words, phrase, times) of each shard for all phrases that the bitmap lets through; all words as words 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shard_words)
        for shard in reader.shards(batches):
            codes, names = reader.codes(), pa.array(reader.names, pa.string())
            told = lambda langs, k, phrases, times: pa.RecordBatch.from_arrays([names.take(pa.array(langs)), pa.array(np.full(len(langs), k, np.int32)), pa.array(phrases, pa.string()), pa.array(times)], names=["lang", "words", "phrase", "times"])
            n = np.bincount(shard.langs[shard.carried :], minlength=len(names))
            yield told(np.arange(len(names)), 0, [""] * len(names), n.astype(np.int64))
            for k in range(1, LONGEST + 1):
                first, hashes = shard.phrases(k, codes)
                keep = _passes(may_hold.value, hashes)
                at, times = shard.told_apart(first[keep], hashes[keep], k, codes)
                for i in range(0, len(at), HANDED):
                    few = at[i : i + HANDED]
                    yield told(shard.langs[few], k, [shard.phrase(a, k) for a in few.tolist()], times[i : i + HANDED].astype(np.int64))

    each = rows.mapInArrow(run, "lang string, words int, phrase string, times long")
    return each.groupBy("lang", "words", "phrase").agg(F.sum("times").alias("f"))


def frequent_phrases(documents: DataFrame, *, least: int = 30, shard_words: int = SHARD_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to 4 words that occur ``least`` times in texts of a language, and f.

    A row of 0 words and an empty phrase has the number of all words of the language. Words are parted by spaces and
    tabs, A-Z is lower-cased; phrases lie within pieces, which end at ``.,;:!?`` and at line ends; occurrences may
    overlap. A null language is ``und``; a null text is empty; repeated rows count each; an empty table gives no rows.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDECIDED)), F.col(text_col).cast("string")
    rows = documents.select(lang.alias("lang"), text.alias("text")).filter("text is not null and text != ''")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    spark, bits, may_hold = documents.sparkSession, np.zeros(1 << (BITS - 3), np.uint8), None
    segments = min(20, max(8, (total // SEGMENT_BYTES).bit_length()))
    size = 1 << (BITS - segments - 3)
    for lengths in ([1], [2], [3, 4]):
        for segment, made in _united(_mined(rows, lengths, may_hold, least, total, shard_words, segments), least, segments):
            bits[segment * size : (segment + 1) * size] |= np.frombuffer(made, np.uint8)
        if may_hold is not None:
            may_hold.unpersist()
        may_hold = spark.sparkContext.broadcast(bits)
    return _counted(rows, may_hold, shard_words).filter((F.col("f") >= least) | (F.col("words") == 0))


def _exactly(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(documents: DataFrame, *, least: int = 30, top: int = 2000, within_percent: int = 80, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` collocations of each language, 2 to 4 words long.

    a is the phrase's count, l and r those of its parts where a cut scores lowest, n the language's words. A cut's score
    is floor(2,000,000 a / (l + r)); ties go to the shortest first part. A phrase goes if some longer frequent phrase
    that holds it has ``within_percent`` of its count. Ties of score and count are in byte order of phrases. What the
    texts may hold is said in frequent_phrases.
    """
    found = materialise(frequent_phrases(documents, least=least, **options), "phrases-counts")
    counts, candidates = found.filter("words > 0"), found.filter("words > 1")
    words = candidates.withColumn("w", F.split("phrase", " "))
    joined = lambda start, n: f"array_join(slice(w, {start}, {n}), ' ')"
    cuts = words.withColumn("k", F.expr("explode(sequence(1, words - 1))"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.expr(joined("1", "k")).alias("left"), F.expr(joined("k + 1", "words - k")).alias("right"))
    cuts = materialise(cuts, "phrases-cuts")
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = join_hot(join_hot(cuts, of("left", "l"), ["lang", "left"], ["phrase"]), of("right", "r"), ["lang", "right"], ["phrase"])
    score = F.expr("cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    longer = words.filter("words > 2").withColumn("n", F.expr("explode(sequence(2, words - 1))")).withColumn("i", F.expr("explode(sequence(1, words - n + 1))"))
    longer = longer.select("lang", F.expr(joined("i", "n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = F.coalesce(_exactly(F.col("longer")) * 100 >= _exactly(F.col("a")) * within_percent, F.lit(False))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(~held).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # a language's best come from the best of its parts, so that no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    all_words = found.filter("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
