"""Fill in the middle over seekable compressed frames.

A text is stored as independent Zstandard frames with the units, characters and bytes before each of them. A cut after
so many units is found by the unit counts: only the frame that holds the cut is decompressed. The rearranged text is
again a sequence of frames: markers and the two ends of a cut are frames of their own, all others are taken over as
they are, compressed. Laid end to end, an output's frames are one Zstandard file. Digests and the way back stream the
frames in order, one decompressed frame at a time, so a text of any length needs the memory of its compressed frames.

A unit is a word with the white space before it; white space at the end is a unit of its own.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.columns import SEPARATOR, text_bytes

FRAME_BYTES, LEVEL = 1 << 16, 3
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Rows, and bytes of frames, that are handed on at once.
ROWS, HANDED = 256, 1 << 23


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


@functools.cache
def _marker(text: str) -> bytes:
    return _compressor().compress(text.encode())


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _unpacked(frame: bytes) -> bytes:
    return _decompressor().decompress(frame)


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero(raw & 0xC0 != 0x80))


def _ends(raw: np.ndarray, goes_on: bool) -> np.ndarray:
    """Where words end in a run of bytes; goes_on tells that a byte of a word follows it."""
    inside = ~SEPARATOR[raw]
    return np.flatnonzero(inside & ~np.append(inside[1:], goes_on)) + 1


def split_frames(raw: np.ndarray, size: int = FRAME_BYTES) -> tuple[list[int], list[int], list[bytes]]:
    """Units and characters before each frame and, last, in the whole text, and the frames of a text's UTF-8 bytes."""
    units, chars, frames, at = [0], [0], [], 0
    while at < len(raw):
        end = min(at + max(4, size), len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        part = raw[at:end]
        frames.append(_compressor().compress(part))
        units.append(units[-1] + len(_ends(part, end < len(raw) and not SEPARATOR[raw[end]])))
        chars.append(chars[-1] + _characters(part))
        at = end
    if len(raw) and SEPARATOR[raw[-1]]:
        units[-1] += 1
    return units, chars, frames


def cut_after(units: list[int], chars: list[int], frames: list[bytes], n: int) -> tuple[int, int, int]:
    """The frame in which the n-th unit ends, the byte in it, and the characters before; decompresses that frame alone."""
    if n == 0:
        return 0, 0, 0
    if n == units[-1]:
        return len(frames), 0, chars[-1]
    i = bisect.bisect_left(units, n) - 1
    raw = np.frombuffer(_unpacked(frames[i]), np.uint8)
    ends = _ends(raw, False)  # the last end counts only if it's one, but then no other is meant
    end = int(ends[n - units[i] - 1])
    return i, end, chars[i] + _characters(raw[:end])


def between(frames: list[bytes], start: tuple[int, int], stop: tuple[int, int]) -> list[bytes]:
    """Frames of the text from one (frame, byte) to another: whole frames as they are, ends as frames of their own."""
    (i, x), (j, y) = start, stop
    if i == j:
        return [_compressor().compress(_unpacked(frames[i])[x:y])] if x < y else []
    head = [_compressor().compress(_unpacked(frames[i])[x:])] if x else [frames[i]]
    return [*head, *frames[i + 1 : j], *([_compressor().compress(_unpacked(frames[j])[:y])] if y else [])]


def original(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that an output of the given form was made of, part by part, from the output alone.

    Markers are found in the streamed output, in the order that the form says; then prefix, middle and suffix are
    streamed one after the other.
    """
    if form == "plain":
        yield from map(_unpacked, frames)
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    found, starts, at, tail = [], [], 0, b""
    for frame in frames:
        part = _unpacked(frame)
        starts.append(at)
        seen, base = tail + part, at - len(tail)
        while len(found) < 3:
            k = seen.find(order[len(found)].encode(), max(0, (found[-1] + len(order[len(found) - 1]) if found else 0) - base))
            if k < 0:
                break
            found.append(base + k)
        at += len(part)
        tail = seen[-2:]
    stops = [*found[1:], at]
    ranges = {name: (a + len(name), b) for name, a, b in zip(order, found, stops, strict=True)}
    for name in (PREFIX, MIDDLE, SUFFIX):
        a, b = ranges[name]
        i = bisect.bisect_right(starts, a) - 1
        while i < len(frames) and starts[i] < b:
            yield _unpacked(frames[i])[max(0, a - starts[i]) : b - starts[i]]
            i += 1


def _sha256(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _handed(rows: Iterable[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= ROWS or size >= HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _listed(*rows) -> int:
    return sum(len(f) for f in rows[-1])


LONGS, FRAMES = pa.list_(pa.int64()), pa.list_(pa.binary())


def store(documents: DataFrame, *, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, marked, units, chars and frames.

    frames are the text's independent Zstandard frames, of about ``frame_bytes`` each; units and chars tell how many lie
    before each frame and, as their last entry, in the whole text. marked: the text holds a marker. A null text is an
    empty one, of no frames. Repeated rows and null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            marked = functools.reduce(pc.or_, (pc.match_substring(texts, m) for m in MARKERS)).to_pylist()
            raw, at = text_bytes(texts)
            schema = pa.schema([("doc_id", ids.type), ("marked", pa.bool_()), ("units", LONGS), ("chars", LONGS), ("frames", FRAMES)])
            made = ((ids[i].as_py(), marked[i], *split_frames(raw[at[i] : at[i + 1]], frame_bytes)) for i in range(len(ids)))
            yield from _handed(made, schema, lambda row: _listed(row[-1]))

    return rows.mapInArrow(run, f"doc_id {id_type}, marked boolean, units array<long>, chars array<long>, frames array<binary>")


def _draws(seed: int) -> list[Column]:
    """Four numbers of 32 bits, drawn from the seed and a row's id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(stored: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of a store.

    n counts units. Two draws cut a text after so many units into prefix, middle and suffix; a third leaves it plain but
    for ``percent`` of all ids, a fourth chooses between spm (suffix first) and psm. Empty texts and those that hold a
    marker are plain. output is a list of Zstandard frames; laid end to end they are the output's text. A plain output
    is its stored frames; prefix_chars and middle_chars are then null. Repeated rows come out alike.
    """
    h = _draws(seed)
    n = F.element_at("units", -1)
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    rows = stored.select("doc_id", form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "units", "chars", "frames")
    id_type = stored.schema["doc_id"].dataType.simpleString()
    p, s, m = map(_marker, MARKERS)

    def one(doc_id, form: str, low: int, high: int, units: list[int], chars: list[int], frames: list[bytes]) -> tuple:
        if form == "plain":
            return doc_id, units[-1], form, None, None, frames
        x, y = cut_after(units, chars, frames, low), cut_after(units, chars, frames, high)
        prefix, middle, suffix = between(frames, (0, 0), x[:2]), between(frames, x[:2], y[:2]), between(frames, y[:2], (len(frames), 0))
        output = [p, *prefix, s, *suffix, m, *middle] if form == "psm" else [s, *suffix, p, *prefix, m, *middle]
        return doc_id, units[-1], form, x[2], y[2] - x[2], output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", FRAMES)])
            yield from _handed((one(*(c[i].as_py() for c in batch.columns)) for i in range(len(batch))), schema, lambda row: _listed(row[-1]))

    return rows.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def digest(outputs: DataFrame) -> DataFrame:
    """outputs with output_sha256 and restored_sha256, of the UTF-8 bytes, in place of output.

    What is restored comes from output and form alone.
    """
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    types = ", ".join(f"{c} {outputs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, frames = batch.column("form").to_pylist(), batch.column("output")
            sums = [(_sha256(map(_unpacked, f := frames[i].as_py())), _sha256(original(f, form))) for i, form in enumerate(forms)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([x[k] for x in sums], pa.string()) for k in (0, 1))], names=[*columns, "output_sha256", "restored_sha256"])

    return outputs.select(*columns, "output").mapInArrow(run, f"{types}, output_sha256 string, restored_sha256 string")


def texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and output as text: what a trainer that doesn't read frames takes."""
    id_type = outputs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("form", pa.string()), ("output", pa.string())])
            made = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), b"".join(map(_unpacked, batch.column(2)[i].as_py())).decode()) for i in range(len(batch)))
            yield from _handed(made, schema, lambda row: len(row[-1]))

    return outputs.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {id_type}, form string, output string")
