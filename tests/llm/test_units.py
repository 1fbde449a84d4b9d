"""Fill in the middle, token counts and collocations against plain Python and the tokenizers library."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from claimgraph.llm import collocations, fim, queries, token_counts
from tests.llm.test_texts import EDGES, docs_of

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "a", " a ", "é\n\n日本 x\t", "a<P>b c", "<S>", "<<M", "a <", "x" * 5000, " " * 5000, "y " * 3000, "né " * 999 + "\r\n", "a b c", "<P x> <S y> <M z>"]


def plain_fim(doc_id, text):
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [4, 37, fim.FRAME_BYTES])
def test_fim_equals_plain_strings(spark, size):
    rows = [(i, TEXTS[i % len(TEXTS)], "s") for i in range(20 * len(TEXTS))] + [(None, "no id here", "s"), (3, "again", "s"), (3, "again", "s")]
    rng = np.random.default_rng(1)
    rows += [(1000 + i, "".join(rng.choice(list("ab \n<é>PSM日"), rng.integers(0, 80))), "s") for i in range(300)]
    frame = docs_of(spark, rows).withColumnRenamed("source", "form").repartition(3)
    out = fim.rearrange(fim.store(frame, frame_bytes=size))
    text = sorted((r.output, r.form) for r in fim.texts(out).collect())
    want = [plain_fim(i, t) for i, t, _ in rows]
    assert text == sorted((w[4], w[1]) for w in want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r) for r in fim.digest(out).collect())
    assert got == Counter((i, *w[:4], sha(w[4]), sha(t or "")) for (i, t, _), w in zip(rows, want))
    assert fim.digest(fim.rearrange(fim.store(frame.limit(0)))).count() == 0


def test_fim_frames_are_taken_over_and_one_file(spark):
    text = "some words, " * 4000
    units, chars, frames = fim.split_frames(np.frombuffer(text.encode(), np.uint8), 1024)
    assert len(frames) == -(-len(text) // 1024) and units[-1] == 8001 and chars[-1] == len(text)
    opened = []
    unpacked = fim._unpacked
    fim._unpacked = lambda f: opened.append(f) or unpacked(f)
    try:
        i, x, at = fim.cut_after(units, chars, frames, 3001)
        assert opened == [frames[i]] and at == len("".join(UNIT.findall(text)[:3001])) == i * 1024 + x
        out = fim.between(frames, (0, 0), (i, x))
    finally:
        fim._unpacked = unpacked
    assert out[:-1] == frames[:i]
    assert zstandard.ZstdDecompressor().stream_reader(b"".join(out), read_across_frames=True).read().decode() == text[:at]


def test_fim_of_long_texts(spark):
    texts = [" " * 2_000_000, "\n" * 1_500_000 + "x", "w " * 700_000, "z" * 2_000_000]
    rows = [(i, texts[i % 4], "s") for i in range(16)]
    got = {r.doc_id: r for r in fim.digest(fim.rearrange(fim.store(docs_of(spark, rows)))).collect()}
    for i, t, _ in rows:
        n, form, prefix, middle, out = plain_fim(i, t)
        assert tuple(got[i])[1:] == (n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, library):
    rng = np.random.default_rng(0)
    letters, signs = list("abcdefghijklmnopqrstuvwxyz"), list("  '''stmdrvelxyA12!?,\n\t é你　\x1c\0")
    texts = ["", "a", "'", "'r", "'re", "'l", "'ll", " 's", "\n's", "x <|endoftext|> y  <|endoftext|>", "<|endoftext|><|endoftext|>", "  "]
    texts += ["".join(rng.choice(signs, rng.integers(0, 700))) for _ in range(3000)] + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1500)]
    texts += ["".join(map(chr, rng.integers(0x20, 0x3000, rng.integers(1, 60)))) for _ in range(1000)]
    counter = token_counts.TokenCounter.of(queries.tokenizer_path())
    assert counter(texts).tolist() == library(texts)
    documents = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in documents], library([d.text or "" for d in documents])))
    got = queries.op12_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {d.doc_id: (len((d.text or "").encode()), want[d.doc_id], want[d.doc_id] > 512) for d in documents}


def test_token_counts_edges(spark, library):
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs_of(spark, EDGES).withColumnRenamed("lang", "n_tokens"), queries.tokenizer_path(), limit=1).collect())
    counts = library([t or "" for _, t, _ in EDGES])
    assert got == Counter((i, len((t or "").encode()), n, n > 1) for (i, t, _), n in zip(EDGES, counts))
    assert token_counts.count_tokens(docs_of(spark, []), queries.tokenizer_path()).count() == 0


def test_token_counts_of_long_texts(library):
    counter = token_counts.TokenCounter.of(queries.tokenizer_path())
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 1_200_000, "x" + " " * 1_100_000 + "y", "it's 12 é" * 150_000]
    assert counter(texts).tolist() == library(texts)


def test_token_states_are_thrown_away_without_effect(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "PAIRS", 50)
    monkeypatch.setattr(token_counts, "KNOWN", 5)
    counter = token_counts.TokenCounter(queries.tokenizer_path())
    texts = ["antidisestablishmentarianism straightforwardly unquestionable " * 3, "zxqj" * 40]
    assert counter(texts).tolist() == library(texts) and len(counter.known.merges.states) <= 51


def test_cutter_equals_a_plain_walk():
    cutter, rng = token_counts.Cutter(), np.random.default_rng(3)
    for n in [0, 1, 255, 256, 257, 5000]:
        kinds = rng.integers(0, 11, n).astype(np.uint8)
        state, want = token_counts.FRESH, np.zeros(n, bool)
        for i, k in enumerate([*kinds, token_counts.END]):
            state, told = token_counts._rule(state, int(k))
            if told & token_counts.HERE:
                want[i] = True
            if told & token_counts.BEFORE:
                want[i - 1] = True
        assert (cutter.begins(kinds) == want).all()


def test_other_tokenizer_files_are_an_error():
    import public_tokenizers

    with pytest.raises(ValueError, match="plain byte-level"):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows)
    counts = {p: f for p, f in counts.items() if f >= least}
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2:
            continue
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((words, a, counts[lang, words[:k]], counts[lang, words[k:]], score))
    out = set()
    for lang, rows_ in found.items():
        held = {}
        for words, a, *_ in rows_:
            for m in range(2, len(words)):
                for i in range(len(words) - m + 1):
                    held[words[i : i + m]] = max(a, held.get(words[i : i + m], 0))
        kept = [r for r in rows_ if 100 * held.get(r[0], -1) < 80 * r[1]]
        kept.sort(key=lambda r: (-r[4], -r[1], " ".join(r[0]).encode()))
        out |= {(lang, i + 1, " ".join(w), a, left, right, totals[lang], score) for i, (w, a, left, right, score) in enumerate(kept[:top])}
    return out


@pytest.mark.parametrize("shard_words", [1, 50, 1 << 19])
def test_collocations_equal_plain_counts(spark, shard_words):
    rng = np.random.default_rng(5)
    rows = [("".join(rng.choice(["a ", "B ", "c\t", "é ", "d, ", "e.", "f g ", "\n", "  "], rng.integers(0, 60))), ["en", None, "und", "fr"][i % 4]) for i in range(400)]
    rows += [("The Same line again and again\n" * 40, "en")] * 3 + [(None, "en"), ("", None), ("one", "zz"), ("long " * 20000, "en"), ("w" * 100_000 + " x " + "w" * 100_000, "fr")]
    frame = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(5)
    for least, top in ((3, 25), (30, 2000)):
        got = collocations.collocations(frame, least=least, top=top, shard_words=shard_words)
        assert {tuple(r) for r in got.collect()} == plain_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, "a"), (2, "", "a"), (3, " .", "b")])).count() == 0


def test_shards_read_all_words_whatever_their_parts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab  \t.é"), rng.integers(0, 90))) for _ in range(60)] + ["x" * 300, "y" * 40 + " " + "y" * 40, ""]
    monkeypatch.setattr(collocations, "LONG_WORD", 20)
    want, _ = plain_counts([(t, "en") for t in texts])
    for part, shard_words in ((7, 3), (64, 40), (1 << 19, 1 << 19)):
        monkeypatch.setattr(collocations, "PART_BYTES", part)
        reader, got = collocations.Reader(shard_words), Counter()
        batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 10], "lang": ["en"] * len(texts[i : i + 10])}) for i in range(0, len(texts), 10)]
        for shard in reader.shards(iter(batches)):
            for k in range(1, 5):
                first, hashes = shard.phrases(k, reader.codes())
                at, times = shard.told_apart(first, hashes, k, reader.codes())
                got.update({("en", tuple(shard.phrase(a, k).split(" "))): n for a, n in zip(at.tolist(), times.tolist())})
        assert got == want


def test_packed_phrases_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 1000):
        hashes, times = np.unique(rng.integers(0, 1 << 32, n).astype(np.uint64)), rng.integers(1, 1 << 40, n)
        times = times[: len(hashes)]
        got = collocations.unpack(collocations.pack(hashes, times))
        assert np.array_equal(got[0], hashes) and np.array_equal(got[1], times)
