"""Mixing, Jaccard join, searches and joins of vectors, and the pipeline, against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimgraph.llm import ann, columns, jaccard, mixing, pivots, queries, secrets
from claimgraph.llm.columns import mix
from tests.llm.test_texts import EDGES, check_packing, docs_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, out, left, open_ = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("rows", [EDGES, [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}" if i % 9 else None) for i in range(900)], []])
def test_mix_meets_targets(spark, rows):
    got = mixing.mix(docs_of(spark, rows), weights=[1, 2, 3]).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(dict(sizes), [1, 2, 3], 3), defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    if len(rows) > 100:
        assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in sizes)
        assert sorted(map(str, mixing.mix(docs_of(spark, rows[::-1]), weights=[1, 2, 3]).collect())) == sorted(map(str, got))


def test_rates_are_the_multipliers_of_the_dual(spark):
    """Each source's multiplier, found here by halving an interval, meets its target in expectation."""
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(900)]
    sizes = spark.createDataFrame([(f"={s}", len(WORD.findall(t))) for _, t, s in rows], "_source string, size long")
    got = {r._source: r for r in mixing.solve_rates(sizes, mixing.source_targets(sizes, [1, 2, 3], 3), 3).collect()}
    for k in range(4):
        x = np.array([len(WORD.findall(t)) for _, t, s in rows if s == f"s{k}"], float)
        r = got[f"=s{k}"]
        given = lambda m: (np.minimum(3, np.exp(np.minimum(m * x / x.mean(), 50))) * x).sum()
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if given(middle) > r.target else (middle, high)
        assert r.source_size == x.sum() and abs(given(r["lambda"]) - r.target) < 1e-5 * r.target
        if r.target < 2.99 * r.source_size:
            assert abs(r["lambda"] - low) < 1e-6


def test_resample_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 30), f"s{i % 3}") for i in range(300)]
    docs = docs_of(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs, weights=[1, 2, 3]).collect()}
    got = mixing.resample(docs, weights=[1, 2, 3])
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == Counter({d: c for d, c in copies.items() if c})


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def components(ids, linked):
    of = {i: i for i in ids}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard_truth(rows, width, percent):
    sets = {d: shingles(t, width) for d, t, _ in rows if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, pairs)


def near_copies(seed, groups, each, words, edits):
    rng, rows = np.random.default_rng(seed), []
    names = [f"w{i}" for i in range(3000)]
    for g in range(groups):
        base = list(rng.choice(names, words))
        for _ in range(each):
            copy = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits + 1)):
                copy[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows) + 10, " ".join(copy), f"s{g}"))
    return rows


def rows_around_bitmap_lengths():
    """Near copies of about 512, 1,024 and 16,384 shingles, so that bitmaps of two lengths meet."""
    rows = []
    for seed, words in enumerate((512, 1024, 16384), 40):
        for _, text, source in near_copies(seed, 1, 8, words + 60, words // 60):
            rows.append((len(rows) + 10, " ".join(text.split(" ")[: words + 60 - 15 * (len(rows) % 8)]), source))
    return rows


@pytest.mark.parametrize(("width", "percent", "rows"), [(4, 85, [*EDGES, (30, "WORD", "a"), (31, "a b c", "a"), (32, "A b  c", "a"), (33, "a b c d", "a")]), (5, 80, near_copies(1, 3, 40, 60, 3)), (4, 85, near_copies(2, 2, 60, 90, 6)), (4, 85, near_copies(3, 20, 3, 12, 1)), (4, 85, rows_around_bitmap_lengths()), (4, 85, [])])
def test_jaccard_components(spark, monkeypatch, width, percent, rows):
    monkeypatch.setattr(jaccard, "SHARE", 1e-3)
    got = jaccard.jaccard_components(docs_of(spark, rows), width=width, percent=percent).collect()
    sets, want = jaccard_truth(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def hot_rows():
    """Thousands of copies and of empty texts, a large near-copy group, and one whose pairs all lie just below 0.85."""
    rng, base = np.random.default_rng(8), [f"b{i}" for i in range(40)]
    rows = [(i, "the same few words in very many rows", "hot") for i in range(1500)] + [(2000 + i, " \n" if i % 2 else None, "hot") for i in range(1500)]
    for i in range(300):
        words = list(base)
        words[int(rng.integers(40))] = f"x{i}"
        rows.append((4000 + i, " ".join(words), "hot"))
    for i in range(120):  # 57 of 61 shingles stay: two of them share 53 of 61 + 4 + ... : below the threshold, unlike their base
        words = [f"c{k}" for k in range(60)]
        words[i % 50 + 4] = f"y{i}"
        rows.append((5000 + i, " ".join(words), "hot"))
    return rows


@pytest.mark.parametrize("block", [1000, 25])
def test_jaccard_of_hot_keys(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PARTNERS", 50)
    rows = hot_rows()
    sets, want = jaccard_truth(rows, 4, 85)
    got = jaccard.jaccard_components(docs_of(spark, rows).repartition(6), width=4, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(sets[d]), want[d]) for d in sets}
    assert len({c for d, c in want.items() if d >= 5000}) > 20


def test_jaccard_tells_words_of_one_polynomial_apart(spark):
    tm = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, f"{tm} k l m n o", "s"), (2, f"{tm.translate(str.maketrans('ab', 'ba'))} k l m n o", "s")]
    assert {r.component_id for r in jaccard.jaccard_components(docs_of(spark, rows), width=4, percent=85).collect()} == {1, 2}


def test_jaccard_links_texts_of_one_id(spark):
    rows = [(5, "a b c d e f", "s"), (5, "g h i j k l", "s"), (3, "g h i j k l", "s"), (9, "a b c d e f", "s")]
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows)).collect()} == {(5, 3), (3, 3), (9, 3)}


@pytest.mark.parametrize("mask", [None, 0xFF, 0xFFFF])
def test_texts_compare_as_sets_of_words_whatever_the_hashes(monkeypatch, mask):
    """Hashes cut to a few bits mix words up; pieces of 16 bytes cut long words: neither changes what texts share."""
    whole = columns.WordHasher()
    monkeypatch.setattr(columns, "CHUNK_BYTES", 16)
    cut = columns.WordHasher()
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(40)] + ["x" * 70, "x" * 69 + "y", "é", "É"]
    texts = [" ".join(rng.choice(names, n)).encode() for n in (0, 1, 3, 4, 5, 30, 30, 200, 200)] + [b" A  b\tc\nd e", b"a b c d", b"\n "]

    def hasher(data, starts, ends):
        h = cut(data, starts, ends)
        assert np.array_equal(h, whole(data, starts, ends))
        return h if mask is None else h & np.uint64(mask)

    made = [columns.ShingledText(np.frombuffer(t, np.uint8), 4, hasher) for t in texts]
    assert mask is not None or all(m.exact for m, t in zip(made, texts) if len(t.split()) >= 4)
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            a, b = columns.exact_shingles(x, 4), columns.exact_shingles(y, 4)
            assert made[i].common(made[j]) == (len(a & b), len(a | b))


def test_jaccard_refuses_thresholds_at_which_it_could_lose_links(spark):
    with pytest.raises(ValueError, match="percent"):
        jaccard.jaccard_components(docs_of(spark, []), percent=70)


def test_jaccard_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets, want = jaccard_truth(rows, 4, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op7_jaccard_join(spark, SF).collect()} == {(d, len(sets[d]), want[d]) for d in sets}


def test_signatures_of_linked_sets_meet():
    """Whatever classes the tokens have, two sets at the threshold share a signature."""
    rng = np.random.default_rng(4)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        tokens = np.unique(mix(rng.integers(0, 1 << 62, 2 * n + 10).astype(np.uint64)))
        known = np.sort(rng.permutation(tokens)[: int(len(tokens) * rng.random())])
        signer = jaccard.Signer(85, known, rng.integers(2, 4, len(known)).astype(np.int8), rng.random(len(known)) < 0.5)
        common, spare = tokens[:n], tokens[n:]
        extra = int(rng.integers(0, n * 15 // 85 + 1))
        k = int(rng.integers(0, extra + 1))
        a, b = np.sort(np.concatenate([common, spare[:k]])), np.sort(np.concatenate([common, spare[k:extra]]))
        if 100 * n >= 85 * (n + extra):
            assert any(len(np.intersect1d(signer(a)[k], signer(b)[k])) for k in (1, 2)), trial


VECTORS = "vec_id long, embedding array<float>, label int, rank string"


def vector_rows(seed=5, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n, 6):
        x[i + 1] = x[i] + 0.05 * rng.normal(size=d)
        x[i + 2] = x[i]
    rows = [(i, [float(v) for v in x[i]], int(i // 6 % 4)) for i in range(n)]
    bad = [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [1.0] * (d - 1), 1), (n + 4, [None] + [1.0] * (d - 1), 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * d, 2)]
    return rows, bad


def test_nearest_neighbours(spark):
    rows, bad = vector_rows()
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, *bad, rows[3]]], VECTORS)
    got = defaultdict(list)
    for r in ann.nearest(frame, frame["vec_id"] % 20 == 0, k=10).collect():
        got[r.query_id].append(r)
    x, ids = np.array([r[1] for r in [*rows, bad[5]]], np.float64), np.array([r[0] for r in [*rows, bad[5]]])
    hits = asked = 0
    for q in (i for i in range(len(ids)) if ids[i] % 20 == 0):
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:10]
        mine = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - score[list(ids).index(r.vec_id)]) < 1e-9 for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hits, asked = hits + len({r.vec_id for r in mine} & set(ids[best])), asked + 10
    assert set(got) == {i for i in ids if i % 20 == 0} and hits / asked >= 0.9


def test_nearest_of_few_and_equal_vectors(spark):
    rows = [(i * 20, [1.0, 0.0], 0, "") for i in range(40)] + [(1, [0.0, 1.0], 0, "")]
    frame = spark.createDataFrame(rows, VECTORS)
    got = ann.nearest(frame, frame["vec_id"] % 20 == 0, k=3).collect()
    assert len(got) == 120 and [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 20] == [0, 40, 60]
    few = frame.filter("vec_id < 40")
    assert len(ann.nearest(few, few["vec_id"] % 20 == 0, k=20).collect()) == 4
    assert ann.nearest(frame.limit(0), frame["vec_id"] % 20 == 0).count() == 0


@pytest.mark.parametrize(("block", "long"), [(1024, 1 << 16), (40, 1 << 16), (40, 1)])
def test_near_duplicate_vectors(spark, monkeypatch, block, long):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivots, "LONG_LIST", long)
    rows, bad = vector_rows()
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, *bad]], VECTORS)
    got = {r.vec_id: r for r in pivots.near_duplicates(frame, least=0.93).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = components(range(len(rows)), zip(*np.nonzero(near), strict=True))
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(rows)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.9
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in bad)
    if long == 1:  # lists of two pivots give what lists of one give
        monkeypatch.setattr(pivots, "LONG_LIST", 1 << 16)
        assert {r.vec_id: r for r in pivots.near_duplicates(frame, least=0.93).collect()} == got
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def near_copies(n, spread, share=3):
    """Unit rows, the first n // share of them around one centre."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, 64)) / 8
    x[: n // share] = x[n - 1] + spread * x[: n // share]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("share", [3, 1])
def test_a_large_near_copy_group_keeps_its_links(spark, monkeypatch, share):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 300)
    x = near_copies(1500, 0.2, share)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], VECTORS)
    got = {r.vec_id: r for r in pivots.near_duplicates(frame, least=0.93).collect()}
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() > 200_000 and sum(r.n_links for r in got.values()) >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert np.mean([got[i].component_id == 0 for i in range(1500 // share - 1)]) > 0.99


@pytest.mark.parametrize("count", [128, 1000, 4096])
def test_pivots_find_near_copies_at_every_count(count):
    centres = near_copies(count, 0.25)
    x = centres[-1] + 0.25 / 8 * np.random.default_rng(12).standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    centres = pivots.spread(centres)
    named = np.zeros((len(x), len(centres)), np.float32)
    np.put_along_axis(named, np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :8], 1.0, axis=1)
    assert (near & (named @ named.T >= 2)).sum() >= 0.97 * near.sum() > 0


def test_pipeline_stages(spark):
    """Every stage, and the run of all, against brute force over all rows that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, rows = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, before, SF), "test")
        got = after.collect()
        assert after.schema.names == docs.schema.names and got, name
        if name == "quality classifier":
            good = {r.doc_id for r in queries.op5_quality(spark, SF).collect() if r.predicted}
            assert Counter(got) == Counter(r for r in rows if r.doc_id in good)
        elif name == "n-gram Jaccard join":
            sets, of = jaccard_truth([(r.doc_id, r.text, None) for r in rows], 5, 80)
            assert Counter(got) == Counter(r for r in rows if r.doc_id in set(of.values()))
        elif name == "secret scans":
            live = {r.doc_id for r in secrets.digest(secrets.scan(before)).collect() if r.n_live}
            was, now = ({r.doc_id: r for r in x} for x in (rows, got))
            assert was.keys() == now.keys() and len(got) == len(rows)
            assert {d for d in was if was[d] != now[d]} == live and all("[SECRET]" in now[d].text for d in live)
        else:
            sizes, taken = Counter(), Counter()
            for r in rows:
                sizes[r.source] += len(WORD.findall(r.text or ""))
            for r in got:
                taken[r.source] += len(WORD.findall(r.text or ""))
            copies = Counter(got)
            assert set(copies) <= set(rows) and max(copies.values()) <= 3
            want = targets(dict(sizes), queries.SOURCE_WEIGHTS, 3)
            documents = Counter(r.source for r in rows)  # a few documents a source: none ends more than a mean one off
            assert all(abs(taken[s] - want[s]) <= sizes[s] / documents[s] for s in sizes)
        before, rows = after, got
    pieces = corpus_pipeline.run(spark, SF).collect()
    sequences, tokens = check_packing(pieces, [(r.doc_id, r.text) for r in rows], 2048)
    assert sequences <= -(-tokens // 2048) * 1.03 + 1


def test_pipeline_takes_odd_rows(spark):
    docs = docs_of(spark, [*EDGES, (50, "one two three four five six", "a"), (51, "one two three four five six", "a")])
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, 3, None, 7, 8, 50]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages_take_any_column_names(spark):
    rows = [*EDGES, *((60 + i, f"say password=abcdef{i} now " + "more words " * i, "a" if i % 2 else None) for i in range(12))]
    clash = ["_id", "_hash", "_spans", "_text", "_size", "_copy", "_words", "_src", "_copies", "_stat_log_bytes", "row", "masked", "size", "copies", "spans", "text_hash", "component_id", "id", "hub", "set", "n"]
    docs = docs_of(spark, rows)
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        got, plain = stage(spark, wide, SF).collect(), stage(spark, docs, SF).collect()
        assert len(got) == len(plain), name
        if name != "best-fit packing":
            assert Counter(str(r[: len(docs.columns)]) for r in map(tuple, got)) == Counter(str(tuple(r)) for r in plain), name
            assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for r in got for c in clash), name


def test_vectors_of_two_dimensions_meet_their_own(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(41, 12))
    x[1], y[1] = x[0] * 2, y[0] * 2
    rows = [(i, [float(v) for v in r], 1, "") for i, r in enumerate([*x, *y])] + [(200, None, 1, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string")
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5, probes=16).collect():
        got[r.query_id].append(r)
    assert set(got) == {0, 20, 40, 60, 80, 100}
    for q, found in got.items():
        base, of = (0, x) if q < 60 else (60, y)
        score = of @ of[q - base]
        best = [base + i for i in np.argsort(-score, kind="stable") if base + i != q][:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == best
    kept = {r.vec_id: r for r in pivots.near_duplicates(frame).collect()}
    assert len(kept) == 102 and {i for i, r in kept.items() if r.n_links} == {0, 1, 60, 61} and kept[61].component_id == 60 and kept[200].kept


def test_near_copies_go_from_tables_with_dots_in_names(spark):
    frame = docs_of(spark, [(i, "one two three four five six seven", "s") for i in (3, 4, 4)] + [(5, "others", "s"), (5, "others", "s")]).selectExpr("*", "source AS `meta.kind`")
    left = corpus_pipeline.drop_near_copies(spark, frame, SF)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [3, 5]


def test_mixing_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    with pytest.raises(RuntimeError, match="target"):
        mixing.mix(docs_of(spark, [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(900)]), weights=[1, 2, 3])
