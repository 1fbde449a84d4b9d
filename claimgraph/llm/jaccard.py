"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles. All tokens (shingles) have one order: rare ones first, then two classes of
frequent ones. Two sets whose similarity reaches the threshold can differ in few tokens, so a short prefix of each in
that order must share something. A rare token in a prefix is a signature by itself. A frequent token would bring too
many sets together, so frequent tokens sign in combinations of k: of a class, the tokens that fall into the same small
subclass are combined, and the prefix grows until, whatever allowed number of tokens a partner lacks, one whole
combination is left (each subclass gives k - 1 tokens away). Subclasses are sized by bands of set sizes; a set
signs for its own band and the next, so sets of comparable size always meet in one.

Which tokens are frequent is counted over all documents: a token of a share of all of them has that share in some
block, so each block names its own frequent tokens and their counts are added up. The class of a token decides how
fast the join is, never whether it is right; the table has a fixed bound.

Candidates come in two passes over the lists of signatures, and neither writes down all pairs of a list. Lists with the
same members are one list. First every member of a list meets only one hub, the member with the fewest rare tokens.
Links found there give components. Then, in lists that still hold several components, the members outside the largest
one meet the others, block by block, and only pairs of different components whose parity bitmaps allow the threshold
come out. Bitmaps bound the symmetric difference from below, so they lose nothing. What remains is verified word by
word on the whole texts; there a text meets all its partners at once. Equal sets are one set from the start.

No key gathers a large share of the rows: signatures of tokens that many documents hold are counted by partial sums,
keys that many rows share are joined in parts, and empty texts and copies take no part in the search.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, release
from claimgraph.llm.columns import ShingledText, WordHasher, mix, shingle_sets
from claimgraph.llm.ranks import join_hot
from claimgraph.operators.components import connected_components

#: A block of about so many tokens names the tokens that at least three, and this share, of its documents hold.
BLOCK_TOKENS, SHARE = 1 << 21, 1e-4
#: Tokens that are held to be frequent, at most; those in this share of all documents and more sign in threes.
FREQUENT, COMMON_SHARE = 1 << 18, 0.01
#: A signature whose tokens all reach this share of the documents may have a list too long for one task.
HOT_SHARE = 1e-3
#: Mean tokens in a subclass of a set that is all of one class; sets smaller than this many tokens sign by single ones.
SUBCLASS, SMALL = 8, 32
#: Below this threshold two sets that link may differ in so many tokens that their bands of sizes need not meet.
LEAST_PERCENT = 75
#: Members in a block of a list; a text has a copy for so many partners.
BLOCK, PARTNERS = 1000, 256
#: Words of 64 bits: of the bitmap that is compared first, and at most of the one that is compared in a list.
_FOLD_WORDS, _LIST_WORDS = 8, 256
_FOLDED = [f"w{i}" for i in range(_FOLD_WORDS)]
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of a power of two of classes of hashes (512 or more), as packed bits."""
    bits = max(512, 1 << max(0, int(len(tokens) - 1).bit_length()))
    where = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(where, minlength=bits).astype(np.uint8) & 1, bitorder="little")


def fold(bits: np.ndarray, to_bytes: int) -> np.ndarray:
    """The same parities over fewer, wider classes."""
    return bits if len(bits) <= to_bytes else np.bitwise_xor.reduce(bits.reshape(-1, to_bytes), axis=0)


class Signer:
    """Signatures of sets for one threshold, given the frequent tokens, their class (2 or 3), and whether they are hot."""

    def __init__(self, percent: int, frequent: np.ndarray, classes: np.ndarray, hot: np.ndarray | None = None) -> None:
        self.percent, self.frequent = percent, frequent
        self.codes = classes.astype(np.int8) + (4 * hot.astype(np.int8) if hot is not None else np.int8(0))
        self.step = math.log(100 / percent * 1.003)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def code_of(self, tokens: np.ndarray) -> np.ndarray:
        """The class of each token, and 4 more if it is hot."""
        out = np.ones(len(tokens), np.int8)
        look = np.flatnonzero(self.maybe[(tokens >> np.uint64(44)).astype(np.int64)])
        if len(look):
            at = np.minimum(np.searchsorted(self.frequent, tokens[look]), len(self.frequent) - 1)
            hit = self.frequent[at] == tokens[look]
            out[look[hit]] = self.codes[at[hit]]
        return out

    def __call__(self, tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of rare tokens, distinct signatures, those of them that are hot) of a set of sorted tokens."""
        n = len(tokens)
        need = n * (100 - self.percent) // 100 + 1
        codes = self.code_of(tokens)
        rare = tokens[codes == 1]
        none = np.zeros(0, np.uint64)
        if len(rare) >= need:
            return len(rare), mix(rare[:need] ^ _K[0]), none
        kinds = codes & 3
        by = np.argsort(kinds, kind="stable")
        ordered, kinds, hot = tokens[by], kinds[by].astype(np.int64), codes[by] > 3
        band, parts = int(math.log(n) / self.step), []
        for b in (band, band + 1):
            parts += self._band(ordered, kinds, hot, need, b)
        light, heavy = ([p[h] if i else p[~h] for p, h in parts] for i in (0, 1))
        return len(rare), np.unique(np.concatenate([none, *light])), np.unique(np.concatenate([none, *heavy]))

    def _band(self, tokens: np.ndarray, kinds: np.ndarray, hot: np.ndarray, need: int, band: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Arrays of signatures, and of whether each is hot."""
        largest = math.exp((band + 1) * self.step)
        if largest < SMALL:
            return [(mix(tokens[:need] ^ _K[0]), hot[:need])]
        group = (mix(tokens) % np.uint64(math.ceil(largest / SUBCLASS))).astype(np.int64)
        group = np.where(kinds == 1, np.arange(len(tokens)), len(tokens) + group * 4 + kinds)
        by = np.argsort(group, kind="stable")
        new = np.concatenate([[True], np.diff(group[by]) != 0])
        rank = np.empty(len(tokens), np.int64)
        rank[by] = np.arange(len(tokens)) - np.maximum.accumulate(np.where(new, np.arange(len(tokens)), 0))
        end = int(np.searchsorted(np.cumsum(rank >= kinds - 1), need)) + 1
        tokens, kinds, group, rank, hot = tokens[:end], kinds[:end], group[:end], rank[:end], hot[:end]
        single = kinds == 1
        out = [(mix(tokens[single] ^ _K[0]), hot[single])]
        for k in (2, 3):
            mine = np.flatnonzero(kinds == k)
            if not len(mine):
                continue
            _, row = np.unique(group[mine], return_inverse=True)
            grid = np.zeros((row.max() + 1, rank[mine].max() + 1), np.uint64)
            full, heat = np.zeros(grid.shape, bool), np.zeros(grid.shape, bool)
            grid[row, rank[mine]], full[row, rank[mine]], heat[row, rank[mine]] = tokens[mine], True, hot[mine]
            for places in itertools.combinations(range(grid.shape[1]), k):
                rows = full[:, places[-1]]
                if rows.any():
                    signs = mix(sum(mix(grid[rows, p]) * _K[j] for j, p in enumerate(places)) + mix(np.full(1, band * 4 + k, np.uint64)))
                    out.append((signs, heat[rows][:, places].all(axis=1)))
        return out


def _profile(rows: DataFrame, width: int, id_type: str) -> DataFrame:
    """Of each document its id, size and digest; of each block of documents its frequent tokens (then the id is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block, held, docs, kind = WordHasher(), [], 0, 0, None
        names = ["doc_id", "n", "d1", "d2", "token", "times"]

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(block), return_counts=True) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = times >= max(3, SHARE * docs)
            m = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 2, pa.array(_signed(tokens[keep])), pa.array(times[keep].astype(np.int64))], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            n, d1, d2 = [], [], []
            for tokens in shingle_sets(batch.column("text"), width, hasher):
                n.append(len(tokens))
                d1.append(mix(tokens).sum(dtype=np.uint64))
                d2.append(np.bitwise_xor.reduce(mix(tokens ^ _K[1])) if len(tokens) else np.uint64(0))
                block.append(tokens)
                held, docs = held + len(tokens), docs + 1
                if held >= BLOCK_TOKENS:
                    yield counted()
                    block, held, docs = [], 0, 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), *(pa.array(_signed(np.array(d, np.uint64)), pa.int64()) for d in (d1, d2)), none, none], names=names)
        if kind is not None:
            yield counted()

    return rows.mapInArrow(run, f"doc_id {id_type}, n int, d1 long, d2 long, token long, times long")


def _frequent(profile: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most FREQUENT tokens, those with the highest counts, sorted, the class of each, and whether it is hot."""
    totals = profile.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
    totals = materialise(totals, "jaccard-frequent")
    steps = totals.groupBy(F.floor(F.log2("times") * 4).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = math.inf, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["n"]
        if held > FREQUENT:
            break
        least = row["step"]
    found = totals.filter(F.floor(F.log2("times") * 4) >= (least if least < math.inf else 1 << 20)).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    times = found["times"].to_numpy(np.int64)[order]
    return tokens[order], np.where(times >= COMMON_SHARE * documents, 3, 2).astype(np.int8), times >= HOT_SHARE * documents


def _sign(rows: DataFrame, width: int, id_type: str, signer: Signer) -> DataFrame:
    """Of each document its digest, size, share of rare tokens, bitmaps and signatures.

    A bitmap is held once: as the words of _FOLDED up to their 512 bits, with wide up to its 16,384, with bits beyond.
    """

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            digests, sizes, rare, bits, words, wide, light, hot = [], [], [], [], [], [], [], []
            for tokens in shingle_sets(batch.column("text"), width, hasher):
                sizes.append(len(tokens))
                digests.append((mix(tokens).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens ^ _K[1])) if len(tokens) else np.uint64(0)))
                few, *signs = signer(tokens) if len(tokens) else (0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                own = parity(tokens)
                rare.append(few / max(1, len(tokens)))
                bits.append(own.tobytes() if len(own) > _LIST_WORDS * 8 else None)
                words.append(fold(own, _FOLD_WORDS * 8).view(np.int64))
                wide.append(fold(own, _LIST_WORDS * 8).view(np.int64) if len(own) > _FOLD_WORDS * 8 else np.zeros(0, np.int64))
                light.append(_signed(signs[0]))
                hot.append(_signed(signs[1]))
            d = _signed(np.array(digests, np.uint64).reshape(-1, 2))
            w = np.array(words, np.int64).reshape(-1, _FOLD_WORDS)
            columns = [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1)), pa.array(sizes, pa.int32()), pa.array(rare, pa.float32()), pa.array(bits, pa.binary())]
            columns += [*(pa.array(np.ascontiguousarray(w[:, i])) for i in range(_FOLD_WORDS)), lists(wide), lists(light), lists(hot)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d1", "d2", "n", "rare", "bits", *_FOLDED, "wide", "light", "hot"])

    return rows.mapInArrow(run, f"doc_id {id_type}, d1 long, d2 long, n int, rare float, bits binary, {', '.join(f'{w} long' for w in _FOLDED)}, wide array<long>, light array<long>, hot array<long>")


class _Steps:
    """Tables that a step has written on its way; they go once the step's own result is written."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def write(self, rows: DataFrame, tag: str) -> DataFrame:
        self.held.append(materialise(rows, tag))
        return self.held[-1]

    def done(self, rows: DataFrame, tag: str, *more: DataFrame) -> DataFrame:
        """The step's result, written; what it was made of, and more that nothing reads any longer, is deleted."""
        made = materialise(rows, tag)
        release(*self.held, *more)
        self.held.clear()
        return made


def _lists(sets: DataFrame, steps: _Steps) -> DataFrame:
    """(l1, l2, set, hub, size) of lists of two sets and more; l1 and l2 name a list by its members."""
    member = {"size": F.count(F.lit(1)), "hub": F.min(F.struct("rare", "set")), "l1": F.bit_xor(F.xxhash64("set")), "l2": F.bit_xor(F.xxhash64(F.lit(1), "set"))}
    of_list = Window.partitionBy("sign")
    light = sets.select(F.explode("light").alias("sign"), "set", "rare").select("*", *(c.over(of_list).alias(k) for k, c in member.items()))
    hot = steps.write(sets.select(F.explode("hot").alias("sign"), "set", "rare"), "jaccard-hot")
    hot = join_hot(hot, hot.groupBy("sign").agg(*(c.alias(k) for k, c in member.items())).filter("size > 1"), ["sign"], ["set"])
    of = ["l1", "l2", "set", F.col("hub.set").alias("hub"), "size"]
    return light.filter("size > 1").select(*of).unionByName(hot.select(*of)).distinct()


def _similar_sizes(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _meet(pairs: DataFrame, of_set: DataFrame, build: Callable, keep: Callable, id_type: str, steps: _Steps) -> DataFrame:
    """The pairs (hub, set) for which keep holds of what build makes of their payloads, the second column of of_set.

    A hub's payload has one copy for PARTNERS partners and comes right before theirs; a partner's goes to each hub.
    """
    payload = of_set.columns[1]
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    pairs = steps.write(join_hot(pairs, parts, ["hub"], ["set"]).select("hub", "set", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part")), "jaccard-pairs")
    hubs = pairs.select("hub", "part").distinct().join(of_set.withColumnRenamed("set", "hub"), "hub").select("hub", "part", F.col("hub").alias("set"), F.lit(0).alias("role"), payload)
    partners = pairs.join(of_set, "set").select("hub", "part", "set", F.lit(1).alias("role"), payload)
    met = hubs.unionByName(partners).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            good = []
            for hub, part, role, value in zip(*(batch.column(c) for c in ("hub", "part", "role", payload)), strict=True):
                own = (hub.as_py(), part.as_py())
                if own != key:
                    key, held = own, []
                made = build(value)
                if role.as_py() == 0:
                    held.append(made)
                good.append(role.as_py() == 1 and any(keep(x, made) for x in held))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("set")], names=["hub", "set"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(run, f"hub {id_type}, set {id_type}")


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int, id_type: str, steps: _Steps) -> DataFrame:
    """The pairs whose sizes and bitmaps don't rule a link out."""

    def keep(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
        (n, x), (m, y) = x, y
        to = min(len(x), len(y))
        differ = int(np.bitwise_count(fold(x, to) ^ fold(y, to)).sum())
        return min(n, m) * 100 >= max(n, m) * percent and differ * (100 + percent) <= (n + m) * (100 - percent)

    def build(v: pa.StructScalar) -> tuple[int, np.ndarray]:
        bits = np.frombuffer(v["bits"].as_buffer(), np.uint8) if v["bits"].is_valid else v["words"].values.to_numpy().view(np.uint8)
        return v["n"].as_py(), bits

    words = F.when(F.col("bits").isNull(), F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.array(*_FOLDED)))
    return _meet(pairs, sets.select("set", F.struct("n", "bits", words.alias("words")).alias("own")), build, keep, id_type, steps)


@functools.cache
def _hasher() -> WordHasher:
    """One for each Python worker."""
    return WordHasher()


def _linked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, width: int, percent: int, id_type: str, steps: _Steps) -> DataFrame:
    """The pairs whose sets of shingles, of the words of their whole texts, link."""
    pairs = steps.write(_allowed(pairs, sets, percent, id_type, steps), "jaccard-allowed")
    wanted = pairs.select(F.col("hub").alias("set")).union(pairs.select("set")).distinct()
    texts = rows.withColumnRenamed("doc_id", "set").join(wanted, "set", "left_semi").select("set", F.coalesce("text", F.lit("")).alias("text"))

    def build(text: pa.StringScalar) -> ShingledText:
        return ShingledText(np.frombuffer(text.as_buffer(), np.uint8), width, _hasher())

    def keep(x: ShingledText, y: ShingledText) -> bool:
        shared, either = x.common(y)
        return shared > 0 and 100 * shared >= percent * either

    return _meet(pairs, texts, build, keep, id_type, steps)


def _between_components(lists: DataFrame, found: DataFrame, sets: DataFrame, percent: int, steps: _Steps) -> DataFrame:
    """Pairs (hub, set) within a list, of different components, whose sizes and bitmaps allow a link."""
    of_list = ["l1", "l2"]
    rest = lists.filter("size > 2").select(*of_list, "set").join(found.withColumnRenamed("node", "set"), "set", "left")
    rest = steps.write(rest.withColumn("component", F.coalesce("component", "set")), "jaccard-rest")
    each = rest.groupBy(*of_list, "component").agg(F.count(F.lit(1)).alias("here"))
    top = each.groupBy(*of_list).agg(F.max(F.struct("here", "component")).alias("top"), F.sum("here").alias("size")).filter("size > top.here")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    top = top.select(*of_list, F.col("top.component").alias("top"), blocks(F.col("size")).alias("xs"), blocks(F.col("size") - F.col("top.here")).alias("ys"))
    rest = steps.write(join_hot(rest, top, of_list, ["set"]).join(sets.select("set", "n", "wide", *_FOLDED), "set"), "jaccard-rest")
    block, all_of = (lambda k: F.pmod(F.xxhash64("set"), F.col(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    x = rest.withColumn("x", block("xs")).withColumn("y", all_of("ys")).alias("x")
    y = rest.filter("component != top").withColumn("y", block("ys")).withColumn("x", all_of("xs")).alias("y")
    keys = [*of_list, "x", "y"]
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    once = (F.col("x.component") != F.col("y.component")) & ((F.col("x.component") == F.col("x.top")) | (F.col("x.set") < F.col("y.set")))
    within = lambda differ: differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    few = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in _FOLDED), F.lit(0))
    least = F.least(F.size("x.wide"), F.size("y.wide"))
    # bitmaps of sets of similar size are of one length, or one is twice as long; those of up to 512 bits are in few
    cut = lambda v: F.when(F.size(v) > least, F.zip_with(F.slice(v, F.lit(1), least), F.slice(v, least + 1, least), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(v))
    many = F.aggregate(F.zip_with(cut("x.wide"), cut("y.wide"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    allowed = _similar_sizes(F.col("x.n"), F.col("y.n"), percent) & within(few) & F.when((least > 0) & (F.greatest(F.size("x.wide"), F.size("y.wide")) <= 2 * least), within(many)).otherwise(True)
    return x.join(y, [*on, once, allowed]).select(F.col("y.set").alias("hub"), F.col("x.set").alias("set")).distinct()


def jaccard_components(documents: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents.

    Sets are distinct shingles of ``width`` lower-cased (A-Z) words of the whole text; a text with fewer words is one
    shingle, and one without words, or null, is empty and links with nothing. Two documents link when 100 times the
    common shingles is at least ``percent`` times those of both; component_id is the smallest id that links reach. A
    null id takes no part and has a null component. Rows that share an id are one document, whose texts are all linked;
    each row has its own size. An empty table gives no rows. Other columns are ignored. Below LEAST_PERCENT linked sets
    might share no signature, so such a ``percent`` is an error.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is from {LEAST_PERCENT} to 100")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    digest = ["d1", "d2", "n"]
    profile = materialise(_profile(rows, width, id_type), "jaccard-profile")
    each = profile.filter("n is not null").select("doc_id", *digest)
    real = each.filter("n > 0 and doc_id is not null")
    signer = Signer(percent, *_frequent(profile, each.count()))
    reps = materialise(real.groupBy(*digest).agg(F.min("doc_id").alias("set")), "jaccard-reps")

    signed = _sign(rows.filter("doc_id is not null"), width, id_type, signer)
    keys = ["doc_id", *digest]
    signed = signed.join(reps.withColumnRenamed("set", "doc_id"), keys).dropDuplicates(keys).drop("d1", "d2").withColumnRenamed("doc_id", "set")
    sets = materialise(signed, "jaccard-sets")
    steps = _Steps()
    lists = steps.done(_lists(sets, steps), "jaccard-lists")

    first = materialise(lists.filter("set != hub").select("hub", "set").distinct(), "jaccard-first")
    links = steps.done(_linked(first, sets, rows, width, percent, id_type, steps), "jaccard-links")
    found = connected_components(links, "hub", "set")

    between = _between_components(lists, found, sets, percent, steps)
    second = steps.done(between.join(first, ["hub", "set"], "left_anti"), "jaccard-second", lists, first)
    more = [] if second.isEmpty() else [steps.done(_linked(second, sets, rows, width, percent, id_type, steps), "jaccard-links", second)]
    release(sets)
    several = materialise(real.groupBy("doc_id").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).filter("least != most").select("doc_id"), "jaccard-several")
    if not several.isEmpty():
        own = join_hot(real.distinct().join(several, "doc_id", "left_semi"), reps, digest, ["doc_id"])
        more.append(own.select(F.col("doc_id").alias("hub"), "set").filter("hub != set"))
    if any(not m.isEmpty() for m in more):
        found = connected_components(functools.reduce(DataFrame.unionByName, more, links), "hub", "set")

    of_set = reps.join(found.withColumnRenamed("node", "set"), "set", "left").select(*digest, F.coalesce("component", "set").alias("component_id"))
    known = join_hot(real, of_set, digest, ["doc_id"]).select("doc_id", "n", "component_id")
    others = each.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return known.unionByName(others).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
