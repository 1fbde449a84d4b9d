"""Secret scan by corpus-wide ownership frequency, in DataFrame operations alone.

Candidates come from patterns over the whole text. The base kinds always count. The method then asks, for each
candidate's SHA-256 over the whole corpus, how many repositories (distinct texts) and how many owners (sources) hold it:
a string that many owners hold is a copied example; one that few hold looks live, however often they repeat it, and so
does one that others have copied here and there but nearly all of whose repositories are one owner's. Candidates of the wider kinds
(vendor tokens, mixed-case keys) are too often harmless to be taken on their pattern alone; they become spans only
when they look live. Only candidates are shuffled, never texts, and a candidate in very many documents is counted by
partial sums over (hash, owner, text).

Positions come from the lengths of what lies between matches: the pieces that splitting by the pattern leaves and
the matches themselves alternate, so running sums of their lengths, as code points, are the starts and ends.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise


def either_case(word: str) -> str:
    """A pattern for word with ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Kind, pattern over the text, and the group that holds the secret. The first three, in this order, are the base kinds.
ASSIGN = rf"""({ASSIGN_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}"
MIXED = r"[A-Za-z0-9+/_-]{28,}"
KINDS = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("vendor", VENDOR, 0), ("mixed", MIXED, 0)]
BASE = ("assign", "access", "hex")
#: Strings one of which each vendor token holds, and a run that each hex and mixed one is.
VENDOR_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "xox", "AIza")
LONG_RUN = r"[A-Za-z0-9+/_-]{24,}"
LEAST_ASSIGNED = 6
MAX_OWNERS = 3
#: Per cent of the repositories that hold a secret: an owner who has so many of them is the one it belongs to.
OWNED_PERCENT = 90


def _may_hold(text: Column, kind: str) -> Column:
    """False for texts without a match of the kind, by a test that costs less than its pattern."""
    if kind == "assign":
        return F.lit(True)
    if kind == "access":
        return text.contains("AKIA")
    if kind == "vendor":
        return functools.reduce(lambda a, b: a | b, (text.contains(m) for m in VENDOR_MARKS))
    return text.rlike(LONG_RUN)


def _matches(text: Column, order: int, kind: str, pattern: str, group: int) -> Column:
    """Each match as (order, kind, place in this kind, code points since the last match, its length, the secret).

    AKIA, hex and the wider kinds have their least length in the pattern: their class takes whole runs, so a run
    that is too short has no other match inside. An assignment that is too short is dropped later: it still uses up
    what it matched.
    """
    found = F.when(_may_hold(text, kind), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("hit"))
    one = lambda x, i: F.struct(
        F.lit(order).alias("order"), F.lit(kind).alias("kind"), i.alias("place"), F.length(x["piece"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"),
        (F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]).alias("secret"),
    )
    kept = F.filter(F.transform(parts, one), lambda x: x["len"].isNotNull())
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<order:int,kind:string,place:int,gap:bigint,len:bigint,secret:string>>"))


def scan(documents: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", max_owners: int = MAX_OWNERS, owned_percent: int = OWNED_PERCENT) -> DataFrame:
    """A row for each row of documents: doc_id, text_hash, and spans (kind, start, end, owners, repositories, live).

    spans is sorted by start and then kind, and empty where nothing is found. repositories are distinct texts that hold
    the secret. live tells that at most ``max_owners`` owners hold it, or one of them has ``owned_percent`` of its
    repositories. A null text is empty; a null
    owner is an owner of its own; a null id is kept. Copies of a text are one repository; each row gets its spans. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"), text.alias("text"))
    matches = F.concat(*[_matches(F.col("text"), i, *kind) for i, kind in enumerate(KINDS)])
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "owner", F.xxhash64("text").alias("text_hash"), matches.alias("matches")), "secret-matches")
    each = rows.filter(F.size("matches") > 0).select("uid", "owner", "text_hash", F.explode("matches").alias("m")).select("uid", "owner", "text_hash", "m.*")
    sofar = Window.partitionBy("uid", "kind").orderBy("place")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(sofar)).withColumn("start", F.col("end") - F.col("len"))
    secret = F.col("secret")
    fits = F.when(F.col("kind") == "assign", F.length(secret) >= LEAST_ASSIGNED).when(F.col("kind") == "mixed", secret.rlike("[0-9]") & secret.rlike("[A-Z]") & secret.rlike("[a-z]")).otherwise(True)
    each = materialise(each.filter(fits).select("uid", "owner", "text_hash", "order", "kind", "start", "end", F.sha2("secret", 256).alias("hash")), "secret-spans")
    held = each.select("hash", "owner", "text_hash").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("repositories").alias("most"))
    judged = each.join(held, "hash").withColumn("live", (F.col("owners") <= max_owners) | (F.col("most") * 100 >= F.col("repositories") * owned_percent))
    judged = judged.filter(F.col("kind").isin(*BASE) | F.col("live"))
    per_row = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return rows.drop("owner", "matches").join(per_row, "uid", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the checksum of their spans, all spans as a string, and live and copied counts."""
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return scanned.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_copied"),
    )


def _covered(text: Column, spans: Column) -> Column:
    """text with [SECRET] for each span, or for spans that overlap; an assignment in front leaves its name."""
    part = lambda start, n: F.substring(text, (start + 1).cast("int"), n.cast("int"))

    def put(done: Column, x: Column) -> Column:
        name = F.when(x["kind"] == "assign", F.concat(F.regexp_extract(part(x["start"], x["end"] - x["start"]), ASSIGN, 1), F.lit("="))).otherwise("")
        more = F.concat(done["out"], part(done["at"], x["start"] - done["at"]), name, F.lit("[SECRET]"))
        return F.struct(F.when(x["start"] >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, first, put, lambda done: F.concat(done["out"], part(done["at"], F.length(text) - done["at"])))


def mask_live(documents: DataFrame, **options) -> DataFrame:
    """documents with the secrets masked in every text that holds a live-looking one; other texts stay as they are.

    A secret that few owners hold looks live, however many documents repeat it. In a text with one of any kind all
    spans of the scan are masked at their places, and all base matches, copied ones too, so that nothing next to a live
    secret gives it away. The name of an assignment stays. n_chars, where there is such a column, is counted anew. Null
    and empty texts stay; repeated rows are masked alike; a row travels whole, so its columns may have any names.
    """
    flagged = scan(documents, **options).filter(F.exists("spans", lambda x: x["live"])).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]).alias("f")
    masked = F.regexp_replace(_covered(F.col("d.row.text"), F.col("f.spans")), ASSIGN.replace("]+)", f"]{{{LEAST_ASSIGNED},}})"), "$1=[SECRET]")
    masked = F.regexp_replace(F.regexp_replace(masked, ACCESS, "[SECRET]"), HEX, "[SECRET]")
    # most texts hold no candidate at all: they pass by, and only the others meet the flagged ones
    text = F.col("text")
    suspect = F.coalesce(text.rlike(LONG_RUN) | _may_hold(text, "access") | _may_hold(text, "vendor") | text.rlike(ASSIGN), F.lit(False))
    some = documents.filter(suspect).select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    hit = F.col("f.text_hash").isNotNull()
    joined = some.join(flagged.hint("merge"), same, "left").select(F.col("d.row").alias("row"), F.when(hit, masked).alias("masked"))

    def column(c: str) -> Column:
        own = F.col("row")[c]
        if c == "text":
            own = F.coalesce("masked", own)
        elif c == "n_chars":
            own = F.coalesce(F.length("masked").cast(documents.schema[c].dataType), own)
        return own.alias(c)

    return documents.filter(~suspect).unionByName(joined.select(*map(column, documents.columns)))
