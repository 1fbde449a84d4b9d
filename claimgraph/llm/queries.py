"""The queries of this subpackage over the given tables, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm import ann, collocations, fim, jaccard, langid, mixing, packing, pivots, quality, secrets, sharding, token_counts, url_filter

URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]
#: Hosts that farm links or sell, and paths of programs and archives, for urls that no rule covers.
URL_BLOCKED = ["spam*", "spam*/**", "*.spam*", "*.spam*/**", "*cheap-*", "*cheap-*/**", "*casino*", "*casino*/**", "**/cgi-bin/**", "**.exe", "**.zip"]
SHARDS = 24
SOURCE_WEIGHTS = [1, 2, 3]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKED)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    languages, prototypes = langid.learn(documents.filter(_remainder(5) != 0))
    found = langid.identify(documents, languages, prototypes)
    return found.withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learns_from=_remainder(4) != 2)
    return found.withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=SOURCE_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(fim.store(_table(spark, sf_dir, "documents")), "fim-frames")
    return fim.digest(fim.rearrange(stored, seed=42))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


def _url_rule_sql() -> str:
    """A CASE over the rules, longest first: the host equals or ends with the rule's, the path begins with it."""
    out = []
    for rule in sorted(URL_RULES, key=lambda r: -len(r.text)):
        host, slash, path = rule.text.partition("/")
        out.append(f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}') THEN '{rule.text}'")
    return "CASE " + " ".join(out) + " END"


def _secrets_sql() -> str:
    by_kind = " UNION ALL ".join(
        "SELECT uid, owner, {i} AS ord, '{k}' AS kind, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS hits, {s} AS secrets FROM d".format(
            i=i, k=k, p=(p := "'" + pattern.replace("'", "''") + "'"), s=f"regexp_extract_all(t, {p}, {group})"
        )
        for i, (k, pattern, group) in enumerate(secrets.KINDS)
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS t FROM documents),
        k AS ({by_kind}),
        e AS (SELECT uid, owner, ord, kind, u.i, length(pieces[u.i]) AS gap, length(hits[u.i]) AS len, secrets[u.i] AS secret
            FROM k, unnest(range(1, len(hits) + 1)) AS u(i) WHERE len(hits) > 0),
        p AS (SELECT *, sum(gap + len) OVER (PARTITION BY uid, kind ORDER BY i) AS stop FROM e),
        f AS (SELECT uid, owner, ord, kind, stop - len AS start, stop, secret FROM p
            WHERE CASE kind WHEN 'assign' THEN length(secret) >= {secrets.LEAST_ASSIGNED}
                WHEN 'mixed' THEN regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[a-z]') ELSE true END),
        r AS (SELECT secret, owner, count(DISTINCT t) AS repositories FROM f JOIN d USING (uid, owner) GROUP BY ALL),
        h AS (SELECT secret, count(*) AS owners, max(repositories) AS most, sum(repositories) AS repositories FROM r GROUP BY secret),
        j AS (SELECT f.*, owners <= {secrets.MAX_OWNERS} OR most * 100 >= repositories * {secrets.OWNED_PERCENT} AS live FROM f JOIN h USING (secret)),
        g AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
            count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j WHERE ord < 3 OR live GROUP BY uid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM d LEFT JOIN g USING (uid)"""


FIM_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s FROM documents),
    h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
        ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
    c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p"""
PHRASES_SQL = rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER_LETTERS}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    said AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM words, range(1, 5) AS ks(k), unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
    counts AS (SELECT lang, k, phrase, count(*) AS f FROM said GROUP BY ALL HAVING count(*) >= 30),
    candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
    cuts AS (SELECT lang, phrase, a, c, array_to_string(w[:c], ' ') AS part1, array_to_string(w[c + 1:], ' ') AS part2 FROM candidates, unnest(range(1, k)) AS u(c)),
    scored AS (SELECT t.lang, t.phrase, t.a, x.f AS l, y.f AS r, (2000000::HUGEINT * t.a // (x.f + y.f))::BIGINT AS score, c FROM cuts t
        JOIN counts x ON x.lang = t.lang AND x.phrase = part1 JOIN counts y ON y.lang = t.lang AND y.phrase = part2),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    parts AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM candidates, unnest(range(2, k)) AS ms(m), unnest(range(1, k - m + 2)) AS u(i) WHERE k > 2),
    held AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
ORACLE = {
    "op11_fill_in_middle": FIM_SQL,
    "op13_collocations": PHRASES_SQL,
    "op6_secret_scan": _secrets_sql(),
    "op1_url_filter": f"""
        WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT page_id,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER_LETTERS}'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
        ruled AS (SELECT *, {_url_rule_sql()} AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN starts_with(host, 'spam') OR regexp_matches(host, '\\.spam|cheap-|casino')
                OR regexp_matches(host || path, '/cgi-bin/|\\.exe$|\\.zip$') THEN 'block'
            ELSE 'allow' END AS verdict FROM ruled""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_language_id, op3_best_fit_packing, op4_source_mixing, op5_quality, op6_secret_scan, op7_jaccard_join, op8_cross_polytope, op9_pivot_dedup, op10_sharding, op11_fill_in_middle, op12_token_counts, op13_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
