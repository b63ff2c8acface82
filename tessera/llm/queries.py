"""The numbered queries: each applies its operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, classlm, crosstoken, jaccard, linededup, mixing, periodic, quality, rpforest, secrets, tokenfile, urlrules, warc
from .columns import let, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both_ways = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded="decoded")
    return both_ways.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), shared_dir(spark, "blob-ledger"))
    of = lambda *kinds: F.filter("findings", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    base = secrets.written_out(of(*(r.kind for r in secrets.BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.written_out(F.col("findings")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.withColumn("captured", F.timestamp_seconds(1577836800 + F.coalesce("page_id", F.lit(0))))  # the table has no times: one second a page
    folder = shared_dir(spark, "warc")
    return warc.replay(warc.merge_index(warc.write(pages, folder), folder), folder).drop("stamp")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rpforest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key", "text")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) % 10 = 0, the words from a on repeat with period p (see the contract of the query)."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10).cast("long")

    def turned(words):
        """The words once, then a and p: otherwise each element would cut the text again."""
        drawn = F.struct(words.alias("w"), (g % F.size(words)).alias("a"))
        sized = let(drawn, lambda d: F.struct(d["w"].alias("w"), d["a"].alias("a"), (1 + F.floor((F.size(d["w"]) - d["a"]) / (3 + g % 8))).alias("p")))
        return let(sized, lambda d: F.array_join(F.transform(d["w"], lambda w, i: F.when(i < d["a"], w).otherwise(F.get(d["w"], (d["a"] + (i - d["a"]) % d["p"]).cast("int")))), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when((crc % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words, turned)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"),
        F.expr("1000 * r.length div -r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlrules.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_secret_ledger, op3_token_files, op4_class_lm, op5_line_dedup, op6_rp_forest, op7_poisson_mixing, op8_ngram_jaccard_join, op9_warc_histories, op10_quality_rules, op11_periodic_runs, op12_url_filters, op13_token_alignment)}
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    """A rule's spans as a list of structs, in the order of the text."""
    pattern = rule.pattern.replace("'", "''")
    kept = f"length(regexp_extract(found[i], '{pattern}', {rule.group})) >= {rule.least}"
    begin = "CAST(coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0) AS BIGINT)"
    return f"""{rule.kind} AS (SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, b AS s, b + length(m) AS e FROM (
  SELECT doc_id, found[i] AS m, {begin} AS b FROM (SELECT doc_id, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS found, string_split_regex(coalesce(text, ''), '{pattern}') AS pieces FROM documents)) WHERE {kept}))"""


_RULES = (*secrets.BASE, secrets.PEM)
_SECRETS = "WITH " + ",\n".join(_spans_sql(r, k) for k, r in enumerate(_RULES)) + """,
spans AS (""" + " UNION ALL ".join(f"FROM {r.kind}" for r in _RULES) + """),
docs AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (kind <> 'pem') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN docs USING (doc_id)"""

_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

ORACLE_SQL: dict[str, str] = {
    "op2_secret_ledger": _SECRETS,
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id""",
    "op9_warc_histories": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]', '', 'g')) AS u FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, array_to_string(list_reverse(string_split(regexp_extract(u, '{_HOST}', 1), '.')), ',') || ')' || regexp_replace(u, '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*|#.*$', '', 'g') AS url_key FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to,
url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture FROM r""",
    "op12_url_filters": f"""WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, map(tuple, urlrules.RULES)))}),
p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
b AS (SELECT q.page_id, q.host, q.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS v
  FROM q LEFT JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b""",
    "op7_poisson_mixing": """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size ELSE 0 END AS rate FROM sizes),
terms AS (
  SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS j FROM rates),
logs AS (
  SELECT source, j, -rate + sum(CASE WHEN j = 0 OR rate = 0 THEN 0 ELSE ln(rate / j) END) OVER (PARTITION BY source ORDER BY j) AS log_p, rate FROM terms),
thresholds AS (
  SELECT source, j, sum(CASE WHEN rate = 0 THEN CASE WHEN j = 0 THEN 1 ELSE 0 END ELSE exp(log_p) END) OVER (PARTITION BY source ORDER BY j) AS cdf FROM logs),
hashed AS (
  SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS id FROM documents),
placed AS (SELECT *, CAST('0x' || substr(md5('0|' || id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM hashed),
counted AS (
  SELECT p.doc_id, p.source, p.text, p.id, p.u, list(t.cdf) AS cdfs FROM placed p JOIN thresholds t ON p.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
copies AS (SELECT doc_id, source, text, id, len(list_filter(cdfs, lambda c: c <= u)) AS n_copies FROM counted),
exploded AS (SELECT doc_id, source, text, id, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM copies)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, md5('0|' || id || '|' || CAST(copy AS VARCHAR)) AS shuffle_key, text FROM exploded
""",
}
