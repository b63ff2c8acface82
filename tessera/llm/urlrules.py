"""URL filters (operator 12; DataFrame functions).

Rules are rows (verdict, host, path).  A rule fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's.  Each URL is expanded into expressions,
a suffix of its host and a prefix of its path; an expression is looked up by the first
eight hexadecimal digits of its SHA-256, and a hit is confirmed by the full digest.  Of the rules that
fit, the longest (host and path together) wins, of equally long ones that with the longer
host; `block` wins over `allow` for one host and path.

Only expressions of the shapes that rules have (number of labels, length of the path) are made, so
a URL gives as many rows as there are shapes at most, however long it is.  Beyond MOST_SHAPES shapes
every suffix and prefix is made instead; the result is the same.  Distinct URLs are
looked up once, so a URL that many rows share is one row until the last join, which Spark may split.
Rules are joined as a table: Spark broadcasts it if its size allows, and shuffles the expressions otherwise.

The host is what stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; the
path goes on up to `?`, `#` or the end.  A null URL, an empty one and one without `://` have an empty
host and path, no rule and the default verdict.  Rules without a host fit nothing, a null path is empty; A-Z in
their hosts is lower-cased.  Repeated rows give repeated rows; other columns are kept, those named
host, path, rule or verdict are replaced.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_SHAPES = 4096  #: rows of the table of shapes that may be collected; beyond it all expressions are made
SHORT = 8  #: hexadecimal digits of a digest that are joined on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as an inline table, of which Spark knows the size."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(urls: DataFrame, shapes: list[tuple[int, int]] | None) -> DataFrame:
    """urls (url, host, path) -> (url, short, digest), a row for each expression of the shapes (None: all)."""
    cut = "concat(substring_index(host, '.', -s.labels), substring(path, 1, s.length))"
    if shapes is None:
        made = "transform(sequence(1, size(split(host, '[.]'))), l -> substring_index(host, '.', -l))"
        made = f"flatten(transform({made}, h -> transform(sequence(0, length(path)), n -> concat(h, substring(path, 1, n)))))"
    else:
        listed = ", ".join(f"named_struct('labels', {a}, 'length', {b})" for a, b in shapes)
        made = f"transform(filter(array({listed}), s -> s.labels <= size(split(host, '[.]')) AND s.length <= length(path)), s -> {cut})" if shapes else "array()"
    rows = urls.where("host != ''").select("url", F.explode(F.expr(made).cast("array<string>")).alias("expression"))
    digest = rows.select("url", F.sha2("expression", 256).alias("digest"))
    return digest.select("url", F.substring("digest", 1, SHORT).alias("short"), "digest")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (host and path of the winning rule, null without one) and verdict (the rule's, else `default`)."""
    host = F.translate("host", UPPER, LOWER)
    rules = rules.where("host != ''").select("verdict", host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    shapes = rules.select(F.size(F.split("rule_host", "[.]")).alias("labels"), F.length("rule_path").alias("length")).distinct().limit(MOST_SHAPES + 1).collect()
    text = F.concat("rule_host", "rule_path")
    digests = rules.select(F.sha2(text, 256).alias("rule_digest"), F.struct(F.length(text).alias("size"), F.length("rule_host").alias("host_size"), text.alias("rule"), "verdict").alias("found"))
    digests = digests.select(F.substring("rule_digest", 1, SHORT).alias("short"), "rule_digest", "found")

    key = F.col(url)
    own_host, own_path = host_and_path(key)
    urls = df.select(key.alias("url")).distinct().select("url", own_host.alias("host"), own_path.alias("path"))
    made = expressions(urls, None if len(shapes) > MOST_SHAPES else [tuple(r) for r in sorted(shapes)])
    hits = made.join(digests, "short").where("digest = rule_digest")
    best = hits.groupBy("url").agg(F.max("found").alias("found"))

    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), key.alias("url"), own_host.alias("host"), own_path.alias("path"))
    joined = rows.join(best, "url", "left")
    return joined.select("row.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
