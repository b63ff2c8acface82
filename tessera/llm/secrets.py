"""Secret scans over an incremental ledger of blobs (operator 2; DataFrame functions only).

Every version of every text is addressed by its content (SHA-256).  The ledger, a Parquet
table, has a row for each (blob, rule, rule version) that was ever scanned, with its
findings.  A scan keeps one copy of each blob, drops the pairs that the ledger has, runs the
remaining rules, appends to the ledger, and joins the findings back to all paths.

Null texts are empty blobs.  Rows with equal contents share one scan, whatever their ids;
null and repeated ids are kept, each row gives a row.  A match that a rule drops for its
length still consumes its text.  Columns beside the id and the text are not read.
"""

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .columns import let, running_sums, written


class Rule(NamedTuple):
    kind: str
    pattern: str  #: for Java's regular expressions
    least: int  #: characters that the group must have
    group: int = 0
    version: int = 1


#: The rules of the contract (fixed values).  In the second and third, matches that are too
#: short are left out by the pattern: one cannot hide a longer match that overlaps it.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
PEM = Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, version=2)  #: no repeated group: Java recurses for each repetition

SPAN = "struct<start:bigint,end:bigint>"


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end>> in code points.

    The matches and the pieces between them alternate; positions are running sums of their lengths.
    """

    def number(pair: Column) -> Column:
        kept = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
        pieces = F.transform(pair["found"], lambda m, i: F.struct(F.length(pair["between"][i]).alias("gap"), F.length(m).alias("size"), kept(m).alias("kept")))
        return let(pieces, lambda p: let(running_sums(F.transform(p, lambda x: x["gap"] + x["size"])), lambda ends: placed(p, ends)))

    def placed(pieces: Column, ends: Column) -> Column:
        spans_ = F.transform(pieces, lambda x, i: F.struct((ends[i] + x["gap"]).alias("start"), ends[i + 1].alias("end"), x["kept"].alias("kept")))
        return F.transform(F.filter(spans_, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    found = F.struct(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("found"), F.split(text, rule.pattern, -1).alias("between"))
    return F.when(text.rlike(rule.pattern), let(found, number)).otherwise(F.array().cast(f"array<{SPAN}>"))


LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def scan(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = (*BASE, PEM), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger up to date with df; then df's keys, `blob`, and `findings`: array of
    struct<start, order (of the rule), kind, end>, sorted."""
    spark = df.sparkSession
    blobs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    asked = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules)))
    pending = blobs.groupBy("blob").agg(F.min("key").alias("key")).select("blob", "key", asked.alias("ask")).select("blob", "key", "ask.rule", "ask.version")
    known = _ledger(spark, ledger)
    if known is not None:
        pending = pending.join(known.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    pending = pending.groupBy("blob", "key").agg(F.collect_set("rule").alias("rules")).select(F.col("blob").alias("own"), F.col("key").alias("first"), "rules")
    unseen = blobs.join(pending.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("own")))
    results = F.filter(
        F.array(*(F.when(F.array_contains("rules", r.kind), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules)),
        lambda x: x.isNotNull(),
    )
    scanned = unseen.select("blob", F.explode(results).alias("r")).select("blob", "r.rule", "r.version", "r.spans")
    scanned.write.mode("append").parquet(ledger)

    order = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("rule"))
    current = F.struct("rule", "version").isin(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    hits = spark.read.schema(LEDGER).parquet(ledger).where(current & (F.size("spans") > 0)).dropDuplicates(["blob", "rule", "version"])
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("order"), F.col("rule").alias("kind"), s["end"].alias("end")))
    found = written(hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(listed))).alias("findings")), "findings")  # a plain table: a join with it can be split at a blob that many rows have
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    paths = blobs.select("key", "blob").join(found, "blob", "left")
    return paths.select(F.col("key").alias(key), "blob", F.coalesce("findings", none).alias("findings"))


def written_out(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
