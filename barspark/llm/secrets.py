"""Secret scanning over an incremental ledger of blobs, with DataFrame functions only.

A ledger is a folder in shared storage. Every version of a text is addressed by the SHA-256 of its bytes; the
ledger remembers which (blob, rule version) pairs have been scanned and what was found. A scan touches only pairs
that it has not seen, whatever the number of documents that hold the blob, and findings are joined back to all of
them. The version of a rule set is a digest of its rules, so changed rules are scanned anew over all blobs; adding documents
costs only their new blobs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barspark.llm.storage import documents, new_path, saved

#: The base rules. A match counts if its checked part has at least the given number of characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping, whose group (0: all of it) has least characters or more.

    hint is a pattern that any text with a counted match must contain; it only saves time.
    """

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 1, 8),
    Rule("access", ACCESS, r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", HEX, r"[0-9a-f]{32}", 0, 32),
    # Added by the method's own rule set, beyond the base: headers of private keys.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of all that the rules say, so that rules which change in anything are scanned anew."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of a rule's matches, in code points, end exclusive.

    The pieces between matches and the matches alternate, so a running sum of their lengths gives the places. Only
    texts with the rule's hint are split.
    """
    # A match of [0-9a-f]+ that is long enough is a whole run, so the pattern may ask for the length itself.
    pattern = rf"[0-9a-f]{{{rule.least},}}" if rule.pattern == HEX else rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, pattern, -1)
    joined = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
        part,
        lambda x, p: F.struct(x["b"].alias("b"), x["m"].alias("m"), (F.length(p) >= rule.least).alias("ok")),
    )
    span = "struct<start:int,kind:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["b"]
        end = begin + x["m"]
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    none = F.array().cast(f"array<{span}>")
    return F.when(text.rlike(rule.hint), F.aggregate(joined, start, step, lambda s: s["spans"])).otherwise(none)


def _seen(spark: SparkSession, ledger: str, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, version columns of versions with blob and spans: array of (start, kind, end), sorted.

    versions has id columns and content. New pairs of blob and rule version are scanned and appended to the ledger;
    a blob without findings is remembered too. A null content is an empty one. Identical versions under other ids are
    scanned once, and the ledger has one row a blob and rule version. kind is the number of the rule. Equal rows stay as many rows
    as they are. An empty table scans nothing; texts of any length are scanned whole.
    """
    spark, version = versions.sparkSession, version_of(rules)
    ids = [c for c in versions.columns if c != "content"]
    text = F.coalesce(F.col("content"), F.lit(""))
    addressed = versions.withColumn("blob", F.sha2(F.encode(text, "UTF-8"), 256))
    # Narrow: which version has which blob. Copies meet in a partial minimum, so a blob that a third of all versions
    # share moves as one row a task.
    held = saved(addressed.select(*ids, "blob"), "ledger-held")
    first = held.groupBy("blob").agg(F.min(F.struct(*ids)).alias("_first"))
    schema = "blob string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"
    known = _seen(spark, ledger, "scans", schema).where(F.col("rule_version") == version)
    unseen = first.join(known.select("blob"), "blob", "left_anti").select("blob", F.struct("blob", "_first").alias("_k"))
    unseen = unseen.select(F.col("_k.blob").alias("blob"), *(F.col(f"_k._first.{c}").alias(c) for c in ids))
    # One version of each unseen blob carries the text to its scan. Its ids and its blob are the key: a path brings only its new versions, and
    # null ids, or copies of one blob, don't meet in one task. Few unseen blobs are broadcast, and then no text moves.
    same = [F.col("a.blob") == F.col("u.blob"), *(F.col(f"a.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ids)]
    todo = addressed.select(*ids, "blob", text.alias("_text")).alias("a").join(unseen.alias("u"), same, "left_semi")
    found = F.array_sort(F.concat(*(spans_of(F.col("_text"), r, k) for k, r in enumerate(rules))))
    # Rows that repeat in ids and content are alike and have equal findings, of which the ledger keeps one.
    scanned = todo.select("blob", found.alias("spans")).groupBy("blob").agg(F.max("spans").alias("spans"))
    scanned.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(f"{ledger}/scans")
    everything = _seen(spark, ledger, "scans", schema).where(F.col("rule_version") == version)
    hits = everything.where(F.size("spans") > 0).groupBy("blob").agg(F.max("spans").alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return held.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no findings; its base_sha256 is that of the empty string. An empty table gives an empty result. Other
    columns are ignored.
    """
    kinds = [r.kind for r in rules]
    found = scan(docs.select("doc_id", F.col("text").alias("content")), ledger, rules)
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kinds[k]}") for k in base),
        F.sha2(F.encode(written(F.filter("spans", lambda s: s["kind"].isin(base)), kinds), "UTF-8"), 256).alias("base_sha256"),
        written(F.col("spans"), kinds).alias("spans"),
        F.col("blob"),
    )


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_report() of all documents, on a ledger of this run: a query gives what the tables hold now, whatever ran before."""
    return secret_report(documents(spark, sf_dir), new_path(spark, "ledger"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each union of overlapping spans replaced by mark. spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with every secret replaced by a mark; n_chars follows. All rows stay, repeated ones too; null texts stay null.

    All other columns stay as they are, whatever their names; an empty table stays empty.
    """
    found = scan(docs.select("doc_id", F.col("text").alias("content")), new_path(spark, "ledger"))
    hits = found.where(F.size("spans") > 0).groupBy("doc_id", "blob").agg(F.max("spans").alias("spans")).alias("h")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(whole.alias("doc"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("address")).alias("d")
    # By doc_id as well as blob: copies of one text don't meet in one task.
    same = F.col("d.doc.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.address") == F.col("h.blob"))
    spans = F.coalesce("h.spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    marked = keyed.join(hits, same, "left").select("d.doc", spans.alias("spans"), redacted(F.col("d.doc.text"), spans).alias("clean"))
    length = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("doc.n_chars"))
    new = {"text": F.col("clean").alias("text"), "n_chars": length.alias("n_chars")}
    return marked.select(*(new.get(c, F.col(f"doc.`{c}`").alias(c)) for c in docs.columns))
