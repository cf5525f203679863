"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. A
blob is scanned once for each rule version: the ledger keeps, for each digest,
the rule versions it has been scanned with and the spans that each version found,
so that a run scans only unseen (blob, rule version) pairs and joins the spans of
its own rule versions back to all paths that hold the blob. A changed rule is a new
version: what its old one found stays in the ledger and out of the results.

Defined cases: a null text counts as empty; rows with null or repeated paths
each get their own result; an empty table gives no rows; further columns of the
input are given back as they are by ``redact``, whatever their names, and ignored
by ``secret_report``; a ledger folder without finished files is an empty ledger.
Spans are in code points, end exclusive, in order of start, then of their rule's rank,
then of its kind, in whatever order the rules are given. A text's spans are gathered in one row, whose size
follows that one text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_folder, materialize

SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"
HIT = "struct<version:string,start:bigint,stop:bigint>"
LEDGER = f"digest string, scanned array<string>, spans array<{HIT}>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: Where spans with one start stand among those of other rules; no part of the version.
    rank: int = 100

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


#: The contract's base rules. Where a match is one whole run of a character class, the
#: least length stands in the pattern: the same matches, and most of a text is passed over.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, rank=0),
    Rule("access", r"AKIA[A-Z0-9]{14,}", rank=1),
    Rule("hex", r"[0-9a-f]{16,}", rank=2),
)
#: A private key, however long: from BEGIN to the END line if no other such line lies between; without it, header lines and
#: lines of base64. All loops are possessive, so a text is passed once and matching needs no stack.
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])*+[A-Z][A-Za-z-]{2,20}+:\x20[^\r\n\\]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{20,}+)*+"
    r"(?:(?:\s|\\[rn])++[A-Za-z0-9+/=]++[\x20\t]*+(?![^\r\n\\\"']))?+)"
)
#: What the scan adds to them.
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", rank=3),
    Rule("pem", _PEM, rank=4),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", rank=5),
)
RULES = BASE_RULES + MORE_RULES


def _spans(text: Column, rule: Rule) -> Column:
    """Array of HIT: lengths of the pieces between matches and of the matches add up to places."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    tested = hits if not rule.group else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{HIT}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(F.lit(rule.version).alias("version"), begin.alias("start"), end.alias("stop"))
        return F.struct(
            end.alias("at"),
            F.when(x["tested"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    pieces = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), tested.alias("tested"))
    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_into_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan the unseen (blob, rule version) pairs of versions and append one ledger row for each blob scanned.

    Returns the ledger: digest, scanned (rule versions), spans (rule version, start,
    stop). An append is one Parquet commit, so a run that dies leaves the ledger as it
    was. Where two runs scan a blob at once, its rows agree and readers drop the repeats.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one row a task and blob reaches the shuffle, so a text with very many copies doesn't pile up
    blobs = versions.select(F.sha2(text, 256).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if _exists(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(seen, "digest", "left")
        due = lambda rule: ~F.coalesce(F.array_contains("seen", rule.version), F.lit(False))
        todo = F.filter(F.array(*[F.lit(r.version) for r in rules]), lambda v: ~F.coalesce(F.array_contains("seen", v), F.lit(False)))
    else:
        due = lambda rule: F.lit(True)
        todo = F.array(*[F.lit(r.version) for r in rules])
    none = F.array().cast(f"array<{HIT}>")
    found = [F.when(due(r) & F.col("text").rlike(r.pattern), _spans(F.col("text"), r)).otherwise(none) for r in rules]
    scanned = blobs.select("digest", todo.alias("scanned"), F.concat(*found).alias("spans")).where(F.size("scanned") > 0)
    scanned.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def _found(rows: DataFrame, text: Column, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with the column found, an array of SPAN."""
    ledger_rows = scan_into_ledger(rows.select(text.alias("text")), ledger, rules).where(F.size("spans") > 0)
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    ranks = F.create_map(*[x for r in rules for x in (F.lit(r.version), F.lit(r.rank))])
    mine = F.filter(F.flatten(F.collect_list("spans")), lambda s: s["version"].isin([r.version for r in rules]))
    named = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), ranks[s["version"]].alias("rank"), kinds[s["version"]].alias("kind"), s["stop"].alias("stop")))
    # a blob has one row a run that scanned it with new rules: its few spans meet here
    found = ledger_rows.groupBy("digest").agg(F.array_sort(F.array_distinct(named)).alias("found"))
    # written first: the join then has nothing above its inputs that needs a digest's rows together, and can split a hot one
    found = materialize(found, "findings").hint("merge")
    keyed = rows.withColumn("own_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    joined = keyed.join(found, F.col("own_digest") == F.col("digest"), "left").drop("own_digest", "digest")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions with the column spans (array of SPAN; one of that name is replaced) from the ledger, for these rule versions."""
    rows = versions.select(F.struct("*").alias("row"))
    found = _found(rows, F.col("row")[text_col], ledger, rules)
    return found.select(*[F.col("row")[c].alias(c) for c in versions.columns if c != "spans"], F.col("found").alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of documents."""
    versions = documents.select("doc_id", "text")
    found = findings(versions, ledger or fresh_folder(documents.sparkSession, "secrets"), rules).select("doc_id", "spans")
    count = lambda rule: F.size(F.filter("spans", lambda s: s["rank"] == rule.rank)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(r).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans")
    )


def redact(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[REDACTED]") -> DataFrame:
    """documents with each span (overlapping ones as one) replaced by mask; n_chars follows the new text. Other rows stay as they are."""
    rows = documents.select(F.struct("*").alias("row"))
    found = _found(rows, F.col("row.text"), ledger or fresh_folder(documents.sparkSession, "secrets"), rules)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))
    out = found.withColumn("masked", F.when(F.size("found") > 0, F.aggregate("found", start, step, rest)))
    new = {"text": F.coalesce("masked", text)}
    if "n_chars" in documents.columns:
        n_chars = F.col("row.n_chars")
        new["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked").cast(documents.schema["n_chars"].dataType)).otherwise(n_chars)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
