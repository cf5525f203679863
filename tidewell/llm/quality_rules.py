"""Quality rules as a bitmask ledger, with DataFrame functions only.

Each rule is evaluated once a document: the ledger row holds the measurements
and one bit for each rule that failed. Policies are versioned masks over those
bits, and ablations (what each rule rejects alone, what dropping it would let
through) are bitwise aggregations over the ledger; neither reads a text again.

Defined cases: a null text has no words; an empty table gives no rows; repeated
rows and ties each get their own, equal result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, let

WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more; words is bound (see let)."""

    def of_windows(wins: Column) -> Column:
        # windows in hash order, each beside its equals; then their places in text order
        ordered = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            places = F.sort_array(F.transform(hit, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
            step = lambda acc, i: F.struct(
                (acc["n"] + (i + WINDOW) - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")
            )
            return F.aggregate(places, zero, step, lambda acc: acc["n"])

        some = F.size(F.array_distinct(wins)) < F.size(wins)
        return F.when(some, let(ordered, repeated)).otherwise(F.lit(0).cast("bigint"))

    window = lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), window)
    return F.when(F.size(words) > WINDOW, let(windows, of_windows)).otherwise(F.lit(0).cast("bigint"))


def measurements(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    by_word = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("chars"),
            _repeat_words(w).alias("repeat"),
        ),
    )
    n_symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l"), n_symbols.alias("s")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"), m["w"]["chars"].alias("word_chars"), m["s"].alias("n_symbols"),
            m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeat"].alias("n_repeat_words"),
        ),
    )


#: name -> does it fail; the bit is the place in this list, which only grows.
RULES = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: F.col("n_symbols") * 2 > F.col("n_words") * 3,
    "repeated_lines": lambda: (F.col("n_dup_lines") * 2 > F.col("n_lines")) & (F.col("n_lines") >= 4),
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 40,
}
#: version -> rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
}
BASE = "base"
CURRENT = "v1"


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def rule_ledger(documents: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements, and failed: one bit for each rule that the document fails."""
    measured = documents.select(F.col(key), measurements(F.col(text_col)).alias("_m")).select(key, "_m.*")
    bits = None
    for i, fails in enumerate(RULES.values()):
        bit = F.when(fails(), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("failed", bits)


def apply_policy(ledger: DataFrame, policy: str = CURRENT, column: str = "kept") -> DataFrame:
    return ledger.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents it fails, documents it alone fails, and documents all other rules pass.

    One pass over the ledger; what is shuffled is one row a task.
    """
    mask = mask_of(policy)
    failed = F.col("failed").bitwiseAND(F.lit(mask))
    names = list(RULES)
    sums = []
    for name in POLICIES[policy]:
        bit = F.lit(1 << names.index(name))
        fails = failed.bitwiseAND(bit) != 0
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.count(F.when(fails, 1)).alias("n_failed"),
                F.count(F.when(failed == bit, 1)).alias("n_failed_alone"),
                F.count(F.when(failed.bitwiseAND(F.bitwise_not(bit)) == 0, 1)).alias("n_kept_without"),
            )
        )
    return ledger.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def quality_report(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, the measurements, failed, base_failed, kept."""
    ledger = apply_policy(apply_policy(rule_ledger(documents), BASE, "_base"), policy, "_kept")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").cast("bigint").alias("failed"),
        (~F.col("_base")).alias("base_failed"), (F.col("_base") & F.col("_kept")).alias("kept"),
    )
