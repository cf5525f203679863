"""Linkage of results to notices, end to end: blocks, candidates, scores, decisions, merged rows.

Rows have id, title, number, purchaser, package, published (date), source_file.
Every pair that the recall rule accepts is found. It agrees in number or file, or its titles
are near. Which titles are near is told on distinct titles of neighbouring date buckets that share rare
characters (see similar, which loses no pair); which purchasers are, by equal short names and prefixes. So a
pair of rows meets by an equi-join on near title (with near purchaser, or package), number or file,
and on dates.

A key that very many rows share gives very many pairs, of which only the best count. With ``top``,
a notice goes out to a result only while fewer than ``top`` later ones of its class do: in
a class all that scores depend on is equal or better but the date, and a later date is never worse.

Steps are written between, so that no plan holds more than a few joins, and what grows with the rows is joined
by sorting (the hint merge; met, where it may be few rows), not sent to all tasks by way of the driver: its
memory goes by the plan that it has at a time, not by rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text, values
from tidewell.operators import links, ranking
from tidewell.sources.shared import met, written

FIELDS = ("id", "title", "number", "purchaser", "package", "published", "source_file")
#: Below it no branch of the recall rule looks at titles.
NEAR = 0.30
#: Days of the buckets for notices that go out for a short time.
SHORT = 8


def _prepared(df: DataFrame, prefix: str) -> DataFrame:
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "published" else F.to_date("published").alias(c) for c in FIELDS])
    rows = rows.withColumns({c: text.nfkc(F.col(c)) for c in ("title", "number", "purchaser", "package")})
    # a title names the package where its field is empty
    package = text.package_number(F.coalesce(F.nullif("package", F.lit("")), "title")).cast("string")
    rows = rows.withColumn("package", F.coalesce(package, F.lit("")))
    title, number, buyer = text.project_key(F.col("title")), text.number_key(F.col("number")), text.company_short(F.col("purchaser"))
    buyer = F.when(buyer == "", text.company_key(F.col("purchaser"))).otherwise(buyer)  # nothing but a legal form
    rows = rows.withColumns({"key_title": title, "key_number": number, "key_buyer": buyer})
    return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns])


def _rarest_first(titles: DataFrame) -> Column:
    """Function of a title: its characters as numbers, rarest first; a character that comes again is another number.

    titles (title): all there are. Their characters are counted, which are no more than Unicode has.
    """
    counts = titles.select(F.explode(F.array_distinct(F.split("title", ""))).alias("c")).groupBy("c").count().orderBy("count", "c").collect()
    rank = {r["c"]: i for i, r in enumerate(counts)}

    def numbers(s: pd.Series) -> pd.Series:
        out = []
        for title in s:
            seen: Counter = Counter()
            places = []
            for c in title:
                places.append(rank[c] << 20 | seen[c])
                seen[c] += 1
            out.append(sorted(places))
        return pd.Series(out)

    return F.pandas_udf(numbers, "array<long>")


def similar(left: DataFrame, right: DataFrame, keys: list[str], least: float | Column) -> DataFrame:
    """a, b: distinct titles of left and right (title, keys: each row once) that agree in keys and may have a similarity of ``least`` or more.

    ``least`` is a number or made of the keys.

    Titles whose ratio is at least ``least`` share least / 2 of the characters of both, so they share one
    of the rarest of each: all but so many that the others are too few. A pair comes from the rarest
    character that both begin with, if what they share, counted as a bound of the ratio, is enough.
    Titles of which one holds the other count as similar whatever their lengths; such a pair comes
    from the shorter one's rarest character.
    """
    # at least this share of a title's own characters is in common, as the other one holds them too
    least = F.lit(least)
    own = least / (2 - least)
    first = lambda c: F.slice(c, 1, (F.size(c) - F.ceil(own * F.size(c) - 1e-9) + 1).cast("int"))
    a, b = (df.select(F.col("title").alias(x), F.col("t").alias(f"t{x}"), *keys) for df, x in ((left, "a"), (right, "b")))
    one = a.withColumn("pa", first(F.col("ta"))).withColumn("c", F.explode("pa")).join(b.withColumn("pb", first(F.col("tb"))).withColumn("c", F.explode("pb")).hint("merge"), [*keys, "c"])
    both = F.size("ta") + F.size("tb")
    enough = 2 * F.size(F.array_intersect("ta", "tb")) >= least * both - 1e-9
    # the first that both begin with, so that a pair comes once for the same keys
    told = one.where(2 * F.least(F.size("ta"), F.size("tb")) >= least * both - 1e-9).where((F.element_at(F.array_intersect("pa", "pb"), 1) == F.col("c")) & enough)
    short = lambda x, y: 2 * F.size(x) < least * (F.size(x) + F.size(y)) + 1e-9
    inner = a.withColumn("c", F.element_at("ta", 1)).join(b.withColumn("c", F.explode("tb")).hint("merge"), [*keys, "c"]).where(short("ta", "tb") & F.contains("b", F.col("a")))
    outer = b.withColumn("c", F.element_at("tb", 1)).join(a.withColumn("c", F.explode("ta")).hint("merge"), [*keys, "c"]).where(short("tb", "ta") & F.contains("a", F.col("b")))
    return functools.reduce(DataFrame.unionByName, [x.select("a", "b") for x in (told, inner, outer)])


def near_titles(left: DataFrame, right: DataFrame, buyers: DataFrame, days: int) -> DataFrame:
    """r_key_title, n_key_title, title: distinct titles that are near enough for a branch of the recall rule.

    0.45 within neighbouring date buckets; 0.32 there if purchasers are near, NEAR there if packages are
    equal; 0.9 whatever the dates, where one is missing.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    a = left.where("r_key_title <> ''").select(F.col("r_key_title").alias("title"), F.col("r_key_buyer").alias("buyer"), F.col("r_package").alias("package"), F.explode(F.array(bucket("r_published"), bucket("r_published") - 1)).alias("bucket"))
    b = right.where("n_key_title <> ''").select(F.col("n_key_title").alias("title"), F.col("n_key_buyer").alias("buyer"), F.col("n_package").alias("package"), bucket("n_published").alias("bucket"))
    a, b = (written(df.distinct(), "titles") for df in (a, b))
    every = written(a.select("title").union(b.select("title")).distinct(), "titles")
    numbered = written(every.withColumn("t", _rarest_first(every)("title")), "titles")
    dated_a, dated_b = a.where("bucket IS NOT NULL"), b.where("bucket IS NOT NULL")
    bought = dated_a.join(met(buyers), F.col("buyer") == F.col("r_key_buyer")).select("title", "bucket", F.col("n_key_buyer").alias("buyer"))
    packaged_a, packaged_b = dated_a.where("package <> ''"), dated_b.where("package <> ''")
    branches = {  # kind: left, right, what both agree in, similarity
        "t": (dated_a, dated_b, ["bucket"], 0.45), "p": (bought, dated_b, ["bucket", "buyer"], 0.32), "k": (packaged_a, packaged_b, ["bucket", "package"], NEAR),
        "r": (a.where("bucket IS NULL"), b, [], 0.9), "n": (dated_a, b.where("bucket IS NULL"), [], 0.9),
    }

    def keyed(side: int) -> DataFrame:
        rows = [branch[side].select(F.lit(kind).alias("kind"), _key(kind, *[F.col(c).cast("string") for c in branch[2]]), "title") for kind, branch in branches.items()]
        return written(functools.reduce(DataFrame.unionByName, rows).distinct().join(met(numbered), "title"), "titles")

    least = F.coalesce(*[F.when(F.col("kind") == kind, branch[3]) for kind, branch in branches.items()])
    pairs = similar(keyed(0), keyed(1), ["kind", "key"], least).distinct().select(F.col("a").alias("r_key_title"), F.col("b").alias("n_key_title"))
    return pairs.withColumn("title", values.title_similarity_from(F.col("r_key_title"), F.col("n_key_title"), NEAR)).where(F.col("title") >= NEAR)


def near_buyers(left: DataFrame, right: DataFrame) -> DataFrame:
    """r_key_buyer, n_key_buyer: short names that are equal, or of which one of four or more characters begins the other."""
    a, b = left.select("r_key_buyer").where("r_key_buyer <> ''").distinct(), right.select("n_key_buyer").where("n_key_buyer <> ''").distinct()

    def begins(c: str) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: (i >= 4) | (i == F.length(c)))
        return F.explode(F.transform(ends, lambda i: F.substr(F.col(c), F.lit(1), i)))

    one = a.withColumn("n_key_buyer", begins("r_key_buyer")).join(b.hint("merge"), "n_key_buyer").select("r_key_buyer", "n_key_buyer")
    two = b.withColumn("r_key_buyer", begins("n_key_buyer")).join(a.hint("merge"), "r_key_buyer").select("r_key_buyer", "n_key_buyer")
    return one.unionByName(two).distinct()


def _key(kind: str, *columns: str | Column) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *columns).alias("key")


def _dated(asks: DataFrame, notices: DataFrame, days: int) -> DataFrame:
    """Pairs (r_id, n_id) of asks (key, r_id, r_published) and notices (key, n_id, since, until) with equal key and since <= r_published <= until."""
    day, since, until = F.unix_date("r_published"), F.unix_date("since"), F.unix_date("until")
    wide = F.greatest(F.lit(days + 1), F.lit(SHORT))
    asked = asks.select("*", F.explode(F.array(*[F.struct(w.alias("w"), F.floor(day / w).alias("b")) for w in (F.lit(SHORT), wide)])).alias("cell"))
    size = F.when(until - since < SHORT, F.lit(SHORT)).otherwise(wide)
    cells = F.transform(F.array_distinct(F.array(F.floor(since / size), F.floor(until / size))), lambda b: F.struct(size.alias("w"), b.alias("b")))
    held = notices.select("*", F.explode(cells).alias("cell"))
    return asked.join(held.hint("merge"), ["key", "cell"]).where(F.col("r_published").between(F.col("since"), F.col("until"))).select("r_id", "n_id")


def _pairs(left: DataFrame, right: DataFrame, days: int, top: int | None) -> DataFrame:
    """Distinct (r_id, n_id): all pairs that may be accepted, or as many as hold each result's ``top`` best."""
    buyers = written(near_buyers(left, right), "near")
    titles = written(near_titles(left, right, buyers, days), "near")
    keys = {  # kind: notices' key, what makes its classes
        "t": (["key_title"], ["package"]), "p": (["key_title", "key_buyer"], ["package", "purchaser"]), "k": (["key_title", "package"], []),
        "n": (["key_number"], ["key_title", "package", "purchaser"]), "f": (["source_file"], ["key_title", "package", "purchaser", "key_number"]),
    }
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    # what a title's key goes on with, the least similarity with both dates, and without one
    sides = {"t": (left, F.lit(None).cast("string"), 0.45, None), "p": (left.join(met(buyers), "r_key_buyer"), F.col("n_key_buyer"), 0.32, 0.9), "k": (left.where("r_package <> ''"), F.col("r_package"), NEAR, 0.92)}
    titled = union(
        rows.select("r_id", "r_published", "r_key_title", F.lit(kind).alias("kind"), more.alias("more"), F.lit(dated).cast("double").alias("dated"), F.lit(undated).cast("double").alias("undated"))
        for kind, (rows, more, dated, undated) in sides.items()
    )
    titled = titled.join(met(titles), "r_key_title").withColumn("key", F.concat_ws("\x1f", "kind", "n_key_title", "more"))
    asks = {kind: left.where(F.col(c) != "").select(_key(kind, c), "r_id", "r_published") for kind, c in (("n", "r_key_number"), ("f", "r_source_file"))}

    n = {kind: ([f"n_{c}" for c in key], [f"n_{c}" for c in more]) for kind, (key, more) in keys.items()}
    kinds = [F.struct(F.lit(kind).alias("kind"), _key(kind, *key), F.array(*key, *more).alias("class"), (F.col(key[-1]) != "").alias("named")) for kind, (key, more) in n.items()]
    held = right.select("n_id", "n_published", F.explode(F.array(*kinds)).alias("k")).select("n_id", "n_published", "k.*").where("named")
    until = F.date_add("n_published", days)
    if top:
        later = F.lead("n_published", top).over(Window.partitionBy("kind", "class").orderBy("n_published", "n_id"))
        until = F.least(until, F.date_sub(later, 1))
    since = held.where("n_published IS NOT NULL").select("key", "n_id", F.col("n_published").alias("since"), until.alias("until")).where("until >= since")
    asked = union([titled.where("title >= dated").select("key", "r_id", "r_published"), *asks.values()])
    dated = written(_dated(asked.where("r_published IS NOT NULL"), since, days).distinct(), "pairs")
    # undated rows: equal numbers, or titles at 0.9 with a near purchaser or the same package
    asked = titled.where("title >= undated").select("key", "r_id", "r_published").unionByName(asks["n"])
    # an undated result asks for all notices, a dated one for the undated
    meets = F.explode(F.when(F.col("r_published").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("undated")
    notices = held.where("kind IN ('n', 'p', 'k')").select("key", "n_id", F.col("n_published").isNull().alias("undated"))
    undated = written(asked.select("key", "r_id", meets).join(notices.hint("merge"), ["key", "undated"]).select("r_id", "n_id").distinct(), "pairs")
    return dated.unionByName(undated)  # no pair is in both


def candidates(results: DataFrame, notices: DataFrame, days: int = links.WINDOW_DAYS, top: int | None = None) -> DataFrame:
    """Scored pairs that pass the recall rule: equal number or file, or titles near enough for what else agrees.

    All of them, or with ``top`` at least the best ``top`` of each result by ORDER.
    """
    left, right = written(_prepared(results, "r"), "results"), written(_prepared(notices, "n"), "notices")
    pairs = _pairs(left, right, days, top).join(left.hint("merge"), "r_id").join(right.hint("merge"), "n_id")
    pairs = pairs.withColumn("title", values.title_similarity(F.col("r_key_title"), F.col("n_key_title")))
    pairs = pairs.withColumns({
        "purchaser": text.company_similarity(F.col("r_purchaser"), F.col("n_purchaser")),
        "package_score": links.package_similarity(F.col("r_package"), F.col("n_package")),
        "number": F.when((F.col("r_key_number") != "") & (F.col("r_key_number") == F.col("n_key_number")), 1.0).otherwise(0.0),
        "gap": F.datediff("r_published", "n_published"),
    })
    same_package = (F.col("r_package") != "") & (F.col("r_package") == F.col("n_package"))
    same_file = (F.col("r_source_file") != "") & (F.col("r_source_file") == F.col("n_source_file"))
    both_numbers = (F.col("r_key_number") != "") & (F.col("n_key_number") != "")
    recall = (
        (F.col("number") == 1.0) | same_file | (F.col("title") >= 0.45) | ((F.col("title") >= 0.32) & (F.col("purchaser") >= 0.82)) | (same_package & (F.col("title") >= 0.30))
    )
    strong = F.when(both_numbers, F.col("number") == 1.0).otherwise(
        ((F.col("title") >= 0.9) & (F.col("purchaser") >= 0.82)) | (same_package & (F.col("title") >= 0.92))
    )
    pairs = pairs.where(F.when(F.col("gap").isNull(), strong).otherwise(recall))
    score = links.pair_score(F.col("title"), F.col("purchaser"), F.col("package_score"), F.col("number"), links.date_gap_score(F.col("gap")))
    conflicts = links.hard_conflicts(
        both_numbers & (F.col("number") == 0.0), (F.col("r_package") != "") & (F.col("n_package") != "") & ~same_package, F.col("gap") < 0,
        F.col("r_title").contains("二次") != F.col("n_title").contains("二次"),
    )
    return pairs.withColumns({"score": score, "conflicts": conflicts})


ORDER = ("score", "title", "purchaser", "n_published", "n_id")


def matched(scored: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the ``top`` candidates of each result by rank, the best one with margin and verdict)."""
    order = [F.desc_nulls_last(c) for c in ORDER]
    return ranking.top_per_group(scored, ["r_id"], order, top), ranking.with_margin(scored, ["r_id"], order, "score")


Client = Callable[[dict], dict]


def rule_client() -> Client:
    """A deterministic client in place of a model: matched at 0.82 or above, with the score as confidence."""
    def ask(pair: dict) -> dict:
        good = pair["score"] >= 0.82
        return {"decision": "matched" if good else "unmatched", "confidence": round(pair["score"] if good else 1 - pair["score"], 4)}

    return ask


def asked(pairs: DataFrame, factory: Callable[[], Client] = rule_client, column: str = "answer") -> DataFrame:
    """pairs (r_id, n_id, score) with a client's decision and confidence; a pair whose request fails gets the error instead."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for pair in pdf.to_dict("records"):
                try:
                    said = client(pair)
                    out.append((pair["r_id"], pair["n_id"], said["decision"], float(said["confidence"]), None))
                except Exception as error:  # noqa: BLE001  one pair's failure is a row
                    out.append((pair["r_id"], pair["n_id"], None, None, str(error)))
            yield pd.DataFrame(out, columns=["r_id", "n_id", "decision", "confidence", "error"])

    return pairs.select("r_id", "n_id", "score").mapInPandas(run, "r_id string, n_id string, decision string, confidence double, error string")


def asked_once(pairs: DataFrame, cache: DataFrame, version: str, factory: Callable[[], Client] = rule_client) -> tuple[DataFrame, DataFrame]:
    """(answers for all pairs, answers that are new): what the cache (pair_hash, decision, confidence, error) holds isn't asked again."""
    keyed = pairs.withColumn("pair_hash", values.fingerprint(F.col("r_id"), F.col("n_id"), F.col("r_title"), F.col("n_title"), F.lit(version)))
    todo = keyed.join(cache.select("pair_hash"), "pair_hash", "left_anti")
    fresh = asked(todo, factory).join(todo.select("r_id", "n_id", "pair_hash"), ["r_id", "n_id"])
    fresh = fresh.where("error IS NULL").select("pair_hash", "decision", "confidence", "error")
    answers = keyed.join(cache.select("pair_hash", "decision", "confidence", "error").unionByName(fresh), "pair_hash", "left")
    return answers, fresh


def decided(best: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Each result's best pair with the final status of two passes of answers."""
    one = first.select("r_id", F.col("n_id").alias("id1"), F.col("decision").alias("d1"), F.col("confidence").alias("c1"), F.col("error").alias("e1"))
    two = second.select("r_id", F.col("n_id").alias("id2"), F.col("decision").alias("d2"), F.col("confidence").alias("c2"), F.col("error").alias("e2"))
    rows = best.join(one.hint("merge"), "r_id", "left").join(two.hint("merge"), "r_id", "left")
    error = F.col("e1").isNotNull() | F.col("e2").isNotNull() | F.col("d1").isNull() | F.col("d2").isNull()
    status = links.two_pass_decision(F.col("d1"), F.col("d2"), F.col("id1") == F.col("id2"), F.least("c1", "c2"), F.size("conflicts") > 0, error)
    return rows.withColumn("status", status).drop("id1", "d1", "e1", "id2", "d2", "e2")


def merged(notices: DataFrame, results: DataFrame, accepted: DataFrame) -> DataFrame:
    """Notices with their results' history, and results without an accepted link as rows of their own.

    accepted has r_id and n_id.
    """
    linked = results.join(accepted.select(F.col("r_id").alias("id"), F.col("n_id").alias("_n")).hint("merge"), "id")
    history = linked.select(F.col("_n").alias("id"), F.col("id").alias("result_id"), "published", "title")
    own = links.with_history(notices.hint("merge"), history, "id", ["published", "result_id"], ["result_id", "title"]).withColumn("kind", F.lit("notice"))
    alone = results.join(accepted.select(F.col("r_id").alias("id")).hint("merge"), "id", "left_anti").withColumn("kind", F.lit("result"))
    return own.unionByName(alone, allowMissingColumns=True)


def reusable(results: DataFrame, state: DataFrame, notices: DataFrame) -> DataFrame:
    """results (id, content_hash) with reuse: stable_matched, stable_unmatched or reprocess.

    state has id, old_hash, status, n_id, n_hash from the run before; notices has
    n_id, hash. An unmatched result is stable only if its own content is; whether
    changed notices concern it is for the candidates to say (see affected).
    """
    rows = results.join(state, "id", "left").join(notices.withColumnRenamed("hash", "_now"), "n_id", "left")
    same = F.col("content_hash") == F.col("old_hash")
    kind = (
        F.when(same & (F.col("status") == "auto_matched") & (F.col("n_hash") == F.col("_now")), "stable_matched")
        .when(same & (F.col("status") == "auto_unmatched"), "stable_unmatched")
        .otherwise("reprocess")
    )
    return rows.select("id", kind.alias("reuse"))


def affected(unmatched: DataFrame, changed_notices: DataFrame) -> DataFrame:
    """id of the unmatched results for which a changed notice is a candidate."""
    return candidates(unmatched, changed_notices, top=1).select(F.col("r_id").alias("id")).distinct()


def reasons(score: Column) -> Column:
    """Why a pair scores: in fixed order."""
    said = (("number", F.col("number") == 1.0), ("title", F.col("title") >= 0.9), ("purchaser", F.col("purchaser") >= 0.82), ("score", score >= 0.82))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in said]))
