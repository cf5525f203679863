"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry names a host and the beginning of a path. It fits the host and all its
subdomains, where the address's path starts with the entry's. Of the entries that
fit, the longest decides: the one with the most host labels, then the one with the
longest path; of two entries for the same host and path, block wins.

The entries become a trie: one edge for each host label, from the last label to the
first, then one for each whole path segment; what an entry holds of its last, open
segment hangs at the node, by its length. An address walks at most as many edges as
it has labels and segments, however many entries there are. The trie is broadcast
where there are no more than ``MOST`` entries, which is checked; a larger table of
entries is joined instead, by the host's suffixes and the path's beginnings
of the lengths that occur, and gives the same rows.

Defined cases: a null address, or one without ``://``, has an empty host and path,
and no entry fits it; an empty path begins with no ``/``, so an entry whose path is
``/`` doesn't fit it; ports and user names stay parts of the host's labels; entries
with a null or empty host fit nothing, a null path is empty, repeated entries count
once; rows with null or repeated page_id get their own result each; an empty table
gives no rows, no entries give ``default`` for all; further columns are ignored by
``judge`` and given back as they are by ``permitted``.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))
DEFAULT = ALLOW
#: Entries whose trie is broadcast: about 100 bytes each, as they are sent.
MOST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between ``://`` and the next ``/``, ``?`` or ``#`` with A-Z lower-cased, and what follows up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    # up to the first ``://``, lazily; (?s) as an address may hold line ends
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


class Trie:
    """Nodes are lists [children by label, path node or None]; path nodes [children by segment, {open segment: verdict}, their lengths]."""

    def __init__(self, rules: Iterable[tuple[str | None, str | None, str]]):
        self.root: list = [{}, None]
        for host, path, verdict in rules:
            if not host:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, ()]
            node = node[1]
            *whole, rest = (path or "").split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}, ()])
            if node[1].get(rest) != BLOCK:
                node[1][rest] = verdict
            node[2] = tuple(sorted({len(x) for x in node[1]}, reverse=True))

    @staticmethod
    def _longest(node: list, segments: list[str]) -> tuple[str, str] | None:
        """(beginning of the path, verdict) of the longest entry below a host's path node."""
        best, last = None, len(segments) - 1
        for depth, segment in enumerate(segments):
            for n in node[2]:
                if n <= len(segment) and (verdict := node[1].get(segment[:n])):
                    best = depth, segment[:n], verdict
                    break
            if depth == last or (node := node[0].get(segment)) is None:
                break
        return best and ("/".join([*segments[: best[0]], best[1]]), best[2])

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry as host and path, verdict) of the longest entry that fits."""
        if not host:
            return None
        best, node, segments = None, self.root, None
        labels = host.split(".")
        for i in range(len(labels) - 1, -1, -1):
            node = node[0].get(labels[i])
            if node is None:
                break
            if node[1] is not None:
                segments = segments or path.split("/")
                if found := self._longest(node[1], segments):
                    best = i, *found
        return best and (".".join(labels[best[0] :]) + best[1], best[2])


def _by_trie(pages: DataFrame, rules: list[tuple], host: Column, path: Column) -> Column:
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf(FOUND)
    def find(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        walk = trie.value.find
        found = [walk(h, p) or (None, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        rule, verdict = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    return find(host, path)


def _by_join(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (_host, _path, each once) with _found: an equi-join of what an address can begin with and the entries."""
    known = rules.where("host != ''").select(F.col("host").alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), "verdict")
    known = known.groupBy("_h", "_p").agg(F.max(F.struct(F.col("verdict") == BLOCK, "verdict"))["verdict"].alias("_v"))
    # numbers up to the length of the longest path, whatever the number of entries
    lengths = [r[0] for r in known.select(F.length("_p")).distinct().collect()]
    labels = F.split("_host", r"\.")
    keys = addresses.where("_host != ''").withColumn("_labels", labels).withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_labels"))))
    keys = keys.withColumn("_h", F.array_join(F.slice("_labels", -F.col("_n"), F.col("_n")), "."))
    # only suffixes that some entry has go on
    keys = keys.join(known.select("_h").distinct(), "_h")
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_path"))
    keys = keys.withColumn("_l", F.explode(fits)).withColumn("_p", F.expr("substring(_path, 1, _l)"))
    hits = keys.join(known, ["_h", "_p"])
    best = F.max(F.struct(F.col("_n"), F.col("_l"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict")))
    return hits.groupBy("_host", "_path").agg(best.alias("_best"))


def matched(pages: DataFrame, rules: Iterable[tuple] | DataFrame = RULES, url_col: str = "url", most: int = MOST) -> DataFrame:
    """pages with _judged: host, path, rule and verdict of the longest entry that fits (nulls without one)."""
    host, path = host_and_path(F.col(url_col))
    if isinstance(rules, DataFrame):
        some = [tuple(r) for r in rules.select("host", "path", "verdict").limit(most + 1).collect()]
        if len(some) > most:
            mine = pages.withColumn("_judged", F.struct(host.alias("host"), path.alias("path")))
            each = mine.select(F.col("_judged.host").alias("_host"), F.col("_judged.path").alias("_path")).distinct()
            found = _by_join(each, rules).withColumnsRenamed({"_host": "_fh", "_path": "_fp"})
            mine = mine.join(found, (F.col("_judged.host") == F.col("_fh")) & (F.col("_judged.path") == F.col("_fp")), "left")
            whole = F.struct("_judged.host", "_judged.path", "_best.rule", "_best.verdict")
            return mine.withColumn("_judged", whole).drop("_fh", "_fp", "_best")
        rules = some
    else:
        rules = list(rules)
        if len(rules) > most:
            raise ValueError(f"more than {most} entries: give them as a DataFrame")
    found = _by_trie(pages, rules, host, path)
    mine = pages.withColumn("_judged", F.struct(host.alias("host"), path.alias("path"), found.alias("found")))
    return mine.withColumn("_judged", F.struct("_judged.host", "_judged.path", "_judged.found.rule", "_judged.found.verdict"))


def judge(pages: DataFrame, rules: Iterable[tuple] | DataFrame = RULES, default: str = DEFAULT, most: int = MOST) -> DataFrame:
    """page_id, host, path, rule (the entry that decides, or null), verdict: one row for each row of pages."""
    told = matched(pages.select("page_id", "url"), rules, most=most)
    return told.select("page_id", "_judged.host", "_judged.path", "_judged.rule", F.coalesce("_judged.verdict", F.lit(default)).alias("verdict"))


def permitted(pages: DataFrame, rules: Iterable[tuple] | DataFrame = RULES, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """The rows of pages, as they are, whose address is allowed."""
    return matched(pages, rules, url_col).where(F.coalesce("_judged.verdict", F.lit(default)) == ALLOW).drop("_judged")
