"""Plan of a crawl, and its bodies dispatched to the parsers of their sources.

A parser reads the rows of its own kind only, and all give one schema; a body that can't be
read, lacks what was asked for or has no parser gives a row with the error, and stops no other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources import blocks, payloads

RELEASE = "source string, parser string, item string, platform string, version string, released date, notes string, error string"
Parser = Callable[[DataFrame, dict], DataFrame]


def _rows(df: DataFrame, item: Column | str, platform: Column | str = "", version: Column | str = "", released: Column | None = None, notes: Column | str = "", error: Column | None = None) -> DataFrame:
    said = lambda x: F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit(""))
    nothing = F.lit(None)
    return df.select(
        "source", said(item).alias("item"), said(platform).alias("platform"), said(version).alias("version"), (nothing if released is None else released).cast("date").alias("released"),
        said(notes).alias("notes"), (nothing if error is None else error).cast("string").alias("error"),
    )


def _store(df: DataFrame, o: dict) -> DataFrame:
    return _rows(payloads.store_lookup(df, "body", F.lit(o["track_id"]) if "track_id" in o else None), o.get("app", ""), version=F.col("version"), released=F.col("released"), notes=F.col("notes"))


def _software(df: DataFrame, o: dict) -> DataFrame:
    out = payloads.software_list(df, "body", o["item_id"])
    return _rows(out, F.col("name"), released=F.col("released"), notes=F.array_join("sections", "\n"))


def _repaired(df: DataFrame, o: dict) -> DataFrame:
    return _software(df.withColumn("body", payloads.repaired(F.col("body"))), o)


def _platforms(df: DataFrame, o: dict) -> DataFrame:
    error = F.when(~F.col("found"), F.concat(F.lit("no platform "), F.col("platform")))
    return _rows(payloads.platform_config(df, "body"), F.col("name"), F.col("platform"), F.col("version"), F.col("released"), F.col("notes"), error)


def _menu(df: DataFrame, o: dict) -> DataFrame:
    return _rows(payloads.category_menu(df, "body"), F.col("name"), version=F.col("version"), released=F.col("released"), notes=F.col("category"))


def _groups(df: DataFrame, o: dict) -> DataFrame:
    return _rows(payloads.platform_groups(df, "body", o["groups"]), F.col("name"), F.col("platform"), F.col("version"), F.col("released"), F.col("notes"), F.col("error"))


def _clients(df: DataFrame, o: dict) -> DataFrame:
    return _rows(payloads.mobile_clients(df, "body", o["clients"]), F.col("name"), released=F.col("released"), notes=F.col("notes"))


def _by_app(df: DataFrame, o: dict) -> DataFrame:
    out = payloads.clients_by_app(df, "body", o["app_ids"])
    return _rows(out, F.col("name"), version=F.col("version"), released=F.col("released"), notes=F.col("notes"), error=F.when(~F.col("found"), F.concat(F.lit("no app "), F.col("app"))))


def _sections(df: DataFrame, o: dict) -> DataFrame:
    return _rows(blocks.sections(df, "source", "body", o["headings"]), F.col("heading"), notes=F.col("content"), error=F.col("error"))


def _downloads(df: DataFrame, o: dict) -> DataFrame:
    return _rows(blocks.downloads(df, "source", "body", o["apps"]), F.col("app"), F.col("platforms"), released=F.to_date("released"), notes=F.col("introduction"), error=F.col("error"))


def _cards(df: DataFrame, o: dict) -> DataFrame:
    out = blocks.cards(df, "source", "body", o["apps"], o["card"], o["name"], o.get("content", ":self"), o.get("excluded", ()))
    return _rows(out, F.col("app"), notes=F.col("content"), error=F.col("error"))


def _articles(df: DataFrame, o: dict) -> DataFrame:
    out = blocks.articles(df, "source", "body", *([o["keywords"]] if "keywords" in o else []))
    return _rows(out, F.col("app"), notes=F.col("content"), error=F.col("error"))


JSON_PARSERS: Mapping[str, Parser] = {
    "store": _store, "software": _software, "software_repaired": _repaired, "platforms": _platforms, "menu": _menu, "groups": _groups, "clients": _clients, "by_app": _by_app, "articles": _articles,
}
HTML_PARSERS: Mapping[str, Parser] = {"sections": _sections, "downloads": _downloads, "cards": _cards}


def planned(catalog: DataFrame) -> DataFrame:
    """The sources in use of a catalog (source, enabled, parser): those with a null or true enabled, each once."""
    return catalog.where(F.coalesce("enabled", F.lit(True))).dropDuplicates(["source"])


def dispatched(bodies: DataFrame, options: Mapping[str, dict]) -> DataFrame:
    """RELEASE rows of bodies (source, parser, body): each by its parser, with that parser's options.

    Where bodies are stored by parser, a parser scans its own part alone.
    """
    out = []
    for name, parse in {**JSON_PARSERS, **HTML_PARSERS}.items():
        mine = bodies.where(F.col("parser") == name).select("source", "body")
        read = mine
        if name in JSON_PARSERS:
            readable = F.try_parse_json(F.col("body")).isNotNull()
            read = mine.where(readable)
            out.append(_rows(mine.where(~readable), "", error=F.lit("unreadable body")).withColumn("parser", F.lit(name)))
        found = parse(read, dict(options.get(name, {})))
        empty = read.join(found.select("source").distinct(), "source", "left_anti")
        out += [x.withColumn("parser", F.lit(name)) for x in (found, _rows(empty, "", error=F.lit("nothing found")))]
    known = [*JSON_PARSERS, *HTML_PARSERS]
    other = bodies.where(~F.coalesce(F.col("parser").isin(*known), F.lit(False)))
    out.append(_rows(other, "", error=F.concat(F.lit("no parser "), F.coalesce("parser", F.lit("")))).join(other.select("source", "parser").distinct(), "source"))
    return functools.reduce(DataFrame.unionByName, out).select(*[c.split()[0] for c in RELEASE.split(", ")])
