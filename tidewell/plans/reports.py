"""Reports that a model gave as JSON: five sections of typed items in any of their shapes, citations resolved and grounded, warnings told.

An answer is a variant; each section is looked for by its name, then by an older one, and may be a
text, an item, a list of either, or an object that holds the list. Items become rows, their
citations rows of rows, so that what they cite is found by joins with an execution's aliases and sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import values
from tidewell.functions.keywords import let

#: Section, its older name, the type of its items that name none.
SECTIONS = (
    ("core_judgment", "core_conclusion", "analysis"), ("key_developments", "key_dynamics", "fact"), ("impact_analysis", None, "analysis"), ("company_implications", "focus_sections", "analysis"),
    ("risks_and_watch_items", None, "analysis"),
)
TYPES = ("fact", "analysis", "recommendation")
OLDER_RISKS = (("risks", "analysis"), ("watch_items", "recommendation"))
NOT_FOUND, UNCITED, UNVERIFIED = "未找到引用来源：", "存在未引用来源的事实或分析项", "[未核验链接]"
TITLE = "AI 自定义情报报告"
MOST, LONGEST = 30, 4000
NO_JSON, NO_CONTENT, NO_GROUND = "not JSON", "no usable content", "core judgment without a source"


def clean_text(c: Column, most: int) -> Column:
    """Text without code fences, tags (written or as entities) and control characters, trimmed, cut to ``most`` characters."""
    tags = r"</?[A-Za-z][^>]*>"
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)```(?:json|markdown|html|text)?", ""), tags, "")
    bare = F.regexp_replace(F.regexp_replace(values.unescaped(bare), tags, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.substring(F.regexp_replace(bare, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", ""), 1, most)


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(name)), F.lit(False))


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _listed(v: Column) -> Column:
    """array<variant>: a section's items, whatever its shape."""
    inner = _get(v, "items")
    several = lambda x: F.try_variant_get(x, "$", "array<variant>")
    return F.when(_kind(v, "ARRAY"), several(v)).when(_kind(v, "OBJECT") & _kind(inner, "ARRAY"), several(inner)).when(_kind(v, "OBJECT") | _kind(v, "STRING"), F.array(v))


def _has(v: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), key), F.lit(False))


def _items(read: DataFrame) -> DataFrame:
    """execution, section (its place), pos, type, raw (text as written), ids: one row for each item of read (execution, v)."""
    raw, out = F.col("v"), []
    # a lambda of two parameters would be given places, so what it needs is bound around it
    typed = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))
    placed = lambda i: lambda e: F.struct(F.lit(i).alias("section"), e["kind"].alias("kind"), e["x"].alias("x"))
    as_item = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.try_variant_get(F.to_variant_object(F.array(x)), "$[0]", "variant").alias("x"))
    empty = F.array().cast("array<string>")
    for i, (name, older, default) in enumerate(SECTIONS):
        value = _get(raw, name)
        if older:
            value = F.when(_has(raw, name), value).otherwise(_get(raw, older))
        listed = F.transform(_listed(value), typed(default))
        if name == "risks_and_watch_items":
            # older reports have two lists of texts in its place
            texts = [F.slice(F.filter(F.coalesce(_get(raw, key, "array<string>"), empty), lambda x: F.trim(x) != ""), 1, MOST) for key, _ in OLDER_RISKS]
            both = F.concat(*[F.transform(held, as_item(kind)) for held, (_, kind) in zip(texts, OLDER_RISKS, strict=True)])
            missing = F.coalesce(F.schema_of_variant(value), F.lit("VOID")) == "VOID"
            listed = F.when(missing, both).otherwise(listed)
        out.append(F.transform(listed, placed(i)))
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<section:int,kind:string,x:variant>>")) for x in out]))
    rows = read.select("execution", F.posexplode(every).alias("pos", "e")).select("execution", "pos", "e.section", "e.kind", "e.x")
    x = F.col("x")
    text = F.coalesce(*[F.nullif(_get(x, c, "string"), F.lit("")) for c in ("text", "summary", "impact_analysis", "title")])
    said = F.lower(F.trim(F.coalesce(F.nullif(_get(x, "type", "string"), F.lit("")), "kind")))
    ids = F.slice(F.filter(F.transform(F.coalesce(_get(x, "source_ids", "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != ""), 1, MOST)
    is_text, is_object = _kind(x, "STRING"), _kind(x, "OBJECT")
    return rows.where(is_text | is_object).select(
        "execution", "section", "pos", F.when(is_object & said.isin(*TYPES), said).otherwise(F.col("kind")).alias("type"),
        F.when(is_text, F.try_variant_get(x, "$", "string")).otherwise(text).alias("raw"), F.when(is_object, ids).otherwise(F.array().cast("array<string>")).alias("ids"),
    )


def _verified(said: Column, allowed: Column) -> Column:
    """said with addresses that aren't among the allowed ones replaced."""
    found = F.regexp_extract_all(said, F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0))
    unknown = F.filter(found, lambda u: ~F.coalesce(F.array_contains(allowed, values.canonical_url(u)), F.lit(False)))
    return F.aggregate(unknown, said, lambda t, u: F.replace(t, u, F.lit(UNVERIFIED)))


def normalized(answers: DataFrame, sources: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(execution, title, warnings, error: a row for each answer; execution, section, place, type, text, source_ids: the items that stay).

    answers: execution (unique), answer. sources: execution, source_id, url, some dozens each. aliases: execution, alias, source_id.
    Facts and analyses without a known source are dropped with a warning. A report has an error if its answer
    isn't a JSON object, nothing of it stays, or its core judgment has no grounded fact or analysis; its items are left out then.
    """
    read = answers.select("execution", values.outermost_json(F.col("answer")).alias("v")).withColumn("good", _kind(F.col("v"), "OBJECT"))
    allowed = sources.where("url <> ''").groupBy("execution").agg(F.collect_set(values.canonical_url(F.col("url"))).alias("allowed"))  # some dozens
    items = _items(read.where("good")).join(allowed, "execution", "left")
    items = items.withColumn("text", clean_text(F.col("raw"), LONGEST))
    items = items.withColumn("text", _verified(F.col("text"), F.coalesce("allowed", F.array().cast("array<string>")))).drop("allowed", "raw")
    cited = items.select("execution", "pos", F.posexplode("ids").alias("k", "id"))
    by_alias = aliases.select("execution", F.col("alias").alias("id"), F.col("source_id").alias("_alias")).dropDuplicates(["execution", "id"])
    by_id = sources.select("execution", F.col("source_id").alias("id"), F.lit(True).alias("_own")).distinct()
    cited = cited.join(by_alias, ["execution", "id"], "left").join(by_id, ["execution", "id"], "left")
    cited = cited.withColumn("source", F.coalesce("_alias", F.when(F.col("_own"), F.col("id"))))
    known = F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("k", "source")))), lambda s: s["source"])
    items = items.drop("ids").join(cited.groupBy("execution", "pos").agg(F.array_distinct(known).alias("source_ids")), ["execution", "pos"], "left")
    items = items.withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))).where("text <> ''")
    uncited = (F.col("type") != "recommendation") & (F.size("source_ids") == 0)
    kept = items.where(~uncited).withColumn("place", F.row_number().over(Window.partitionBy("execution", "section").orderBy("pos"))).where(F.col("place") <= MOST)
    told = cited.where("source IS NULL").select("execution", "pos", "k", F.concat(F.lit(NOT_FOUND), "id").alias("said")).unionByName(items.where(uncited).select("execution", "pos", F.lit(MOST + 1).alias("k"), F.lit(UNCITED).alias("said")))
    told = told.groupBy("execution", "said").agg(F.min(F.struct("pos", "k")).alias("at")).withColumn("_n", F.row_number().over(Window.partitionBy("execution").orderBy("at"))).where(F.col("_n") <= MOST)
    told = told.groupBy("execution").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda s: s["said"]).alias("warnings"))
    grounded = (F.col("section") == 0) & (F.col("type") != "recommendation") & (F.size("source_ids") > 0)
    state = kept.groupBy("execution").agg(F.count("*").alias("n"), F.count_if(grounded).alias("core"))
    title = let(clean_text(_get(F.col("v"), "title", "string"), 500), lambda t: t)
    reports = read.withColumn("title", title).join(allowed, "execution", "left").join(state, "execution", "left").join(told, "execution", "left")
    error = F.when(~F.col("good"), NO_JSON).when(F.coalesce("n", F.lit(0)) == 0, NO_CONTENT).when(F.col("core") == 0, NO_GROUND)
    shown = F.coalesce(F.nullif(_verified(F.col("title"), F.coalesce("allowed", F.array().cast("array<string>"))), F.lit("")), F.lit(TITLE))
    reports = reports.select("execution", F.when(F.col("good"), shown).alias("title"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), error.alias("error"))
    names = F.array(*[F.lit(s) for s, _, _ in SECTIONS])
    fine = reports.where("error IS NULL").select("execution")
    return reports, kept.join(fine, "execution", "left_semi").select("execution", F.element_at(names, F.col("section") + 1).alias("section"), "place", "type", "text", "source_ids")
