"""What a search is asked: plans of queries that a model gave, and saved settings, each in any of their shapes, as rows of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import values
from tidewell.functions.keywords import let
from tidewell.plans.reports import _get, _kind, clean_text

#: How many queries a plan has, marks of queries that only put tags together, the purpose of one that names none.
FEWEST, MOST = 2, 5
MARKS = ("新增多个所选标签", "多个所选标签", "组合全部标签", "所有标签")
PURPOSE = "规划方向"
#: settings' older values and what they are now, and what is allowed.
LENGTHS = {"short": "concise", "brief": "concise", "long": "deep"}
AUDIENCES = {"product_business": "wealth_management", "business_product": "wealth_management", "technology": "fintech_operations", "industry_research": "research_business"}
KNOWN_AUDIENCES = (
    "management", "wealth_management", "investment_banking", "institutional_business", "asset_management", "proprietary_investment", "research_business", "fintech_operations", "compliance_risk", "custom",
)
KNOWN_LENGTHS, KNOWN_RANGES = ("concise", "standard", "deep"), ("week", "month", "semiyear", "year")
TAGS, TAG, DIRECTION = 8, 80, 300
_BETWEEN = "\ue000"


def planned_queries(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(execution, intent, error; execution, place, query, purpose) of answers (execution: unique, answer).

    Queries stand under queries or directions, as texts, objects or one object; the same query (spaces and case
    aside) counts once, the first MOST stay. A plan without intent, or with fewer than FEWEST queries, has an error, and its queries are left out.
    """
    read = answers.select("execution", values.outermost_json(F.col("answer")).alias("v"))
    v = F.col("v")
    shape = lambda key: F.when(_kind(_get(v, key), "ARRAY"), F.try_variant_get(_get(v, key), "$", "array<variant>")).when(_kind(_get(v, key), "OBJECT"), F.array(_get(v, key)))
    read = read.withColumns({"intent": clean_text(F.when(_kind(_get(v, "intent"), "STRING"), _get(v, "intent", "string")), 200), "_q": F.coalesce(shape("queries"), shape("directions"))})
    rows = read.select("execution", F.posexplode("_q").alias("pos", "x"))

    def said(x: Column, *keys: str) -> Column:
        """The first key with something in it; null unless that is a text."""
        out = F.lit(None).cast("string")
        for key in reversed(keys):
            one, plain = _get(x, key), _get(x, key, "string")
            out = F.when(one.isNull() | (plain == ""), out).when(_kind(one, "STRING"), plain)
        return out

    def asked(x: Column) -> Column:
        given = F.coalesce(_get(x, "purpose", "string"), _get(x, "description", "string"), F.lit("")) == ""
        is_text, is_object = _kind(x, "STRING"), _kind(x, "OBJECT")
        query = F.when(is_text, F.try_variant_get(x, "$", "string")).when(is_object, said(x, "query", "direction", "text"))
        purpose = F.when(is_text | given, F.lit(PURPOSE)).when(is_object, said(x, "purpose", "description"))
        return F.struct(query.alias("query"), purpose.alias("purpose"))

    rows = rows.select("execution", "pos", let(F.col("x"), asked).alias("a"))
    rows = rows.select("execution", "pos", clean_text(F.col("a.query"), 300).alias("query"), clean_text(F.col("a.purpose"), 120).alias("purpose"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(F.concat_ws(" ", "query", "purpose"), F.lit(mark))
    good = rows.where((F.col("query") != "") & (F.col("purpose") != "") & ~marked)
    same = F.lower(F.regexp_replace("query", r"\s+", ""))
    first = good.withColumn("_k", F.row_number().over(Window.partitionBy("execution", same).orderBy("pos"))).where("_k = 1").drop("_k")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("execution").orderBy("pos"))).where(F.col("place") <= MOST)
    state = read.select("execution", "intent", _kind(v, "OBJECT").alias("_object")).join(kept.groupBy("execution").agg(F.count("*").alias("_n")), "execution", "left")
    error = F.when(~F.col("_object"), "not JSON").when(F.col("intent") == "", "no intent").when(F.coalesce("_n", F.lit(0)) < FEWEST, "too few queries")
    plans = state.select("execution", F.when(F.col("_object"), F.col("intent")).alias("intent"), error.alias("error"))
    fine = plans.where("error IS NULL").select("execution")
    return plans, kept.join(fine, "execution", "left_semi").select("execution", "place", "query", "purpose")


def _texts(v: Column, most: int, longest: int) -> Column:
    """Up to most different texts of a list, cleaned and cut; no list gives none."""
    several = F.coalesce(F.when(_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<string>")), F.array().cast("array<string>"))
    # cleaned as one text, with a sign between that no text holds
    joined = clean_text(F.array_join(F.transform(several, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(_BETWEEN), F.lit(""))), _BETWEEN), 1 << 20)
    parts = F.transform(F.split(joined, _BETWEEN), lambda x: F.substring(F.btrim(x, F.lit(" \t\r\n")), 1, longest))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def settings(saved: DataFrame, column: str) -> DataFrame:
    """saved with its settings (JSON) in their present form: audience, audience_detail, focus, focus_tags, extra_focus, time_range, report_length, plan_intent, plan_directions.

    Older names fill what is blank, older values become the present ones, what isn't allowed becomes the default; a
    confirmed plan without intent or directions is none (nulls). JSON that can't be read counts as empty.
    """
    v = values.outermost_json(F.col(column))
    text = lambda key: F.coalesce(F.when(_kind(_get(v, key), "STRING"), _get(v, key, "string")), F.when(~_kind(_get(v, key), "ARRAY") & ~_kind(_get(v, key), "OBJECT"), _get(v, key, "string")), F.lit(""))
    first = lambda *keys: F.coalesce(*[F.nullif(text(k), F.lit("")) for k in keys], F.lit(""))
    present = lambda c, names: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c), c)
    one_of = lambda c, known, default: let(c, lambda x: F.when(x.isin(*known), x).otherwise(default))
    version = text("config_version").try_cast("int")
    older = F.exists(F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>")), lambda k: k.isin("question", "keywords", "analysis_perspective", "analysis_depth", "extra_requirements"))
    legacy = F.when(text("config_version") != "", F.coalesce(version < 2, F.lit(False))).otherwise((text("focus") == "") & older)
    objects = F.array_join(_texts(_get(v, "focus_objects"), 1000, 200), "、")
    focus = F.coalesce(F.nullif(first("focus", "question", "search_question"), F.lit("")), F.nullif(objects, F.lit("")), text("focus_objects"))
    length = F.when(legacy | (text("report_length") == ""), F.coalesce(F.nullif(text("analysis_depth"), F.lit("")), F.lit("standard"))).otherwise(text("report_length"))
    tags, keywords = _texts(_get(v, "focus_tags"), TAGS, TAG), _texts(_get(v, "keywords"), TAGS, TAG)
    plan = _get(v, "confirmed_plan")
    intent, directions = clean_text(_get(plan, "intent", "string"), 200), _texts(_get(plan, "directions"), MOST, DIRECTION)
    has_plan = _kind(plan, "OBJECT") & (intent != "") & (F.size(directions) > 0)
    audience = clean_text(first("audience", "analysis_perspective"), 120)
    return saved.withColumns({
        "audience": one_of(present(F.coalesce(F.nullif(audience, F.lit("")), F.lit("research_business")), AUDIENCES), KNOWN_AUDIENCES, "research_business"),
        "audience_detail": clean_text(first("audience_detail", "description"), 2000), "focus": clean_text(focus, 1000), "focus_tags": F.when(F.size(tags) > 0, tags).otherwise(keywords),
        "extra_focus": clean_text(first("extra_focus", "extra_requirements"), 2000), "time_range": one_of(clean_text(text("time_range"), 32), KNOWN_RANGES, "month"),
        "report_length": one_of(let(clean_text(length, 32), lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in LENGTHS.items() for y in pair]), F.lower(x)), x)), KNOWN_LENGTHS, "standard"), "plan_intent": F.when(has_plan, intent), "plan_directions": F.when(has_plan, directions),
    })
