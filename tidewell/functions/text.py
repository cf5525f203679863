"""Text functions, Column to Column: keys, suffixes, classifiers, scores, extraction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.keywords import let

#: Notice suffixes, legal suffixes, signs that keys leave out.
NOTICE_SUFFIXES = (
    "中标候选人公示", "成交候选人公示", "中标结果公告", "成交结果公告", "采购结果公告", "结果公告", "招标公告", "采购公告", "询价公告", "竞争性磋商公告",
    "竞争性谈判公告", "磋商公告", "谈判公告", "比选公告", "中标公告", "成交公告", "流标公告", "废标公告", "终止公告", "取消公告",
)
LEGAL_SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "证券股份有限公司", "证券有限责任公司")
SIGNS = r"""[\s,，.。;；:：!！?？、/\\|·`'"“”‘’\[\]【】{}<>《》\-＿_+＝=~～]+"""
#: What a result notice's text must and must not hold to be classified by its own.
NOT_FINTECH = ("工程装修", "物业", "保洁", "法律服务", "审计服务", "办公用品", "员工活动", "餐饮", "车辆", "驾驶", "印刷", "广告制作")
SYSTEM_OBJECTS = ("系统", "平台", "软件", "应用", "数据库", "接口", "引擎", "网关", "终端", "内核", "数据")
BUSINESS = (
    "风控", "风险管理", "合规", "反洗钱", "监管", "行情", "金融数据", "资讯", "研报", "投研", "交易", "柜台", "清算", "结算", "估值", "订单", "投行", "资本市场", "质控",
)
ACTIONS = (("续签|续约|续订|延续", "续采续约"), ("升级|改造|适配|优化", "升级改造"), ("扩容", "扩容"), ("维保|维护|运维", "维保"))
#: What a shown name loses at its end.
STAGE_SUFFIXES = ("采购公告", "招标公告", "结果公告", "结果公示", "中标公告", "成交公告", "流标公告", "废标公告", "候选人公示")
#: Terms of the category that was renamed.
LEGACY_BUSINESS = ("投行", "资本市场", "质控", "风控")
LEGACY_OBJECTS = ("系统", "平台", "软件", "内核", "数据库", "接口")
#: A result's types and states, what its title tells of them (first match), and what its name loses at its end.
RESULT_TYPES = ("candidate", "winning", "transaction", "failed", "terminated", "cancelled", "other")
RESULT_STATES = ("候选人公示", "已中标", "已成交", "流标", "废标", "终止", "取消", "未知")
TITLE_TYPES = (("候选人", "candidate"), ("成交", "transaction"), ("中标", "winning"), ("流标|失败|废标", "failed"), ("终止", "terminated"), ("取消", "cancelled"))
TITLE_STATES = (
    ("候选人", "candidate", "候选人公示"), ("成交", "transaction", "已成交"), ("中标", "winning", "已中标"), ("流标", "", "流标"), ("废标", "", "废标"),
    ("终止", "terminated", "终止"), ("取消", "cancelled", "取消"),
)
RESULT_SUFFIXES = (
    "中标候选人公示", "成交候选人公示", "中标结果公告", "成交结果公告", "采购结果公告", "结果公告", "中标公告", "成交公告", "流标公告", "废标公告", "终止公告", "取消公告",
)
#: Chinese digits.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())


def nfkc(c: Column) -> Column:
    """Compatibility normal form, trimmed; Spark has no built-in for it."""
    return F.pandas_udf(_nfkc, "string")(c)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_suffixes(c: Column, suffixes: tuple[str, ...] = NOTICE_SUFFIXES) -> Column:
    """Trailing suffixes removed again and again; after each, edge signs go at both ends, and only then."""
    found = "|".join(sorted(suffixes, key=len, reverse=True))
    edge = r"[ \-_（）()\[\]【】]"
    cut = F.regexp_replace(c, rf"(?:{edge}*(?:{found}))+{edge}*$", "")
    return F.when(c.rlike(rf"(?:{found})$"), F.regexp_replace(cut, rf"^{edge}+|{edge}+$", "")).otherwise(c)


def project_key(c: Column) -> Column:
    """Name without suffixes, a leading 关于 or 有关, a trailing 的, and signs; lower case, round brackets alike."""
    x = F.translate(F.lower(strip_suffixes(F.trim(c))), "（）", "()")
    x = F.regexp_replace(F.regexp_replace(x, "^(?:关于|有关)", ""), "的$", "")
    return F.regexp_replace(x, SIGNS, "")


def number_key(c: Column) -> Column:
    """Project number: upper case, dashes alike, delimiters removed."""
    return F.regexp_replace(F.upper(F.translate(c, "－—–", "---")), r"[\s\-_/\\.:：（）()\[\]【】]+", "")


def company_key(c: Column) -> Column:
    """Company name without signs."""
    return F.regexp_replace(c, SIGNS, "")


def company_short(c: Column) -> Column:
    """Company name without signs and its longest legal suffix."""
    return F.regexp_replace(company_key(c), "(?:" + "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True)) + ")$", "")


def company_similarity(a: Column, b: Column) -> Column:
    """1 if equal but for signs, 0.9 if short names are, 0.82 if one of four or more characters begins the other, else 0."""
    x, y = company_short(a), company_short(b)
    begins = (F.length(x) >= 4) & F.startswith(y, x) | (F.length(y) >= 4) & F.startswith(x, y)
    none = (company_key(a) == "") | (company_key(b) == "")
    return F.when(none, 0.0).when(company_key(a) == company_key(b), 1.0).when((x != "") & (x == y), 0.9).when(begins, 0.82).otherwise(0.0)


def chinese_number(c: Column) -> Column:
    """Digits, one Chinese digit, or a number below a hundred with 十 in it, as an integer; anything else is null."""
    digits = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    one = "".join(NUMERALS)
    part = lambda i: F.regexp_extract(c, f"^([{one}]??)十([{one}]?)$", i)
    value = F.coalesce(F.try_element_at(digits, part(1)), F.lit(1)) * 10 + F.coalesce(F.try_element_at(digits, part(2)), F.lit(0))
    return (
        F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")).when(F.length(c) == 1, F.try_element_at(digits, c)).when(c.rlike(f"^[{one}]?十[{one}]?$"), value)
    )


def package_number(c: Column) -> Column:
    """Number of a package: digits or a Chinese number before 包 or 标段, else after 包, 包件 or 标段; null if there is none."""
    number = f"([0-9]{{1,3}}|[{''.join(NUMERALS)}]{{1,3}})"
    found = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    said = F.coalesce(found(f"第?{number}(?:包|标段)"), found(rf"(?:包件|包|标段)\s*{number}"))
    return chinese_number(F.coalesce(F.nullif(F.ltrim(said, F.lit("0")), F.lit("")), F.when(said.isNotNull(), F.lit("0"))))


def ordered_classifier(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern found in c."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(other)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether c holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def standalone_class(title: Column, context: Column) -> Column:
    """Struct of category, subcategory, action and scope for a result without a notice; null where its text doesn't tell.

    The text (title and body) must name a line of business and a system, and nothing that rules it out.
    """
    said = F.lower(context)
    known = (title != "") & ~contains_any(said, NOT_FINTECH) & contains_any(said, BUSINESS) & contains_any(said, SYSTEM_OBJECTS)
    fields = F.struct(
        F.lit("IT软硬件").alias("category"), F.lit("业务系统与软件").alias("subcategory"), ordered_classifier(title, list(ACTIONS), "").alias("action"), title.alias("scope")
    )
    return F.when(known, fields)


def legacy_category(category: Column, subcategory: Column, name: Column, scope: Column) -> Column:
    """Struct of category and subcategory, the renamed one replaced where name, scope or subcategory tell of a business system."""
    said = F.concat_ws(" ", *[F.trim(F.coalesce(c, F.lit(""))) for c in (name, scope, subcategory)])
    renamed = (F.trim(category) == "专业及金融服务") & (F.trim(subcategory) == "投行与资本市场") & contains_any(said, LEGACY_BUSINESS) & contains_any(said, LEGACY_OBJECTS)
    new = F.struct(F.lit("IT软硬件").alias("category"), F.lit("业务系统与软件").alias("subcategory"))
    return F.when(F.coalesce(renamed, F.lit(False)), new).otherwise(F.struct(category.alias("category"), subcategory.alias("subcategory")))


def result_type(said: Column, title: Column) -> Column:
    """A result's type: the one said if it is known, else what the title tells."""
    x = F.lower(F.trim(F.coalesce(said, F.lit(""))))
    return F.when(x.isin(*RESULT_TYPES), x).otherwise(ordered_classifier(title, list(TITLE_TYPES), "other"))


def result_status(said: Column, kind: Column, title: Column) -> Column:
    """A result's state: the one said if it is known, else what title or type tell."""
    x = F.trim(F.coalesce(said, F.lit("")))
    out = F.when(x.isin(*RESULT_STATES), x)
    for word, of_type, state in TITLE_STATES:
        out = out.when(F.contains(title, F.lit(word)) | ((kind == of_type) if of_type else F.lit(False)), state)
    return out.otherwise("未知")


def result_name(c: Column) -> Column:
    """A project's name without result suffixes and the signs before each of them."""
    edge = r"[ \-_（）()\[\]【】]*"
    bare = F.regexp_replace(c, f"(?:{edge}(?:{'|'.join(RESULT_SUFFIXES)}))+$", "")
    return F.when(bare == c, c).otherwise(F.regexp_replace(bare, rf"^{edge}|{edge}$", ""))


def tags(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all patterns found in c, in rule order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(label)) for p, label in rules]))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))))


def phones(c: Column) -> Column:
    """Mainland mobile and landline numbers, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"1[3-9][0-9]{9}|0[0-9]{2,3}-[0-9]{7,8}"), F.lit(0))))


def people_and_phones(c: Column) -> Column:
    """Struct of person and phones (each once, joined by 、): numbers of eleven digits or with an area code, and what is left of the text without signs at its end; null where there is none."""
    pattern = r"0[0-9]{2,3}-[0-9]{7,8}|[0-9]{11}"
    found = F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), "、")
    rest = F.trim(F.regexp_replace(F.regexp_replace(c, pattern, ""), r"[：:,\s、/]+$", ""))
    return F.struct(F.nullif(rest, F.lit("")).alias("person"), F.nullif(found, F.lit("")).alias("phones"))


def mask_email(c: Column) -> Column:
    """The first character and the domain."""
    return F.regexp_replace(c, r"^(.).*(@.*)$", "$1***$2")


def mask_secret(c: Column) -> Column:
    """Two characters and fourteen dots, or dots alone for a short one; empty stays so."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", "").when(F.length(c) > 2, F.concat(F.substring(c, 1, 2), F.lit("•" * 14))).otherwise("•" * 16)


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def username(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def query_key(c: Column) -> Column:
    """What tells two questions apart: no spaces, commas, and words for and; lower case."""
    return F.lower(F.regexp_replace(c, r"[\s、，,与和及]+", ""))


def front_matter(document: Column) -> Column:
    """map<string,string> of a document's leading --- block; values lose one pair of quotes; no block gives an empty map."""
    block = F.regexp_extract(document, r"(?s)^﻿?---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]+:", "")), r"""^(["'])(.*)\1$""", "$2").alias("value")),
    )
    return let(pairs, lambda held: let(F.transform(held, lambda p: p["key"]), lambda keys: F.map_from_entries(F.filter(held, lambda p, i: F.array_position(keys, p["key"]) == i + 1))))


def decoded_front_matter(document: Column, strict: bool = False) -> Column:
    """map<string,string> of the block between --- at a document's very beginning and the next --- (strict: alone on its line), values as JSON where they are.

    A JSON text loses its quotes and escapes, null is empty, true and false are True and False; other values lose quotes at their
    ends. Of a repeated key the last value counts.
    """
    block = F.regexp_extract(document, r"(?s)\A---\n(.*?)\n---\n" if strict else r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))

    def value(raw: Column, json: Column, kind: Column) -> Column:
        read = F.try_variant_get(json, "$", "string")
        other = (kind == "") | F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        return F.when(kind == "VOID", "").when(kind == "BOOLEAN", F.initcap(read)).when(other, F.btrim(raw, F.lit("'\""))).otherwise(read)

    def pair(x: Column) -> Column:
        raw, kind = F.trim(F.regexp_replace(x, r"^[^:]*:", "")), lambda json: F.coalesce(F.schema_of_variant(json), F.lit(""))
        read = let(raw, lambda raw: let(F.try_parse_json(raw), lambda json: let(kind(json), lambda kind: value(raw, json, kind))))
        return F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), read.alias("value"))

    def last(held: Column, keys: Column) -> Column:
        return F.filter(held, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), p["key"]))

    return let(F.transform(lines, pair), lambda held: let(F.transform(held, lambda p: p["key"]), lambda keys: F.map_from_entries(last(held, keys))))


def markdown_title(document: Column) -> Column:
    return F.nullif(F.regexp_extract(document, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))


def portable_name(c: Column, most: int = 72) -> Column:
    """A file name without signs that some system refuses, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_")), 1, most)


def display_name(c: Column) -> Column:
    """A name as it is shown: full-width letters, digits and round brackets as ASCII, spaces collapsed, one stage suffix off, unless nothing else is left."""
    wide = "".join(chr(0xFF01 + i) for i in range(94) if chr(0x21 + i).isalnum()) + "（）"
    plain = "".join(chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalnum()) + "()"
    x = F.regexp_replace(F.translate(F.trim(c), wide, plain), r"\s+", " ")
    return F.trim(F.regexp_replace(x, f"^(.+)(?:{'|'.join(STAGE_SUFFIXES)})$", "$1"))


def sections(document: Column, default: Column) -> Column:
    """array<struct<app, body>>: a document's parts from one ## heading to the next; what stands after a · names the app. Without headings, all of it."""
    parts = F.filter(F.split(document, r"(?m)(?=^##\s+\S)"), lambda x: x.rlike(r"^##\s+\S"))
    heading = lambda x: F.trim(F.regexp_extract(x, r"^##\s+(.+?)\s*(?:\n|$)", 1))
    named = lambda h: F.when(F.contains(h, F.lit("·")), F.trim(F.regexp_replace(h, "^[^·]*·", ""))).otherwise(h)
    app = lambda x: F.coalesce(F.nullif(named(heading(x)), F.lit("")), default)
    found = F.transform(parts, lambda x: F.struct(app(x).alias("app"), F.regexp_replace(x, r"\s+$", "").alias("body")))
    return F.when(F.size(parts) > 0, found).otherwise(F.array(F.struct(default.alias("app"), document.alias("body"))))
