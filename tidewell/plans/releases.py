"""App releases: low-value notes filtered, keys normalized, events folded into one row a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text, values
from tidewell.functions.keywords import let

#: Words of change, verbs, patterns of metadata.
CHANGE_WORDS = (
    "新增", "增加", "新功能", "全新", "新版本", "上线", "推出", "支持", "优化", "提升", "改进", "升级", "修复", "解决", "调整", "完善", "改版", "适配", "兼容", "重构", "增强", "恢复",
    "移除", "下线", "更新", "改造", "替换", "补充", "修正", "安全", "合规", "风控", "体验", "提速", "流畅", "稳定", "性能", "卡顿", "崩溃", "焕新",
    "add", "support", "improv", "fix", "upgrad", "enhanc", "compatib", "refactor", "remove",
)
VERBS = "(?i)(?:修复|解决|新增|上线|支持|优化|升级|适配|改进|enhanc|fix|add|support|improv)"
LOW_VALUE = (
    r"(?i)^(?:[-*•]\s*)?(?:运行环境|系统要求|支持语言|适用客户|文件大小|下载地址|下载链接|md5(?:值)?|开发者|官方网站|官网|官方微信|热线电话|联系电话|联系方式)\s*[：:]",
    r"(?i)^(?:需要|支持)\s*(?:ios|android|安卓|苹果|鸿蒙|harmonyos)\s*[\d.]+", r"(?i)^(?:https?://|ftp://|www\.)",
    r"(?i)^(?:[-*•]\s*)?(?:本软件|本产品|本应用).{0,40}(?:是一款|为用户提供|致力于|专注于提供)", r"(?i)(?:手机版智能炒股软件|股票交易平台|一站式服务|专注于提供|欢迎.*联系)",
)
#: What a client shows as it is.
SHOWN_LOW_VALUE = (
    r"(?i)^(?:[-*]\s*)?(?:运行环境|系统要求|支持语言|适用客户|文件大小|下载地址|下载链接|md5|开发者|官方网站|官方微信|热线电话)\s*[：:]",
    r"(?i)^(?:需要|支持)\s*(?:iOS|Android|安卓|鸿蒙|HarmonyOS)\s*[\d.]+", r"(?i)(?:手机版智能炒股软件|股票交易平台|一站式服务|专注于提供|欢迎.*联系)",
)
#: Lines of a source that are metadata or promotion, and those that tell of a change.
SOURCE_LOW_VALUE = (
    "运行环境", "系统要求", "系统版本", "发布日期", "发布时间", "更新时间", "更新日期", "支持语言", "适用客户", "适用对象", "文件大小", "下载地址", "下载链接", "安装包", "校验码", "联系方式",
    "联系电话", "客服电话", "客服热线", "邮箱", "二维码", "截图", "产品介绍", "软件介绍", "本应用", "本软件", "该应用", "该软件", "是一款", "为您提供", "为投资者提供", "为客户提供", "服务平台",
    "一站式", "集交易", "足不出户", "丰富功能", "始终坚持", "以客户为中心", "让投资更简单", "邀您体验", "全新投资工具", "福利已就位", "财富赢家", "欢迎使用", "致力于",
)
SOURCE_CHANGES = (
    "新增", "新功能", "增加", "上线", "推出", "发布", "优化", "提升", "改进", "升级", "增强", "调整", "修复", "解决", "修正", "纠正", "已知问题", "安全", "合规", "风控", "加固", "漏洞", "性能",
)
SOURCE_GENERIC = (
    "新增功能", "版本升级", "优化体验", "问题修复", "更新内容", "其他若干优化", "若干优化", "多项细节优化", "优化多项细节体验", "功能使用体验优化", "安全版本", "修复已知问题", "修复线上问题",
    "技术优化及线上问题修复",
)
SOURCE_SYSTEM = (
    r"^(?:运行环境|系统要求|需要|支持|兼容)?[^。；;]{0,24}(?:ios|android|harmonyos|安卓|苹果)[^。；;]{0,24}(?:版本|以上|以下|及更高|及以上|[0-9]+(?:\.[0-9]+){0,2})"
)
#: Names of platforms, the order of types of update, what a client takes for a change.
PLATFORMS = {
    "安卓": "Android", "android": "Android", "android手机": "Android", "苹果": "iOS", "ios": "iOS", "iphone": "iOS", "ipad": "iOS", "鸿蒙": "HarmonyOS", "harmony": "HarmonyOS", "harmonyos": "HarmonyOS",
    "windows": "Windows", "win": "Windows", "mac": "macOS", "macos": "macOS", "网页": "Web", "web": "Web", "h5": "Web", "未知": "未知",
}
UPDATE_TYPES = ("新功能", "体验优化", "问题修复", "合规安全", "其他")
SHOWN_CHANGE = "新增|增加|上线|推出|支持|优化|提升|改进|升级|修复|解决|调整|完善|改版|安全|合规|风控"
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyyMMdd", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sXX", "yyyy-M-d'T'H:m:s")
UNKNOWN, EVERY = "未知", "全平台"
#: A broker's other names.
BROKERS = {
    "国泰海通": "国泰海通证券", "国泰海通证券股份有限公司": "国泰海通证券", "国泰君安": "国泰海通证券", "国泰君安证券": "国泰海通证券", "国泰君安证券股份有限公司": "国泰海通证券", "海通证券": "国泰海通证券",
    "海通证券股份有限公司": "国泰海通证券", "中银国际": "中银国际证券", "中银国际证券有限责任公司": "中银国际证券", "中银国际证券股份有限公司": "中银国际证券", "中信建投": "中信建投证券",
    "中信建投证券股份有限公司": "中信建投证券", "中国银河": "中国银河证券", "中国银河证券股份有限公司": "中国银河证券", "中金财富": "中金财富证券", "中国中金财富证券有限公司": "中金财富证券",
    "光大证券股份有限公司": "光大证券", "南京证券股份有限公司": "南京证券", "申万宏源": "申万宏源证券", "申万宏源证券有限公司": "申万宏源证券", "国联证券": "国联民生证券", "国联证券股份有限公司": "国联民生证券",
    "民生证券": "国联民生证券", "民生证券股份有限公司": "国联民生证券", "安信证券": "国投证券", "安信证券股份有限公司": "国投证券", "华融证券": "国新证券", "华融证券股份有限公司": "国新证券", "新时代证券": "诚通证券",
    "新时代证券股份有限公司": "诚通证券",
}


def canonical_text(c: Column) -> Column:
    """Spaces collapsed, leading list signs off."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(bare, r"^(?:[-*•]\s*)+", ""))


def _scored(c: Column, of) -> Column:
    """of(text as it is shown, number of words of change in it, whether it is worth nothing): too short, metadata or promotion, or without any word of change."""

    def told(x: Column, hits: Column) -> Column:
        low = (F.length(x) < 2) | (hits == 0)
        for p in LOW_VALUE:
            low = low | x.rlike(p)
        return let(low, lambda is_low: of(x, hits, is_low))

    words = F.array(*[F.lit(w) for w in CHANGE_WORDS])
    return let(canonical_text(c), lambda x: let(F.size(let(F.lower(x), lambda low: F.filter(words, lambda w: F.contains(low, w)))), lambda hits: told(x, hits)))


def low_value(c: Column) -> Column:
    """Too short, metadata or promotion, or without any word of change."""
    return _scored(c, lambda x, hits, low: low)


def update_score(c: Column) -> Column:
    """A point for each ten characters up to 180, ten for each word of change, eight for a verb of change; -100 for what is worth nothing."""
    points = lambda x, hits: F.floor(F.least(F.length(x), F.lit(180)) / 10).cast("int") + hits * 10 + F.when(x.rlike(VERBS), 8).otherwise(0)
    return _scored(c, lambda x, hits, low: F.when(low, F.lit(-100)).otherwise(points(x, hits)))


def shown(c: Column) -> Column:
    """Whether a client shows a text: there is one, and no pattern of metadata fits."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    said = x == ""
    for p in SHOWN_LOW_VALUE:
        said = said | x.rlike(p)
    return ~said


def source_line(c: Column) -> Column:
    """A line without its list marker, spaces collapsed."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*(?:[-*•·]\s*|\d+[.)、]\s*)", "")), r"\s+", " ")


def line_low_value(x: Column) -> Column:
    """source_low_value of a line as source_line gives it."""

    def of(x: Column, low: Column, meaning: Column) -> Column:
        others = F.length(x) - F.length(meaning)
        return (
            (x == "") | text.contains_any(low, tuple(w.lower() for w in SOURCE_LOW_VALUE)) | low.rlike(SOURCE_SYSTEM)
            | low.rlike(r"https?://|www\.|(?:^|[：:]|\s)md5(?:$|[：:]|\s)") | (low.rlike(r"[0-9a-f]{24,}") & ~low.rlike(r"(?<![\p{L}\p{N}_])\d+(?:\.\d+){1,3}(?![\p{L}\p{N}_])"))
            | (F.length(meaning) < 2) | meaning.rlike(r"^(.)\1*$") | ((others > 2 * F.length(meaning)) & (F.length(x) > 8))
        )

    bare = lambda x: F.regexp_replace(x, r"[^A-Za-z0-9\u3400-\u9fff]", "")
    return let(F.struct(F.lower(x).alias("low"), bare(x).alias("meaning")), lambda s: of(x, s["low"], s["meaning"]))


def source_low_value(c: Column) -> Column:
    """A source's line of metadata or promotion, or what is left of unreadable signs."""
    return let(source_line(c), line_low_value)


def line_tells_change(x: Column, low_value: Column) -> Column:
    """tells_change of a line as source_line gives it, of which low_value is known."""
    supports = (F.length(x) <= 120) & x.rlike("^(?:支持|现已支持|现在支持|正式支持)") & ~text.contains_any(x, ("系统", "语言", "客户", "版本"))
    return ~low_value & ~x.isin(*SOURCE_GENERIC) & (text.contains_any(x, SOURCE_CHANGES) | supports)


def tells_change(c: Column) -> Column:
    """Whether a source's line tells of a change: a word of change, or a short sentence on what is now supported."""
    return let(source_line(c), lambda x: line_tells_change(x, line_low_value(x)))


RELEASE_TEXTS = ("app_name", "app_version", "platform", "publish_date", "update_type", "update_summary")
RELEASE_LISTS = ("feature_tags", "highlights")
RELEASE_DEFAULTS = {"platform": "未知", "update_type": "其他"}


def release_items(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """rows with a model's answer -> one row an item: the other columns, item (from 0), the release's fields, error.

    An answer is a list of items, an object that holds them under releases, or one item. An
    item that is no object gives an error row, as does an answer of another kind (item null); what
    can be read beside it stays. Fields that are missing take their defaults, null texts are "".
    """
    kept = [c for c in rows.columns if c != answer]
    read = rows.select(F.struct(*kept).alias("row"), values.outermost_json(F.col(answer)).alias("v"))
    kind = F.schema_of_variant(F.col("v"))
    is_list, is_object = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)), F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    inner = F.try_variant_get("v", "$.releases", "variant")
    inner_list = F.coalesce(F.startswith(F.schema_of_variant(inner), F.lit("ARRAY")), F.lit(False))
    items = (
        F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).when(is_object & inner_list, F.try_variant_get("v", "$.releases", "array<variant>"))
        .when(is_object & inner.isNull(), F.array("v"))
    )
    good = read.withColumn("items", items).where("items IS NOT NULL").select("row", F.posexplode("items").alias("item", "v"))
    bad = read.withColumn("items", items).where("items IS NULL").select("row", F.lit(None).cast("int").alias("item"), F.lit(None).cast("variant").alias("v"))
    out = good.unionByName(bad)
    valid = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    error = F.when(F.col("item").isNull(), F.lit("answer holds no releases")).when(~valid, F.concat(F.lit("item["), F.col("item").cast("string"), F.lit("] is no object")))

    def field(name: str) -> Column:
        there = F.exists(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")), lambda k: k == name)
        value = F.when(there, F.trim(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))).otherwise(RELEASE_DEFAULTS.get(name, ""))
        return F.when(valid, value).alias(name)

    def strings(name: str) -> Column:
        several, one = F.try_variant_get("v", f"$.{name}", "array<string>"), F.trim(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
        parts = F.transform(F.coalesce(several, F.array(one)), lambda x: F.trim(F.coalesce(x, F.lit(""))))
        return F.when(valid, F.filter(parts, lambda x: x != "")).alias(name)

    return out.select("row.*", "item", *map(field, RELEASE_TEXTS), *map(strings, RELEASE_LISTS), error.alias("error"))


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def platform(c: Column) -> Column:
    """A platform's own name for any of its names, compatibility forms and spaces aside; other names as they are."""
    named = text.nfkc(F.coalesce(c, F.lit("")))
    known = F.try_element_at(_map(PLATFORMS), F.lower(F.regexp_replace(named, r"\s+", "")))
    return F.coalesce(known, F.nullif(named, F.lit("")), F.lit(UNKNOWN))


def version_key(c: Column) -> Column:
    """A version in compatibility form without 版本 or 版本号 and then without v before it, spaces out, lower case."""
    bare = F.regexp_replace(text.nfkc(F.coalesce(c, F.lit(""))), r"^版本(?:号)?\s*[:：]?\s*", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^[vV]\s*", ""), r"\s+", ""))


def app_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text.nfkc(F.coalesce(c, F.lit(""))), r"\s+", " ")))


def broker(name: Column) -> Column:
    """The name a broker goes by now."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    return F.coalesce(F.try_element_at(_map(BROKERS), bare), bare)


def broker_key(code: Column, name: Column) -> Column:
    """code:… where there is a code, which is the strongest identity, else broker:… by the present name."""
    known = F.lower(F.regexp_replace(text.nfkc(F.coalesce(code, F.lit(""))), r"\s+", ""))
    return F.when(known != "", F.concat(F.lit("code:"), known)).otherwise(F.concat(F.lit("broker:"), F.lower(broker(name))))


def package_url(c: Column) -> Column:
    """An address that a package may hold: http(s), without credentials, not of this machine, without a crawler's path; else empty."""
    url = F.trim(F.coalesce(c, F.lit("")))
    local = url.rlike(r"^(?i:https?)://(?i:localhost|127\.0\.0\.1|\[::1\])(?:[:/?#]|$)") | url.rlike(r"(?i)(?<![A-Za-z0-9])(?:[a-z]:[\\/]|/(?:Volumes|Users|home|app)/)")
    return F.when(url.rlike(r"^(?i:https?)://[^/?#@]+(?:[/?#]|$)") & ~local, url).otherwise("")


def package_date(c: Column) -> Column:
    """A date in any of the known forms, with - / . or 年月日 between, as ISO; else empty."""
    x = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    read = values.parse_date(F.regexp_replace(F.translate(x, "/年月日", "---"), r"^(\d+)\.(\d+)\.(\d+)", "$1-$2-$3"), DATE_FORMATS)
    return F.coalesce(F.date_format(read, "yyyy-MM-dd"), F.lit(""))


def told_apart(c: Column) -> Column:
    """What tells two notes apart: no spaces, no punctuation, no case."""
    return F.lower(F.regexp_replace(c, r"[\s，。；;、,:：.!！?？]+", ""))


def snapshot_key(row: dict[str, Column]) -> Column:
    """Key of a release without a version: broker, app, platform, date and address, and its content's hash, or else a digest of all it says."""
    said = F.to_json(F.struct(
        row["version"].alias("app_version"), F.array_sort(row["tags"]).alias("feature_tags"), F.array_sort(row["highlights"]).alias("highlights"), row["url"].alias("source_url"),
        row["summary"].alias("update_summary"), row["kind"].alias("update_type"),
    ))
    own = F.when(row["sha"] != "", F.concat(F.lit("hash:"), F.lower(row["sha"]))).otherwise(F.concat(F.lit("digest:"), F.sha2(said, 256)))
    return F.concat_ws("|", F.lit("unversioned"), row["broker"], row["app"], F.lower(row["platform"]), row["date"], row["url"], own)


RECORD = ("broker_code", "broker_name", "app_name", "source_url", "content_sha256", "crawl_time", "app_version", "platform", "publish_date", "update_type", "update_summary", "processed_at")


def folded(rows: DataFrame, most: int = 5) -> DataFrame:
    """One row a release of rows with RECORD's columns (texts), feature_tags and highlights (arrays of text).

    Rows of one broker, app and version are one release, whatever their platform or date; rows
    without a version are one only if all they hold agrees (see snapshot_key). The best row by
    the score of its summary, then of its highlights, then its date, hash and address stands for the
    release; the best summary, and the ``most`` best highlights that differ in more than
    punctuation, come from all its rows. Rows without broker, app and summary fall out. Where dates tie, the later crawl is the latest.
    """
    clean = {c: canonical_text(F.col(c)) for c in ("app_name", "app_version", "update_summary")}
    trimmed = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("broker_code", "content_sha256", "crawl_time", "processed_at")}
    listed = {c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "") for c in ("feature_tags", "highlights")}
    rows = rows.withColumns({
        **clean, **trimmed, **listed, "source_url": package_url(F.col("source_url")), "broker_name": broker(F.col("broker_name")), "platform": platform(F.col("platform")),
        "publish_date": package_date(F.col("publish_date")),
        "update_type": F.coalesce(F.nullif(canonical_text(F.col("update_type")), F.lit("")), F.lit("其他")), "_kind": canonical_text(F.col("update_type")),
        "_broker": broker_key(F.col("broker_code"), F.col("broker_name")), "_app": app_key(clean["app_name"]), "_version": version_key(F.col("app_version")),
    }).where("broker_name <> '' OR broker_code <> '' OR app_name <> '' OR update_summary <> ''")
    each = lambda c: F.transform(F.col(c), canonical_text)
    whole = {
        "version": F.col("_version"), "tags": each("feature_tags"), "highlights": each("highlights"), "url": F.col("source_url"), "summary": F.col("update_summary"), "kind": F.col("_kind"),
        "sha": F.col("content_sha256"), "broker": F.col("_broker"), "app": F.col("_app"), "platform": F.col("platform"), "date": F.col("publish_date"),
    }
    key = F.when(F.col("_version") != "", F.concat_ws("|", F.lit("versioned"), "_broker", "_app", "_version")).otherwise(snapshot_key(whole))
    best = F.coalesce(F.array_max(F.transform("highlights", update_score)), F.lit(-100))
    rows = rows.withColumns({"_key": key, "_s": update_score(F.col("update_summary")), "_h": best})
    # notes are ranked as rows, so that only the few that stay meet in one
    notes = rows.select("_key", F.explode("highlights").alias("_t")).withColumn("_t", canonical_text(F.col("_t")))
    # a release's rows repeat its notes, which are scored once each
    notes = notes.distinct().withColumn("_n", update_score(F.col("_t"))).where("_n > -100")
    notes = notes.groupBy("_key", told_apart(F.col("_t")).alias("_same")).agg(F.min(F.struct((-F.col("_n")).alias("s"), F.col("_t").alias("t"))).alias("_note"))
    # one more than asked for, as one may be the summary
    notes = notes.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("_note"))).where(F.col("_k") <= most + 1)
    notes = notes.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list("_note")), lambda r: r["t"]).alias("_notes"))
    record = F.struct(*RECORD, F.col("_version"))
    rank = F.array_position(F.array(*[F.lit(t) for t in UPDATE_TYPES]), F.col("update_type"))
    typed = F.struct(F.when(rank > 0, rank).otherwise(len(UPDATE_TYPES) + 1).alias("r"), F.col("update_type").alias("t"))
    dated = F.struct("publish_date", "crawl_time", "processed_at")
    tags = rows.select("_key", F.explode(each("feature_tags")).alias("_t")).where("_t <> ''").groupBy("_key").agg(F.sort_array(F.collect_set("_t")).alias("feature_tags"))
    folds = rows.groupBy("_key").agg(
        F.max_by(record, F.struct("_s", "_h", "publish_date", "content_sha256", "source_url")).alias("r"), F.min(F.nullif("_version", F.lit(""))).alias("v"),
        F.max(F.when(F.col("publish_date") != "", dated)).alias("d"), F.min(F.nullif("content_sha256", F.lit(""))).alias("sha"), F.min(F.nullif("source_url", F.lit(""))).alias("url"),
        F.min(F.when((F.col("_s") >= 0) | (F.col("_h") >= 0), typed))["t"].alias("kind"), F.min(F.when(F.col("_s") > -100, F.struct((-F.col("_s")).alias("s"), F.col("update_summary").alias("t"))))["t"].alias("said"),
        F.min(F.nullif("platform", F.lit(UNKNOWN))).alias("p1"), F.max(F.nullif("platform", F.lit(UNKNOWN))).alias("p2"), F.count("*").alias("n_merged"),
    )
    empty = F.array().cast("array<string>")
    out = folds.join(notes, "_key", "left").join(tags, "_key", "left").withColumns({"_notes": F.coalesce("_notes", empty), "feature_tags": F.coalesce("feature_tags", empty)})
    summary = F.coalesce("said", F.get("_notes", F.lit(0)), F.lit(""))
    out = out.withColumns({
        "update_summary": summary, "highlights": F.slice(F.filter("_notes", lambda x: x != summary), 1, most), "broker_code": F.col("r.broker_code"),
        "broker_name": F.coalesce(F.nullif("r.broker_name", F.lit("")), "r.broker_code"), "app_name": F.col("r.app_name"), "source_url": F.coalesce(F.nullif("r.source_url", F.lit("")), "url", F.lit("")),
        "content_sha256": F.coalesce(F.nullif("r.content_sha256", F.lit("")), "sha", F.lit("")), "crawl_time": F.coalesce("d.crawl_time", "r.crawl_time"), "app_version": F.coalesce("v", "r.app_version"),
        "platform": F.when(F.col("p1") != F.col("p2"), EVERY).otherwise(F.coalesce("p1", F.lit(UNKNOWN))), "publish_date": F.coalesce("d.publish_date", F.lit("")), "update_type": F.coalesce("kind", F.lit("其他")),
        "processed_at": F.coalesce("d.processed_at", "r.processed_at"), "id": F.concat(F.lit("app-"), F.sha2("_key", 256)),
    })
    said = F.concat_ws("\n", "broker_name", "broker_code", "app_name", "app_version", "update_summary", "update_type", F.array_join("feature_tags", " "), F.array_join("highlights", " "))
    return out.select("id", F.col("_key").alias("release_key"), *RECORD, "feature_tags", "highlights", F.lower(said).alias("search_text"), "n_merged")


def shown_score(c: Column) -> Column:
    """A client's score of a note: its length, words of change and digits; -100 for what it doesn't show."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(~shown(x), F.lit(-100.0)).otherwise(F.least(F.length(x), F.lit(120)) / 30 + F.when(x.rlike(f"(?i){SHOWN_CHANGE}"), 8).otherwise(0) + F.when(x.rlike(r"[0-9]"), 1).otherwise(0))


def shown_folded(records: DataFrame, most: int = 5) -> DataFrame:
    """A client's fold of records (as folded gives them; n_merged may be absent): one row a broker, app and version.

    Records without a version stay as they are. The record with the best summary, then the best highlight,
    then the latest date stands for the release; of ties, the one with the smallest id. Its date is the latest one's.
    """
    version = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("app_version", F.lit(""))), r"^[vV]\s*", ""), r"\s+", ""))
    named = F.lower(F.trim(F.coalesce(F.nullif("broker_code", F.lit("")), "broker_name")))
    own = F.concat_ws("||", F.concat(F.lit("versioned:"), named), F.lower(F.regexp_replace(F.trim("app_name"), r"\s+", " ")), version)
    merged = F.col("n_merged") if "n_merged" in records.columns else F.lit(1)
    best = F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform("highlights", shown_score))), F.lit(0.0))
    rows = records.withColumns({"_key": F.when(version == "", F.concat(F.lit("unversioned:"), F.col("id"))).otherwise(own), "_s": shown_score(F.col("update_summary")), "_h": best, "_m": merged})
    first = F.struct((-F.col("_s")).alias("s"), (-F.col("_h")).alias("h"), (-F.coalesce(F.unix_date(F.to_date(F.nullif("publish_date", F.lit("")))), F.lit(0))).alias("d"), "id")
    folds = rows.groupBy("_key").agg(
        F.min_by(F.struct("broker_code", "broker_name", "app_name", "app_version", "platform", "update_type"), first).alias("r"), F.max("publish_date").alias("publish_date"), F.sum("_m").alias("n_merged"),
        F.min(F.when(F.col("_s") > -100, F.struct((-F.col("_s")).alias("s"), "id", "update_summary")))["update_summary"].alias("said"),
        F.min(F.nullif(F.nullif("platform", F.lit(UNKNOWN)), F.lit(""))).alias("p1"), F.max(F.nullif(F.nullif("platform", F.lit(UNKNOWN)), F.lit(""))).alias("p2"),
    )
    notes = rows.select("_key", F.explode("highlights").alias("_t")).withColumn("_t", F.trim(F.regexp_replace("_t", r"\s+", " "))).distinct().withColumn("_n", shown_score(F.col("_t"))).where("_n > -100")
    notes = notes.join(folds.select("_key", "said"), "_key").where("said IS NULL OR _t <> said").withColumn("_note", F.struct((-F.col("_n")).alias("s"), F.col("_t").alias("t")))
    notes = notes.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("_note"))).where(F.col("_k") <= most)
    notes = notes.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list("_note")), lambda r: r["t"]).alias("highlights"))
    tags = rows.select("_key", F.explode("feature_tags").alias("_t")).groupBy("_key").agg(F.sort_array(F.collect_set("_t")).alias("feature_tags"))
    out, empty = folds.join(notes, "_key", "left").join(tags, "_key", "left"), F.array().cast("array<string>")
    return out.select(
        F.col("_key").alias("id"), "r.broker_code", "r.broker_name", "r.app_name", "r.app_version",
        F.when(F.col("p1") != F.col("p2"), EVERY).otherwise(F.coalesce("p1", F.nullif("r.platform", F.lit("")), F.lit(UNKNOWN))).alias("platform"), "publish_date", "r.update_type",
        F.coalesce("said", F.lit("")).alias("update_summary"), F.coalesce("highlights", empty).alias("highlights"), F.coalesce("feature_tags", empty).alias("feature_tags"), "n_merged",
    )
