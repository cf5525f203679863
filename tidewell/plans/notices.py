"""Notices of a dashboard: stage, domain, tags, score and reason, and what a note of changes tells.

A row's fields are searched once each by one dictionary of all tables of keywords; the
domain is then a list of decisions over bit masks. The words hold no spaces, so what a text joined from several fields
holds is what one of the fields holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.keywords import Dictionary, let
from tidewell.plans import releases

#: A domain's keywords, in order of precedence.
DOMAINS = {
    "AI与智能化": ("AI", "AIGC", "大模型", "智能体", "人工智能", "机器学习", "知识库", "智能客服", "语音识别", "OCR", "智能投研", "智能问答", "智能运营"),
    "数据治理与数据平台": ("数据治理", "数据仓库", "数据中台", "数据平台", "湖仓", "数据湖", "指标平台", "主数据", "元数据", "数据质量", "数据资产", "数据集市", "BI", "驾驶舱", "实时数据", "数据交换"),
    "财富管理与客户经营": ("财富管理", "财富CRM", "CRM", "客户画像", "客户运营", "营销平台", "精准营销", "投顾平台", "产品销售", "客户服务"),
    "APP与数字化渠道": ("APP", "移动端", "手机证券", "鸿蒙", "小程序", "互联网金融", "网上交易", "客户端", "数字渠道", "移动应用"),
    "交易、柜台与核心系统": ("交易系统", "核心交易", "柜台", "集中交易", "极速交易", "两融", "融资融券", "期权", "清算", "结算", "估值", "登记结算", "法人清算", "行情交易", "OMS", "订单管理"),
    "网络安全与监管科技": ("信息安全", "网络安全", "数据安全", "防火墙", "态势感知", "漏洞", "渗透测试", "终端安全", "反洗钱", "监管报送", "风险管理", "合规管理", "风控", "灾备", "容灾"),
    "云计算、算力与基础设施": ("服务器", "存储", "算力", "云平台", "云计算", "容器", "虚拟化", "数据库", "操作系统", "交换机", "路由器", "网络设备", "机房", "备份", "硬件设备"),
    "IT运维与技术服务": ("运维", "维保", "驻场", "技术支持", "技术服务", "开发外包", "人员外包", "系统维护", "续保", "续采"),
    "投研资讯与金融数据": ("Wind", "同花顺", "金融数据", "行情数据", "行情系统", "期货行情", "资讯服务", "研报", "投研数据", "舆情", "数据终端", "资讯终端"),
}
#: Keywords of the business that a title or scope names, by domain, in order of precedence.
BUSINESS_DOMAINS = {
    "交易、柜台与核心系统": (
        "交易系统", "交易软件", "交易功能", "交易执行", "交易平台", "交易算法", "交易网关", "连续竞价", "竞价网络", "智能交易", "策略交易", "自营交易", "专业化交易", "快速交易", "交易反演", "条件单",
        "多资产ETF", "ETF", "连板", "核心交易", "柜台", "柜面", "业务受理", "集中交易", "极速交易", "期权", "两融", "融资融券", "清算", "结算", "估值", "登记结算", "登记过户", "法人清算", "行情交易",
        "订单管理", "量化交易", "程序化交易", "固定收益", "固收", "衍生品", "回购", "收益互换", "委托交易", "股票质押", "增减持", "资产证券化", "资产负债", "资负", "场外交易", "OTC", "FICC", "账户及场外",
    ),
    "网络安全与监管科技": (
        "信息隔离墙", "合规系统", "合规管理", "合规", "监管报送", "监管系统", "监管政策", "报送系统", "反洗钱", "风险管理", "风险识别", "风险模型", "信用风险", "授信管理", "风控", "异常交易", "身份信息核验",
        "公安校验", "受益所有人", "安全流量", "CISP", "WAF", "零信任", "上网行为审计", "网页防篡改", "基金风险", "风险加权", "带外管理", "流量分析", "全链路流量", "RiskMetrics", "企业微信", "企微", "会话存档",
    ),
    "APP与数字化渠道": (
        "网厅", "网上开户", "非现场开户", "开户系统", "开户", "移动展业", "移动化", "手机证券", "线上业务办理", "互联网金融", "客户渠道", "客户服务", "客户联络", "小程序", "VTM", "双录", "业务权限", "一站通", "一账通",
        "视频见证",
    ),
    "财富管理与客户经营": (
        "财富管理", "财富管家", "财富", "投顾", "基金投顾", "基金绩效", "基金系统", "获客", "客户经营", "人群洞察", "产品中台", "LiveBOS", "理财", "资管", "资产管理", "信托", "托管", "经纪", "客户托管", "客户画像",
        "客户运营", "股权投资", "投资管理", "产品销售", "产品管理", "产品中心", "基金登记", "基金业务", "私募基金", "资产配置", "TA", "QTrade",
    ),
    "投研资讯与金融数据": (
        "投研", "金融数据", "行情数据", "行情系统", "实时行情", "量化数据", "量化分析", "金融量化", "量化", "投资数据", "研究数据", "市场数据", "债券数据", "数据终端", "投研数据", "实时同步平台", "Dataxone",
    ),
    "投行与资本市场": ("投行", "资本市场", "质控", "底稿", "承销", "保荐", "企业库", "机构库", "金融文档", "文档智能", "智能刷报", "项目库"),
    "AI与智能化": ("智能投研", "智能投顾", "智能审核", "智能风控", "智能解析", "文档解析", "版面解析", "合同智能", "算法交易", "量化算法", "人脸质检"),
    "IT运维与技术服务": ("财务账套", "财务附件自动采集", "财务自动化", "运营自动化", "新意系统", "金证系统", "顶点系统", "恒生系统", "RPA", "DevOps", "XC", "公有云", "云服务", "ORACLE"),
}
#: Terms of capital markets, systems, technical objects and services, and of what is no technology.
CAPITAL_MARKET = ("投行", "资本市场", "质控", "承销", "保荐")
SYSTEMS = ("系统", "平台", "软件", "应用", "数据库", "接口", "引擎", "网关", "终端", "内核", "模块", "助手", "程序化")
OBJECTS = (
    "功能", "总线", "算法", "模型", "节点", "底座", "数据中心", "防火墙", "负载均衡", "超融合", "服务器", "存储", "云平台", "RPA", "WAF", "FIX", "CSTP", "PB", "O32", "A5", "CISP", "Acadia", "OneLink", "Matrix", "XTS",
    "QMT", "ESB", "DevOps", "XC", "FICC", "OTC", "TA", "QTrade", "RiskMetrics", "Dataxone", "Bonree", "CTP", "企点", "金证", "新意", "华锐", "会话存档",
)
SERVICES = (
    "技术服务", "系统服务", "软件服务", "平台服务", "接口服务", "数据服务", "维护服务", "运维服务", "实施服务", "开发服务", "授权服务", "许可服务", "系统维保", "软件维保", "平台维保", "会话存档服务",
)
OTHER_CONTEXT = (
    "装修工程", "装修施工", "物业", "保洁", "安保", "空调", "通风", "消防", "办公", "办公家具", "办公电脑", "办公用房", "办公场地", "办公楼", "办公终端", "办公软件", "信创办公", "WPS", "Adobe", "工会消费券", "人力外包",
    "人力资源", "人事", "招聘", "薪酬", "员工绩效", "绩效考核", "绩效管理", "绩效系统", "部门绩效", "员工活动", "员工福利", "员工信息", "员工管理", "劳动合同", "电子劳动合同", "法务", "法律顾问", "审计服务", "内部审计",
    "财务审计", "税务管理", "财务总账", "财务共享", "智慧财务", "股权激励", "邮件", "邮箱", "电话录音", "录音系统", "会议系统", "会议", "会务", "培训", "比赛", "推广", "推广代理", "营销代理", "营销推广", "营销活动",
    "市场推广", "IP孵化", "巨量引擎", "市场投放", "应用市场", "内容运营", "企小码", "小红书", "公众号", "固定资产", "固定资产管理", "IT资产管理", "资产处置", "不良债权", "承销服务", "主承销商",
)
SOFT_CONTEXT = ("投放", "广告", "广告投放")
OTHER_WORDS = ("工程装修", "物业", "办公用品", "员工活动", "法律服务", "审计服务", "行政采购", "装修", "保洁", "安保", "餐饮", "车辆", "驾驶", "印刷", "广告制作")
#: Tags and the words that give them.
TAGS = {
    "信创": ("信创", "国产化", "国产", "自主可控", "适配"), "AI": ("AI", "AIGC", "大模型", "智能体", "人工智能"), "数据治理": ("数据治理", "数据质量", "主数据", "元数据"), "二期建设": ("二期", "三期", "四期", "第二阶段"),
    "系统升级": ("升级", "改造", "扩容", "优化"), "新建": ("新建", "建设", "构建", "搭建"), "续采": ("续采", "续保", "续费", "延续"), "运维": ("运维", "维保", "维护", "驻场"), "软件采购": ("软件", "License", "授权", "许可"),
    "硬件采购": ("硬件", "服务器", "设备", "采购设备"), "外包服务": ("外包", "驻场", "人员外包", "人力外包"),
}
#: An announcement's stages, and the marks of a result's title.
STAGES = (("流标|废标", "流标废标"), ("结果|中标|成交|候选人公示", "结果公示"), ("采购|招标|询价|供应商招募|单一来源|竞争性谈判", "采购招标"))
RESULT_MARKS = ("结果", "中标", "成交", "中选", "流标", "废标", "终止", "取消")
NOT_TECH, OPERATIONS, CAPITAL, CATEGORY = "非金融科技及其他", "IT运维与技术服务", "投行与资本市场", "IT软硬件"
#: Types of update and their words, tags of features and their words, in order.
UPDATE_TYPES = (
    (("修复", "解决", "已知问题", "修正", "纠正"), "问题修复"), (("安全", "合规", "风控", "加固", "漏洞"), "合规安全"), (("新增", "增加", "上线", "支持", "推出", "发布"), "新功能"), (("优化", "提升", "改进"), "体验优化"),
)
FEATURES = (("行情", "行情"), ("交易", "交易"), ("开户", "开户"), ("理财", "理财"), ("资讯", "资讯"), ("ai", "AI智能"), ("智能", "AI智能"), ("安全", "安全"))

WORDS = Dictionary(
    {f"domain {k}": v for k, v in DOMAINS.items()} | {f"business {k}": v for k, v in BUSINESS_DOMAINS.items()} | {f"tag {k}": v for k, v in TAGS.items()}
    | {"capital": CAPITAL_MARKET, "system": SYSTEMS, "object": SYSTEMS + OBJECTS + SERVICES, "hard": OTHER_CONTEXT, "soft": SOFT_CONTEXT, "other": OTHER_WORDS}
)
STEPS = ("business", "broker", "excluded", "named", "named capital", "other", "domain", "capital", "category", "none")


def domains(rows: DataFrame, title: str, scope: str, subcategory: str, category: str, is_broker: str) -> DataFrame:
    """rows with step (which decision fell), domain, is_fintech and tags.

    Title and scope make the context, all four fields the whole. Nulls are empty; a null is_broker is not known.
    """
    masks = {f"_m_{i}": WORDS.mask(F.col(c)) for i, c in enumerate((title, scope, subcategory, category))}
    rows = rows.withColumns(masks)
    own, context, several = F.col("_m_0"), F.col("_m_0").bitwiseOR(F.col("_m_1")), F.col("_m_0").bitwiseOR(F.col("_m_2"))
    whole = context.bitwiseOR(F.col("_m_2")).bitwiseOR(F.col("_m_3"))
    plain = lambda c: F.regexp_extract(c, "^[a-z]+ (.*)$", 1)
    business = WORDS.first(context, [f"business {k}" for k in BUSINESS_DOMAINS])
    near, wide = (WORDS.first(m, [f"domain {k}" for k in DOMAINS]) for m in (context, whole))
    has = WORDS.has
    hard, soft, thing = has(context, "hard"), has(context, "soft"), has(context, "object")
    broker = F.coalesce(F.col(is_broker), F.lit(False))
    rules = [
        (business.isNotNull() & thing & ~hard, "business", business),
        (broker & has(own, "object") & ~hard & (~soft | business.isNotNull()), "broker", F.coalesce(business, near, F.lit(f"domain {OPERATIONS}"))),
        (hard | soft & (business.isNull() | ~thing), "excluded", None),
        (near.isNotNull() & has(context, "system"), "named", near),
        (has(context, "capital") & has(context, "system"), "named capital", F.lit(f"domain {CAPITAL}")),
        (has(whole, "other"), "other", None),
        (wide.isNotNull(), "domain", wide),
        (has(whole, "capital") & has(whole, "system"), "capital", F.lit(f"domain {CAPITAL}")),
        (F.coalesce(F.trim(F.col(category)) == CATEGORY, F.lit(False)), "category", F.lit(f"domain {OPERATIONS}")),
    ]
    decided = None
    for when, step, domain in rules:
        value = F.struct(F.lit(step).alias("step"), F.lit(NOT_TECH).alias("domain") if domain is None else plain(domain).alias("domain"), F.lit(domain is not None).alias("tech"))
        decided = F.when(when, value) if decided is None else decided.when(when, value)
    decided = decided.otherwise(F.struct(F.lit("none").alias("step"), F.lit(NOT_TECH).alias("domain"), F.lit(False).alias("tech")))
    tags = F.filter(F.array(*[F.when(has(several, f"tag {t}"), F.lit(t)) for t in TAGS]), lambda t: t.isNotNull())
    rows = rows.withColumn("_d", decided)
    return rows.withColumns({"step": F.col("_d.step"), "domain": F.col("_d.domain"), "is_fintech": F.col("_d.tech"), "tags": tags}).drop("_d", *masks)


def stage(c: Column) -> Column:
    return text.ordered_classifier(F.trim(F.coalesce(c, F.lit(""))), list(STAGES), "其他")


def notice_type(title: Column) -> Column:
    return F.when(text.contains_any(F.coalesce(title, F.lit("")), RESULT_MARKS), "result").otherwise("procurement")


def scored(rows: DataFrame, published: str = "published") -> DataFrame:
    """rows (domain, tags, stage, supplier, amount_kind, published: a timestamp) with score and reason, the latest row being today."""
    latest = rows.agg(F.max(published).alias("_latest"))
    ai, core, home, result = F.col("domain") == "AI与智能化", F.col("domain") == "交易、柜台与核心系统", F.array_contains("tags", "信创"), F.col("stage") == "结果公示"
    supplier = F.coalesce(F.col("supplier"), F.lit("")) != ""
    kind = F.coalesce(F.col("amount_kind"), F.lit(""))
    recent = F.coalesce(F.unix_millis("_latest") - F.unix_millis(published) <= 30 * 86_400_000, F.lit(False))
    points = ((ai, 30), (core, 20), (home, 15), (result, 15), (supplier, 10), (kind == "winning", 10), (kind == "budget", 5), (recent, 20))
    reasons = (
        (ai, "近期新增的AI与智能化项目"), (core, "涉及核心交易系统建设"), (home, "具有信创或国产化属性"), (result & supplier, "结果公告已披露供应商"), (kind == "winning", "公告公开披露成交金额"),
        (kind == "budget", "公告公开披露项目预算"),
    )
    score = F.lit(0)
    for fits, n in points:
        score = score + F.when(fits, n).otherwise(0)
    reason = F.coalesce(*[F.when(fits, F.lit(said)) for fits, said in reasons], F.lit("公开招采动态值得关注"))
    return rows.crossJoin(F.broadcast(latest)).withColumns({"score": score, "reason": reason}).drop("_latest")  # one row


def _told_lines(lines: Column) -> Column:
    """array<struct<x, told, low>>: each line as source_line gives it, whether it tells of a change, whether it is worth nothing; all of a line is computed once."""

    def of(x: Column) -> Column:
        told = lambda y, low: F.struct(x.alias("x"), (~F.startswith(x, F.lit("#")) & releases.line_tells_change(y, low)).alias("told"), low.alias("low"))
        return let(releases.source_line(x), lambda y: let(releases.line_low_value(y), lambda low: told(y, low)))

    return F.transform(F.transform(lines, releases.source_line), of)


def _shown_changes(told: Column) -> Column:
    bare = F.transform(F.filter(told, lambda r: r["told"]), lambda r: F.btrim(F.regexp_replace(r["x"], r"https?://\S+|www\.\S+", ""), F.lit(" ，,;；")))
    # lines are told apart whole, then cut to what is shown
    return F.transform(F.array_distinct(F.filter(bare, lambda x: x != "")), lambda x: F.substring(x, 1, 240))


def meaningful_lines(content: Column) -> Column:
    """Lines of content that tell of a change, without list marker and addresses, each once, up to 240 characters."""
    return _shown_changes(_told_lines(F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"\r\n?", "\n"), "\n")))


def update_fields(lines: Column) -> Column:
    """Struct of update_type, feature_tags and highlights that the lines of a note tell, without a model."""

    def of(held: Column, said: Column) -> Column:
        kind = F.coalesce(*[F.when(text.contains_any(said, words), F.lit(name)) for words, name in UPDATE_TYPES], F.lit("其他"))
        tags = F.array_distinct(F.filter(F.array(*[F.when(F.contains(said, F.lit(w)), F.lit(tag)) for w, tag in FEATURES]), lambda t: t.isNotNull()))
        tags = let(tags, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("其他"))))
        return F.struct(kind.alias("update_type"), tags.alias("feature_tags"), F.slice(held, 1, 8).alias("highlights"))

    return let(lines, lambda held: let(F.lower(F.array_join(held, " ")), lambda said: of(held, said)))


#: Evidence of version, date and platform in a note, and headings and labels that are no candidates.
VERSION = r"(?i)(?:版本(?:号)?|version|V)\s*[：:]?\s*[vV]?([0-9]+(?:\.[0-9]+){1,3})"
DATED = r"(?:更新(?:日期|时间)?|发布日期|发布时间)\s*[：:]?\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?|\d{8})"
SYSTEM_NAMES = ("iOS", "Android", "HarmonyOS")
HEADINGS = ("更新说明", "新版特性", "更新内容")
LABELLED = r"^(?:版本|平台|更新日期|日期证据|版本证据|平台证据)\s*[：:]"


def evidence(content: Column) -> Column:
    """Struct of version (all that are named, in order), platform and published (ISO, or empty) that a note's text names."""
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(VERSION), F.lit(1)))
    named = let(F.lower(content), lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in SYSTEM_NAMES]), lambda x: x.isNotNull()))
    one = let(named, lambda held: F.when(F.size(held) > 1, "全平台").otherwise(F.coalesce(F.get(held, F.lit(0)), F.lit(""))))

    def date(said: Column) -> Column:
        forms = [F.to_date(F.try_to_timestamp(x, F.lit(p))) for x in (said, F.substring(said, 1, 10), F.translate(said, "/.", "--")) for p in ("yyyy-M-d", "yyyyMMdd")]
        return F.when(said != "", F.date_format(F.coalesce(*forms), "yyyy-MM-dd"))

    published = F.coalesce(let(F.regexp_extract(content, DATED, 1), date), F.lit(""))
    return F.struct(F.array_join(found, "、").alias("version"), one.alias("platform"), published.alias("published"))


#: What ends a line besides \n and \r.
OTHER_ENDS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def prepared(content: Column) -> Column:
    """Struct of evidence and of content as a model is given it: evidence, lines of change, then what else may tell of one, labelled."""
    named = (("version", "版本证据："), ("platform", "平台证据："), ("published", "日期证据："))

    def whole(told: Column, changes: Column, lines: Column) -> Column:
        fits = F.filter(
            lines,
            lambda r: (r["x"] != "") & ~F.startswith(r["x"], F.lit("#")) & ~r["low"] & ~r["x"].isin(*releases.SOURCE_GENERIC) & ~F.array_contains(changes, r["x"])
            & ~F.rtrim(r["x"], F.lit("：:")).isin(*HEADINGS) & ~r["x"].rlike(LABELLED),
        )
        labelled = F.transform(F.array_distinct(F.transform(fits, lambda r: F.substring(r["x"], 1, 240))), lambda x: F.concat(F.lit("官方更新说明候选："), x))
        heads = F.filter(F.array(*[F.when(told[c] != "", F.concat(F.lit(label), told[c])) for c, label in named]), lambda x: x.isNotNull())
        return F.struct(told.alias("evidence"), F.array_join(F.concat(heads, changes, labelled), "\n").alias("prepared"))

    def of(content: Column, told: Column) -> Column:
        plain = F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n")
        # lines are read once, but where other signs end lines too
        every = lambda held: F.when(content.rlike(OTHER_ENDS), _told_lines(F.split(F.regexp_replace(content, rf"\r\n?|{OTHER_ENDS}", "\n"), "\n"))).otherwise(held)
        return let(_told_lines(plain), lambda held: let(_shown_changes(held), lambda changes: whole(told, changes, every(held))))

    return let(F.coalesce(content, F.lit("")), lambda content: let(evidence(content), lambda told: of(content, told)))


def prepared_content(content: Column) -> Column:
    """What a model is given of a note (see prepared)."""
    return prepared(content)["prepared"]
