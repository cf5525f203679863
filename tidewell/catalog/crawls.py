"""Bodies of sources dispatched to parsers: each supplier is a source whose body is put together from its own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.sources import crawl
from tidewell.sources.shared import fresh_folder

PARSERS = [*crawl.JSON_PARSERS, *crawl.HTML_PARSERS, "other"]
OPTIONS = {
    "store": {"track_id": "7", "app": "App"}, "software": {"item_id": "5"}, "software_repaired": {"item_id": "5"}, "groups": {"groups": {"iOS": "ios", "Android": "android"}}, "clients": {"clients": ["phone"]},
    "by_app": {"app_ids": {"One": "1", "Two": "2"}}, "sections": {"headings": ["更新 说明", "没有"]}, "downloads": {"apps": ["App"]},
    "cards": {"apps": ["A pp"], "card": "div.card", "name": ".name", "content": ".body", "excluded": ["大小"]},
}


def _body(name: Column, key: Column) -> Column:
    """A supplier's body: by its key's remainder one of the forms; some are broken, some lack what is asked for."""
    lit = lambda x: F.lit(x)
    ver = F.concat(lit("1."), key.cast("string"))
    lacks = key % 3 == 0
    wrong = F.when(lacks, lit("9"))
    js = F.to_json
    one = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    app = one(chName=name, versionName=ver, createTime=lit("2024-03-04 05:06"), downInfo=F.array(one(type=F.when(lacks, lit("win")).otherwise(lit("Android")))))
    forms = [
        js(one(results=F.array(one(trackId=lit("6"), version=lit("0"), currentVersionReleaseDate=lit(""), releaseNotes=lit("")), one(trackId=F.coalesce(wrong, lit("7")), version=ver, currentVersionReleaseDate=lit("2024-01-02T03:04:05Z"), releaseNotes=name)))),
        js(one(data=F.array(one(id=F.coalesce(wrong, lit("5")), swName=name, newFeatureFull=lit("full"), newFeature=lit("new"), softUpdateDate=lit("2024-02-03"))))),
        js(one(data=F.array(one(id=F.coalesce(wrong, lit("5")), swName=F.concat(lit("Ã©"), name), newFeature=lit("n"))))),
        js(one(iOS=one(name=name, version=ver, date=lit("2024-04-05"), notes=lit("n")))),
        js(one(data=F.array(one(categoryName=lit("c"), appList=F.array(app))))),
        js(one(data=one(ios=F.array(one(name=name, ver=ver, time=lit("2024-05-06 01:01"), remark=lit("r")))))),
        js(one(data=F.array(one(adaptClient=F.when(lacks, lit("pc")).otherwise(lit(" phone ")), downloadName=name, softUpdateTime=lit("2024-06-07"), updateExplain=lit("u"))))),
        js(one(results=F.array(one(softid=lit("1"), title=lit("old"), version=lit("0"), modify_date=lit(""), content=lit("")), one(softid=lit("1"), title=name, version=ver, modify_date=lit("2024-07-08"), content=lit("c"))))),
        js(one(data=one(records=F.array(one(content=F.concat(lit("<div class='so-download-cont'><h2>APP "), name, lit("</h2>t<a href='"), F.when(lacks, lit("u.exe")).otherwise(lit("u.apk")), lit("'>立即下载</a></div>"))))))),
        F.concat(lit("<div><h2>更新  <b>说明</b></h2><p>"), name, lit("</p><h3>更多</h3><p>b</p><h2>别的</h2><p>c</p></div>")),
        F.concat(lit("<ul><li><b>App</b> 2024-08-09更新 软件介绍："), name, lit(" <a>IOS下载</a></li><li>App 软件介绍：x</li></ul>")),
        F.concat(lit('<div class="card"><p class="name">B</p><p class="body">x</p></div><div class="big card"><i class="name">A p p</i><div class="body"><p>'), name, lit("</p><p>大小：1</p></div></div>")),
        lit(""),
    ]
    body = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(forms))):
        body = F.when(key % len(forms) == i, form).otherwise(body)
    return F.when(key % 7 == 0, lit("{broken")).otherwise(body)


@query(f"""
WITH s AS (SELECT s_suppkey, s_suppkey::VARCHAR AS source, s_name AS name, '1.' || s_suppkey AS ver, s_suppkey % 3 = 0 AS lacks, s_suppkey % 7 = 0 AS broken, {PARSERS}[(s_suppkey % {len(PARSERS)} + 1)::INT] AS parser FROM supplier WHERE s_suppkey % 10 <> 3),
j AS (SELECT * FROM s WHERE NOT broken AND parser NOT IN ('sections', 'downloads', 'cards', 'other'))
SELECT source, parser, '' AS item, '' AS platform, '' AS version, NULL::DATE AS released, '' AS notes, 'unreadable body' AS error FROM s WHERE broken AND parser NOT IN ('sections', 'downloads', 'cards', 'other')
UNION ALL SELECT source, parser, '', '', '', NULL, '', 'nothing found' FROM j WHERE lacks AND parser IN ('store', 'software', 'software_repaired', 'menu', 'clients')
UNION ALL SELECT source, parser, 'App', '', ver, DATE '2024-01-02', name, NULL FROM j WHERE parser = 'store' AND NOT lacks
UNION ALL SELECT source, parser, name, '', '', DATE '2024-02-03', 'full' || chr(10) || 'new', NULL FROM j WHERE parser = 'software' AND NOT lacks
UNION ALL SELECT source, parser, 'é' || name, '', '', NULL, 'n', NULL FROM j WHERE parser = 'software_repaired' AND NOT lacks
UNION ALL SELECT source, parser, CASE WHEN p = 'iOS' THEN name ELSE '' END, p, CASE WHEN p = 'iOS' THEN ver ELSE '' END, CASE WHEN p = 'iOS' THEN DATE '2024-04-05' END, CASE WHEN p = 'iOS' THEN 'n' ELSE '' END, CASE WHEN p <> 'iOS' THEN 'no platform ' || p END
  FROM j, (VALUES ('iOS'), ('Android'), ('HarmonyOS')) AS t(p) WHERE parser = 'platforms'
UNION ALL SELECT source, parser, name, '', ver, DATE '2024-03-04', 'c', NULL FROM j WHERE parser = 'menu' AND NOT lacks
UNION ALL SELECT source, parser, name, 'iOS', ver, DATE '2024-05-06', 'r', NULL FROM j WHERE parser = 'groups'
UNION ALL SELECT source, parser, '', 'Android', '', NULL, '', 'no group android' FROM j WHERE parser = 'groups'
UNION ALL SELECT source, parser, name, '', '', DATE '2024-06-07', 'u', NULL FROM j WHERE parser = 'clients' AND NOT lacks
UNION ALL SELECT source, parser, name, '', ver, DATE '2024-07-08', 'c', NULL FROM j WHERE parser = 'by_app'
UNION ALL SELECT source, parser, 'Two', '', '', NULL, '', 'no app Two' FROM j WHERE parser = 'by_app'
UNION ALL SELECT source, parser, CASE WHEN lacks THEN '' ELSE 'APP ' || name END, '', '', NULL, CASE WHEN lacks THEN '' ELSE 't' || chr(10) || chr(10) || '- 下载：u.apk' END, CASE WHEN lacks THEN 'no mobile app' END FROM j WHERE parser = 'articles'
UNION ALL SELECT source, parser, '更新 说明', '', '', NULL, CASE WHEN broken THEN '' ELSE name || chr(10) || chr(10) || '### 更多' || chr(10) || chr(10) || 'b' END, CASE WHEN broken THEN 'no heading 更新 说明' END FROM s WHERE parser = 'sections'
UNION ALL SELECT source, parser, '没有', '', '', NULL, '', 'no heading 没有' FROM s WHERE parser = 'sections'
UNION ALL SELECT source, parser, 'App', CASE WHEN broken THEN '' ELSE 'iOS' END, '', CASE WHEN NOT broken THEN DATE '2024-08-09' END, CASE WHEN broken THEN '' ELSE name END, CASE WHEN broken THEN 'no app App' END FROM s WHERE parser = 'downloads'
UNION ALL SELECT source, parser, 'A pp', '', '', NULL, CASE WHEN broken THEN '' ELSE name END, CASE WHEN broken THEN 'no app A pp' END FROM s WHERE parser = 'cards'
UNION ALL SELECT source, parser, '', '', '', NULL, '', 'no parser other' FROM s WHERE parser = 'other'""")
def crawl_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources in use, their bodies stored by parser, each read by its own one into the same columns."""
    key = F.col("s_suppkey")
    names = F.array(*[F.lit(p) for p in PARSERS])
    catalog = table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("source"), F.when(key % 10 == 3, F.lit(False)).when(key % 2 == 0, F.lit(True)).alias("enabled"),
        F.element_at(names, (key % len(PARSERS) + 1).cast("int")).alias("parser"), _body(F.col("s_name"), key).alias("body"),
    )
    path = fresh_folder(spark, "bodies")
    crawl.planned(catalog).select("source", "parser", "body").write.partitionBy("parser").parquet(path)
    return crawl.dispatched(spark.read.schema("source string, body string, parser string").parquet(path), OPTIONS)
