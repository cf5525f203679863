"""Parsers of JSON payloads, as projections: each takes a column of response bodies and gives rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text, values


def store_lookup(df: DataFrame, body: str, track_id: Column | None = None) -> DataFrame:
    """The result of the configured track id (the first one if none is set): version, released, notes."""
    schema = "results array<struct<trackId:string,trackName:string,version:string,currentVersionReleaseDate:string,releaseNotes:string>>"
    results = F.from_json(F.col(body), schema)["results"]
    found = F.filter(results, lambda x: x["trackId"] == track_id) if track_id is not None else results
    one = F.get(found, 0)
    out = df.withColumn("_r", one).where("_r IS NOT NULL AND coalesce(_r.version, '') <> ''")
    return out.select("*", F.col("_r.version").alias("version"), F.to_date(F.substring("_r.currentVersionReleaseDate", 1, 10)).alias("released"), F.col("_r.releaseNotes").alias("notes")).drop("_r")


def software_list(df: DataFrame, body: str, item_id: str) -> DataFrame:
    """The first item with the id: name, sections, released."""
    schema = "data array<struct<id:string,swName:string,newFeatureFull:string,newFeature:string,softUpdateDate:string>>"
    one = F.get(F.filter(F.from_json(F.col(body), schema)["data"], lambda x: x["id"] == item_id), 0)
    return df.withColumn("_r", one).where("_r IS NOT NULL").select("*", F.col("_r.swName").alias("name"), F.array_compact(F.array("_r.newFeatureFull", "_r.newFeature")).alias("sections"), F.to_date("_r.softUpdateDate").alias("released")).drop("_r")


def platform_config(df: DataFrame, body: str, platforms: tuple[str, ...] = ("iOS", "Android", "HarmonyOS")) -> DataFrame:
    """One row for each of the platforms; found is false where the payload lacks it."""
    parsed = F.from_json(F.col(body), "map<string,struct<name:string,version:string,date:string,notes:string>>")
    rows = df.withColumn("platform", F.explode(F.array(*[F.lit(p) for p in platforms]))).withColumn("_r", F.try_element_at(parsed, F.col("platform")))
    return rows.select("*", F.col("_r").isNotNull().alias("found"), "_r.name", "_r.version", F.to_date("_r.date").alias("released"), "_r.notes").drop("_r")


def category_menu(df: DataFrame, body: str, keyword: str = "(?i)android|ios|phone|手机") -> DataFrame:
    """Apps of all categories that some download entry names as mobile."""
    schema = "data array<struct<categoryName:string,appList:array<struct<chName:string,versionName:string,createTime:string,description:string,downInfo:array<struct<type:string>>>>>>"
    rows = df.withColumn("_c", F.explode(F.from_json(F.col(body), schema)["data"])).withColumn("_a", F.explode("_c.appList"))
    rows = rows.where(F.exists("_a.downInfo", lambda d: d["type"].rlike(keyword)))
    return rows.select("*", F.col("_c.categoryName").alias("category"), F.col("_a.chName").alias("name"), F.col("_a.versionName").alias("version"), F.to_date(F.substring("_a.createTime", 1, 10)).alias("released")).drop("_c", "_a")


def platform_groups(df: DataFrame, body: str, groups: dict[str, str]) -> DataFrame:
    """Apps of each platform's group (platform -> key of data); a group that is missing or empty gives one row with an error."""
    parsed = F.from_json(F.col(body), "data map<string,array<struct<name:string,ver:string,time:string,env:string,remark:string>>>")["data"]
    chosen = F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(k).alias("group")) for p, k in groups.items()])
    rows = df.withColumn("_g", F.explode(chosen)).withColumn("_a", F.filter(F.try_element_at(parsed, F.col("_g.group")), lambda a: a.isNotNull()))
    rows = rows.select("*", F.explode_outer("_a").alias("_r"))
    error = F.when(F.col("_r").isNull(), F.concat(F.lit("no group "), F.col("_g.group")))
    return rows.select("*", "_g.platform", "_r.name", F.col("_r.ver").alias("version"), F.to_date(F.substring("_r.time", 1, 10)).alias("released"), F.col("_r.remark").alias("notes"), error.alias("error")).drop("_g", "_a", "_r")


def mobile_clients(df: DataFrame, body: str, clients: list[str]) -> DataFrame:
    """Apps whose adaptClient is one of the clients, with their downloads as type and address; downloads without an address go."""
    schema = "data array<struct<adaptClient:string,downloadName:string,softUpdateTime:string,updateExplain:string,verionList:array<struct<versionType:string,softDownUrl:string>>>>"
    rows = df.withColumn("_r", F.explode(F.from_json(F.col(body), schema)["data"])).where(F.trim("_r.adaptClient").isin([c.strip() for c in clients]))
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    links = F.filter(F.coalesce(F.col("_r.verionList"), F.array()), lambda v: F.trim(v["softDownUrl"]) != "")
    shown = F.transform(links, lambda v: F.struct(blank(v["versionType"], "下载").alias("type"), F.trim(v["softDownUrl"]).alias("url")))
    return rows.select("*", F.trim("_r.downloadName").alias("name"), F.to_date(F.substring("_r.softUpdateTime", 1, 10)).alias("released"), F.col("_r.updateExplain").alias("notes"), shown.alias("downloads")).drop("_r")


def clients_by_app(df: DataFrame, body: str, app_ids: dict[str, str]) -> DataFrame:
    """The record of each app's id, the last one of several; an app without a record has found false."""
    schema = "results array<struct<softid:string,title:string,version:string,modify_date:string,content:string>>"
    results = F.coalesce(F.from_json(F.col(body), schema)["results"], F.array().cast("array<struct<softid:string,title:string,version:string,modify_date:string,content:string>>"))
    apps = F.array(*[F.struct(F.lit(a).alias("app"), F.lit(i).alias("softid")) for a, i in app_ids.items()])
    rows = df.withColumn("_all", results).withColumn("_w", F.explode(apps))
    rows = rows.withColumn("_r", F.try_element_at(F.filter("_all", lambda x: x["softid"] == F.col("_w.softid")), F.lit(-1)))
    return rows.select("*", "_w.app", F.col("_r").isNotNull().alias("found"), F.coalesce("_r.title", "_w.app").alias("name"), "_r.version", F.to_date(F.substring("_r.modify_date", 1, 10)).alias("released"), F.col("_r.content").alias("notes")).drop("_all", "_w", "_r")


def attachments(c: Column, base: str, download: str) -> Column:
    """array<struct<name, url>> of a JSON list of files: the address of a download with the file's own, made absolute, as a parameter."""
    files = F.from_json(F.when(F.trim(c).startswith("["), c), "array<struct<fileName:string,fileUrl:string>>")
    tidy = F.transform(files, lambda x: F.struct(F.trim(F.coalesce(x["fileName"], F.lit(""))).alias("name"), F.trim(F.coalesce(x["fileUrl"], F.lit(""))).alias("at")))
    kept = F.filter(tidy, lambda x: (x["name"] != "") | (x["at"] != ""))
    absolute = lambda u: F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("/"), F.concat(F.lit(base), u)).when(u == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), u))
    quoted = lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(u), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")
    address = lambda x: F.concat(F.lit(base + download + "?downloadUrl="), quoted(absolute(x["at"])), F.lit("&realFileName="), quoted(x["name"]))
    return F.coalesce(F.transform(kept, lambda x: F.struct(x["name"].alias("name"), address(x).alias("url"))), F.array().cast("array<struct<name:string,url:string>>"))


#: A notice's columns and the keys that answers give them by.
DETAIL = {
    "notice_id": "id", "title": "noticeTitle", "publish_time": "publishTime", "purchaser": "userName", "procurement_method": "purchaseTypeName",
    "region": "area", "tag": "yxCategoryNames", "category": "labelAllId", "notice_source": "noticeSource", "raw_notice_type": "noticeType",
}


def notice_detail(df: DataFrame, detail: str, item: str, base: str, download: str) -> DataFrame:
    """A detail answer (its first row) beside the list's item: each column is the detail's value, or the item's where that is blank, or ""."""
    row = F.from_json(F.get(F.from_json(F.get_json_object(F.col(detail), "$.rows"), "array<string>"), 0), "map<string,string>")
    rows = df.withColumn("_d", row).withColumn("_i", F.from_json(F.col(item), "map<string,string>"))
    one = lambda key: F.coalesce(*[F.nullif(F.try_element_at(F.col(m), F.lit(key)), F.lit("")) for m in ("_d", "_i")])
    html = values.unescaped(F.coalesce(one("noticeContent"), one("briefContent"), F.lit("")))
    named = [F.coalesce(one(key), F.lit("")).alias(name) for name, key in DETAIL.items()]
    return rows.select("*", *named, html.alias("content_html"), attachments(F.try_element_at(F.col("_d"), F.lit("file")), base, download).alias("attachments")).drop("_d", "_i")


def result_rows(df: DataFrame, payload: str, meta: str, file: str) -> DataFrame:
    """Rows of result payloads: a list, an envelope of records, or one record; without any, one stub from the front matter (meta, a map).

    Columns that come back besides df's: item and the result's; a candidate has no winner.
    """
    said = F.trim(F.col(payload))
    inner = F.get_json_object(said, "$.records")
    listed = F.when(said.startswith("["), said).when(inner.startswith("["), inner).when(said.startswith("{"), F.concat(F.lit("["), said, F.lit("]")))
    records = F.filter(F.from_json(listed, "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    records = F.when(F.size(records) > 0, records).otherwise(F.array(F.lit("{}")))
    rows = df.select("*", F.posexplode(records).alias("item", "_t")).withColumn("_r", F.from_json("_t", "map<string,string>"))
    own = lambda key: F.nullif(F.trim(F.try_element_at(F.col("_r"), F.lit(key))), F.lit(""))
    head = lambda key: F.nullif(F.trim(F.try_element_at(F.col(meta), F.lit(key))), F.lit(""))
    first = lambda *c: F.coalesce(*c, F.lit(""))
    title = first(own("title"), head("title"))
    kind = text.result_type(own("result_type"), title)
    listing = F.filter(F.from_json(F.when(own("winner_candidates").startswith("["), own("winner_candidates")), "array<string>"), lambda x: F.trim(x) != "")
    return rows.select(
        "*", title.alias("title"), *[first(own(k), head(k)).alias(k) for k in ("notice_id", "publish_date", "purchaser", "source_url")],
        text.result_name(first(own("project_name"), title)).alias("project_name"), first(own("project_number"), own("procurement_number")).alias("project_number"),
        first(own("package_number"), own("section_number")).alias("package_number"), kind.alias("result_type"), F.when(kind == "candidate", "").otherwise(first(own("winner"))).alias("winner"),
        F.coalesce(F.to_json(listing), own("winner_candidates"), F.lit("")).alias("winner_candidates"), values.amount_with_units(own("winning_amount")).alias("winning_amount"),
        text.result_status(own("result_status"), kind, title).alias("result_status"), first(own("source_file"), F.col(file)).alias("source_file"),
    ).drop("_t", "_r")


def search_request(query: Column, recency: Column, top_k: Column, source: str, most: int = 10) -> Column:
    """JSON of a search request: the question, how recent answers must be, and 1 to ``most`` of them."""
    message = F.struct(F.lit("user").alias("role"), query.alias("content"))
    kind = F.struct(F.lit("web").alias("type"), F.greatest(F.lit(1), F.least(F.lit(most), top_k.cast("int"))).alias("top_k"))
    return F.to_json(F.struct(F.array(message).alias("messages"), F.lit(source).alias("search_source"), recency.alias("search_recency_filter"), F.array(kind).alias("resource_type_filter")))


def search_references(df: DataFrame, body: str) -> DataFrame:
    """References of a search answer with rank; an id that is missing is the rank's."""
    schema = "references array<struct<id:string,title:string,url:string,website:string,date:string,content:string,snippet:string>>"
    rows = df.select("*", F.posexplode(F.from_json(F.col(body), schema)["references"]).alias("_i", "_r"))
    return rows.select(
        "*", (F.col("_i") + 1).alias("rank"), F.coalesce(F.nullif("_r.id", F.lit("")), (F.col("_i") + 1).cast("string")).alias("provider_id"), "_r.title", "_r.url",
        F.col("_r.website").alias("site"), F.to_date(F.substring("_r.date", 1, 10)).alias("published"), F.coalesce("_r.snippet", "_r.content").alias("snippet"),
    ).drop("_i", "_r")


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right; other text stays."""
    latin = c.rlike(r"^[\x00-\xff]*$") & c.rlike(r"[\xc2-\xf4][\x80-\xbf]")
    return F.when(latin, F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
