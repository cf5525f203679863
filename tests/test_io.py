"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import markup
from tidewell.operators import keyed
from tidewell.sources import files, paged, payloads, publish
from tidewell.streaming import flows


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ id ,name,note\n1,"a ""q"", b","x\ny"\n2,,\n,,\n', encoding="utf-8")
    df = files.csv_text(spark, f"file://{tmp_path}/a.csv", ["id", "name", "note"])
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b', "x\ny"), ("2", "", ""), ("", "", "")]
    assert files.without_blank_rows(df).count() == 2
    with pytest.raises(files.InputError):
        files.csv_text(spark, f"file://{tmp_path}/a.csv", ["id", "name"])
    with pytest.raises(files.InputError):
        files.csv_text(spark, f"file://{tmp_path}/a.csv", required=["absent"])


def test_json_lines_fall_back_to_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\nnot json\n[1]\n{"id": "2"}\n')
    (tmp_path / "b.jsonl").write_text("\n")
    (tmp_path / "a.csv").write_text("id\n7\n")
    root = f"file://{tmp_path}"
    assert {r.id for r in files.json_lines(spark, f"{root}/a.jsonl", T.StructType([T.StructField("id", T.StringType())])).collect()} == {"1", "2"}
    assert [r.id for r in files.json_lines_or_csv(spark, f"{root}/b.jsonl", f"{root}/a.csv", ["id"]).collect()] == ["7"]


def test_markdown_admission(spark, tmp_path):
    for name, body in {"x/a.md": "# T\nbody", "x/b.md": "# T\nbody", "y/c.md": "no title", "y/d.md": " ", "y/e.md": "---\ntitle: M\n---\nz", "y/f.txt": "# no"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    docs = files.markdown_tree(spark, f"file://{tmp_path}")
    assert docs.count() == 5 and files.markdown_tree(spark, f"file://{tmp_path}", "x").count() == 2
    new = files.admitted(docs, docs.limit(0).select("sha256"))
    assert sorted((r.path.rpartition("/")[2], r.title) for r in new.collect()) == [("a.md", "T"), ("e.md", "M")]
    assert files.admitted(docs, docs.select("sha256")).count() == 0


def test_paged_source(spark, tmp_path):
    paged.register(spark)
    for i in range(3):
        (tmp_path / f"page-{i}.json").write_text("broken" if i == 1 else json.dumps([{"id": f"{i}{k}", "date": f"2024-0{5 - i}-0{9 - k}"} for k in range(2)]))
    df = spark.read.format("tidewell_pages").options(path=str(tmp_path), pages="3", pages_a_task="2").load()
    got = df.collect()
    assert sorted(r.id for r in got if r.id) == ["00", "01", "20", "21"] and sum(r.error is not None for r in got) == 1
    recent = paged.take_while(df.where("error IS NULL").withColumn("all", F.lit(0)), [F.col("page"), F.col("place")], F.col("date") < "2024-05-09", ["all"])
    assert [r.id for r in recent.collect()] == ["00"]


def test_payloads(spark):
    body = lambda x: spark.createDataFrame([(json.dumps(x),)], "body string")
    apple = body({"results": [{"trackId": 1, "version": "1"}, {"trackId": 2, "version": "2.0", "currentVersionReleaseDate": "2024-01-02T00:00:00Z", "releaseNotes": "n"}]})
    assert payloads.store_lookup(apple, "body", F.lit("2")).first()["version"] == "2.0"
    assert payloads.store_lookup(apple, "body").first()["version"] == "1"
    config = body({"iOS": {"name": "a", "version": "1", "date": "2024-01-01", "notes": ""}})
    assert {r.platform: r.found for r in payloads.platform_config(config, "body").collect()} == {"iOS": True, "Android": False, "HarmonyOS": False}
    menu = body({"data": [{"categoryName": "c", "appList": [{"chName": "a", "versionName": "1", "createTime": "2024-01-01", "downInfo": [{"type": "Android"}]}, {"chName": "b", "downInfo": [{"type": "pc"}]}]}]})
    assert [r["name"] for r in payloads.category_menu(menu, "body").collect()] == ["a"]
    refs = payloads.search_references(body({"references": [{"id": "", "title": "t", "url": "u", "date": "2024-01-01 x"}, {"id": "p"}]}), "body").collect()
    assert [(r["rank"], r["provider_id"]) for r in refs] == [(1, "1"), (2, "p")]
    item = payloads.software_list(body({"data": [{"id": "1", "swName": "x", "newFeature": "f", "softUpdateDate": "2024-01-01"}]}), "body", "1").first()
    assert item["sections"] == ["f"]
    garbled = "新增".encode().decode("latin-1")
    got = spark.createDataFrame([(garbled,), ("é",), ("新",)], "x string").select(payloads.repaired(F.col("x"))).collect()
    assert [r[0] for r in got] == ["新增", "é", "新"]


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    assert publish.current(spark, root) is None and publish.publish(spark.range(0), root) is None
    names = [publish.publish(spark.range(n), root, keep=2) for n in (10, 6, 8)]
    assert all(names) and publish.versions(spark, root) == names[1:]
    assert publish.publish(spark.range(3), root) is None and publish.current(spark, root).count() == 8
    publish.write_by_folder(spark.createDataFrame([("a", 1), (" ", 2)], "f string, v int"), f"{root}/by", "f")
    assert {r._folder for r in spark.read.parquet(f"{root}/by").collect()} == {"a", "unknown"}


def test_package_notices_changes(spark, tmp_path):
    path, df = f"file://{tmp_path}/p", spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    publish.write_package({"x": df, "y": df.limit(0)}, path)
    schemas = {"x": df.schema, "y": df.schema}
    assert publish.broken_datasets(spark, path, schemas) == []
    df.limit(1).write.mode("append").json(f"{path}/y")
    assert publish.broken_datasets(spark, path, {**schemas, "z": df.schema}) == ["y", "z"]


def test_streams(spark, tmp_path):
    schema = "user_id long, ts timestamp, v long"
    source = f"file://{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, "user_id long, t string, v long").select("user_id", F.to_timestamp("t").alias("ts"), "v").write.mode("append").parquet(source)
    put([(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:10:00", 2), (2, "2024-01-01 01:00:00", 3)])
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    table, mark = f"file://{tmp_path}/table", f"file://{tmp_path}/mark"
    assert {(r.user_id, r.v) for r in flows.upsert_into(stream(), table, mark, ["user_id"], ["ts", "v"]).collect()} == {(1, 2), (2, 3)}
    put([(1, "2024-01-01 00:05:00", 9), (3, "2024-01-02 00:00:00", 4)])
    assert {(r.user_id, r.v) for r in flows.upsert_into(stream(), table, mark, ["user_id"], ["ts", "v"]).collect()} == {(1, 2), (2, 3), (3, 4)}
    # a run without new files changes nothing; one row rewrites one bucket, and two versions of it stay
    assert flows.upsert_into(stream(), table, mark, ["user_id"], ["ts", "v"]).count() == 3
    for v in (10, 11, 12):
        put([(2, "2024-02-01 00:00:00", v)])
        flows.upsert_into(stream(), table, mark, ["user_id"], ["ts", "v"])
    held = flows.current(spark, table)
    assert max(map(len, held.values())) == 2 and sum(max(ns) == 4 for ns in held.values()) == 1
    assert {(r.user_id, r.v) for r in flows.upsert_into(stream(), table, mark, ["user_id"], ["ts", "v"]).collect()} == {(1, 2), (2, 12), (3, 4)}
    seen = flows.run_to_table(flows.first_seen(stream(), "user_id"), f"file://{tmp_path}/seen", f"file://{tmp_path}/mark2")
    assert seen.count() == 3
    closed = flows.run_to_table(flows.sessions(stream(), late="1 hour"), f"file://{tmp_path}/sessions", f"file://{tmp_path}/mark3")
    assert {(r.user_id, r.n) for r in closed.collect()} == {(1, 3), (2, 1), (3, 1)}  # the last one is still open


def test_markdown_of_odd_pages():
    assert markup.to_markdown(None) == markup.to_markdown("<p> </p><div><b></b></div>") == ""
    assert markup.to_markdown("<ul><li>a<ul><li>b</ul><li>c") == "- a\n\n- b\n\nc"  # an open item holds the next one
    assert markup.to_markdown("</p>a</div><p>b") == "a\n\nb"
    assert markup.to_markdown("<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>") == "| \\| x \\|<br>\\| --- \\| |\n| --- |"
    deep = 5000
    assert markup.to_markdown("<div>" * deep + "x" + "</div>" * deep) == "x"
    assert markup.to_markdown("<style>p { }</style><a href=''>t</a><a>u</a><img src='i'>") == "t\n\nu"


def test_source_catalog_refuses(spark, tmp_path):
    for i, brokers in enumerate(([{"key": "a", "broker_name": "b", "collector": "c"}] * 2, [{"key": "a", "broker_name": "b"}], [])):
        (tmp_path / f"{i}.json").write_text(json.dumps({"brokers": brokers}))
        with pytest.raises(files.InputError):
            files.source_catalog(spark, f"file://{tmp_path}/{i}.json")


def test_response_of_a_dead_build_is_made_again(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, t string")
    first = publish.write_response(df, f"file://{tmp_path}", None, "v1", "then").first()
    assert first["count"] == 2 and publish.write_response(df.limit(1), f"file://{tmp_path}", None, "v2", "now").first()["count"] == 1
    (tmp_path / first["path"].rsplit("/", 2)[1] / "meta" / "_SUCCESS").unlink()
    again = publish.write_response(df, f"file://{tmp_path}", None, "v1", "later").first()
    assert (again["updated_at"], again["digest"]) == ("later", first["digest"])
    assert sorted(r.t for r in spark.read.json(first["path"]).collect()) == ["", "b"]


def test_answers_survive_a_failed_retry(spark):
    inputs, cache = spark.createDataFrame([(1,), (2,)], "key int"), spark.createDataFrame([(1, "{}"), (9, "[]")], "key int, answer string")
    refuse = lambda df: df.withColumn("answer", F.lit(None).cast("string")).withColumn("error", F.lit("no"))
    out, after = keyed.answered(inputs, cache, refuse, again=True)
    assert {r.key: (r.answer, r.error) for r in out.collect()} == {1: ("{}", "no"), 2: (None, "no")}
    assert {tuple(r) for r in after.where("answer IS NOT NULL").collect()} == {(1, "{}"), (9, "[]")}


def test_collection_goes_on_and_probes(spark, tmp_path):
    options = {"path": str(tmp_path), "pages": "5", "pages_a_task": "3"}
    put = lambda i, ids: (tmp_path / f"page-{i}.json").write_text(json.dumps([{"id": x} for x in ids]))
    for i in range(5):
        put(i, [f"{i}a", f"{i}b"])
    (tmp_path / "page-3.json").write_text("broken")
    root = f"file://{tmp_path}/run"
    assert {r.page for r in paged.collected(spark, options, root).collect()} == {0, 1, 2, 4}
    put(0, ["changed"])
    put(3, ["3a"])
    again = paged.collected(spark, options, root).collect()
    assert {r.page for r in again} == set(range(5)) and len(again) == 9 and "changed" not in {r.id for r in again}
    known = spark.createDataFrame([("changed",), ("1a",)], "id string")
    assert {r.page for r in paged.collected(spark, options, f"file://{tmp_path}/short", known).collect()} == {0, 1}
    assert {r.page for r in paged.collected(spark, options, f"file://{tmp_path}/long", known.where("id = '1a'")).collect()} == {0, 1, 2, 3}
    assert list(paged._gaps(0, 6, {1, 2, 5})) == [(0, 1), (3, 5)]


def test_complete_results_of_every_run(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.mode("append").parquet(source)
    stream = lambda: flows.hourly_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(source))
    run = lambda: {(str(r.hour), r.n) for r in flows.run_complete(stream(), f"file://{tmp_path}/rows", f"file://{tmp_path}/mark").collect()}
    (tmp_path / "in").mkdir()
    assert run() == set()
    put(("2024-01-01 00:30:00", "a"))
    assert run() == run() == {("2024-01-01 00:00:00", 1)}
    for hour in (1, 2, 3):
        put((f"2024-01-01 0{hour}:30:00", "a"))
        assert len(run()) == hour + 1
    assert len(flows.versions(spark, f"file://{tmp_path}/rows")) == 2
    empty = spark.readStream.schema("user_id long, ts timestamp").parquet(f"file://{tmp_path}/in2") if (tmp_path / "in2").mkdir() is None else None
    assert flows.upsert_into(empty, f"file://{tmp_path}/t", f"file://{tmp_path}/m", ["user_id"], ["ts"]).count() == 0


def test_scans_stop_where_nothing_more_is_asked_for(spark, tmp_path):
    """Pages past the stop aren't requested, nor details of known items."""
    lines = []
    for page in range(6):
        lines += [json.dumps({"page": page, "place": k, "id": f"{page}{k}", "date": "" if k == 1 else f"2024-05-{20 - 2 * page - (k > 2):02}"}) for k in range(4)]
    spark.createDataFrame([(x,) for x in lines], "l string").selectExpr("from_json(l, 'page int, place int, id string, date string') AS j").select("j.*").write.partitionBy("page").json(f"file://{tmp_path}/pages")
    (tmp_path / "counting_client.py").write_text(
        "import pathlib\nfrom tidewell.sources.paged import JsonFolderClient\n"
        "class Client(JsonFolderClient):\n"
        "    def __init__(self, options):\n        super().__init__(options)\n        self.log = pathlib.Path(options['log'])\n"
        "    def page(self, i):\n        (self.log / f'page-{i}').touch()\n        return super().page(i)\n"
        "    def detail(self, item):\n        (self.log / f'detail-{item[\"id\"]}').touch()\n        return {'more': item['id'] * 2}\n"
    )
    spark.sparkContext.addPyFile(f"{tmp_path}/counting_client.py")
    paged.register(spark)

    def scan(**options):
        log = tmp_path / f"log{len(list(tmp_path.glob('log*')))}"
        log.mkdir()
        base = {"client": "counting_client:Client", "path": f"file://{tmp_path}/pages", "pages": "6", "log": str(log), "order": "newest", **options}
        asked = lambda kind: sorted(p.name.split("-")[1] for p in log.glob(f"{kind}-*"))
        return spark.read.format("tidewell_pages").options(**base).load(), asked

    df, asked = scan()
    got = {r.id for r in df.where("date >= '2024-05-16'").collect()}
    assert got == {"00", "02", "03", "10", "12", "13", "20", "22"} and asked("page") == ["0", "1", "2"]
    df, asked = scan()
    assert {r.id for r in df.where("date > '2024-05-18'").collect()} == {"00", "02", "03"} and asked("page") == ["0", "1"]
    df, asked = scan(since="2024-05-17", details="true")
    got = {r.id: json.loads(r.item)["more"] for r in df.where(~F.col("id").isin("00", "10", "xx")).collect()}
    assert set(got) == {"01", "02", "03", "11", "12", "13"} and got["12"] == "1212" and asked("page") == ["0", "1", "2"] and asked("detail") == sorted(got)
    df, asked = scan(max_items="5")
    assert df.count() == 5 and asked("page") == ["0", "1"]
    df, asked = scan(order="any")
    assert df.where("date >= '2024-05-16'").count() == 8 and asked("page") == list("012345")
    df, asked = scan()
    assert [r.id for r in df.where("id = '31'").collect()] == ["31"]
