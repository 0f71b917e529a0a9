"""Sources and stores on small files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import batches, prices, stores


def zipped(path, lines):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x.csv", "\n".join(lines))
    path.write_bytes(b.getvalue())


def test_manifest_and_plan(spark):
    lines = ["10 AB http://d/20250127000000.gkg.csv.zip", "11 CD http://d/20250127000000.export.CSV.zip", "12 EF http://d/20250127000000.mentions.CSV.zip", "13 AA http://d/20250127000000.translation.gkg.csv.zip", "garbage", "14 BB http://d/20250127001500.gkg.csv.zip", "15 CC http://d/20250201000000.gkg.csv.zip", "16 DD http://d/20250127000000.gkg.csv.zip"]
    m = batches.manifest(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))
    assert m.count() == 6 and m.where("seq = 0").first().url.startswith("https://") and m.where("seq = 0").first().md5 == "ab"
    p = batches.plan(m, "20250127000000", "20250201000000", "seq").collect()
    assert [(r.batch_ts[8:12], r.kind, r.seq) for r in p] == [("0000", "gkg", 7), ("0000", "export", 1), ("0000", "mentions", 2), ("0015", "gkg", 5)]


def test_ledger_and_days(spark):
    led = spark.createDataFrame([("a", "error", 1), ("a", "ok", 2), ("b", "ok", 3)], "url string, status string, seq long")
    now = batches.latest(led, "url", "seq")
    assert {r.url: r.status for r in now.collect()} == {"a": "ok", "b": "ok"}
    planned = spark.createDataFrame([("a", "20250101000000"), ("b", "20250102000000"), ("c", "20250102001500"), ("a", "20250103000000")], "url string, batch_ts string")
    assert [(r.day, r.complete, r.in_prefix) for r in batches.complete_days(planned, now).orderBy("day").collect()] == [("20250101", True, True), ("20250102", False, False), ("20250103", True, False)]
    assert {r.url for r in batches.outstanding(planned, now).collect()} == {"c"}


def test_observation_lines(spark, tmp_path):
    c = [""] * 27
    c[0], c[1], c[2], c[3], c[4], c[7] = "r1", "20250127101500", "1", "Example.COM", "http://www.example.com/a?utm_x=1", "T1;T2;T1"
    c[9], c[11], c[13], c[15], c[18] = "1#x#US#y;2#z#CN", "ann;bob", "acme", "-1.5,1,2,3,4,5,321", "http://img"
    c[22], c[23], c[24] = "1|2|said|hello#bad#1|2||  ", "Ann B,12;Acme, Inc,40", "5,dollar, more,9;x,y,z;1,2"
    c[26] = "<PAGE_TITLE>A &amp;  B</PAGE_TITLE><PAGE_AUTHORS>Ann, Bob ,Ann</PAGE_AUTHORS><PAGE_PRECISEPUBTIMESTAMP>20250127100000</PAGE_PRECISEPUBTIMESTAMP>"
    zipped(tmp_path / "a.zip", ["\t".join(c), "", "too\tshort"])
    lines = batches.read_lines(spark, str(tmp_path))
    r = batches.gkg(lines).first()
    assert (r.record_id, r.source_name, r.title, r.authors, r.themes, r.countries) == ("r1", "example.com", "A & B", ["Ann", "Bob"], ["T1", "T2"], ["US", "CN"])
    assert (r.all_names, round(r.tone, 3), r.word_count, [tuple(q) for q in r.quotations], [tuple(a) for a in r.amounts]) == (["Ann B", "Acme, Inc"], -1.5, 321, [("said", "hello")], [(5.0, "dollar, more")])
    assert str(r.published_time) == "2025-01-27 10:00:00" and len(r.url_key) == 64
    assert [tuple(q) for q in batches.quarantine(lines, "gkg").collect()] == [("gkg", 2, 2, "too\tshort")]


def test_event_and_mention_lines(spark):
    e = [""] * 61
    e[0], e[1], e[6], e[26], e[30], e[59], e[60] = "7", "20250127", "X", "010", "-2.0", "20250127101500", "u"
    m = ["7", "20250127101500", "bad", "1", "Site", "u", *[""] * 5, "80", *[""] * 4]
    lines = spark.createDataFrame([("p", 0, "\t".join(e)), ("p", 1, "\t".join(m))], "path string, line_no int, line string")
    assert batches.exports(lines).first().event_id == 7 and batches.exports(lines).count() == 1
    r = batches.mentions(lines).first()
    assert (r.confidence, r.mention_time, r.source_name) == (80, None, "site")


def test_chart_bars_and_actions(spark):
    body = {"chart": {"result": [{"meta": {"gmtoffset": -18000}, "timestamp": [1738074600, 1738161000], "indicators": {"quote": [{"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 1.0], "close": [1.23455, 2.0], "volume": [None, 5]}]}, "events": {"dividends": {"1": {"date": 1738074600, "amount": 0.5}}, "splits": {"2": {"date": 1738161000, "numerator": 4, "denominator": 1}}}}]}}
    raw = spark.createDataFrame([("A", json.dumps(body))], "symbol string, body string")
    assert [tuple(r) for r in prices.daily_bars(raw).collect()] == [("A", "2025-01-28", 10000, 20000, 5000, round(12345.5), 0)]
    assert sorted(tuple(r) for r in prices.actions(raw).collect()) == [("A", "2025-01-28", "dividend", 0.5), ("A", "2025-01-29", "split", 4.0)]


def test_index_pages(spark):
    page = 'x id="constituents"\n|-\n| [[Nvidia]] || NVDA || Technology || Chips\n|}\n* [[TSMC]], TSM\n{{NyseSymbol|BRK.B}}\n| [[B]] || Utilities || x'
    df = spark.createDataFrame([(page,)], "value string")
    assert [tuple(r) for r in prices.constituents(df).collect()] == [("NVDA", "Technology")]
    assert prices.bullet_members(df).first().symbol == "TSM" and prices.sector_members(df).first().symbol == "BRK-B"


def test_stores(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda d, v: spark.createDataFrame([(d, v)], "day string, v long")
    for d, v in (("2025-01-01", 1), ("2025-01-02", 2), ("2025-01-01", 3)):
        stores.write_days(df(d, v), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    stores.register(spark, str(tmp_path), ["t"])
    assert spark.sql("select sum(v) from t").first()[0] == 5
    a = stores.write_snapshot({"s": df("x", 1)}, str(tmp_path / "snap"), "cfg", 5, "")
    assert a == stores.write_snapshot({"s": df("x", 1)}, str(tmp_path / "snap"), "cfg", 5, "") != stores.write_snapshot({"s": df("x", 2)}, str(tmp_path / "snap"), "cfg", 5, "")
    assert stores.read_snapshot(spark, str(tmp_path / "snap"), "s", a).first().v == 1
    import hashlib

    d = hashlib.sha256(b"abc").hexdigest()
    f = tmp_path / "blobs" / stores.blob_path(d, ".json")
    f.parent.mkdir(parents=True)
    f.write_bytes(b"abc")
    assert stores.blobs(spark, str(tmp_path / "blobs")).first().named_right


def test_cases(spark, tmp_path):
    (tmp_path / "2025-01-27.json").write_text(json.dumps({"day": "2025-01-27", "tau_star": "t", "fired": ["A"]}))
    (tmp_path / "2025-01-28.json").write_text("{broken")
    (tmp_path / "plan.json").write_text("{}")
    assert {r.case_id: (r.status, r.fired) for r in stores.cases(spark, str(tmp_path)).collect()} == {"2025-01-27": ("OK", ["A"]), "2025-01-28": ("UNREADABLE", None)}
    assert "| A | +1.00% | 5.0 | yes |" in stores.dossier({"day": "d", "stats": [{"symbol": "A", "R": 0.01, "SAR": 5, "fired": True}]})


def test_archived_responses(spark, tmp_path):
    k = stores.search_key({"q": "x", "engine": "g"})
    (tmp_path / f"{k}.json").write_text(json.dumps({"params": {}, "organic_results": [{"position": 1, "title": "t", "link": "l"}]}))
    assert tuple(stores.responses(spark, str(tmp_path)).select("key", "position", F.col("link")).first()) == (k, 1, "l")
