"""Readers, store, HTTP source, streaming ingest, reports and the command line."""

import datetime as dt
import json
import sqlite3

import pytest

from terazi import cli
from terazi.operators import lens
from terazi.config import LensConfig
from terazi.reports.markdown import fund_sentences, market_report, selected_report
from terazi.reports.snapshot import dominance_comments, fund_snapshot, group_comments, snapshot_text
from terazi.sources import readers, store
from terazi.sources.fetch import FetchConfig, NoAnswer, fetch_complete, fetch_period, fetch_strict, month_chunks, payload
from terazi.streaming.ingest import daily_totals, stream_general, upsert

DAY = dt.date(2026, 1, 1)


def vendor(n=6, codes=("AAA", "BBB")):
    g = [(c, "İŞ PORTFÖY FON", str(DAY + dt.timedelta(days=i)), 1.0 + i / 100, str(2e6 + i * 1e4), 10 + i, (1.0 + i / 100) * (2e6 + i * 1e4)) for c in codes for i in range(n)]
    a = [(c, "T", str(DAY + dt.timedelta(days=i)), 80.0, 20.0) for c in codes for i in range(n)]
    return g, a


G = "fonKodu string, fonUnvan string, tarih string, fiyat double, tedPaySayisi string, kisiSayisi bigint, portfoyBuyukluk double"
A = "fonKodu string, fonUnvan string, tarih string, dt double, hs double"


def test_formats_give_the_same(spark, tmp_path):
    g, a = vendor()
    gd, ad = spark.createDataFrame(g, G), spark.createDataFrame(a, A)
    want = sorted(map(tuple, readers.from_frames(gd, ad)[0].collect()))
    assert len(want) == 12 and want[0][4] == 2e6 and want[0][2] == DAY
    gd.write.parquet(str(tmp_path / "g.parquet"))
    ad.write.parquet(str(tmp_path / "a.parquet"))
    readers.write_csv(gd, str(tmp_path / "g.csv"))
    readers.write_csv(ad, str(tmp_path / "a.csv"))
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute(f"create table {readers.GENERAL_TABLE} (fonKodu, fonUnvan, tarih, fiyat, tedPaySayisi, kisiSayisi, portfoyBuyukluk)")
        c.executemany(f"insert into {readers.GENERAL_TABLE} values (?,?,?,?,?,?,?)", g)
        c.execute(f"create table {readers.ALLOCATION_TABLE} (fonKodu, fonUnvan, tarih, dt, hs)")
        c.executemany(f"insert into {readers.ALLOCATION_TABLE} values (?,?,?,?,?)", a)
    for source, options in (("parquet", {"general": str(tmp_path / "g.parquet"), "allocation": str(tmp_path / "a.parquet")}), ("csv", {"general": str(tmp_path / "g.csv"), "allocation": str(tmp_path / "a.csv")}), ("sqlite", {"path": db})):
        gg, aa = readers.load(spark, source, **options)
        assert sorted(map(tuple, gg.collect())) == want
        assert aa.count() == 24 and {r.code for r in aa.select("code").distinct().collect()} == {"dt", "hs"}
    with pytest.raises(ValueError):
        readers.load(spark, "ftp")
    with pytest.raises(ValueError):
        readers.canonical_general(gd.drop("fiyat"))


def test_vendor_frame(spark):
    df = spark.createDataFrame([("AAA", "T", "2026-01-02", 1.5, "1000", 3, 1500.0, 1.5, 60.0, 40.0), ("BBB", "T", "bad", None, "x", 3, None, 1.5, 60.0, None)], "FONKODU string, FONUNVAN string, TARIH string, FIYAT double, TEDPAYSAYISI string, KISISAYISI bigint, PORTFOYBUYUKLUK double, FIYAT_6DEC double, DT double, HS double")
    g, a = readers.split_vendor_frame(df)
    rows = {r.fund_code: r for r in g.collect()}
    assert rows["AAA"].units == 1000.0 and rows["BBB"].units is None and rows["BBB"].date is None
    assert a.count() == 3
    with pytest.raises(ValueError):
        readers.split_vendor_frame(df.drop("TARIH"))


def test_months_and_payload():
    c = month_chunks(dt.date(2026, 1, 31), dt.date(2026, 4, 2))
    assert c[0][0] == dt.date(2026, 1, 31) and c[-1][1] == dt.date(2026, 4, 2)
    assert all(b[0] == a[1] + dt.timedelta(days=1) for a, b in zip(c[:-1], c[1:], strict=True))
    assert month_chunks(DAY, DAY) == [(DAY, DAY)] and month_chunks(DAY, DAY - dt.timedelta(days=1)) == []
    p = payload(DAY, DAY, FetchConfig())
    assert p["bastarih"] == "20260101" and len(p) == 11


def test_retries_and_strictness():
    calls = []

    def flaky(url, body, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        return [{"a": 1}]

    assert fetch_period("general", DAY, DAY, FetchConfig(), flaky, lambda _: None) == [{"a": 1}] and len(calls) == 3
    assert fetch_period("general", DAY, DAY, FetchConfig(retries=2), lambda *_: 1 / 0, lambda _: None) == []
    some = lambda url, body, timeout: [] if body["bastarih"] == "20260201" else [{"d": body["bastarih"]}]
    with pytest.raises(RuntimeError):
        fetch_strict("general", DAY, dt.date(2026, 3, 5), FetchConfig(), dt.date(2026, 4, 1), transport=some, sleep=lambda _: None)
    assert len(fetch_strict("general", DAY, dt.date(2026, 2, 1), FetchConfig(), dt.date(2026, 2, 1), transport=some, sleep=lambda _: None)) == 1


def test_data_source(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            day = f"{body['bastarih'][:4]}-{body['bastarih'][4:6]}-{body['bastarih'][6:]}"
            row = {"fonKodu": "AAA", "fonUnvan": "T", "tarih": day, "fiyat": 1.0, "tedPaySayisi": 2.0, "kisiSayisi": 3, "portfoyBuyukluk": 2.0} if "general" in self.path else {"fonKodu": "AAA", "tarih": day, "dt": 100.0}
            out = json.dumps({"data": [row, row]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        g, a = readers.load(spark, "api", start="2026-01-01", end="2026-02-15", base_url=f"http://127.0.0.1:{server.server_port}")
        assert sorted(str(r.date) for r in g.collect()) == ["2026-01-01", "2026-02-01"] and a.count() == 2
    finally:
        server.shutdown()


def general(spark, rows):
    return spark.createDataFrame(rows, readers.GENERAL_SCHEMA)


def row(code, day, price=1.0):
    return (code, "T", day, price, 10.0, 1, price * 10)


def test_store_replaces_a_period(spark, tmp_path):
    path = str(tmp_path / "s")
    days = [dt.date(2026, m, 10) for m in (1, 2, 3, 4)]
    assert store.latest_date(spark, path) is None
    store.save_snapshot(general(spark, [row(c, d) for c in "AB" for d in days]), path)
    assert store.latest_date(spark, path) == days[-1]
    assert store.update_start(days[-1], days[-1]) == dt.date(2026, 4, 8) and store.update_start(None, dt.date(2024, 2, 29)) == dt.date(2019, 2, 28)
    assert not store.replace_period(spark, path, general(spark, []), days[1])
    assert store.replace_period(spark, path, general(spark, [row("A", days[2], 7.0)]), dt.date(2026, 2, 5))
    got = sorted((r.fund_code, r.date, r.price) for r in store.load_store(spark, path).collect())
    assert got == [("A", days[0], 1.0), ("A", days[2], 7.0), ("B", days[0], 1.0)]


def test_stream_upserts(spark, tmp_path):
    path, source, cp = (str(tmp_path / x) for x in ("store", "in", "cp"))
    d = dt.date(2026, 1, 5)
    for part in ([row("A", d), row("B", d)], [row("A", d, 2.0), row("A", d + dt.timedelta(days=40))]):
        general(spark, part).write.mode("append").parquet(source)
        stream_general(spark, source, path, cp).awaitTermination()
        stream_general(spark, source, path, cp).awaitTermination()
    assert sorted((r.fund_code, r.price) for r in store.load_store(spark, path).collect()) == [("A", 1.0), ("A", 2.0), ("B", 1.0)]
    upsert(spark, general(spark, []), path)


def test_a_store_that_cannot_be_opened_stays(spark, tmp_path):
    """An error on opening isn't taken for the first batch: nothing is overwritten."""
    path = tmp_path / "store"
    (path / "month=2026-01").mkdir(parents=True)
    (path / "month=2026-01" / "part-0.parquet").write_bytes(b"damaged")
    with pytest.raises(Exception):  # noqa: B017
        upsert(spark, general(spark, [row("A", dt.date(2026, 2, 5))]), str(path))
    assert (path / "month=2026-01" / "part-0.parquet").read_bytes() == b"damaged" and not (path / "month=2026-02").exists()


def test_upsert_follows_the_sequence(spark, tmp_path):
    d = dt.date(2026, 1, 5)
    batch = spark.createDataFrame([(*row("A", d, 5.0), 9), (*row("A", d, 1.0), 3), (*row("A", d, 2.0), 4)], readers.GENERAL_SCHEMA + ", arrived int").repartition(3)
    for _ in range(2):
        upsert(spark, batch, str(tmp_path / "s"), "arrived")
    assert [(r.fund_code, r.price) for r in store.load_store(spark, str(tmp_path / "s")).collect()] == [("A", 5.0)]


def test_a_month_that_never_answers(spark):
    """It is asked for again in later rounds, then an error, in the reader as well; weekends may be empty."""
    calls = []

    def late(url, body, timeout):
        calls.append(1)
        return [] if len(calls) < 3 else [{"a": 1}]

    quick = {"transport": late, "sleep": lambda _: None}
    assert fetch_complete("general", DAY, DAY, FetchConfig(), dt.date(2026, 4, 1), **quick) == [{"a": 1}]
    with pytest.raises(NoAnswer):
        fetch_complete("general", DAY, DAY, FetchConfig(retries=1), dt.date(2026, 4, 1), transport=lambda *_: 1 / 0, sleep=lambda _: None)
    saturday = dt.date(2026, 1, 3)
    assert fetch_complete("general", saturday, saturday, FetchConfig(), dt.date(2026, 4, 1), transport=lambda *_: [], sleep=lambda _: None) == []
    g, _ = readers.load(spark, "api", start="2026-01-01", end="2026-01-31", base_url="http://127.0.0.1:9", retries=1, rounds=2, wait=0, pause_after_error=0)
    with pytest.raises(Exception, match="no answer for general"):
        g.collect()


def test_daily_totals(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, h), "a" if h % 2 else "b", 1.0) for h in range(6)] + [(dt.datetime(2026, 1, 5), "a", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    q = daily_totals(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("daily_totals_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n) for r in spark.table("daily_totals_test").collect()} == {("a", 3), ("b", 3)}


def test_gaps_and_lines(spark, tmp_path):
    p = general(spark, [row("A", dt.date(2026, 1, 5)), row("A", dt.date(2026, 1, 12))])
    h = spark.createDataFrame([(dt.date(2026, 1, 7),)], "date date")
    assert [str(r.date) for r in store.calendar_gaps(p, h).orderBy("date").collect()] == ["2026-01-06", "2026-01-08", "2026-01-09"]
    (tmp_path / "l.txt").write_text("# c\n a \n\nb\n")
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]


def test_reports_and_command_line(spark, tmp_path):
    g, a = vendor(8)
    spark.createDataFrame(g, G).write.parquet(str(tmp_path / "g"))
    spark.createDataFrame(a, A).write.parquet(str(tmp_path / "a"))
    general_, allocation = readers.load(spark, "parquet", general=str(tmp_path / "g"), allocation=str(tmp_path / "a"))
    u = lens.universe(general_, allocation, LensConfig(lookback=5))
    for language, word in (("en", "Overview"), ("tr", "Genel görünüm")):
        text = market_report(u, language)
        assert word in text and "AAA" in text
        assert "BBB" in selected_report(u, [" bbb"], language) and "AAA" not in selected_report(u, ["bbb"], language)
        assert fund_sentences(u.orderBy("fund_code").first(), language).startswith("AAA")
    snap = fund_snapshot(general_, allocation, " aaa ", LensConfig(lookback=5))
    assert snap["tables"]["broad"][0] == ("Fixed Income", 80.0) and fund_snapshot(general_, allocation, "ZZZ") is None
    assert "Fixed Income" in snapshot_text(snap) and "Borçlanma" in snapshot_text(snap, "tr")
    assert group_comments(u, "archetype") and dominance_comments(u, "tr") and group_comments(u.limit(0), "archetype") == []
    assert lens.validation(u).first().repeated_codes == 0
    assert [(r.founder, r.funds) for r in lens.founder_totals([u, u]).collect()] == [("İŞ PORTFÖY", 4)]
    listed = spark.createDataFrame([("iş portföy-fon",), ("YOK",)], "title string")
    assert {(r.title, r.fund_code) for r in lens.listed_titles(listed, general_).collect()} == {("iş portföy-fon", "AAA"), ("iş portföy-fon", "BBB"), ("YOK", None)}
    base = ["--general", str(tmp_path / "g"), "--allocation", str(tmp_path / "a")]
    out = str(tmp_path / "out" / "r.md")
    assert cli.main(["report", *base, "--lookback", "5", "--language", "tr", "--output", out], spark) == 0
    assert "Piyasa raporu" in open(out, encoding="utf-8").read()
    assert cli.main(["compare", *base, "--lookback", "5", "--funds", "AAA", "--output", out], spark) == 0
    assert cli.main(["classify", *base, "--lookback", "5", "--model", str(tmp_path / "m.json"), "--output", out], spark) == 0
    assert cli.main(["stress", *base, "--start", "2026-01-02", "--end", "2026-01-08", "--output", out], spark) == 0
