"""Readers, writers and the streaming ingest on files made here."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens import schema
from flowlens.sources import files as R
from flowlens.sources import sinks as K
from flowlens.streaming import ingest as M


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


VOLUMES = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240102|AA|10|0|40|Q\n20240102|BB|x|0|5|Q\n20240102|AA|12|0|40|Q\n20240102|CC|1\n3\n"


def test_daily_volumes(spark, tmp_path):
    put(tmp_path / "v/CNMSshvol20240102.txt", VOLUMES)
    put(tmp_path / "v/CNMSshvol20170102.txt", VOLUMES)
    got = R.daily_volumes(spark, str(tmp_path / "v")).collect()
    assert [tuple(r) for r in got] == [("AA", dt.date(2024, 1, 2), 12.0, 40.0)]


def test_price_bars(spark, tmp_path):
    doc = {"chart": {"result": [{"meta": {"symbol": "brk.b"}, "timestamp": [1704153600, 1704240000, 1704240001], "indicators": {"quote": [{"close": [1.0, None, 3.0], "volume": [10, 20, 30]}], "adjclose": [{"adjclose": [0.5, None, None]}]}}]}}
    put(tmp_path / "p/x.json", json.dumps(doc))
    got = {r["d"]: (r["symbol"], r["close"], r["adjclose"], r["volume"]) for r in R.price_bars(spark, str(tmp_path / "p")).collect()}
    assert got == {dt.date(2024, 1, 2): ("BRK-B", 1.0, 0.5, 10.0), dt.date(2024, 1, 3): ("BRK-B", 3.0, 3.0, 30.0)}


def test_filings_and_numbers(spark, tmp_path):
    arrays = {"form": ["8-K", "10-Q"], "filingDate": ["2024-01-10", "2024-01-11"], "items": ["2.02,9.01", ""], "acceptanceDateTime": ["2024-01-10T21:05:00.000Z", "bad"]}
    put(tmp_path / "f/CIK1.json", json.dumps({"filings": {"recent": arrays, "files": []}}))
    put(tmp_path / "m/CIK1-more.json", json.dumps(arrays))
    rows = R.filings(spark, str(tmp_path / "f"), str(tmp_path / "m"))
    assert rows.count() == 4
    got = R.earnings_candidates(rows).select("report_date", "timing").distinct().collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 10), "amc")]
    put(tmp_path / "c/map.json", json.dumps({"0": {"ticker": "aa", "cik_str": 42}}))
    numbers = R.company_numbers(spark, str(tmp_path / "c"))
    found, none = R.with_numbers(spark.createDataFrame([("AA",), ("ZZ",)], "symbol string"), numbers)
    assert [tuple(r) for r in found.collect()] == [("AA", "CIK0000000042")] and [r[0] for r in none.collect()] == ["ZZ"]


def test_earnings_dates_default_timing(spark, tmp_path):
    put(tmp_path / "e.csv", "ticker,report_date\n aa ,2024-01-10\nbb,never\n")
    assert [tuple(r) for r in R.earnings_dates(spark, str(tmp_path / "e.csv")).collect()] == [("AA", dt.date(2024, 1, 10), "amc")]


def test_event_table_is_read_again(spark, tmp_path):
    names = [x.split() for x in schema.EVENT_TABLE.split(",")]
    row = {"symbol": "AA", "report_date": dt.date(2024, 1, 10), "timing": "amc"}
    rows = [tuple(row.get(n, None if k == 1 else {"int": 7, "double": 0.25}.get(kind)) for n, kind in names) for k in (0, 1)]
    df = spark.createDataFrame(rows, schema.EVENT_TABLE).withColumn("more", F.lit(1))
    K.write_events(df, str(tmp_path / "events"))
    got = R.event_table(spark, str(tmp_path / "events"))
    assert got.dtypes == df.drop("more").dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.drop("more").collect()))


def test_dimensions(spark, tmp_path):
    put(tmp_path / "d/w.csv", "symbol,weight\nAA,1.5\nBB,x\n")
    assert [tuple(r) for r in R.dimension(spark, str(tmp_path / "d"), "symbol string, weight double").collect()] == [("AA", 1.5), ("BB", None)]


def test_holdings(spark, tmp_path):
    put(tmp_path / "h/IWM.csv", 'Fund\nAs of\n\nTicker,Name,Asset Class\nAA,"A, Inc",Equity\nUSD,Cash,Cash\nbad ticker,B,Equity\nAA,A,Equity\nBB,B,Equity\n')
    got = R.holdings_csv(spark, str(tmp_path / "h")).orderBy("place").collect()
    assert [r["symbol"] for r in got] == ["AA", "BB"] and got[0]["fund"] == "IWM"
    cell = lambda v, i="": f"<ss:Cell{i}><ss:Data ss:Type='String'>{v}</ss:Data></ss:Cell>"
    rows = ["<ss:Row>" + cell("Name") + cell("Ticker") + cell("Asset Class") + cell("Weight (%)", ' ss:Index="6"') + "</ss:Row>"]
    for name, t, w in (("A & B", "GOOGL", "1.5"), ("C", "GOOG", "1,000.25"), ("D", "DD", "2")):
        rows.append("<ss:Row>" + cell(name) + cell(t) + cell("Equity") + cell(w, ' ss:Index="6"') + "</ss:Row>")
    put(tmp_path / "x/QQQ.xls", "<Workbook><Table>" + "\n".join(rows) + "</Table></Workbook>")
    got = {r["symbol"]: r["weight"] for r in R.holdings_xml(spark, str(tmp_path / "x"), {"GOOG": "GOOGL"}).collect()}
    assert got == {"GOOGL": pytest.approx(1001.75), "DD": 2.0}
    put(tmp_path / "l.txt", "aa, BB\ncc aa 9x\n")
    assert sorted(r[0] for r in R.ticker_list(spark, str(tmp_path / "l.txt")).collect()) == ["AA", "BB", "CC"]


def test_spreadsheet_is_read_in_splits(spark, tmp_path):
    cell = lambda v, i="": f"<Cell{i}><Data Type='String'>{v}</Data></Cell>"
    rows = ["<Row>" + cell("fund of A & B") + "</Row>", "<Row Height='3'>" + cell("Ticker") + cell("Weight (%)", ' Index="4"') + "</Row>", "<Row/>"]
    rows += [f"<Row Index='{k + 9}'>\n" + cell(f"T{chr(65 + k % 26)}{chr(65 + k // 26)}") + "<Cell/>" + cell(f"{k}.5", ' Index="4"') + "</Row>" for k in range(300)] + ["<Row>" + cell("BA<D") + cell("1", ' Index="4"') + "</Row>"]
    put(tmp_path / "x/SPY.xml", '<?xml version="1.0"?><Workbook><Table>' + "\n".join(rows) + "</Table></Workbook>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    df = R.holdings_xml(spark, str(tmp_path / "x"))
    got = {r["symbol"]: r["weight"] for r in df.collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 300 and got["TAA"] == 0.5 and got["TZC"] == 77.5 and {r["fund"] for r in df.select("fund").collect()} == {"SPY"}


def test_wide_document_snapshot_and_sector(spark, tmp_path):
    put(tmp_path / "w.csv", "date,AA,BB\n2024-01-02,1.5,\n")
    assert [tuple(r) for r in R.wide_document(spark, str(tmp_path / "w.csv"), "short").collect()] == [("AA", dt.date(2024, 1, 2), 1.5)]
    day = dt.date
    snaps = spark.createDataFrame([("f", day(2024, 1, 1), "old"), ("f", day(2024, 1, 2), "new"), ("g", day(2023, 1, 1), "kept")], "fund string, snapshot_date date, symbol string")
    assert sorted(r["symbol"] for r in R.latest_holdings(snaps).collect()) == ["kept", "new"]
    pairs = "symbol string, sector string"
    out = R.sector_of(spark.createDataFrame([("BRK-B",), ("ZZ",)], "symbol string"), spark.createDataFrame([("BRK.B", "Fin")], pairs), spark.createDataFrame([("ZZ", "Tech"), ("BRK-B", "Other")], pairs))
    assert {r["symbol"]: r["sector"] for r in out.collect()} == {"BRK-B": "Fin", "ZZ": "Tech"}


def test_sinks(spark, tmp_path):
    panel = spark.createDataFrame([("a", 1, 0.123456), ("a", 0, None), ("b", 0, None)], "symbol string, t int, dpi double")
    packed = K.pack(panel, "dpi")
    assert [tuple(r) for r in packed.collect()] == [("a", [None, 0.1235])]
    K.write_payload({"dpi": packed, "again": packed}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    K.write_report({"x": panel, "y": packed}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 4
    K.write_csv(panel, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0), ("a", dt.date(2024, 2, 2), 2.0)], "symbol string, d date, short double")
    K.write_volumes(rows, str(tmp_path / "vol"), "u")
    K.write_volumes(rows.filter("d < date'2024-02-01'").withColumn("short", F.lit(5.0)), str(tmp_path / "vol"), "u")
    assert sorted(r["short"] for r in R.volume_table(spark, str(tmp_path / "vol"), "u").collect()) == [2.0, 5.0]


def day_file(symbol, n):
    return f"Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240102|{symbol}|{n}|0|100|Q\n"


def test_streaming_equals_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    run = lambda today: M.ingest(spark, src, out, cp, today).awaitTermination()
    rows = lambda: sorted((r["symbol"], r["d"].isoformat(), r["short"]) for r in M.volumes(M.stored(spark, out)).collect())
    put(f"{src}/a20240105.txt", day_file("AA", 1))
    put(f"{src}/a20240103.txt", day_file("AA", 2))
    put(f"{src}/a20240104.txt", "Date|Symbol\n")  # posted late: empty so far
    run("2024-01-06")
    first = [("AA", "2024-01-03", 2.0), ("AA", "2024-01-05", 1.0)]
    assert rows() == first
    run("2024-01-06")
    assert rows() == first  # nothing new
    put(f"{src}/b20240104.txt", day_file("BB", 3))  # the empty day is filled
    put(f"{src}/b20240105.txt", day_file("CC", 9))  # a stored day is final
    run("2024-01-06")
    assert rows() == sorted([*first, ("BB", "2024-01-04", 3.0)])
    put(f"{src}/a20230104.txt", "Date|Symbol\n")
    run("2024-01-06")
    put(f"{src}/b20230104.txt", day_file("DD", 3))  # an old empty day is final as well
    run("2024-01-06")
    assert len(rows()) == 3


def test_derived_columns_follow_late_days(spark, tmp_path):
    """Batches in any order, a late day among them, leave what deriving everything at once gives; days out of reach are not touched."""
    src, out, cp, der = (str(tmp_path / x) for x in ("src", "out", "cp", "der"))
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    text = lambda k: "Date|Symbol\n" + "".join(f"{day(k):%Y%m%d}|{s}|{(7 * k + i * k * k) % 50}|0|{60 + i}|Q\n" for i, s in enumerate(["AA", "BB", "CC"]) if (k + i) % 5)
    run = lambda: M.ingest(spark, src, out, cp, "2024-03-01", derived=der, reach=6).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("symbol", "d", "dpi", "dd", "seen", "share").collect())
    stamps = lambda: {p: os.stat(os.path.join(der, p)).st_mtime_ns for p in os.listdir(der) if p.startswith("d=")}
    for batch in (range(3, 8), range(9, 24), [8], range(0, 3), range(24, 26)):
        old = stamps() if os.path.isdir(der) else {}
        for k in batch:
            put(f"{src}/v{day(k):%Y%m%d}.txt", text(k))
        run()
        assert rows(spark.read.parquet(der)) == rows(M.derive(M.volumes(M.stored(spark, out)), 6))
        if batch == [8]:
            same = {p for p, at in stamps().items() if old.get(p) == at}
            assert {f"d={day(k)}" for k in range(3, 8)} <= same and {f"d={day(k)}" for k in range(14, 24)} <= same  # of 9 to 23 only what 8 reaches
    assert len(os.listdir(der)) >= 26
    M.refresh(spark, out, der, [day(12)], 6)
    assert rows(spark.read.parquet(der)) == rows(M.derive(M.volumes(M.stored(spark, out)), 6))


def test_stored_panel_needs_no_shuffle(spark, tmp_path):
    from flowlens.operators import panel as P

    df = spark.range(4000).select(F.format_string("s%02d", F.col("id") % 40).alias("symbol"), F.floor(F.col("id") / 40).cast("int").alias("t"), F.rand(1).alias("adjclose"))
    spark.sql(f"create database if not exists panels location '{tmp_path}/panels'")
    K.store_panel(df, "panels.panel", 4)
    table = spark.table("panels.panel")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    window = P.forward_return(P.moving_average(table, "adjclose", "m"), 5, "r5")
    assert "Exchange" not in plan(window) and "Exchange" not in plan(window.groupBy("symbol").agg(F.avg("m"))) and "Exchange" in plan(P.moving_average(df, "adjclose", "m"))
    assert window.count() == 4000 and window.filter("r5 is not null").count() == 40 * 95
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    both = table.join(table.groupBy("symbol").agg(F.max("t").alias("last")), "symbol")
    assert "Exchange" not in plan(both) and both.count() == 4000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop database panels cascade")
