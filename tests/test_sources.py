import json

import pytest

from flowtrace.operators import graph, validation
from flowtrace.sources import feedback, geo, readers, writers

ROW = {
    "timestamp": "2026-09-01T12:00:00Z", "src_ip": "192.0.2.1", "dst_ip": "198.51.100.1", "src_port": 8333, "dst_port": 8333, "txid": "e" * 64,
    "input_addresses": ["1addr1", "bc1addr2"], "output_addresses": ["1out"], "input_amounts": [1.5, 2.5], "output_amounts": [3.9], "fee": 0.1, "script_type": "P2PKH",
}


def test_json_list_and_wrapper(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([ROW]))
    row = readers.read_transactions(spark, str(a)).first()
    assert row.input_addresses == ["1addr1", "bc1addr2"] and row.input_amounts == [1.5, 2.5] and row.src_port == 8333
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"transactions": [ROW | {"input_addresses": "bc1in1;1in2", "input_amounts": "0.5;x;1.5", "src_port": "12345", "fee": ""}]}))
    row = readers.read_transactions(spark, str(b)).first()
    assert row.input_addresses == ["bc1in1", "1in2"] and row.input_amounts == [0.5, 1.5] and row.src_port == 12345 and row.fee is None


def test_csv_and_round_trip(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("txid,timestamp,input_addresses,input_amounts,extra\nabc,not a time,a;b,1;2,zzz\n")
    df = readers.read_transactions(spark, str(p))
    row = df.first()
    assert row.timestamp is None and row.input_addresses == ["a", "b"] and row.output_addresses == [] and row.dst_ip == "" and df.columns == readers.COLUMNS
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert readers.read_transactions(spark, str(tmp_path / "t.parquet")).first() == row


def test_xml(spark, tmp_path):
    p = tmp_path / "t.xml"
    p.write_text(
        "<transactions><transaction><txid>t1</txid><input_addresses>1addrA;1addrB</input_addresses><input_amounts>2.0;3.0</input_amounts></transaction>"
        "<transaction><txid>t2</txid><input_addresses><address>q</address><address>r</address></input_addresses><input_amounts><amount>1.25</amount><amount>0.75</amount></input_amounts></transaction>"
        "<transaction><txid>t3</txid><input_address>s</input_address><input_address>u</input_address></transaction></transactions>"
    )
    rows = {r.txid: r for r in readers.read_transactions(spark, str(p)).collect()}
    assert rows["t1"].input_addresses == ["1addrA", "1addrB"] and rows["t1"].input_amounts == [2.0, 3.0]
    assert rows["t2"].input_addresses == ["q", "r"] and rows["t2"].input_amounts == [1.25, 0.75]
    assert rows["t3"].input_addresses == ["s", "u"]


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_transactions(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        readers.read_transactions(spark, str(tmp_path / "none.csv"))


def test_validation(spark):
    faults = [
        {"txid": "zz"}, {"txid": "1" * 64, "output_amounts": [-0.5]}, {"txid": "2" * 64, "input_amounts": [1.0]}, {"txid": "3" * 64, "src_ip": "999.999.999.999"},
        {"txid": "4" * 64}, {"txid": "4" * 64}, {"txid": "5" * 64, "fee": None}, {"txid": "6" * 64}, {"txid": "7" * 64, "src_ip": "2001:db8::1"},
    ]
    schema = "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, txid string, input_addresses array<string>, output_addresses array<string>, input_amounts array<double>, output_amounts array<double>, fee double, script_type string"
    rows = spark.createDataFrame([tuple((ROW | f)[c] for c in readers.COLUMNS) for f in faults], schema)
    flags = validation.flagged(rows)
    n = validation.issue_counts(flags).first()
    assert (n.invalid_txid, n.negative_amount, n.length_mismatch, n.invalid_ip, n.duplicate_txid, n.null_field, n.clean_rows) == (1, 1, 1, 1, 2, 1, 2)
    assert {r.txid[0] for r in validation.clean_subset(flags).collect()} == {"6", "7"}


def test_geo(spark):
    rows = spark.createDataFrame([(1, "195.201.0.1"), (2, "195.201.0.1"), (3, "10.0.0.1"), (4, "bad")], "row_idx long, src_ip string")
    cidrs = spark.createDataFrame([("195.201.0.0/16", "DE", 24940), ("195.0.0.0/8", "FR", 1), ("10.0.0.0/8", "XX", 2)], "cidr string, country string, asn long")
    out = {r.row_idx: (r.src_ip_country, r.src_ip_asn) for r in geo.enrich(rows, cidrs).collect()}
    assert out == {1: ("DE", 24940), 2: ("DE", 24940), 3: (None, None), 4: (None, None)}
    with pytest.raises(KeyError):
        geo.enrich(rows, cidrs, "dst_ip")


def test_feedback(spark, tmp_path):
    store = feedback.FeedbackStore(spark, str(tmp_path / "fb"))
    assert store.all().count() == store.get("w").count() == 0
    store.set_feedback("w1", " confirmed ", "wallet")
    store.set_feedback("w1", "FALSE_POSITIVE", "ip")
    row = store.get("w1").first()
    assert (row.status, row.entity_type) == ("FALSE_POSITIVE", "wallet") and store.all().count() == 1
    with pytest.raises(ValueError):
        store.set_feedback("w1", "maybe")


def test_writers(spark, tmp_path):
    alerts = spark.createDataFrame([("w1", 0.9, "CRITICAL", ["a"]), ("w2", 0.1, "LOW", [])], "entity_id string, composite_risk_score double, risk_level string, pattern_types array<string>")
    writers.write_alerts(alerts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).first().entity_id == "w1"
    text = open(writers.case_report(alerts, "w1", str(tmp_path))).read()
    assert "w1" in text and "CRITICAL" in text
    with pytest.raises(ValueError):
        writers.case_report(alerts, "nobody", str(tmp_path))


def test_numbered_and_legs(spark, tmp_path):
    p = tmp_path / "n.json"
    p.write_text(json.dumps([ROW, ROW | {"txid": "", "timestamp": "2026-09-01T11:00:00Z"}, ROW | {"txid": "f" * 64, "timestamp": "2026-09-01T10:00:00Z", "input_addresses": ["a", "", "b"], "input_amounts": [1.0, 2.0]}]))
    rows = readers.numbered(readers.read_transactions(spark, str(p)))
    legs = graph.legs_of(rows).orderBy("row_idx", "pos").collect()
    assert [(r.row_idx, r.side, r.wallet) for r in legs] == [(0, "input", "a"), (0, "input", "b"), (0, "output", "1out"), (2, "input", "1addr1"), (2, "input", "bc1addr2"), (2, "output", "1out")]
    assert graph.tx_of(rows).count() == 2
