"""Event text files: torn tails, headers, logs, merged output."""

import gzip

import pytest
from pyspark.sql import functions as F

from sparkcollide.operators import lhe as ops
from sparkcollide.sinks.lhe_writer import write_lhe
from sparkcollide.sources import catalogue, lhe

HEAD = '<LesHouchesEvents version="1.0">\n<init>\n 2212 2212 7000 7000 0 0 1 1 3 1\n 1.0 0.1 1 1\n</init>\n'
EVENT = "<event>\n 2 1 {w} 1 1 1\n 21 -1 0 0 501 502 0 0 1 1 0 0 9\n 21 -1 0 0 502 501 0 0 -1 1 0 0 9\n</event>\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.lhe").write_text(HEAD + EVENT.format(w=2.0) + "</LesHouchesEvents>\n")
    with gzip.open(tmp_path / "b.lhe.gz", "wt") as f:
        f.write(HEAD + EVENT.format(w=3.0) + EVENT.format(w=4.0) + "<event>\n 2 1 9.0")
    return tmp_path


def test_plain_and_gzip_with_torn_tail(spark, folder):
    ev = lhe.scan_lhe_events(spark, str(folder))
    assert ev.count() == 3
    counts = {r["path"].rsplit("/", 1)[1]: (r["complete"], r["incomplete"]) for r in lhe.incomplete_counts(spark, str(folder)).collect()}
    assert counts == {"a.lhe": (1, 0), "b.lhe.gz": (2, 1)}
    weights = sorted(r["xwgtup"] for r in lhe.parse_event_header(ev).collect())
    assert weights == [2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="incomplete event block"):
        lhe.scan_lhe_events(spark, str(folder), strict=True).collect()


def test_splits_do_not_change_the_scan(spark, tmp_path):
    (tmp_path / "big.lhe").write_text(HEAD + "".join(EVENT.format(w=i) for i in range(500)) + "</LesHouchesEvents>\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        ev = lhe.parse_event_header(lhe.scan_lhe_events(spark, str(tmp_path)))
        assert ev.rdd.getNumPartitions() > 4
        rows = [r["xwgtup"] for r in ev.orderBy("path", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [float(i) for i in range(500)]


@pytest.mark.parametrize("bad,msg", [("2212 2212 1 1", "short beam line"), (" 1 1 1 1 1 1 1 1 1 2\n 1.0 0.1 1 1", "declared count"), (" 1 1 1 1 1 1 1 1 1 1\n 1.0 x 1 1", "invalid process line")])
def test_malformed_init_raises(spark, tmp_path, bad, msg):
    (tmp_path / "a.lhe").write_text(f"<LesHouchesEvents>\n<init>\n{bad}\n</init>\n" + EVENT.format(w=1))
    with pytest.raises(Exception, match=msg):
        lhe.scan_lhe_init(spark, str(tmp_path)).collect()


def test_discovery(spark, folder):
    (folder / "note.txt").write_text("x")
    found = lhe.discover_inputs(spark, [str(folder), str(folder)], exclude="a.lhe").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["b.lhe.gz"]


def test_log_values_must_agree(spark, folder):
    inits = lhe.scan_lhe_init(spark, str(folder))
    here = inits.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).first()["dir"]
    line = "proc : 2.5 pb +- ( 0.05 pb = 2 %)"
    logs = spark.createDataFrame([(here, "a.log", 0, line), (here, "b.log", 0, line)], "dir string, log string, line_no int, line string")
    got = {(r["xsec"], r["xerr"], r["source"]) for r in ops.log_xsec_override(inits, logs).collect()}
    assert got == {(2.5, 0.05, "log")}
    off = logs.withColumn("line", F.when(F.col("log") == "b.log", F.regexp_replace("line", "2.5", "2.7")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="differs between logs"):
        ops.log_xsec_override(inits, off).collect()


def test_log_values_must_match_the_process_count(spark, folder):
    inits = lhe.scan_lhe_init(spark, str(folder))
    here = inits.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).first()["dir"]
    line = "proc : 2.5 pb +- ( 0.05 pb = 2 %)"
    logs = spark.createDataFrame([(here, "a.log", k, line) for k in range(2)], "dir string, log string, line_no int, line string")
    assert ops.log_xsec_override(inits, logs).count() == 2  # one process: the first value
    two = inits.withColumns({"nprup": F.lit(3), "processes": F.array_repeat(F.get("processes", F.lit(0)), 3)})
    with pytest.raises(Exception, match="differ in number"):
        ops.log_xsec_override(two, logs).collect()


def test_unreadable_event_has_one_error(spark):
    good = "<event>\n 2 1 1 1 1 1\n 21 -1 0 0 501 502 0 0 1 1 0 0 9\n 21 -1 0 0 502 501 0 0 -1 1 0 0 9\n</event>"
    texts = {
        "good": good, "header": good.replace(" 2 1 1", " x 1 1"), "word": good.replace("501 502 0 0 1", "501 502 0 y 1"),
        "short": good.replace(" 0 0 9\n<", "\n<"), "count": good.replace(" 2 1 1", " 3 1 1"), "swapped": good.replace("0 0 1 1", "0 0 -2 2"),
        "one": "<event>\n 1 1 1 1 1 1\n 21 -1 0 0 501 502 0 0 1 1 0 0 9\n</event>",
    }
    rows = lhe.parse_rows(spark.createDataFrame(list(texts.items()), "path string, event string").withColumn("pos", F.lit(0)))
    got = {r["path"]: r["errors"] for r in ops.check_events(rows, final_count=4, beam_order=True).collect()}
    assert (got["header"], got["word"], got["short"], got["count"]) == (["bad header"], ["short row 1"], ["short row 2"], ["row count"])
    assert got["good"] == ["final 0"] and "beam order" in got["swapped"]
    assert {"incoming 1", "beam order needs two"} <= set(got["one"])
    assert [r["errors"] for r in ops.check_events(rows.where("path = 'swapped'")).collect()] == [[]]
    massive = rows.withColumn("particles", F.transform("particles", lambda p: p.withField("m", F.lit(3.0))))
    assert "mass 1" in ops.check_events(massive.where("path = 'good'")).first()["errors"]
    assert ops.check_events(massive.where("path = 'good'"), mass_status=(1,)).first()["errors"] == []


def test_unreadable_weight_raises(spark):
    bad = spark.createDataFrame([("<event>\n 2 1 w 1 1 1\n</event>",)], "event string")
    assert lhe.parse_event_header(bad, strict=False).first()["xwgtup"] is None
    with pytest.raises(Exception, match="unreadable event header"):
        lhe.parse_event_header(bad, strict=True).collect()
    with pytest.raises(Exception, match="no event header"):
        spark.createDataFrame([("<event>\n 2 1\n</event>",)], "event string").select(ops.rewrite_event_weight(F.col("event"), F.lit(1.0))).collect()


def test_round_trip_keeps_order_and_one_header(spark, folder, tmp_path):
    ev = lhe.scan_lhe_events(spark, str(folder)).withColumn("part", F.lit(0))
    head = spark.createDataFrame([(0, HEAD)], "part int, preamble string")
    out = str(tmp_path / "out")
    write_lhe(ev, head, out, ["part"], ["path", "pos"])
    back = lhe.parse_event_header(lhe.scan_lhe_events(spark, out, strict=True)).orderBy("path", "pos")
    assert [r["xwgtup"] for r in back.collect()] == [2.0, 3.0, 4.0]
    assert lhe.scan_lhe_init(spark, out).count() == 1


def test_rewrite_weight_keeps_other_tokens(spark):
    df = spark.createDataFrame([("<event a='1'>\n# note\n  2 1 5.0 7 8 9\n 21 x\n</event>",)], "event string")
    new = df.select(ops.rewrite_event_weight(F.col("event"), F.lit(0.25)).alias("e")).first()["e"]
    assert new == "<event a='1'>\n# note\n  2 1 0.25 7 8 9\n 21 x\n</event>"


def test_catalogue_requires_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("process_id,events\nx,1\n")
    with pytest.raises(ValueError, match="cross_section_pb, local_lhe"):
        catalogue.scan_process_catalogue(spark, str(tmp_path / "p.csv"))


def test_catalogue_needs_eight_candidates(spark, tmp_path):
    (tmp_path / "p.csv").write_text("process_id,events,cross_section_pb,local_lhe,description\nx,1e3,0.5,x.lhe,only 2b\n")
    with pytest.raises(Exception, match="sum to 8"):
        catalogue.scan_process_catalogue(spark, str(tmp_path / "p.csv")).collect()
