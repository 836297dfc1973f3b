"""Header-only reading, header checks and expected numbers of events."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from sparkcollide.operators import lhe as ops
from sparkcollide.sinks.lhe_writer import write_lhe
from sparkcollide.sources import lhe, lhe_header

INIT = "<init>\n 2212 2212 7000 7000 0 0 230000 230000 3 1\n {x:.6e} 1.0e-02 1.0 1\n</init>\n"
EVENT = "<event>\n 1 1 0.5 100.0 -1.0 0.1\n 5 1 0 0 501 0 1.0 2.0 3.0 4.0 4.75 0 9\n</event>\n"
HEAD = '<LesHouchesEvents version="1.0">\n<header>\nnotes\n</header>\n'


def document(events, x=1.0, head=HEAD):
    return head + INIT.format(x=x) + EVENT * events + "</LesHouchesEvents>\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if path.endswith(".gz") else open)(path, "wt") as f:
        f.write(text)


def heads(spark, path):
    spark.dataSource.register(lhe_header.LheHeaderSource)
    return {os.path.basename(r["path"]): r for r in spark.read.format("lhe_header").load(path).collect()}


def test_bytes_read_do_not_grow_with_events(spark, tmp_path):
    for n in (2_000, 20_000):
        for end in ("", ".gz"):
            write(f"{tmp_path}/{n}/a.lhe{end}", document(n))
    few, many = heads(spark, f"{tmp_path}/2000"), heads(spark, f"{tmp_path}/20000")
    assert few["a.lhe"]["bytes_read"] == many["a.lhe"]["bytes_read"] == lhe_header.BLOCK
    assert many["a.lhe"]["file_bytes"] > 9 * few["a.lhe"]["file_bytes"]
    assert many["a.lhe.gz"]["bytes_read"] <= lhe_header.BLOCK
    for r in (*few.values(), *many.values()):
        assert r["preamble"] == HEAD + INIT.format(x=1.0)


def test_long_headers_members_and_hidden_files(spark, tmp_path):
    long = HEAD.replace("notes", "n" * 100_000)
    write(f"{tmp_path}/x=1/long.lhe", document(1, head=long))
    with open(f"{tmp_path}/two.lhe.gz", "wb") as f:  # an archive of two members
        f.write(gzip.compress(HEAD.encode()) + gzip.compress(document(3).removeprefix(HEAD).encode()))
    write(f"{tmp_path}/none.lhe", document(0))
    write(f"{tmp_path}/other.txt", "no events here")
    write(f"{tmp_path}/_SUCCESS", "")
    write(f"{tmp_path}/.part.crc", document(1))
    got = heads(spark, str(tmp_path))
    assert set(got) == {"long.lhe", "two.lhe.gz", "none.lhe"}
    assert got["long.lhe"]["preamble"].startswith(long) and got["two.lhe.gz"]["preamble"] == HEAD + INIT.format(x=1.0)
    paths = {r["path"] for r in lhe.scan_lhe_events(spark, str(tmp_path)).select("path").distinct().collect()}
    assert paths <= {r["path"] for r in got.values()}  # the same names as the event scan's
    inits = lhe.scan_lhe_init(spark, [f"{tmp_path}/x=1", f"{tmp_path}/two.lhe.gz"]).collect()
    assert [r["processes"][0]["xsec"] for r in inits] == [1.0, 1.0]


def test_unknown_file_system_uses_the_event_scan(spark, tmp_path, monkeypatch):
    write(f"{tmp_path}/a.lhe", document(5))
    want = lhe.scan_lhe_init(spark, str(tmp_path)).select("path", "beam_line", "nprup", "processes").collect()
    monkeypatch.setattr(lhe, "can_open", lambda p: False)
    assert lhe.scan_lhe_init(spark, str(tmp_path)).select("path", "beam_line", "nprup", "processes").collect() == want
    assert not lhe_header.can_open("nowhere://a/b")


@pytest.mark.parametrize("bad, message", [
    ("<init>\n</init>", "empty init block"), ("<init>\n 1 2 3\n</init>", "short beam line"), ("<init>\n" + "1 " * 9 + "x\n</init>", "invalid process count"),
    ("<init>\n" + "1 " * 9 + "2\n 1 1 1 1\n</init>", "process lines differ"), ("<init>\n" + "1 " * 9 + "1\n 1 b 1 1\n</init>", "invalid process line"),
])
def test_malformed_headers_raise(spark, tmp_path, bad, message):
    write(f"{tmp_path}/a.lhe", HEAD + bad + "\n" + EVENT)
    with pytest.raises(Exception, match=message):
        lhe.scan_lhe_init(spark, str(tmp_path)).collect()


def merged(spark, path, **options):
    return ops.merge_shards(lhe.scan_lhe_events(spark, path), lhe.scan_lhe_init(spark, path), **options)


def test_merge_checks_headers_and_number_of_events(spark, tmp_path):
    write(f"{tmp_path}/in/a.lhe", document(3))
    write(f"{tmp_path}/in/b.lhe", document(4))
    assert merged(spark, f"{tmp_path}/in", expected_events=7).count() == 7
    with pytest.raises(Exception, match="expected 8 events, found 7"):
        merged(spark, f"{tmp_path}/in", expected_events=8).count()
    write(f"{tmp_path}/in/c.lhe", document(1, x=1.5))
    with pytest.raises(Exception, match="c.lhe: cross-section differs from .*a.lhe"):
        merged(spark, f"{tmp_path}/in").count()
    assert merged(spark, f"{tmp_path}/in", rel_tol=0.5).count() == 8
    write(f"{tmp_path}/empty/a.lhe", document(0))
    with pytest.raises(Exception, match="expected 1 events, found 0"):
        merged(spark, f"{tmp_path}/empty", expected_events=1).count()


def test_writer_counts_events(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 2).alias("part"), F.col("id").alias("k"), F.lit(EVENT.strip()).alias("event"))
    tops = spark.range(2).select(F.col("id").alias("part"), F.lit(HEAD + INIT.format(x=1.0)).alias("preamble"))
    assert write_lhe(rows, tops, f"{tmp_path}/out", ["part"], ["k"], expected_events=10) == 10
    assert lhe.scan_lhe_events(spark, f"{tmp_path}/out", strict=True).count() == 10
    with pytest.raises(ValueError, match="expected 9 events, wrote 10"):
        write_lhe(rows, tops, f"{tmp_path}/out2", ["part"], ["k"], expected_events=9)


def test_unreadable_event_header_raises(spark):
    ev = spark.createDataFrame([("<event>\n 1 1 0.5 x -1.0 0.1\n</event>",)], "event string")
    with pytest.raises(Exception, match="unreadable event header: 1 1 0.5 x"):
        lhe.parse_event_header(ev).collect()
    assert lhe.parse_event_header(ev, strict=False).first()["scale"] is None


def test_text_and_parsed_rows_give_the_same_errors(spark):
    import random

    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    events = []
    for _ in range(400):
        n = r.randrange(0, 7)
        rows = []
        for _ in range(n):
            tags = pick((501, 0), (0, 501), (501, 502), (502, 501), (0, 0), (503, 503))
            tokens = [pick(5, -5, 21, 11, 4), pick(1, 1, -1, 2), 0, 0, *tags, "1.0", "2.0", pick("3.0", "nan", "+3e0", "x"), pick("4.0", "9.5"), pick("4.75", "0"), 0, 9]
            rows.append(" ".join(map(str, tokens[: pick(13, 13, 13, 13, 13, 12)])))
        head = f"{pick(n, n, n, n, n + 1, 'q')} 1 {pick('0.5', 'w')} 1 1 1"
        events.append("<event a='1'>\n# note\n" + "\n".join([head, *rows, pick("", "  ", "<rwgt/>")]) + "\n</event>")
    events += ["<event>\n</event>", "<event> 1 1 2 3 4 5\n</event>"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(events)], "k int, event string")
    rules = dict(final_count=2, final_abs_pdg=5, forbid=(4,), beam_order=True, first_singlet=5, isolated_singlet=5)
    text = {r["k"]: (r["errors"], r["nup"], r["xwgtup"]) for r in ops.check_events(df, **rules).collect()}
    parsed = {r["k"]: (r["errors"], r["nup"], r["xwgtup"]) for r in ops.check_events(lhe.parse_rows(df), **rules).collect()}
    assert text == parsed and len(text) == len(events)
    assert {m.rsplit(" ", 1)[0] for e, _, _ in text.values() for m in e} > {"mass", "tag 501 ends", "tag 501 kinds", "short row", "quark tags", "colourless tag", "gluon tags equal"}
