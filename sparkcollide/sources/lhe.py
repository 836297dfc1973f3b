"""Event text files: splittable scan, header/particle parsing, run header.

A file is read with ``<event`` as record separator. The first record of a
file is its preamble; any other record is one event, complete exactly when it
contains the closing tag. Plain files stay splittable, gzip is one task each.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcollide.sources.lhe_header import LheHeaderSource, can_open

CLOSE = "</event>"

PARTICLE = (
    ("pid", "int"), ("status", "int"), ("mother1", "int"), ("mother2", "int"), ("c1", "int"), ("c2", "int"),
    ("px", "double"), ("py", "double"), ("pz", "double"), ("e", "double"), ("m", "double"),
)


def scan_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw records with their file and a position that orders them in the file."""
    raw = spark.read.option("lineSep", "<event").option("recursiveFileLookup", True).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("pos"),
        F.col("value").alias("chunk"),
    )


def is_preamble() -> Column:
    return F.col("chunk").contains("<LesHouchesEvents")


def scan_lhe_events(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """SRC01 / SRC05: one row per complete event; strict mode fails on a torn tail."""
    ev = scan_chunks(spark, path).filter(~is_preamble())
    body = F.concat(F.lit("<event"), F.substring_index("chunk", CLOSE, 1), F.lit(CLOSE))
    complete = F.col("chunk").contains(CLOSE)
    if strict:
        torn = F.raise_error(F.concat(F.col("path"), F.lit(": incomplete event block"))).cast("string")
        return ev.select("path", "pos", F.when(complete, body).otherwise(torn).alias("event"))
    return ev.filter(complete).select("path", "pos", body.alias("event"))


def incomplete_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Complete and torn event blocks per file."""
    ev = scan_chunks(spark, path).filter(~is_preamble())
    done = F.col("chunk").contains(CLOSE)
    return ev.groupBy("path").agg(F.count(F.when(done, 1)).alias("complete"), F.count(F.when(~done, 1)).alias("incomplete"))


def payload_lines(block: Column) -> Column:
    """Trimmed, non-blank, non-comment lines between the tags of a block."""
    body = F.regexp_replace(block, r"(?s)^<[^>]*>|</[A-Za-z]+>\s*$", "")
    return F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))


def header_line(block: Column) -> Column:
    """The first of ``payload_lines``, found without splitting the rest; null if there is none."""
    line = F.regexp_extract(F.regexp_replace(block, r"^<[^>]*>", ""), r"(?:^|\n)[ ]*+([^#\n][^\n]*)", 1)
    line = F.trim(F.regexp_replace(line, r"</[A-Za-z]+>\s*$", ""))
    return F.when(line != "", line)


def _tokens(line: Column) -> Column:
    return F.split(line, r"\s+")


def parse_event_header(events: DataFrame, strict: bool = True) -> DataFrame:
    """SRC02: nup, idprup, xwgtup, scale and couplings of each event.

    An unreadable value raises; where strict is off it is null.
    """
    ev = events.withColumn("lines", payload_lines(F.col("event")))
    ev = ev.withColumn("_first", header_line(F.col("event")))
    ev = ev.withColumn("_h", _tokens(F.col("_first")))
    names = (("nup", "int"), ("idprup", "int"), ("xwgtup", "double"), ("scale", "double"), ("aqed", "double"), ("aqcd", "double"))
    out = ev.withColumns({n: F.get("_h", F.lit(i)).try_cast(t) for i, (n, t) in enumerate(names)}).drop("_h")
    if strict:
        fail = F.raise_error(F.concat(F.lit("unreadable event header: "), F.coalesce("_first", F.lit(""))))
        out = out.withColumns({n: F.coalesce(n, fail.cast(t)) for n, t in names})
    return out.drop("_first")


def parse_rows(events: DataFrame) -> DataFrame:
    """Typed particle array per event; malformed rows carry ``ok = false``."""

    def row(tok, idx):
        fields = [F.get(tok, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(PARTICLE)]
        return F.struct((idx + 1).alias("idx"), (F.size(tok) >= 13).alias("ok"), *fields)

    # each line is split once; the second pass only picks and casts tokens
    lines = F.slice("lines", F.lit(2), F.greatest(F.col("nup"), F.lit(0)))
    rows = F.transform(F.transform(lines, _tokens), row)
    read = lambda p: reduce(and_, [p[n].isNotNull() for n, _ in PARTICLE], p["ok"])
    rows = F.transform(rows, lambda p: p.withField("ok", read(p)))
    return parse_event_header(events, strict=False).withColumn("particles", rows)


def explode_particles(events: DataFrame) -> DataFrame:
    """SRC03: one row per particle line with an ``error`` for bad lines.

    A missing line (fewer than nup) gives one error row for the event.
    """
    ev = parse_rows(events)
    missing = F.col("nup") - F.size("particles")
    exploded = ev.select("path", "pos", "nup", "event", missing.alias("missing"), F.explode_outer("particles").alias("p"))
    return exploded.select(
        "path", "pos", "event", "nup", "missing", "p.*",
        F.when(~F.col("p.ok"), "short row").when(F.col("p").isNull(), "no rows").alias("error"),
    )


INIT_TYPE = T.StructType(
    [
        T.StructField("xsec", T.DoubleType()), T.StructField("xerr", T.DoubleType()),
        T.StructField("xmax", T.DoubleType()), T.StructField("lprup", T.IntegerType()),
    ]
)


def scan_preambles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, preamble): the text before the first event of each file.

    Only the head of a file is read, by the ``lhe_header`` source; where Python
    cannot open the path's file system, the preambles come from the event scan.
    """
    if not can_open(path):
        return scan_chunks(spark, path).filter(is_preamble()).select("path", F.col("chunk").alias("preamble"))
    spark.dataSource.register(LheHeaderSource)
    paths = path if isinstance(path, str) else "\n".join(path)
    return spark.read.format("lhe_header").load(paths).select("path", "preamble")


def scan_lhe_init(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC04: beam line and processes per file; malformed headers raise."""
    pre = scan_preambles(spark, path)
    block = F.regexp_extract("preamble", r"(?s)(<init\b.*?</init>)", 1)
    pre = pre.withColumn("_lines", payload_lines(block))
    beam = _tokens(F.get("_lines", F.lit(0)))

    def proc(line):
        tok = _tokens(line)
        return F.struct(*[F.get(tok, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(INIT_TYPE)])

    pre = pre.withColumns({"beam_line": F.array_join(beam, " "), "nprup": F.element_at(beam, -1).try_cast("int"), "_nb": F.size(beam)})
    procs = F.slice("_lines", F.lit(2), F.greatest(F.coalesce("nprup", F.lit(0)), F.lit(0)))
    pre = pre.withColumns({"_p": procs, "processes": F.transform(procs, proc)})
    bad_row = F.exists("processes", lambda p: p["xsec"].isNull() | p["xerr"].isNull() | p["xmax"].isNull() | p["lprup"].isNull())
    problem = (
        F.when(F.size("_lines") < 1, "empty init block")
        .when(F.col("_nb") < 10, "short beam line")
        .when(F.col("nprup").isNull(), "invalid process count")
        .when(F.size("_p") != F.col("nprup"), "process lines differ from declared count")
        .when(bad_row, "invalid process line")
    )
    fail = F.raise_error(F.concat(F.col("path"), F.lit(": "), problem)).cast("string")
    return pre.withColumn("beam_line", F.when(problem.isNull(), F.col("beam_line")).otherwise(fail)).select(
        "path", "beam_line", "nprup", "processes", "preamble"
    )


def discover_inputs(spark: SparkSession, roots: list[str], prefix: str = "", suffixes: tuple[str, ...] = (".lhe", ".lhe.gz"), exclude: str | None = None) -> DataFrame:
    """SRC06: files below the roots, filtered by name, unique and sorted.

    Only file metadata is read; contents are pruned from the scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length")
    name = F.substring_index("path", "/", -1)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | name.endswith(s)
    found = found.filter(keep & name.startswith(prefix))
    if exclude:
        found = found.filter(~F.col("path").endswith(exclude))
    return found.dropDuplicates(["path"]).orderBy("path")
