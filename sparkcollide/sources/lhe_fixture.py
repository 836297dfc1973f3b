"""Event text files derived from ``orders``: one order becomes one event.

Ten variants (order key modulo 10) cover good events and every class of
violation. Files are laid out as source/shard/chunk with plain, gzip and
truncated shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.session import cut_lineage, scratch_dir, table
from sparkcollide.sinks.lhe_writer import write_lhe

CHUNK = 50_000  # events per file
_written: dict[tuple[str, str], str] = {}


def particle_columns():
    """Final particles (pid, status, c1, c2, px, py, pz, e, m) as expressions of k and v, or numbers where they are constant, and the beams' energy."""
    k, v = F.col("k"), F.col("v")
    lines = []
    half = None
    for i in (3, 4, 5, 6):
        px = ((k * (37 * i + 11)) % 401 - 200) / F.lit(4.0)
        py = ((k * (53 * i + 7)) % 397 - 198) / F.lit(4.0)
        pz = ((k * (71 * i + 3)) % 599 - 299) / F.lit(4.0)
        e = F.sqrt(px * px + py * py + pz * pz + 4.75**2)
        half = e if half is None else half + e
        pid = F.when(v == 2, 4).otherwise(5) if i == 3 else 5 if i % 2 else -5
        tag = 501 if i < 5 else 502
        c1 = tag if i % 2 else 0
        c2 = 0 if i % 2 else tag
        if i == 4:
            c2 = F.when(v == 0, 0).otherwise(tag)
        if i == 6:
            c2 = F.when(v == 4, 501).otherwise(tag)
        m = F.when(v == 3, "5.7500000000e+00").otherwise("4.7500000000e+00") if i == 5 else 4.75
        lines.append((pid, 1, c1, c2, px, py, pz, e, m))
    return lines, half / 2


def line_text(n: int, values, texts: tuple[int, ...] = ()):
    """Text of particle line n; constants stand in the template, so that only what differs is formatted. ``texts``: places of values that are text."""
    pid, st, c1, c2, *rest = values
    mother = (0, 0) if n < 3 else (1, 2)
    template, args = [], []
    for at, (form, value) in enumerate(zip(("%8d", "%2d", "%d", "%d", "%4d", "%4d", *["%.10e"] * 5), (pid, st, *mother, c1, c2, *rest))):
        if isinstance(value, Column):
            args.append(value)
            template.append("%s" if at in texts else form)
        else:
            template.append(form % value)
    return F.format_string(" ".join(template) + "  0  9", *args)


def beam_lines(v, half):
    """Both beams; their energy is formatted once."""
    def lines(h):
        minus = F.concat(F.lit("-"), h)
        one, two = F.when(v == 5, minus).otherwise(h), F.when(v == 5, h).otherwise(minus)
        first = line_text(1, (21, -1, 503, F.when(v == 1, 503).otherwise(504), 0.0, 0.0, one, h, 0.0), (8, 9))
        return F.concat_ws("\n", first, line_text(2, (21, -1, 504, 503, 0.0, 0.0, two, h, 0.0), (8, 9)))

    return F.get(F.transform(F.array(F.format_string("%.10e", half)), lines), F.lit(0))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = o.select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10).alias("v"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("w"), (F.col("o_orderkey") % 4).cast("int").alias("shard"),
    )
    return o.select(
        F.when(F.col("shard") < 2, "a").otherwise("b").alias("source"), "shard",
        F.floor(F.col("k") / CHUNK).cast("int").alias("chunk"), "k", "v", "w",
    )


def event_text():
    """The text of an event as an expression of k, v and w; the torn one has no v."""
    finals, half = particle_columns()
    text = [beam_lines(F.col("v"), half)]
    for n, values in enumerate(finals, start=3):
        full = line_text(n, values, (10,))
        text.append(F.when(F.col("v") == 6, F.regexp_replace(full, r"\s+9$", "")).otherwise(full) if n == 6 else full)
    nup = F.when(F.col("v") == 7, 7).otherwise(6)
    head = F.format_string("  %d    1   %.10e   1.7019462163e+02  -1.0000000000e+00   1.0873122545e-01", nup, F.col("w"))
    event = F.concat(F.lit("<event trials='1'>\n# derived\n"), F.concat_ws("\n", head, *text), F.lit("\n</event>"))
    return F.when(F.col("v").isNull(), F.lit("<event>\n 6 1 1.0")).otherwise(event)


def preambles(rows: DataFrame) -> DataFrame:
    """One header per file; the cross-section is the weight sum of the shard."""
    files = rows.groupBy("source", "shard", "chunk").agg(F.sum("w").alias("_w"))
    per_shard = files.groupBy("source", "shard").agg(F.sum("_w").alias("x"))
    files = files.join(per_shard, ["source", "shard"])
    init = F.format_string("<init>\n 2212 2212 7000 7000 0 0 230000 230000 3 1\n  %.10e %.10e 1 1\n</init>\n", "x", F.col("x") / 100)
    return files.select("source", "shard", "chunk", F.concat(F.lit("<LesHouchesEvents version=\"1.0\">\n<header>\n</header>\n"), init).alias("preamble"))


def lhe_files(spark: SparkSession, sf: str) -> str:
    """Write the files once per application and return their root."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _written:
        return _written[key]
    root = scratch_dir(spark, "lhe")
    rows = event_rows(spark, sf)
    parts = ["source", "shard", "chunk"]
    heads = cut_lineage(preambles(rows), "preambles")
    pick = lambda df, s: df.filter(F.col("shard") == s)
    text = event_text()
    write_lhe(rows.filter("shard < 2"), heads.filter("shard < 2"), root, parts, ["k"], text=text)
    # shard 2: the last event of each file is cut and the footer is missing
    torn = pick(heads, 2).select(*parts, F.lit(2**62).alias("k"), F.lit(None).cast("long").alias("v"), F.lit(0.0).alias("w"))
    write_lhe(pick(rows, 2).unionByName(torn.select(rows.columns)), pick(heads, 2), root, parts, ["k"], footer=False, text=text)
    write_lhe(pick(rows, 3), pick(heads, 3), root, parts, ["k"], compression="gzip", text=text)
    _written[key] = root
    return root
