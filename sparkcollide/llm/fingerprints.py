"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's five-word shingles are hashed once; the top bits of a hash choose one
of ``BINS`` bins, and a bin keeps its smallest hash.  Empty bins are filled by
optimal densification: bin i asks the bins h(i, 1), h(i, 2), ... of universal
hashes until one is not empty.  A fingerprint keeps 4 low-order bits of each
bin's value (hashed once more with the bin), one hexadecimal digit per bin.  Two unrelated bins agree by chance with
probability 1/16, so the likeness is (agreement - 1/16) / (1 - 1/16), not below 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 256
WORDS = 5
TRIES = 24  # universal hashes that an empty bin asks; then the next non-empty bin to its right
PRIME = 2147483647
RANGE_CHARS = 1_000_000
MOST_RANGES = 200_000


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")


def _probe(bin_: Column, attempt: int, bins: int) -> Column:
    return ((bin_ + 1) * (48271 * attempt + 11) + 69621 * attempt * attempt) % PRIME % bins


def digits(texts: DataFrame, keys: list[str], bins: int = BINS, words: int = WORDS) -> DataFrame:
    """keys + fingerprint for the column ``text``; keys name one row each.

    Fewer words than ``words`` make one shingle; no words: an empty fingerprint.
    If ``texts`` is already dealt by some of the keys, nothing is shuffled: all
    shingles of a row meet in the partition that holds it.
    """
    width = bins.bit_length() - 1
    split = texts.select(*keys, words_of(F.col("text")).alias("_w"))
    rows = split.select(*keys, "_w", (F.get("_w", F.lit(0)) != "").alias("_some"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - words, F.lit(0)))).alias("_i"))
    hashed = rows.select(*keys, "_some", F.xxhash64(*[F.get("_w", F.col("_i") + k) for k in range(words)]).alias("_h"))
    least = hashed.groupBy(*keys, "_some", F.shiftrightunsigned("_h", 64 - width).cast("int").alias("_bin")).agg(F.min("_h").alias("_h"))
    held = least.groupBy(*keys, "_some").agg(F.array_sort(F.collect_list(F.struct("_bin", "_h"))).alias("_b"))
    # one value a bin, null where empty; a digit also depends on its bin, so that copies of one value do not agree together
    none = lambda n: F.array_repeat(F.lit(None).cast("long"), n)
    gaps = F.transform("_b", lambda x, i: F.concat(none(x["_bin"] - F.when(i == 0, F.lit(-1)).otherwise(F.get("_b", i - 1)["_bin"]) - 1), F.array(x["_h"])))
    held = held.select(*keys, "_some", "_b", F.flatten(gaps).alias("_v"))
    right = lambda b: F.coalesce(F.get(F.filter("_b", lambda x: x["_bin"] > b), F.lit(0)), F.get("_b", F.lit(0)))["_h"]
    value = lambda b: F.coalesce(F.get("_v", b), *[F.get("_v", _probe(b.cast("long"), t, bins).cast("int")) for t in range(1, TRIES + 1)], right(b))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.substring(F.lit("0123456789abcdef"), F.xxhash64(value(b), b).bitwiseAND(15).cast("int") + 1, F.lit(1)))
    return held.select(*keys, F.when(F.col("_some"), F.array_join(filled, "")).otherwise("").alias("fingerprint"))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Likeness of two fingerprints, 0 to 1, corrected for chance. Two empty ones: 1; one empty: 0."""
    differ = F.lit(0)
    for k in range(0, bins, 16):
        word = lambda s, k=k: F.conv(F.substring(s, k + 1, 16), 16, -10).cast("long")
        x = word(a).bitwiseXOR(word(b))
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / 16
    near = F.greatest((1 - differ / bins - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(near)


def _range_of(cuts: list[int]) -> Column:
    """How many cuts are not below doc_id, looked up in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    array = lambda x, kind: F.from_json(F.lit(str(x)), kind)
    below = F.size(F.filter(array([b[-1] for b in blocks], "array<bigint>"), lambda c: c < F.col("doc_id")))  # blocks wholly below
    inside = F.size(F.filter(F.get(array(blocks, "array<array<bigint>>"), below), lambda c: c < F.col("doc_id")))
    return F.lit(len(cuts)) - F.when(below == len(blocks), F.lit(len(cuts))).otherwise(below * step + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the next one by descending doc_id: (bucket, place, lent, doc_id, text, next_text).

    Rows are dealt into ranges of doc_id of about equal size (quantiles from one
    aggregate); a range is sorted on its own and borrows the first row of the
    range after it (``lent`` 1, its last row), so no task needs more than one
    range.  Null ids come last, equal ids are ordered by text; after the last
    row comes the first one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    ranges = int(min(MOST_RANGES, max(1, chars // RANGE_CHARS)))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges)).alias("c")).first()["c"]
        cuts = sorted(set(found or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_range_of(cuts)).cast("int")
    dealt = rows.withColumn("bucket", bucket)
    order = Window.orderBy("bucket")  # one row a range: at most MOST_RANGES + 1, hence broadcast below
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    heads = heads.select(F.col("bucket").alias("of"), "head", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    lent = dealt.join(F.broadcast(heads), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("to").agg(F.min("text").alias("text"))
    both = dealt.select("bucket", "doc_id", "text", F.lit(0).alias("lent")).union(lent.select("to", F.lit(None).cast("long"), "text", F.lit(1)))
    w = Window.partitionBy("bucket").orderBy("lent", F.desc_nulls_last("doc_id"), "text")
    return both.select("bucket", F.row_number().over(w).alias("place"), "lent", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edit(rows: DataFrame) -> DataFrame:
    """Adds the edited text: the last floor(n / 2) code points become those the next document begins with."""
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {half})"), F.expr(f"substring(next_text, 1, {half})"))
    return rows.select("bucket", "place", "lent", "doc_id", "text", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and its likeness to the next document.

    Null text: empty.  Empty texts have an empty fingerprint.  Equal texts have
    equal fingerprints.  A document alone is its own next one.  Repeated ids
    keep one row each, ordered by text.  Other columns are not read.  Empty
    table: no rows.
    """
    rows = edit(with_next(docs))
    keys = ["bucket", "place", "lent", "which"]
    both = rows.select("bucket", "place", "lent", F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.coalesce("edited", F.lit("")).alias("text")))).alias("t"))
    made = digits(both.select("bucket", "place", "lent", "t.which", "t.text").where("lent = 0 or which = 0"), keys)
    pick = lambda k: F.max(F.when(F.col("which") == k, F.col("fingerprint")))
    made = made.groupBy("bucket", "place", "lent").agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"))
    w = Window.partitionBy("bucket").orderBy("place")
    near = likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    made = made.withColumn("next_fingerprint", F.lead("fingerprint").over(w)).where("lent = 0").select("bucket", "place", "fingerprint", "edited_fingerprint", near)
    told = rows.where("lent = 0").select("bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return told.join(made, ["bucket", "place"])


def op10_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "near_next",
    )
