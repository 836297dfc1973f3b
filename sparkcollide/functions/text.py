"""Text parsing and formatting as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
# Fixed value: run directory naming.
RUN_NAME = rf"run_gg_4h_([^_/]+)_({NUMBER})_({NUMBER})"
# Fixed value: terminal colour codes.
ANSI = r"\x1b\[[0-9;]*m"


def parse_point(path: Column) -> tuple[Column, Column, Column]:
    """STR01: (group, c3, d4) from the file stem, else from the nearest parent.

    The stem is tried first and then parents from the innermost outwards;
    null when nothing matches.
    """
    no_suffix = F.regexp_replace(path, r"\.[^./]*$", "")
    parts = F.reverse(F.split(no_suffix, "/"))
    hit = F.get(F.filter(parts, lambda s: s.rlike(RUN_NAME)), F.lit(0))
    group = F.regexp_extract(hit, RUN_NAME, 1)
    return group, F.regexp_extract(hit, RUN_NAME, 2).try_cast("double"), F.regexp_extract(hit, RUN_NAME, 3).try_cast("double")


def _sum_ints(text: Column, pattern: str) -> Column:
    nums = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.aggregate(nums, F.lit(0), lambda acc, x: acc + x.cast("int"))


def count_flavours_text(text: Column) -> Column:
    """STR02: struct(b, c, light) from phrases such as ``6b + 2 light jets``."""
    t = F.regexp_replace(F.lower(text), "_", " ")
    compact = lambda f: _sum_ints(t, rf"(?<![A-Za-z0-9])(\d+)\s*{f}\b")
    pairs = lambda f: 2 * F.size(
        F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (rf"\b{f}\s*{f}bar\b", rf"\b{f}\s+anti-?{f}\b", rf"\b{f}\s+-{f}\b")])
    )
    light = compact("j") + _sum_ints(t, r"(?<![A-Za-z0-9])(\d+)\s*light\s+jets?\b")
    return F.struct((compact("b") + pairs("b")).alias("b"), (compact("c") + pairs("c")).alias("c"), light.alias("l"))


def count_flavours_pdg(process: Column) -> Column:
    """STR03: struct(b, c, light) from ids after ``->`` in each ``;`` segment."""
    segments = F.filter(F.split(process, ";"), lambda s: s.contains("->"))
    final = F.transform(segments, lambda s: F.regexp_replace(s, r"^.*?->", ""))
    ids = F.flatten(F.transform(final, lambda s: F.regexp_extract_all(s, F.lit(r"([-+]?\d+)"), F.lit(1))))
    ids = F.transform(ids, lambda x: F.abs(x.cast("int")))
    n = lambda *want: F.size(F.filter(ids, lambda i: i.isin(*want)))
    return F.struct(n(5).alias("b"), n(4).alias("c"), n(1, 2, 3, 21, 901).alias("l"))


def infer_flavours(explicit: dict[str, Column], process: Column, texts: list[Column], label: Column) -> Column:
    """STR04: explicit counts > ids > first text source summing to 8 > first source.

    A total other than eight raises.
    """
    total = lambda s: s["b"] + s["c"] + s["l"]
    pdg = count_flavours_pdg(F.coalesce(process, F.lit("")))
    counts = F.transform(F.filter(F.array(*texts), lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""), count_flavours_text)
    best = F.coalesce(F.get(F.filter(counts, lambda s: total(s) == 8), F.lit(0)), F.get(counts, F.lit(0)))
    zero = F.lit(0)
    # pdg and best are each evaluated once per row: fields are picked from one struct
    picked = F.when(total(pdg) > 0, pdg).otherwise(best)
    out = F.struct(*[F.coalesce(explicit[k], picked[k], zero).cast("int").alias(k) for k in ("b", "c", "l")])
    fail = F.raise_error(F.concat(F.lit("flavour counts do not sum to 8: "), label)).cast("struct<b:int,c:int,l:int>")
    return F.when(out["b"] + out["c"] + out["l"] == 8, out).otherwise(fail)


def stable_seed(text: Column, base: int) -> Column:
    """STR05: base + first 32 bits of sha256, modulo 1e8."""
    return F.lit(base) + F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 100_000_000


def replace_suffix(name: Column, replacement: str, suffixes: tuple[str, ...] = (".root", ".input")) -> Column:
    """STR07: swap a known suffix anywhere in the name."""
    return F.regexp_replace(name, "|".join(s.replace(".", r"\.") for s in suffixes), replacement)


def sibling_name(var_file: Column, replacement: str) -> Column:
    """STR07: analysis log or summary next to a variable file."""
    return F.concat(F.substring_index(var_file, "_var.smear", 1), F.lit(replacement))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.get(found, F.size(found) - 1).try_cast("double")


def round_sig(x: Column, sig: int = 4) -> Column:
    """STR08: significant-digit rounding; zero and NaN give zero."""
    p = F.pow(F.lit(10.0), sig - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | F.isnan(x), 0.0).otherwise(F.round(x * p) / p)


@F.pandas_udf(T.StringType())
def format_level(x: pd.Series) -> pd.Series:
    """STR08: contour label by range; exact binary rounding needs C formatting."""

    def label(v):
        return ("%.0e" if v >= 1000 or v < 0.01 else "%.0f" if v >= 10 else "%.2g") % v

    return x.map(label)
