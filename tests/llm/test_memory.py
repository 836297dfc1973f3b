"""A Python worker serves one operator after the other; what one has learnt goes when the next begins."""

import os
import subprocess
import sys

import pytest

WORKER = """
import re
import pyarrow as pa
from sparkcollide.llm import jaccard, packing, queries, substring, toxicity

def anon():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["a b c d e f", None]), pa.array([3, 4], pa.int64())], names=["doc_id", "text", "th"])
first = {
    "packing": lambda: packing.encode_texts([" ".join(f"w{k * 7919 % 999983}x{k}" for k in range(n, n + 1000)) for n in range(0, 150_000, 1000)], queries.vocabulary("word_bpe_49k.json")),
    "toxicity": lambda: toxicity.shared(("idiot", "moron")).sentences([" ".join(f"w{k * 7919 % 999983}x{k}" for k in range(n, n + 1000)) for n in range(0, 149_000, 1000)]),
}
then = {
    "jaccard": lambda: list(jaccard._describe(5)(iter([batch]))),
    "substring": lambda: list(substring._paths(35, 8)(iter([batch]))),
    "toxicity": lambda: toxicity.shared(("idiot",)),
}
then["jaccard"](), then["substring"]()  # what these need themselves
before = anon()
first[FIRST]()
full = anon()
then[THEN]()
print(full - before, anon() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
@pytest.mark.parametrize("first, then", [("packing", "jaccard"), ("packing", "substring"), ("packing", "toxicity"), ("toxicity", "jaccard")])
def test_the_next_operator_frees_what_the_last_one_held(first, then):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = WORKER.replace("[FIRST]", f"[{first!r}]").replace("[THEN]", f"[{then!r}]")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert not out.returncode, out.stderr
    grown, left = map(int, out.stdout.split())
    assert grown > 20 and left < grown / 2
