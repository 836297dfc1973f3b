"""Operators of the llm subpackage against brute force on small tables."""

import collections
import hashlib
import math
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkcollide.llm import bpe, fingerprints, jaccard, kneser_ney, packing, queries, secrets, substring, toxicity, url_filter, vectors
from sparkcollide.llm.words import chunks
from tests.llm.fixtures import LOWER, SCHEMA, WORD, by_id, clashing, documents, texts

WORDS = queries.vocabulary("word_bpe_49k.json")
BYTES = queries.vocabulary("byte_bpe_50k.json")
TEXTS = texts()


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_url_lists_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    cur = con.execute(url_filter.ORACLE)
    cols = [d[0] for d in cur.description]
    got = [tuple(r[c] for c in cols) for r in queries.op1(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(cur.fetchall(), key=repr)


def test_url_lists_ties_nulls_and_repeats(spark):
    caps = spark.sql("""select * from values (1L, 'http://a.b.com/x/y.html', date'2020-05-01', 'z'), (1L, 'http://a.b.com/x/y.html', date'2020-05-01', 'z'),
        (2L, 'http://b.com', date'2019-01-01', 'z'), (3L, null, date'2020-01-01', 'z'), (4L, '/rel', null, 'z') as t(page_id, url, fetched_at, pattern)""")
    entries = spark.sql("""select * from values ('l', 'b.com', 'allow', date'2020-01-01'), ('l', 'b.com', 'block', date'2020-01-01'), ('l', 'a.b.com/x/', 'allow', date'2020-02-01'),
        ('l', 'a.b.com/x/', 'retire', date'2020-05-01'), ('m', 'b.com', 'allow', date'2020-05-01'), (null, 'b.com', 'block', date'2000-01-01') as t(list, pattern, action, effective_at)""")
    got = by_id(url_filter.filter_urls(caps, entries), "page_id")
    assert len(got) == 4
    assert (got[1]["action"], got[1]["list"], got[1]["pattern"]) == ("block", "l", "b.com")  # the longer pattern is retired that day
    assert got[2]["action"] is None and got[3]["host"] == "" and got[4]["pattern"] is None
    assert url_filter.filter_urls(caps.limit(0), entries).count() == 0


def test_url_lists_hot_pattern(spark):
    caps = spark.range(4000).selectExpr("id as page_id", "if(id % 2 = 0, 'http://hot.com/a', concat('http://h', id, '.org/')) as url", "date_add(date'2020-01-01', cast(id % 100 as int)) as fetched_at")
    keyed = caps.select(F.explode(url_filter.lookup_keys(F.col("url"))).alias("key"))
    assert {r["hot"] for r in url_filter.hot_keys(keyed).collect()} == {"hot.com", "com", "org"}
    entries = spark.sql("select * from values ('l', 'hot.com', 'block', date'2020-01-01'), ('l', 'hot.com', 'allow', date'2020-02-01'), ('m', 'h7.org', 'allow', date'2019-01-01') as t(list, pattern, action, effective_at)")
    got = by_id(url_filter.filter_urls(caps, entries), "page_id")
    assert len(got) == 4000
    for i, r in got.items():
        assert r["action"] == (("block" if i % 100 < 31 else "allow") if i % 2 == 0 else "allow" if i == 7 else None)


def test_guess_cost():
    words = secrets.dictionary(WORDS)
    cost = lambda v: secrets.guess_cost(v, words)[0]
    assert cost("password") < cost("passw0rd#") < cost("x9$Kq!v2Lm@Z")
    kinds = lambda v: [k for k, _, _ in secrets.guess_cost(v, words)[1]]
    assert kinds("aaaaaaaa") == ["repeat"] and kinds("asdfghjkl") == ["walk"] and kinds("2019-12-31") == ["date"] and kinds("password2019") == ["word", "date"]
    assert secrets.guess_cost("", words) == (0.0, [])


def test_secrets(spark):
    got = by_id(secrets.op2_secrets(clashing(documents(spark)), WORDS))
    for i, t in enumerate(TEXTS):
        t = t or ""
        want = sorted(x for x in secrets.find(t, {}, math.inf))
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in want)
        assert got[i]["base_sha256"] == sha(text.encode())
    row = next(r for r in got.values() if r["n_access"])
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1)
    clean = secrets.scan(documents(spark), WORDS, redact="[s]").where("size(spans) > 0").first()["redacted"]
    assert "hunter2" not in clean and "AKIA" not in clean and "0a0a" not in clean


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = packing.op3_best_fit(clashing(documents(spark)), WORDS).collect()
    made, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        made[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(made[i]) == [(k, 4096 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cut)]
    for held in places.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 4096) + 1
    assert packing.op3_best_fit(documents(spark, []), WORDS).count() == 0


def test_sum_of_squares_by_hand():
    seq, offset = packing.sum_of_squares(np.array([10, 6, 4, 7, 3, 5, 5]), 10)
    assert seq.tolist() == [0, 1, 1, 2, 2, 3, 3] and offset.tolist() == [0, 0, 6, 0, 7, 0, 5]


def components_of(sets, linked):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_groups(spark):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = components_of(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = by_id(jaccard.op4_jaccard(clashing(documents(spark))))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 5


def test_jaccard_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (5, "A b c d e f"), (None, "z"), (None, None)]
    got = sorted((r["doc_id"] is None, r["n_shingles"], r["component_id"]) for r in jaccard.op4_jaccard(documents(spark, rows)).collect())
    assert got == sorted([(True, 2, 5), (False, 2, 5), (False, 2, 5), (True, 1, None), (True, 0, None)])
    assert jaccard.op4_jaccard(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 130, 512, 600, 2049, 5000])
def test_jaccard_parities_refute_no_link(n):
    """Distances at the narrower width never exceed the shingles in one set only; sets without common shingles are refuted."""
    r = np.random.default_rng(n)
    pool = np.unique(r.integers(0, 1 << 63, 4 * n + 9).astype(np.uint64))
    r.shuffle(pool)
    one = pool[:n]
    others = [one, pool[n : 2 * n], pool[n // 10 : n + n // 10], pool[: n + n // 3], pool[: n - n // 4]]
    flat, start, width = jaccard._ragged(pa.array([jaccard._spread(x) for x in [one, *others]], pa.binary()))
    far = jaccard._distance(flat, start, width, np.zeros(len(others), int), np.arange(1, len(others) + 1))
    assert [int(f) <= len(np.setxor1d(one, x)) for f, x in zip(far, others, strict=True)] == [True] * len(others)
    assert far[0] == 0 and 7 * far[1] > 2 * n


def test_jaccard_cell_names_fewer_pairs_than_sets():
    """A cell of near copies: all links at first made a pair each, a forest joins the same rows."""
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.sort(np.concatenate([r.permutation(base)[:-6], r.integers(0, 1 << 63, 6).astype(np.uint64)])) for _ in range(90)]
    k, same = len(sets), np.zeros(len(sets), np.int32)
    batch = jaccard.row_batch(token=np.zeros(k, np.int64), i=same, j=same, block=same, sid=np.arange(k), n=np.array([len(x) for x in sets], np.int32), pos=same, g=np.arange(k), spread=pa.array([jaccard._spread(x) for x in sets], pa.binary()))
    pairs = {forest: [(a, b) for out in jaccard._cross(forest)([batch.slice(0, 40), batch.slice(40)]) for a, b in zip(*out.to_pydict().values(), strict=True)] for forest in (True, False)}
    joined = components_of(dict.fromkeys(range(k), 1), lambda a, b: (a, b) in set(pairs[True]))
    assert len(pairs[False]) == k * (k - 1) // 2 and set(pairs[True]) < set(pairs[False])
    assert len(pairs[True]) == k - 1 and set(joined.values()) == {0}


def test_jaccard_large_group_of_near_copies(spark):
    """Groups of copies with up to five words changed equal brute force, whoever meets first."""
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        own = list(base)
        for at in r.integers(0, 120, r.integers(1, 6)):
            own[at] = f"x{k}"
        rows.append((k, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    want = components_of(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = by_id(jaccard.op4_jaccard(documents(spark, rows)))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert 1 < len(set(want.values())) < 150


@pytest.mark.parametrize("seed", range(3))
def test_t_occurrence(seed):
    r = np.random.default_rng(seed)
    query = np.unique(r.integers(0, 400, 120).astype(np.uint64))
    members = [np.unique(np.concatenate([query[r.random(len(query)) < p], r.integers(500, 900, 20).astype(np.uint64)])) for p in (0.0, 0.5, 0.8, 0.9, 0.95, 1.0)] * 5
    want = [7 * len(np.intersect1d(query, m)) >= 3 * (len(query) + len(m)) for m in members]
    assert jaccard.t_occurrence(query, members).tolist() == want


def test_substring(spark):
    count, words = collections.Counter(), {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    for w in words.values():
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    got = by_id(substring.op6_substring(clashing(documents(spark))))
    assert sum(r["n_removed"] for r in got.values()) > 200
    for i, w in words.items():
        gone = {q for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for q in range(k, k + 35)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), sha(kept.encode()))
    assert substring.op6_substring(documents(spark, [])).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    got = by_id(bpe.op7_bpe(clashing(documents(spark)), BYTES))
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert got[i]["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False).encode())
    one = bpe.load(BYTES)
    for w in (b"hello", b" worthless", b"aaaaaaa", "déjà".encode(), b"x"):
        assert one.encode_many([w])[0].tolist() == one.encode_long(w).tolist()


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + r.standard_normal(16) * (0.05 if i % 3 else 0.6)).tolist(), 0) for i in range(90)]
    rows += [(90, rows[0][1], 1), (91, rows[0][1], 1), (92, None, 0), (93, [0.0] * 16, 0), (94, [float("nan")] + [1.0] * 15, 0), (95, [None] + [1.0] * 15, 0), (96, [1.0, 2.0], 0), (None, rows[4][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = by_id(vectors.op8_vectors(clashing(df)), "vec_id")
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:92]}
    x[-1] = x[4]
    deg = {i: sum(j != i and float(x[i] @ x[j]) >= 0.9 for j in x) for i in x}
    comp = components_of(x, lambda a, b: float(x[a] @ x[b]) >= 0.9)
    fix = lambda c: min(i for i in x if comp[i] == c and i >= 0)  # noqa: E731  the null id is never the smallest
    for i in range(92):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (deg[i], fix(comp[i]), i == fix(comp[i]))
    assert got[None]["n_links"] == deg[-1]
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (92, 93, 94, 95, 96))
    many = by_id(vectors.near_duplicates(df, block=8, passes=12), "vec_id")
    assert sum(r["n_links"] for r in many.values()) >= 0.9 * sum(r["n_links"] for r in got.values())
    assert vectors.passes_for(10**6, 0.9) > vectors.passes_for(10**4, 0.9)


def test_vectors_dense_group(spark):
    """A group of distinct near copies far larger than three blocks keeps its links."""
    r = np.random.default_rng(2)
    x = r.standard_normal((1800, 64))
    x[:1200] = r.standard_normal(64) + 0.3 * x[:1200]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    deg = (x @ x.T >= 0.9).sum(1) - 1
    got = np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in vectors.near_duplicates(df, block=16).collect())])
    assert deg.sum() > 500_000 and (got <= deg).all() and got.sum() >= vectors.RECALL * deg.sum()


def test_language_model(spark):
    docs = clashing(documents(spark))
    got = by_id(kneser_ney.op9_language_model(docs))
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    count = collections.Counter(x for i, t in enumerate(TEXTS) if not out(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(TEXTS):
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (out(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n)
        assert abs(got[i]["base_score"] - base) < 1e-6 * abs(base) + 1e-9
    # after any context, the words of the training rows, the end and one unseen word have probabilities that sum to one
    model = kneser_ney.train(docs.where(~kneser_ney.held_out(docs["doc_id"])))
    hashed = lambda w: kneser_ney._tokens(next(chunks(pa.array([w]))))[0][0]
    words = np.array([hashed(w) if w else kneser_ney.END for w in count] + [hashed("never-seen")])
    for ctx in ("ban", "lok", "never-seen"):
        pairs = np.stack([np.full(len(words), hashed(ctx)), words], 1).ravel()
        p, _ = kneser_ney.log_probabilities(model, pairs, np.arange(0, len(pairs) + 1, 2))
        assert (10 ** p[1::2]).sum() == pytest.approx(1)
    assert by_id(kneser_ney.op9_language_model(documents(spark, []))) == {}


def test_fingerprints(spark):
    got = by_id(fingerprints.op10_fingerprints(clashing(documents(spark))))
    order = sorted(range(len(TEXTS)), reverse=True)
    off = []
    for k, i in enumerate(order):
        t, nxt = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited.encode()))
        plain = lambda x: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := WORD.findall(x)) else set()
        a, b = plain(t), plain(edited)
        off.append(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.08
    same = collections.defaultdict(set)
    for i, t in enumerate(TEXTS):
        same[t or ""].add(got[i]["fingerprint"])
    assert all(len(f) == 1 for f in same.values())
    assert by_id(fingerprints.op10_fingerprints(documents(spark, [(3, "a b")])))[3]["near_next"] == 1.0
    twice = fingerprints.op10_fingerprints(documents(spark, [(3, "a b"), (3, "a b"), (None, "c"), (None, None)])).collect()
    assert len(twice) == 4
    assert fingerprints.op10_fingerprints(documents(spark, [])).count() == 0


def test_subsequence_kernel():
    words = ["idiot", "idioot", "id-iot", "i.d.i.o.t", "garden"]
    k = toxicity.Kernel(["idiot"])
    k.learn(words)
    value = [0.0 if k.known[w] is None else float(k.known[w][0]) for w in words]
    assert value[0] == value[2] == value[3] == pytest.approx(1) and 0.3 < value[1] < 1 and value[4] == 0
    a = toxicity._codes(["cat"], 0)
    assert toxicity.subsequence_kernel(a, toxicity._codes(["cat"], -1), 0.5)[0] == pytest.approx(0.5**6)


def test_kernel_of_stretched_and_joined_words():
    """No length limit: values are the kernel's own, and long words count with their best part."""
    k = toxicity.Kernel(["idiot", "stupid"])
    words = ["iiddiioottt", "youaresostupid", "stupididiot", "what" * 5 + "stupid" + "river" * 4, "garden" * 5]
    k.learn(words)
    value = [np.zeros(2) if k.known[w] is None else k.known[w] for w in words]
    code = lambda w, filler: toxicity._codes([w], filler)
    own = lambda w: toxicity.subsequence_kernel(code(w, 0), code(w, -1))[0]
    plain = lambda a, b: (toxicity.subsequence_kernel(code(a, 0), code(b, -1))[0] / math.sqrt(own(a) * own(b))) ** toxicity.SHARP
    least = lambda a, b: plain(a, b) * (1 - 1e-9)
    assert value[0][0] >= least(words[0], "idiot") > 0.5
    assert value[1][1] >= least(words[1], "stupid") > 0.1
    assert value[2][0] >= least("didiot", "idiot") > 0.2 and value[2][1] >= least(words[2], "stupid") > 0.15
    assert value[3][1] > 0.1 and not value[4].any()


def test_toxicity(spark):
    import random

    r = random.Random(1)
    plain = ["river", "table", "garden", "window", "letter", "music", "paper", "winter"]
    bad = ["stupid", "moron", "worthless"]
    rows = []
    for i in range(400):
        w = [r.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(w[:15]) + ". " + " ".join(w[15:])))
    rows += [(1000, None), (1001, ""), (1002, "river table you st*upid window"), (1003, "here m o r o n here"), (None, "moron " + "river " * 20000), (1004, "garden letter")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.op5_toxicity(clashing(documents(spark, rows)), labels).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    wrong = sum(by[i]["predicted"] != int(i % 4 == 0) for i in range(400))
    assert wrong <= 4
    assert [by[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None)] == [0, 0, 1, 1, 0, 1]
    one = toxicity.op5_toxicity(documents(spark, rows), labels.where("toxic = 0")).collect()
    assert all(x["predicted"] == 0 for x in one)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.op5_toxicity(none, labels).count() == 0
    assert secrets.op2_secrets(none, WORDS).count() == 0 and bpe.op7_bpe(none, BYTES).count() == 0
    assert vectors.op8_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_extreme_vectors_and_null_ids(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e198]), (None, [1e200, 0.0]), (4, [0.0, 1e-200]), (5, [0.0, 1e-180]), (None, [0.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got)) == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
