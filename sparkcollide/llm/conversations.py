"""Conversation structure repair: the cheapest edits that give turns a proper order.

A dynamic programme walks a conversation's turns through four states (nothing
yet, after system, after user, after assistant) and keeps, per state, the
cheapest edits so far.  Edits are kept as a persistent trail: a node names its
predecessor, so that paths share their prefixes, and has ancestors at powers of
two and a rolling hash of all edits up to it.  Of equally cheap edits the
ASCII-least win: the longest common prefix of two trails is searched over the
ancestors' hashes, and a prefix found by hash is verified edit by edit.

Turns are dealt to tasks by ranges of (conversation, turn), so a conversation may
span many tasks.  One that lies within a task in at most BLOCK turns is finished
there.  Others leave as segments, each with its cheapest edits from every state
to every state; a second pass links a conversation's segments by the same
trails and streams over the turns once more to digest what was repaired.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcollide.session import cut_lineage

BLOCK = 4096  # turns of one segment
CHARS = 1 << 23  # characters of one segment, but for its last turn
BLANKS = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
ROLE_AFTER = ("user", "user", "assistant", "user")  # role that an inserted or renamed turn gets, by state
NEXT = (USER, USER, ASSISTANT, USER)
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
MOD, BASE = (1 << 61) - 1, 1_000_003

SUMMARY = "rows long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
LINKS = "array<struct<a:int,b:int,cost:bigint,edits:string>>"
TURNS = "array<struct<role:string,text:string>>"
SEGMENT = f"{RESULT}, open boolean, part long, {SUMMARY}, links {LINKS}, body {TURNS}"


class Trails:
    """Persistent strings: node = (predecessor, text); nodes are compared as the strings that lead to them."""

    def __init__(self):
        self.up: list[tuple[int, ...]] = [()]
        self.text, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, text: str) -> int:
        jumps = [node]
        while len(jumps) <= len(self.up[jumps[-1]]):
            jumps.append(self.up[jumps[-1]][len(jumps) - 1])
        self.up.append(tuple(jumps))
        h = self.hash[node]
        for c in text:
            h = (h * BASE + ord(c)) % MOD
        self.text.append(text), self.depth.append(self.depth[node] + 1), self.hash.append(h)
        return len(self.text) - 1

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][min((self.depth[node] - depth).bit_length(), len(self.up[node])) - 1]
        return node

    def path(self, node: int, to: int = 0) -> list[str]:
        """Texts from below ``to`` down to the node."""
        out = []
        while node != to:
            out.append(self.text[node])
            node = self.up[node][0]
        return out[::-1]

    def string(self, node: int) -> str:
        return "".join(self.path(node))

    def same(self, a: int, b: int) -> bool:
        """Equal hashes verified: both ways back are walked until they meet."""
        while a != b:
            if self.text[a] != self.text[b] or self.depth[a] != self.depth[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def fork(self, a: int, b: int) -> tuple[int, int]:
        """The last nodes of two trails whose strings up to them are equal, one on each, at one depth."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.lift(a, depth), self.lift(b, depth)
        if self.hash[a] == self.hash[b] and self.same(a, b):
            return a, b
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        a, b = self.up[a][0], self.up[b][0]
        while not self.same(a, b):  # a collision: step by step from here
            a, b = self.up[a][0], self.up[b][0]
        return a, b

    def less(self, a: int, b: int) -> bool:
        if a == b:
            return False
        x, y = self.fork(a, b)
        left, right = iter(self.path(a, x)), iter(self.path(b, y))
        s = t = ""
        while True:  # texts may have different lengths
            s, t = s or next(left, ""), t or next(right, "")
            n = min(len(s), len(t))
            if not n or s[:n] != t[:n]:
                return s < t
            s, t = s[n:], t[n:]


class Walk:
    """Cheapest trail per state: best[state] = (cost, node) or None."""

    def __init__(self, trails: Trails, best: list):
        self.trails, self.best = trails, best

    def offer(self, best: list, state: int, cost: int, node: int, text: str) -> None:
        """Candidate: the trail ``node`` followed by ``text``."""
        have = best[state]
        if have is None or cost < have[0]:
            best[state] = (cost, self.trails.add(node, text))
        elif cost == have[0]:
            new = self.trails.add(node, text)
            if self.trails.less(new, have[1]):
                best[state] = (cost, new)

    def insert(self) -> None:
        best = self.best
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):  # a user turn first, an assistant turn may follow it
            if best[state] is not None:
                to = NEXT[state]
                if best[to] is None or best[state][0] + INSERT <= best[to][0]:
                    self.offer(best, to, best[state][0] + INSERT, best[state][1], "I")

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        new: list = [None] * 4
        extra = TRUNCATED if truncated else 0
        for state in STATES:
            if self.best[state] is None:
                continue
            cost, node = self.best[state]
            if not must_go:
                kept = KEEPS.get((state, initial))
                if kept is not None:
                    self.offer(new, kept, cost + extra, node, "K")
                if kept != NEXT[state]:
                    self.offer(new, NEXT[state], cost + extra + RENAME, node, "R")
            self.offer(new, state, cost + DELETE, node, "D")
        self.best = new

    def finish(self) -> tuple[int, int]:
        """Cheapest way to a proper end: nothing at all, or after an assistant turn."""
        self.insert()
        ends = [self.best[s] for s in (NOTHING, ASSISTANT) if self.best[s] is not None]
        if len(ends) == 2 and (ends[1][0] < ends[0][0] or ends[1][0] == ends[0][0] and self.trails.less(ends[1][1], ends[0][1])):
            return ends[1]
        return ends[0]


def _apply(edits: str, turns, state: int):
    """Repaired (role, text) of a stretch of turns that starts in ``state``."""
    turns = iter(turns)
    for e in edits:
        if e == "I":
            role, text = ROLE_AFTER[state], ""
        else:
            role, text = next(turns)
            if e == "D":
                continue
            if e == "R":
                role = ROLE_AFTER[state]
        state = NEXT[state] if e in "IR" else KEEPS[state, role[:1]]
        yield role, text


class _Digest:
    """Lines ``role:text`` joined by newlines, as a running digest and, if asked, as text."""

    def __init__(self, keep: bool):
        self.sha, self.lines, self.some = hashlib.sha256(), [] if keep else None, False

    def add(self, pairs) -> None:
        for role, text in pairs:
            line = f"{role}:{text}"
            self.sha.update(("\n" + line if self.some else line).encode())
            self.some = True
            if self.lines is not None:
                self.lines.append(line)

    def values(self) -> tuple[str, str | None]:
        return self.sha.hexdigest(), None if self.lines is None else "\n".join(self.lines)


def _faults(turns: list) -> tuple[dict, list]:
    """Counts over a stretch of (turn, role, text, duplicate) and, per turn, (initial, must go, truncated)."""
    out = dict(rows=len(turns), blank=0, duplicate=0, truncated=0, illegal=0, turns=0, first_turn=None, last_turn=None, first_initial=None, last_initial=None)
    marks = []
    for turn, role, text, again in turns:
        initial, body = role[:1], text.rstrip(BLANKS)
        blank, cut = not body, bool(body) and body[-1] not in ".!?"
        out["blank"] += blank
        out["duplicate"] += again and not blank
        cut = cut and not again
        out["truncated"] += cut
        if out["last_initial"] is None:
            out["first_initial"] = initial
        else:
            out["illegal"] += out["last_initial"] + initial not in LEGAL
        out["last_initial"] = initial
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = turn
        marks.append((initial, blank or again, cut))
    return out, marks


def _joined(a: dict, b: dict) -> dict:
    """Counts of two stretches, one after the other."""
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"]}


def _gaps(s: dict) -> int:
    return 0 if s["first_turn"] is None else s["last_turn"] - s["first_turn"] + 1 - s["turns"]


def _result(conv, s: dict, cost: int, audit: str, digest: _Digest) -> dict:
    sha, text = digest.values()
    return dict(conv_id=conv, gaps=_gaps(s), cost=cost, audit=audit, repaired_sha256=sha, repaired=text) | {k: s[k] for k in COUNTS}


def _whole(conv, turns: list, keep: bool) -> dict:
    s, marks = _faults(turns)
    walk = Walk(Trails(), [(0, 0), None, None, None])
    for m in marks:
        walk.turn(*m)
    cost, node = walk.finish()
    audit, digest = walk.trails.string(node), _Digest(keep)
    digest.add(_apply(audit, ((role, text) for _, role, text, _ in turns), NOTHING))
    return _result(conv, s, cost, audit, digest) | {"open": False}


def _segment(conv, part: int, turns: list) -> dict:
    s, marks = _faults(turns)
    links = []
    for a in STATES:
        walk = Walk(Trails(), [(0, 0) if k == a else None for k in STATES])
        for m in marks:
            walk.turn(*m)
        links += [dict(a=a, b=b, cost=x[0], edits=walk.trails.string(x[1])) for b, x in enumerate(walk.best) if x is not None]
    return dict(conv_id=conv, open=True, part=part, links=links, body=[dict(role=r, text=t) for _, r, t, _ in turns]) | s


def _rows(batches):
    """Sorted rows of a task: (conv_id, turn, role, text, copy, duplicate, gone), repeated rows marked as duplicates."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            *key, again, gone = row
            yield row[0], None if gone else (row[1], row[2], row[3], bool(again or key == last))
            last = last if gone else key


def _segments(block: int, keep: bool, schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId() << 32, 0, []
        groups = groupby(_rows(batches), itemgetter(0))
        first, pending = True, None  # a task's first and last conversation may have turns elsewhere
        for conv, rows in groups:
            if pending:
                out.append(_whole(*pending, keep))
            turns, size, opened, pending = [], 0, first, None
            for _, turn in rows:
                if turn is None:
                    continue
                if len(turns) == block or size > CHARS:
                    out.append(_segment(conv, part + number, turns))
                    number, turns, size, opened = number + 1, [], 0, True
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                turns.append(turn)
                size += len(turn[2])
            if opened:
                out.append(_segment(conv, part + number, turns))
                number += 1
            else:
                pending = (conv, turns)
            first = False
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if pending:
            out.append(_segment(pending[0], part + number, pending[1]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _linked(keep: bool, schema: pa.Schema):
    """Segments of a conversation, twice in order: first their links (body null), then their turns."""

    def run(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.slice(k, 1).to_pylist()[0]

        for conv, both in groupby(rows(), itemgetter("conv_id")):
            walk, total, choice = Walk(Trails(), [(0, 0), None, None, None]), {"rows": 0}, None
            node_state: dict[int, int] = {0: NOTHING}
            for row in both:
                if row["body"] is None:
                    total = _joined(total, row)
                    new: list = [None] * 4
                    for link in row["links"]:
                        if walk.best[link["a"]] is not None:
                            cost, node = walk.best[link["a"]]
                            walk.offer(new, link["b"], cost + link["cost"], node, link["edits"])
                            if new[link["b"]][1] not in node_state:
                                node_state[new[link["b"]][1]] = link["b"]
                    walk.best = new
                    continue
                if choice is None:
                    choice = _choice(walk, node_state)
                    digest = _Digest(keep)
                edits, state = choice[2].pop()
                digest.add(_apply(edits, ((t["role"], t["text"]) for t in row["body"]), state))
            digest.add(_apply(choice[3], (), choice[4]))
            total = total if total["rows"] else _faults([])[0]
            yield pa.RecordBatch.from_pylist([_result(conv, total, choice[0], choice[1], digest)], schema)

    return run


def _choice(walk: Walk, node_state: dict[int, int]):
    """Cost, audit, per segment in reverse order (edits, state before it), closing inserts and the state before them."""
    before = [x[1] for x in walk.best if x is not None]
    cost, node = walk.finish()
    trails, at = walk.trails, node
    while at not in node_state:  # inserts after the last segment
        at = trails.up[at][0]
    closing, tail = "".join(trails.path(node, at)), at
    assert at in before
    steps = []
    while at:
        steps.append((trails.text[at], node_state[trails.up[at][0]]))
        at = trails.up[at][0]
    return cost, trails.string(node), steps, closing, node_state[tail]


def repair(turns: DataFrame, block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """Repair plan per conversation: counts of faults, cost, audit, digest and (keep_text) lines of the repaired turns.

    ``turns`` has conv_id, turn, role, text, and may have ``gone``: rows that only
    name their conversation.  Turns are taken by number, nulls first, equal
    numbers by role and text.  A turn is blank (no character but blanks), else
    duplicate (role and text came before), else truncated (its last such
    character is none of ``.!?``).  Edits, in order: K keeps a turn, R (1) makes
    it user or assistant, D (2) deletes it, which blank and duplicate turns must
    be, I (5) inserts an empty turn; a truncated turn that stays costs 5.  The
    result's roles are an optional system turn and pairs of user and assistant,
    or nothing.  Cheapest edits win, then the ASCII-least.

    Null role or text counts as one space; an empty or unknown role fits nowhere.
    A null conv_id is a conversation.  Repeated rows are duplicates of each
    other.  Other columns are not read; no rows give no rows.  Very long
    conversations are cut into segments of ``block`` turns; only their digest (and
    text) is made in one task, as a stream.
    """
    spark = turns.sparkSession
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    clean = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"), copy.cast("int").alias("copy"), gone.alias("gone")
    )
    place = F.struct(F.col("turn").isNotNull().alias("x"), F.coalesce("turn", F.lit(0)).alias("y"), F.col("copy").alias("z"))
    name = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]
    first = rows.where("not gone").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), *name, place.alias("place"))
    first = first.groupBy("c", "r", "t1", "t2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.xxhash64("text") == F.col("t1")) & (F.xxhash64(F.lit(7), "text") == F.col("t2"))
    marked = rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copy", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"), "gone")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    done = cut_lineage(dealt.mapInArrow(_segments(block, keep_text, _arrow(SEGMENT)), SEGMENT), "segments")
    result = [x.split()[0] for x in RESULT.split(", ")]
    opened = done.where("open").select("conv_id", "part", *COUNTS, *[x.split()[0] for x in SUMMARY.split(", ")], "links", "body")
    plan, body = opened.withColumn("body", F.lit(None).cast(TURNS)), opened.withColumn("links", F.lit(None).cast(LINKS))
    linked = plan.withColumn("k", F.lit(0)).union(body.withColumn("k", F.lit(1))).repartition("conv_id").sortWithinPartitions("conv_id", "k", "part")
    linked = linked.drop("k", "part").mapInArrow(_linked(keep_text, _arrow(RESULT)), RESULT)
    return done.where("not open").select(*result).union(linked)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn``; dropped rows stay as ``gone``. Null columns are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy"))


def op11_repair(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations)).drop("repaired")
