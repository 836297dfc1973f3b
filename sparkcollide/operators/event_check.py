"""Rules of event records as one pass over flat arrays.

The particle rows of all events of a batch lie one after another in numpy
columns; colour ends are sorted by event and tag, and every rule is a mask or a
reduction over segments.  The work is linear in rows and ends, and text is made
only for events that break a rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Coloured PDG ids are the six quarks and the gluon.
COLOURED = (1, 2, 3, 4, 5, 6, 21)
GLUON = 21
INTS, FLOATS = ("pid", "status", "mother1", "mother2", "c1", "c2"), ("px", "py", "pz", "e", "m")
TOKENS = 13  # of a whole particle row
INT_TEXT, FLOAT_TEXT = r"^-?\d{1,9}$", r"(?i)^-?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$"


@dataclass
class Rules:
    """What an event must look like; None leaves a rule out."""

    incoming: int = 2
    final_count: int | None = None
    final_abs_pdg: int | None = None
    forbid: tuple[int, ...] = ()
    abs_tol: float = 1e-5
    rel_tol: float = 1e-6
    beam_order: bool = False
    first_singlet: int | None = None
    isolated_singlet: int | None = None
    mass_status: tuple[int, ...] = (-1, 1)


@dataclass
class Events:
    """Flat particle rows of a batch: ``event`` rises, ``idx`` counts from 1 within an event."""

    nup: np.ndarray  # -1: unreadable
    event: np.ndarray
    idx: np.ndarray
    ok: np.ndarray
    column: dict[str, np.ndarray]


# --- reading ---------------------------------------------------------------------------
def _numbers(text: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """(values, readable) of number texts."""
    try:
        return pc.cast(text, kind).to_numpy(zero_copy_only=False), np.ones(len(text), bool)
    except pa.ArrowInvalid:
        plain = pc.replace_substring_regex(text, r"^\+", "")
        good = pc.match_substring_regex(plain, INT_TEXT if pa.types.is_integer(kind) else FLOAT_TEXT)
        value = pc.cast(pc.if_else(good, plain, pa.scalar("0")), kind)
        return value.to_numpy(zero_copy_only=False), good.to_numpy(zero_copy_only=False)


def read_text(texts: pa.Array) -> tuple[Events, np.ndarray]:
    """Rows of whole event blocks, and the weights of their headers (NaN: unreadable)."""
    body = pc.replace_substring_regex(texts, r"^<[^>]*>|</[A-Za-z]+>\s*$", "")
    split = pc.split_pattern(body, "\n")
    line = pc.ascii_trim_whitespace(split.flatten())
    keep = pc.and_(pc.not_equal(line, ""), pc.invert(pc.starts_with(line, "#"))).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths()))[keep]
    line = line.filter(pa.array(keep))
    first = np.searchsorted(of, np.arange(len(texts)))
    place = np.arange(len(of)) - first[of]
    nup, weight = np.full(len(texts), -1, np.int64), np.full(len(texts), np.nan)
    head = pc.ascii_split_whitespace(line.filter(pa.array(place == 0)))
    with_head, count = of[place == 0], np.asarray(head.value_lengths())
    word, start = head.flatten(), np.concatenate([[0], np.cumsum(count)])[:-1]
    value, good = _numbers(word.take(pa.array(start)), pa.int32())
    nup[with_head] = np.where(good & (value >= 0), value, -1)
    has = count > 2
    value, good = _numbers(word.take(pa.array(start[has] + 2)), pa.float64())
    weight[with_head[has]] = np.where(good, value, np.nan)

    rows = np.flatnonzero((place > 0) & (place <= nup[of]))
    token = pc.ascii_split_whitespace(line.take(pa.array(rows)))
    count = np.asarray(token.value_lengths())
    ok, start = count >= TOKENS, np.concatenate([[0], np.cumsum(count)])[:-1]
    whole = np.flatnonzero(ok)
    column = {}
    for names, shift, kind in ((INTS, 0, pa.int32()), (FLOATS, len(INTS), pa.float64())):
        at = (start[whole][:, None] + shift + np.arange(len(names))).ravel()
        value, good = _numbers(token.flatten().take(pa.array(at)), kind)
        value, good = value.reshape(-1, len(names)), good.reshape(-1, len(names))
        ok[whole] &= good.all(1)
        for k, n in enumerate(names):
            column[n] = np.zeros(len(rows), value.dtype)
            column[n][whole] = value[:, k]
    return Events(nup, of[rows], place[rows], ok, column), weight


def from_arrays(nup: pa.Array, particles: pa.Array) -> Events:
    """Rows of parsed particle arrays (idx, ok, and the particle fields)."""
    flat = particles.flatten()
    of = np.repeat(np.arange(len(nup)), np.asarray(pc.fill_null(particles.value_lengths(), 0)))
    ok = flat.field("ok").to_numpy(zero_copy_only=False).astype(bool)
    column = {n: pc.fill_null(flat.field(n), 0).to_numpy(zero_copy_only=False) for n in (*INTS, *FLOATS)}
    return Events(pc.fill_null(nup, -1).to_numpy(zero_copy_only=False).astype(np.int64), of, flat.field("idx").to_numpy(zero_copy_only=False), ok, column)


# --- rules -----------------------------------------------------------------------------
def _counts(event: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(event, minlength=n)


def _firsts(event: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """First of the given rows of each event, -1 where there is none."""
    out = np.full(n, -1)
    out[event[rows][::-1]] = rows[::-1]
    return out


def messages(ev: Events, rules: Rules) -> Iterator[tuple[int, str]]:
    """(event, message) of every broken rule, in no order; an event that cannot be read has one message."""
    n, e, idx, c = len(ev.nup), ev.event, ev.idx, ev.column
    lost = ev.nup < 0
    yield from ((int(k), "bad header") for k in np.flatnonzero(lost))
    bad = _firsts(e, np.flatnonzero(~ev.ok), n)
    short = ~lost & (bad >= 0)
    yield from ((int(k), f"short row {idx[bad[k]]}") for k in np.flatnonzero(short))
    few = ~lost & ~short & (_counts(e, n) != ev.nup)
    yield from ((int(k), "row count") for k in np.flatnonzero(few))
    readable = ~(lost | short | few)
    live = readable[e]
    pid, status, c1, c2 = (c[k] for k in ("pid", "status", "c1", "c2"))
    coming, final, active = live & (status == -1), live & (status == 1), live & (np.abs(status) == 1)

    n_in = _counts(e[coming], n)
    yield from ((int(k), f"incoming {n_in[k]}") for k in np.flatnonzero(readable & (n_in != rules.incoming)))
    if rules.beam_order:
        yield from ((int(k), "beam order needs two") for k in np.flatnonzero(readable & (n_in != 2)))
        beams = np.flatnonzero(coming & (n_in[e] == 2))
        yield from ((int(e[k]), "beam order") for k in beams[::2][c["pz"][beams[::2]] < c["pz"][beams[1::2]]])
    if rules.final_count is not None:
        n_out = _counts(e[final], n)
        yield from ((int(k), f"final {n_out[k]}") for k in np.flatnonzero(readable & (n_out != rules.final_count)))
    if rules.final_abs_pdg is not None:
        others: dict[int, list[str]] = {}
        for k in np.flatnonzero(final & (np.abs(pid) != rules.final_abs_pdg)):
            others.setdefault(int(e[k]), []).append(str(pid[k]))
        yield from ((k, f"final id {','.join(v)}") for k, v in others.items())
    for p in rules.forbid:
        yield from ((int(k), f"forbidden {p}") for k in np.unique(e[final & (pid == p)]))

    px, py, pz, en, m = (c[k].astype(float) for k in FLOATS)
    with np.errstate(all="ignore"):
        m2 = en * en - px * px - py * py - pz * pz
        tol = np.maximum(rules.abs_tol, rules.rel_tol * np.maximum(1.0, np.abs(en)))
        massive = live & np.isin(status, rules.mass_status)
        below = massive & (m2 < -tol)
        off = massive & ~below & ~(np.abs(np.sqrt(np.maximum(0.0, m2)) - np.abs(m)) <= tol)
    yield from _rowwise(below, "negative mass", e, idx)
    yield from _rowwise(off, "mass", e, idx)

    coloured, gluon = active & np.isin(np.abs(pid), COLOURED), active & (np.abs(pid) == GLUON)
    none, one = (c1 == 0) & (c2 == 0), (c1 != 0) != (c2 != 0)
    quark = coloured & ~gluon
    yield from _rowwise(coloured & none, "no colour", e, idx)
    yield from _rowwise(gluon & ((c1 == 0) | (c2 == 0)), "gluon tag missing", e, idx)
    yield from _rowwise(gluon & (c1 == c2), "gluon tags equal", e, idx)
    yield from _rowwise(quark & ~one, "quark tags", e, idx)
    yield from _rowwise(quark & one & np.where(pid > 0, c1 == 0, c2 == 0), "quark side", e, idx)
    yield from _rowwise(active & ~np.isin(np.abs(pid), COLOURED) & ~none, "colourless tag", e, idx)
    yield from _tags(ev, rules, readable, active, final)


def _rowwise(mask: np.ndarray, label: str, event: np.ndarray, idx: np.ndarray) -> Iterator[tuple[int, str]]:
    rows = np.flatnonzero(mask)
    return ((k, f"{label} {i}") for k, i in zip(event[rows].tolist(), idx[rows].tolist(), strict=True))


def _tags(ev: Events, rules: Rules, readable: np.ndarray, active: np.ndarray, final: np.ndarray) -> Iterator[tuple[int, str]]:
    n, c = len(ev.nup), ev.column
    rows = np.flatnonzero(active)
    row, tag = np.concatenate([rows, rows]), np.concatenate([c["c1"][rows], c["c2"][rows]])
    # an incoming line's first tag is an anticolour end
    anti = np.concatenate([np.ones(len(rows), bool), np.zeros(len(rows), bool)]) == (c["status"][row] == -1)
    row, tag, anti = row[tag != 0], tag[tag != 0], anti[tag != 0]
    order = np.lexsort((row, tag, ev.event[row]))
    row, tag, anti = row[order], tag[order], anti[order]
    new = np.ones(len(row), bool)
    new[1:] = (tag[1:] != tag[:-1]) | (ev.event[row[1:]] != ev.event[row[:-1]])
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    many = np.diff(np.append(head, len(row)))
    antis = np.bincount(of[anti], minlength=len(head))
    other = new.copy()
    other[1:] |= row[1:] != row[:-1]
    lines = np.bincount(of[other], minlength=len(head))  # different particles on the tag
    at, event = tag[head], ev.event[row[head]]
    two = many == 2
    yield from ((int(event[k]), f"tag {at[k]} ends {many[k]}") for k in np.flatnonzero(~two))
    yield from ((int(event[k]), f"tag {at[k]} kinds {'aa' if antis[k] else 'cc'}") for k in np.flatnonzero(two & (antis != 1)))
    yield from ((int(event[k]), f"tag {at[k]} self") for k in np.flatnonzero(two & (lines == 1)))

    pid, c1, c2 = c["pid"], c["c1"], c["c2"]
    if rules.first_singlet is not None:
        q, aq = (_firsts(ev.event, np.flatnonzero(final & (pid == s * rules.first_singlet)), n) for s in (1, -1))
        both = (q >= 0) & (aq >= 0)
        good = both & (c1[q] != 0) & (c2[q] == 0) & (c1[aq] == 0) & (c2[aq] == c1[q])
        clean = {(int(event[k]), int(at[k])) for k in np.flatnonzero(lines == 2)}
        yield from ((int(k), "first pair") for k in np.flatnonzero(readable) if not (good[k] and (int(k), int(c1[q[k]])) in clean))
    if rules.isolated_singlet is not None:
        f = rules.isolated_singlet
        end = lambda mask: np.bincount(of[mask], minlength=len(head)) > 0
        quark = end(final[row] & (pid[row] == f) & (c1[row] == tag) & (c2[row] == 0))
        antiquark = end(final[row] & (pid[row] == -f) & (c2[row] == tag) & (c1[row] == 0))
        found = np.zeros(n, bool)
        found[event[(lines == 2) & quark & antiquark]] = True
        yield from ((int(k), "no singlet") for k in np.flatnonzero(readable & ~found))


def error_lists(ev: Events, rules: Rules) -> pa.Array:
    """Sorted messages per event."""
    pairs = sorted(messages(ev, rules), key=lambda p: (p[0], p[1].encode()))
    ends = np.searchsorted(np.array([k for k, _ in pairs], np.int64), np.arange(len(ev.nup) + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array([m for _, m in pairs], pa.string()))
