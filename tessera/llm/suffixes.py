"""Exact removal of long repeated byte strings, by a distributed merge sort of suffixes that knows common prefixes.

Not every suffix has to be sorted. Of the STRIDE windows of GRAM bytes at the head of a string of PASSAGE_BYTES bytes
or more, the one with the smallest hash is the string's anchor; equal strings have their anchors at equal places. So
it does to sort the suffixes at anchors, about two in STRIDE bytes, each with the bytes before it as a tail. All
strings with an anchor hold the core, the bytes that follow it up to the end of the shortest of them; anchors whose
core occurs once (by a 64-bit hash, which can only let too many through) can't be in a repeated string and are not
sorted.

Each task sorts its suffixes into runs, holds equal ones once, front-codes them (length of the prefix shared with the
one before, then the rest) and sends each part to one task, which merges the runs with a loser tree that keeps the
length of the prefix that each candidate shares with the last winner and never compares it again. Suffixes are ordered
by a hash of their core first and by bytes within it, so parts are even whatever the texts begin with, and a class of
suffixes with one core lies in one part.

A class with more than CLASS_SUFFIXES different suffixes is split before it is sorted: each anchor of it stands for
STRIDE strings that start at the STRIDE places before it, and these are dealt to narrower classes whose cores are
longer (LEVELS). The narrowest hold equal strings only, so that nothing remains to be split; all pass the same merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, stored

#: Bytes of the strings that are removed if they repeat.
LENGTH = 400
#: Bytes of the repeated strings that make up a passage, and words that it has at least. Passages are only reported.
PASSAGE_BYTES = 256
PASSAGE_WORDS = 51
STRIDE = 200
GRAM = 16
CORE = PASSAGE_BYTES - STRIDE + 1
#: Width of the classes: an anchor stands for the strings that start at as many places, and bytes a suffix has.
LEVELS = ((STRIDE, LENGTH), (50, LENGTH), (10, LENGTH), (1, LENGTH), (1, PASSAGE_BYTES))
#: The first of the narrowest levels; they split the last of the wider ones.
NARROWEST = 3
#: Bytes that are searched for anchors at a time, and bytes of a sorted run.
BLOCK = 2_000_000
RUN_BYTES = 48_000_000
#: Different suffixes of a class beyond which it is split into narrower ones: 60 MB at most are held for a class.
CLASS_SUFFIXES = 100_000
#: Bytes of suffixes, before coding, that one part of the order should get.
RANGE_BYTES = 16_000_000
_M1, _M2, _M3, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_ROOM = BLOCK + 2 * (LENGTH + STRIDE)
_UP = _powers(_ROOM)
_DOWN = np.full(_ROOM, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
_DOWN[0] = 1
_DOWN = np.multiply.accumulate(_DOWN)


def _least(keys: np.ndarray) -> np.ndarray:
    """The smallest of each STRIDE keys in a row."""
    n = len(keys) - STRIDE + 1
    pad = np.full(-len(keys) % STRIDE, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.concatenate([keys, pad]).reshape(-1, STRIDE)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[STRIDE - 1 : STRIDE - 1 + n])


def _stirred(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    return (x * _M3) ^ (x >> np.uint64(29))


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in data, hashes of their cores, and hashes of the suffixes there with their tails.

    The documents of data lie from starts to ends; anchors are those of strings within one document that start at
    one of the two places own or between them (own: first place and the place behind the last, for each document).
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < PASSAGE_BYTES:
        return none, none, none
    own = np.stack([starts, ends], axis=1) if own is None else own
    b = np.frombuffer(data, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(data, dtype="<u8", count=1), shape=(len(b) - 7,), strides=(1,))
    h = eight[: len(b) - GRAM + 1] * _M1 + eight[8:] * _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    low = _least(h)
    step = np.zeros(len(b) + 1, dtype=np.int8)
    first, last = own[:, 0], np.minimum(own[:, 1], ends - PASSAGE_BYTES + 1)
    long = last > first
    np.add.at(step, first[long], 1)
    np.add.at(step, last[long], -1)
    inside = np.cumsum(step[: len(low)], dtype=np.int8) > 0
    at = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none
    at = at[np.concatenate([[True], np.diff(at) != 0])]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)])])
    core = _stirred((total[at + CORE] - total[at]) * _DOWN[at])
    part = np.searchsorted(starts, at, side="right") - 1
    lo, hi = np.maximum(starts[part], at - STRIDE + 1), np.minimum(ends[part], at + LENGTH)
    full = _stirred((total[hi] - total[lo]) * _DOWN[lo] + (at - lo).astype(np.uint64) * _M1 + (hi - at).astype(np.uint64) * _M2)
    return at, core.view(np.int64), full.view(np.int64)


def _blocks(texts: Iterator[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int, int]]]]:
    """Texts in blocks of about BLOCK bytes: the bytes, and for each piece its row, the place in the text where it
    starts, its start and end in the block, and the first and last (exclusive) places of strings that are its own.

    A longer text is cut into pieces that hold all that suffixes at the anchors of their own strings reach.
    """
    held, parts, n = [], [], 0
    step = BLOCK // 2
    for row, text in enumerate(texts):
        for off in range(0, max(1, len(text) - PASSAGE_BYTES + 1), step):
            whole = len(text) <= step
            at = 0 if whole else max(0, off - STRIDE)
            piece = text if whole else text[at : off + step + STRIDE + LENGTH]
            if n + len(piece) > BLOCK and held:
                yield b"".join(held), parts
                held, parts, n = [], [], 0
            held.append(piece)
            parts.append((row, at, n, n + len(piece), n + off - at, n + (len(piece) if whole else off - at + step)))
            n += len(piece)
            if whole:
                break
    if held:
        yield b"".join(held), parts


_AT = "_k long, _h long, pos int, core long, full long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.binary()))
        for data, parts in _blocks(texts):
            row, off, start, end, first, last = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
            at, core, full = anchors(data, start, end, np.stack([first, last], axis=1))
            if len(at):
                part = np.searchsorted(start, at, side="right") - 1
                take = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([b.column("_k").take(take), b.column("_h").take(take), pa.array((at - start[part] + off[part]).astype(np.int32)), pa.array(core), pa.array(full)], ["_k", "_h", "pos", "core", "full"])


def _needed(level: int) -> int:
    """Bytes that all strings of a class share from its anchor on."""
    width, most = LEVELS[level]
    return PASSAGE_BYTES - width + 1 if level < NARROWEST else most


def _narrowed(wide: list[np.ndarray], level: int):
    """The places of classes of a level that wide classes are split into; wide holds the cores of each level before it.

    Anchors are found again, so no text is moved for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            column = b.column("text").cast(pa.binary())
            places: dict[int, set[int]] = {}
            for data, parts in _blocks(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column):
                row, off, start, end, first, last = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
                at, core, _ = anchors(data, start, end, np.stack([first, last], axis=1))
                at = at[np.isin(core, wide[0])]
                part = np.searchsorted(start, at, side="right") - 1
                for r, p in zip(row[part].tolist(), (at - start[part] + off[part]).tolist(), strict=True):
                    places.setdefault(r, set()).add(p)
            for r, some in places.items():
                text, within = column[r].as_py(), STRIDE
                for step in range(1, len(wide) + 1):
                    to = step if step < len(wide) else level
                    width, most = LEVELS[to]
                    need = _needed(to)
                    starts = np.array(sorted({p - j for p in some for j in range(0, within, width) if 0 <= p - j <= len(text) - need}), dtype=np.int64)
                    core = np.array([digest(text[q : q + need], to) for q in starts], dtype=np.uint64).view(np.int64)
                    if step < len(wide):
                        some, within = starts[np.isin(core, wide[step])].tolist(), width
                n = len(starts)
                if n:
                    full = np.array([digest(text[max(0, q - width + 1) : q + most], min(q, width - 1) << 10 | min(len(text) - q, most)) for q in starts.tolist()], dtype=np.uint64).view(np.int64)
                    take = pa.array([r] * n)
                    yield pa.RecordBatch.from_arrays([b.column("_k").take(take), b.column("_h").take(take), pa.array(starts.astype(np.int32)), pa.array(core), pa.array(full)], ["_k", "_h", "pos", "core", "full"])

    return run


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the longest common prefix of a and b, the first known bytes of which are known to agree."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        end = min(n, known + step)
        x, y = a[known:end], b[known:end]
        if x != y:
            return end - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        known, step = end, step * 4
    return n


_RUNS = "part int, full binary, times binary, right binary, prefix binary, rest binary, tails binary"
_RUN_SCHEMA = pa.schema([("part", pa.int32()), *[(x.split()[0], pa.binary()) for x in _RUNS.split(", ")[1:]]])


def _coded(rows: list[tuple[int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    """A run of (part, suffix, bytes to the right of the anchor, hash), sorted and front-coded, in a row for each part."""
    rows.sort()
    pack = zstandard.ZstdCompressor(level=3).compress
    lo = 0
    while lo < len(rows):
        part, hi = rows[lo][0], lo
        full, times, right, prefix, rest, tails, last = [], [], [], [], [], [], b""
        while hi < len(rows) and rows[hi][0] == part:
            _, key, r, f = rows[hi]
            hi += 1
            if full and key == last and r == right[-1]:
                times[-1] = 2
                continue
            n = shared_prefix(last, key, 0)
            full.append(f)
            times.append(1)
            right.append(r)
            prefix.append(n)
            rest.append(len(key) - n)
            tails.append(key[n:])
            last = key
        cells = [np.array(full, "<i8"), np.array(times, "u1"), np.array(right, "<u2"), np.array(prefix, "<u2"), np.array(rest, "<u2")]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in cells], pa.array([pack(b"".join(tails))], pa.binary())], schema=_RUN_SCHEMA)
        lo = hi


def _to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes, int, int]] = []
    n = 0
    levels = [(bytes([i]), width - 1, most) for i, (width, most) in enumerate(LEVELS)]
    for b in batches:
        for text, places in zip(b.column("text").cast(pa.binary()), b.column("places").to_pylist(), strict=True):
            text = text.as_py()
            for x in places:
                p, part = x["pos"], x["part"]
                sign, before, most = levels[part & 7]
                right = text[p : p + most]
                rows.append((part, sign + right + text[max(0, p - before) : p][::-1], len(right), x["full"]))
                n += len(rows[-1][1])
                if n >= RUN_BYTES:
                    yield from _coded(rows)
                    rows, n = [], 0
    if rows:
        yield from _coded(rows)


class Run:
    """The suffixes of one front-coded run, decoded one by one."""

    def __init__(self, cells: dict[str, bytes]):
        self.full, self.times = np.frombuffer(cells["full"], "<i8").tolist(), cells["times"]
        self.right, self.prefix, self.rest = (np.frombuffer(cells[x], "<u2").tolist() for x in ("right", "prefix", "rest"))
        self.tails = zstandard.ZstdDecompressor().decompress(cells["tails"])
        self.at, self.place, self.now = -1, 0, b""

    def next(self) -> bool:
        self.at += 1
        if self.at == len(self.prefix):
            return False
        end = self.place + self.rest[self.at]
        self.now = self.now[: self.prefix[self.at]] + self.tails[self.place : end]
        self.place = end
        return True


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, Run]]:
    """(suffix, length of the prefix shared with the suffix before, run) in order, from a loser tree over the runs.

    known[i] is the prefix that run i's suffix shares with the last winner. Where two differ, the larger one wins
    without a comparison; where they agree, comparing starts behind it.
    """
    k = len(runs)
    known, live = [0] * k, [r.next() for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known becomes what it shares with the winner."""
        if not live[a] or not live[b]:
            return (a, b) if live[a] else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a].now, runs[b].now
        n = shared_prefix(x, y, known[a])
        first = n == len(x) and (n < len(y) or a < b) or n < len(x) and n < len(y) and x[n] < y[n]
        if first:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * (2 * size)

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        a, b = build(2 * node), build(2 * node + 1)
        if a < 0 or b < 0:
            losers[node] = -1
            return max(a, b)
        winner, losers[node] = play(a, b)
        return winner

    best = build(1)
    while live[best]:
        r = runs[best]
        yield r.now, known[best], r
        live[best] = r.next()
        if live[best]:
            known[best] = r.prefix[r.at]  # shared with its own predecessor, which has just won
        node = (best + size) // 2
        while node:
            if losers[node] >= 0:
                best, losers[node] = play(best, losers[node])
            node //= 2


class _Class:
    """Different suffixes that share a core, in order, with the prefixes that the merge found them to share."""

    def __init__(self, level: int) -> None:
        self.level = level
        self.texts: list[bytes] = []
        self.right: list[int] = []
        self.shared: list[int] = []
        self.times: list[int] = []
        self.full: list[int] = []

    def verdicts(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(hash of the suffix, level, and for LENGTH and PASSAGE_BYTES the most and the least bytes before the
        anchor in strings that repeat, -1 for none) of each suffix in a repeated string."""
        m = len(self.texts)
        left = [len(t) - r - 1 for t, r in zip(self.texts, self.right, strict=True)]
        bounds = []
        for length in (LENGTH, PASSAGE_BYTES):
            most, least = [-1] * m, [length + 1] * m
            for i in range(m):
                if self.times[i] > 1 and left[i] + self.right[i] >= length:
                    most[i], least[i] = min(left[i], length), max(0, length - self.right[i])
            bounds.append((length, most, least))
        if 1 < m <= 8:
            self._pairs(left, bounds)
        elif m > 8:
            self._groups(left, bounds)
        (_, a, b), (_, c, d) = bounds
        for i in range(m):
            if c[i] >= 0:
                yield self.full[i], self.level, a[i], b[i], c[i], d[i]

    def _pairs(self, left: list[int], bounds: list[tuple[int, list[int], list[int]]]) -> None:
        for i in range(len(left)):
            r = LENGTH
            for j in range(i + 1, len(left)):
                r = min(r, self.shared[j] - 1)
                both = min(r, self.right[i], self.right[j])
                n = shared_prefix(self.texts[i][self.right[i] + 1 :], self.texts[j][self.right[j] + 1 :], 0)
                for length, most, least in bounds:
                    if n + both >= length:
                        for k in (i, j):
                            most[k], least[k] = max(most[k], n), min(least[k], max(0, length - both))

    def _groups(self, left: list[int], bounds: list[tuple[int, list[int], list[int]]]) -> None:
        """All strings of the class at once: two suffixes share one with j bytes before the anchor if neither the
        order by what follows the anchor nor that by what precedes it parts them too early."""
        m, before = len(left), LEVELS[self.level][0] - 1
        tails = [t[r + 1 :] for t, r in zip(self.texts, self.right, strict=True)]
        order = sorted(range(m), key=tails.__getitem__)
        after = np.array([-1, *(s - 1 for s in self.shared[1:])])
        ahead = np.array([-1, *(shared_prefix(tails[a], tails[b], 0) for a, b in zip(order, order[1:]))])
        order, lefts, rights = np.array(order), np.array(left), np.array(self.right)
        for length, most, least in bounds:
            tops, lows = np.array(most), np.array(least)
            cuts = np.concatenate([[0], length - after[1:], length - rights, ahead[1:] + 1, lefts + 1])
            cuts = np.unique(cuts[(cuts >= 0) & (cuts <= before)])
            for j, end in zip(cuts, [*cuts[1:], before + 1], strict=True):
                ok = (lefts >= j) & (rights >= length - j)
                if np.count_nonzero(ok) < 2:
                    continue
                by_left = np.empty(m, dtype=np.int64)
                by_left[order] = np.cumsum(ahead < j)
                group = (np.cumsum(after < length - j) * (m + 1) + by_left)[ok]
                _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
                hit = np.flatnonzero(ok)[count[inverse] > 1]
                tops[hit], lows[hit] = np.maximum(tops[hit], end - 1), np.minimum(lows[hit], j)
            most[:], least[:] = tops.tolist(), lows.tolist()


_VERDICT = pa.schema([("part", pa.int32()), ("full", pa.int64()), *[(x, pa.int16()) for x in ("most", "least", "p_most", "p_least")]])


def _merge(table: pa.Table) -> pa.Table:
    """The suffixes of one part that are in repeated strings."""
    found: list[tuple[int, int, int, int, int, int]] = []
    group = _Class(0)
    runs = [Run(r) for r in table.select([f.name for f in _RUN_SCHEMA if f.name != "part"]).to_pylist()]
    cores = [1 + _needed(level) for level in range(len(LEVELS))]
    for text, shared, run in merged(runs):
        i = run.at
        if group.texts and shared == len(text) == len(group.texts[-1]) and run.right[i] == group.right[-1]:
            group.times[-1] = 2
            continue
        if group.texts and (shared < cores[group.level] or text[0] != group.level):
            found += group.verdicts()
            group = _Class(text[0])
        elif not group.texts:
            group.level = text[0]
        group.texts.append(text)
        group.right.append(run.right[i])
        group.shared.append(shared)
        group.times.append(run.times[i])
        group.full.append(run.full[i])
    found += group.verdicts()
    part = table.column("part")[0].as_py() if len(table) else 0
    full, _, *rest = zip(*found, strict=True) if found else ((),) * 6
    return pa.table([pa.array([part] * len(full), pa.int32()), pa.array(full, pa.int64()), *[pa.array(x, pa.int16()) for x in rest]], schema=_VERDICT)


def _united(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of spans, each start << 10 | length; touching ones are one stretch."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans or ()):
        a, b = s >> 10, (s >> 10) + (s & 1023)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words of a text that lie between two places, without those that reach across them."""
    n = len(text[start:end].split())
    cut_left = start > 0 and text[start - 1] not in _SPACE and text[start] not in _SPACE
    cut_right = end < len(text) and text[end] not in _SPACE and text[end - 1] not in _SPACE
    return max(0, n - cut_left - cut_right)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            out = []
            for text, spans, passages in zip(part.column("text").cast(pa.binary()), part.column("spans").to_pylist(), part.column("passages").to_pylist(), strict=True):
                text, kept, at, gone = text.as_py() or b"", [], 0, _united(spans)
                for a, z in gone:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                told = sum(whole_words(text, a, z) >= PASSAGE_WORDS for a, z in _united(passages))
                out.append((len(text), sum(z - a for a, z in gone), len(gone), told, b"".join(kept)))
            n, lost, runs, told, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, lost, runs)], pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(told, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"])


def _repeated(at: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None]:
    """Of places at(_AT): those of classes to be merged, and the cores of classes to be split first, None if there are none."""
    # tables of their own, so that Spark can split the joins at a hot core
    n = F.count(F.lit(1))
    often = stored(at.groupBy("core").agg(n.alias("n"), F.min("full").alias("a"), F.max("full").alias("b")).where("n > 1").select("core", ((F.col("n") > CLASS_SUFFIXES) & (F.col("a") != F.col("b"))).alias("many")), "frequent-cores")
    every = stored(at.join(often, "core").select("_k", "_h", "pos", "core", "full", "many", F.lit(level).alias("level")), "candidates")
    many = every.where("many")
    if many.isEmpty():
        return every, None
    # places are many; now the different suffixes among them
    wide = stored(many.select("core", "full").distinct().groupBy("core").agg(n.alias("n")).where(F.col("n") > CLASS_SUFFIXES).select("core"), "wide-cores")
    if wide.isEmpty():
        return every, None
    return every.where("not many").unionByName(many.join(wide, "core", "left_anti")), wide


def _by_document(places: DataFrame, *columns: str) -> DataFrame:
    value = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return places.groupBy("_k", "_h").agg(F.sort_array(F.collect_set(value)).alias("places"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Places whose suffixes are to be sorted, with core, full and level; wide classes are split until none is left.

    The cores of wide classes go to all tasks: each has over CLASS_SUFFIXES places, so there are 8 bytes for at least
    CLASS_SUFFIXES * (STRIDE / 2) bytes of text, or 1 MB in over a TB.
    """
    long = rows.where(F.octet_length("text") >= PASSAGE_BYTES).select("_k", "_h", "text")
    found, cores = _repeated(stored(long.mapInArrow(_find_anchors, _AT), "anchors"), 0)
    wide: list[np.ndarray] = []
    while cores is not None:
        wide.append(np.array([r.core for r in cores.collect()], dtype=np.int64))
        cores = None
        for level in [len(wide)] if len(wide) < NARROWEST else range(NARROWEST, len(LEVELS)):
            more, cores = _repeated(stored(long.mapInArrow(_narrowed(wide, level), _AT), "narrower"), level)
            found = found.unionByName(more)
    return found


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept) for each row of docs(doc_id, text).

    Every byte goes that lies in a string of LENGTH bytes which also starts anywhere else in docs, in the same
    document too; strings are judged on the input and do not cross documents. A null text is empty. Texts are bytes
    of UTF-8, so kept is binary. Equal rows are documents of their own, so those of LENGTH bytes or more go wholly.

    n_passages counts the maximal stretches of bytes in strings of PASSAGE_BYTES bytes that start anywhere else too
    and which hold PASSAGE_WORDS whole words or more; passages under LENGTH bytes are reported, not removed.

    Copies cost little: equal suffixes are one in each run, and their places wait for the verdict outside the merge.
    """
    rows = docs.select("doc_id", *row_key(), "text")
    found = _candidates(rows)
    parts = max(1, -(-found.count() * (LENGTH + STRIDE) // RANGE_BYTES))
    found = found.withColumn("part", (F.pmod("core", F.lit(parts)) * 8 + F.col("level")).cast("int")).select("_k", "_h", "pos", "part", "full")
    # the same exchange of texts serves this join and the last one
    runs = rows.join(_by_document(found, "pos", "part", "full"), ["_k", "_h"]).select("doc_id", "text", "places").mapInArrow(_to_runs, _RUNS)
    verdicts = runs.groupBy("part").applyInArrow(_merge, "part int, full long, most short, least short, p_most short, p_least short")
    span = lambda most, least, length: F.when(F.col(most) >= 0, F.shiftleft((F.col("pos") - F.col(most)).cast("long"), 10) + (length - F.col(least) + F.col(most)))
    hit = found.join(verdicts, ["part", "full"]).select("_k", "_h", span("most", "least", LENGTH).alias("s"), span("p_most", "p_least", PASSAGE_BYTES).alias("p"))
    gone = hit.groupBy("_k", "_h").agg(F.collect_set("s").alias("spans"), F.collect_set("p").alias("passages"))
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary"
    return rows.join(gone, ["_k", "_h"], "left").select("doc_id", "text", "spans", "passages").mapInArrow(_cut, columns)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
