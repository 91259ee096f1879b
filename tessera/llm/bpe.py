"""BPE encoding and decoding with a public vocabulary: a segment tree over the ranks of adjacent pairs yields each merge."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

FILE = "word_bpe_49k.json"
#: Encoded words kept in each Python worker; beyond it the table starts anew. It changes speed only.
CACHED_WORDS = 400_000
CACHED_CHARS = 64
NONE = 1 << 62

# Code points, as hexadecimal ranges, that are letters or numbers in newer Unicode tables than the
# vocabulary's library has; there they are other characters.
NEWER = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 "
    "A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 "
    "11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# First and last upper-case code point and the lower case of the first, where the library's tables are
# newer than Python's.
NEWER_LOWER = "1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"

# Marks, as hexadecimal ranges, that the library's tables of normal forms don't know yet: they change
# places with no other mark and make up no character. U+11930 is known, but not what it makes up.
NEWER_MARKS = (
    "7FD-7FD 898-89F 8CA-8D3 9FE-9FE C3C-C3C D3B-D3C EBA-EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C 10D24-10D27 "
    "10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070-11070 1133B-1133B 1145E-1145E 11839-1183A 11930-11930 "
    "1193D-1193E 11943-11943 119E0-119E0 11A34-11A34 11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 "
    "11F41-11F42 16FF0-16FF1 1E08F-1E08F 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _lower_map() -> dict[int, int]:
    out = {ord("Σ"): ord("σ")}  # whatever its place in the word
    for x in NEWER_LOWER.split():
        span, to = x.split(":")
        a, b = (int(v, 16) for v in span.split("-"))
        out |= {c: int(to, 16) + c - a for c in range(a, b + 1)}
    return out


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _ranges(kind: str) -> str:
    """The lower-case characters up to U+00FF of a kind, as ranges for a character class."""
    found = [c for c in range(256) if regex.match(kind, chr(c)) and chr(c).lower() == chr(c)]
    starts = [c for c in found if c - 1 not in found]
    return "".join(rf"\x{a:02x}-\x{next(c for c in range(a, 257) if c not in found) - 1:02x}" for a in starts)


class Tokenizer:
    """Encoder and decoder for a vocabulary file with lower-casing, words as units and an end-of-word suffix."""

    def __init__(self, raw: bytes):
        data = json.loads(raw)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed(list(enumerate(model["merges"])))}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.pieces = [""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for table in (self.ids, self.added):
            for piece, i in table.items():
                self.pieces[i] = piece
        self.chars = _byte_chars()
        self.lower = _lower_map()
        listed = lambda spans: "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (x.split("-") for x in spans.split()))
        newer = listed(NEWER)
        self.new_marks = re.compile(f"([{listed(NEWER_MARKS)}])")
        letter, number = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = regex.compile(rf"{ends}|{letter}+|{number}|(?:(?!{letter}|{number})\S)+", regex.V1).findall
        letter, number, space = (_ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
        # the same for lower-cased texts without characters beyond U+00FF, where re is faster
        self.short_words = re.compile(rf"[{letter}]+|{ends}|[{number}]|[^{space}{letter}{number}]+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.known: dict[str, bytes] = {}
        self.added_bytes = {k: np.array([v], dtype="<u4").tobytes() for k, v in self.added.items()}
        self.byte_ids = np.array([self.ids[c] for c in self.chars])
        self.end_ids = np.array([self.ids[c + self.suffix] for c in self.chars])
        pairs = sorted((a << 17 | b, rank, merged) for (a, b), (rank, merged) in self.ranks.items())
        self.pair_keys, self.pair_ranks = np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs])
        self.merged = np.zeros(len(model["merges"]), dtype=np.int64)
        self.merged[[x[1] for x in pairs]] = [x[2] for x in pairs]

    def normal(self, text: str) -> str:
        if self.new_marks.search(text):  # each stands for itself and parts what lies around it
            whole = "".join(unicodedata.normalize("NFC", x) for x in self.new_marks.split(text))
        else:
            whole = unicodedata.normalize("NFC", text)
        return whole.translate(self.lower).lower()

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(self.normal(text))
        return self.short_words(text.lower())  # such text is NFC

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals; n log n for a word of n symbols."""
        n = len(ids)
        if n < 2:
            return ids
        ranks, none = self.ranks, (NONE, 0)
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get((ids[i], ids[i + 1]), none)[0]
            tree[size + i] = rank if rank == NONE else rank << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, pair: tuple[int, int] | None) -> None:
            rank = ranks.get(pair, none)[0]
            at = size + i
            tree[at] = rank if rank == NONE else rank << 32 | i
            at >>= 1
            while at:
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = ranks[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, None)
            if k < n:
                before[k] = i
                put(i, (ids[i], ids[k]))
            else:
                put(i, None)
            if before[i] >= 0:
                put(before[i], (ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they don't merge or one is missing (-1)."""
        key = a.astype(np.int64) << 17 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NONE)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """merge() for many short words at once: symbols by row, -1 behind each word's end and where one was merged away."""
        w, n = rows.shape
        size = 1 << max(1, (n - 1).bit_length())
        sym = np.concatenate([rows, np.full((w, 1), -1, dtype=rows.dtype)], axis=1)
        tree = np.full((w, 2 * size), NONE, dtype=np.int64)
        rank = self._ranks_of(sym[:, :-1], sym[:, 1:])
        tree[:, size : size + n] = np.where(rank == NONE, NONE, rank << 8 | np.arange(n))
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        after, before = np.tile(np.arange(1, n + 2), (w, 1)), np.tile(np.arange(-1, n), (w, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            i = root & 0xFF
            j = after[live, i]
            k = np.minimum(after[live, j], n)
            sym[live, i], sym[live, j] = self.merged[root >> 8], -1
            after[live, i], before[live, k] = k, i
            p = before[live, i]
            has = p >= 0
            for rows_at, leaf, left, right in ((live, j, None, None), (live, i, i, k), (live[has], p[has], p[has], i[has])):
                if left is None:
                    tree[rows_at, size + leaf] = NONE
                else:
                    rank = self._ranks_of(sym[rows_at, left], sym[rows_at, right])
                    tree[rows_at, size + leaf] = np.where(rank == NONE, NONE, rank << 8 | leaf)
                at = (size + leaf) >> 1
                while at.size and at[0]:
                    tree[rows_at, at] = np.minimum(tree[rows_at, 2 * at], tree[rows_at, 2 * at + 1])
                    at >>= 1
            live = live[tree[live, 1] != NONE]
        return sym[:, :-1]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The encodings of distinct words: short ones in blocks by length, long ones each with a tree of its own."""
        raw = [x.encode() for x in words]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: dict[str, bytes] = {}
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            at = np.flatnonzero((length > low) & (length <= high))
            for block in (at[i : i + 8192] for i in range(0, len(at), 8192)):
                n = length[block]
                flat = np.frombuffer(b"".join(raw[i] for i in block), dtype=np.uint8)
                inside = np.arange(high) < n[:, None]
                rows = np.full((len(block), high), -1, dtype=np.int64)
                rows[inside] = self.byte_ids[flat]
                rows[np.arange(len(block)), n - 1] = self.end_ids[flat[np.cumsum(n) - 1]]
                rows = self.merge_rows(rows)
                left = rows >= 0
                coded, ends = rows[left].astype("<u4").tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
                start = 0
                for i, end in zip(block.tolist(), ends, strict=True):
                    out[words[i]] = coded[start:end]
                    start = end
        for i in np.flatnonzero(length > 64).tolist():
            ids = [*self.byte_ids[list(raw[i][:-1])].tolist(), int(self.end_ids[raw[i][-1]])]
            out[words[i]] = np.array(self.merge(ids), dtype="<u4").tobytes()
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; words that are new are merged together."""
        parts = [self.specials(x) if self.specials and any(a in x for a in self.added) else [x] for x in texts]
        found = [[[p] if i % 2 else self._split(p) for i, p in enumerate(x)] for x in parts]
        known = self.known
        new = {w for x in found for part in x[::2] for w in part}.difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = {w for x in found for part in x[::2] for w in part}
        known.update(self.learn(list(new)))
        get = known.__getitem__
        out = [np.frombuffer(b"".join(self.added_bytes[part[0]] if i % 2 else b"".join(map(get, part)) for i, part in enumerate(x)), dtype="<u4") for x in found]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of the ids joined by spaces, special tokens included."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


_LOADED: dict[str, Tokenizer] = {}


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes (under 2 MB), read on the driver and sent once to each executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _loaded(raw: bytes) -> Tokenizer:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(raw)
    return _LOADED[key]


def vocabulary_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _chunks(b: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of the batch's texts of about most characters in all, each with its first row's number."""
    start, held, n = 0, [], 0
    for i, x in enumerate(b.column("text")):
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n >= most:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held


def _digests(file: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file.value)
        for b in batches:
            n, coded, decoded = [], [], []
            for _, texts in _chunks(b):
                for ids in t.encode_many(texts):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _coded(file: Broadcast, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file.value)
        for b in batches:
            for i, texts in _chunks(b):  # ids and pieces take more room than the text
                part, ids = b.slice(i, len(texts)), t.encode_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], pa.array(list(map(len, ids)), pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(list(map(t.decode, ids)), pa.string())],
                    [*rest, "n_tokens", "ids", "decoded"],
                )

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with n_tokens, ids (array<int>) and decoded, the text that the ids give back.

    A null or empty text has no tokens and decodes to ''. Rows are independent: nothing is shuffled, repeated rows get
    equal results, and columns of the results' names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")]
    inputs = docs.select(*[F.col(f"`{c}`") for c in rest], "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema if f.name != "text")
    return inputs.mapInArrow(_coded(shared(docs.sparkSession, path), rest), f"{schema}, n_tokens long, ids array<int>, decoded string" if rest else "n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text): ids as little-endian 32-bit integers, text in UTF-8."""
    table = shared(docs.sparkSession, path or vocabulary_path())
    return docs.select("doc_id", "text").mapInArrow(_digests(table), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
