"""Suffix dedup, PII, WARC, BPE, top-k and the pipeline against plain Python, round trips and held-out cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, pii, suffixes, topk, warc

from .. import oracle
from .held_out import CASES, MORE

# suffixes


def covered(texts, length):
    """For each text, which bytes lie in a string of that length that starts anywhere else too."""
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        out.append(np.cumsum(mark)[:-1] > 0)
    return out


def stretches(flags):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def brute_repeats(texts):
    out = []
    for t, gone, told in zip(texts, covered(texts, 400), covered(texts, 256)):
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        passages = sum(sum(a <= x and y <= b for x, y in words) >= suffixes.PASSAGE_WORDS for a, b in stretches(told))
        out.append((len(t), int(gone.sum()), len(stretches(gone)), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest(), passages))
    return out


def overlapping_texts(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcd é") for _ in range(3000)) for _ in range(3)]
    shared = "".join(r.choice("ab") for _ in range(450))
    texts = [None, "", "a" * 399, "a" * 900, "ab" * 700]
    for _ in range(60):
        t = ""
        for _ in range(r.randrange(1, 5)):
            q = r.choice(pool)
            a = r.randrange(len(q))
            t += q[a : a + r.choice([50, 210, 399, 401, 420, 600, 1500])] + "".join(r.choice("ab") for _ in range(r.randrange(30)))
        texts.append(t + (shared + "".join(r.choice("ab") for _ in range(r.randrange(300))) if r.random() < 0.4 else ""))
    return texts + texts[-2:]


@pytest.mark.parametrize(("wide", "ranges", "block"), [(suffixes.CLASS_SUFFIXES, suffixes.RANGE_BYTES, suffixes.BLOCK), (5, 100_000, 2_500), (3, 30_000, 4_000)])
def test_suffix_dedup(spark, monkeypatch, wide, ranges, block):
    """All texts against plain Python: with and without the split of wide classes, in one part and many, whole and in pieces."""
    texts = overlapping_texts(wide)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "core": F.lit(1)})
    want = collections.Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([(t or "").encode() for t in texts])))
    monkeypatch.setattr(suffixes, "CLASS_SUFFIXES", wide)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", ranges)
    found = suffixes._find_anchors

    def in_pieces(batches):
        suffixes.BLOCK = block
        yield from found(batches)

    monkeypatch.setattr(suffixes, "_find_anchors", in_pieces)
    got = collections.Counter(tuple(x) for x in suffixes.without_repeats(docs).drop("kept").collect())
    assert got == want and sum(x[-1] for x in want) > 0


def test_wide_classes_are_split(monkeypatch):
    """Verdicts over many suffixes of one class equal those over pairs."""
    r = random.Random(5)
    core = "".join(r.choice("ab") for _ in range(57))
    texts = sorted({b"\0" + (core + "".join(r.choice("ab") * r.randrange(1, 90) for _ in range(8)))[: r.randrange(57, 401)].encode() for _ in range(60)})
    by_pairs, by_groups = suffixes._Class(0), suffixes._Class(0)
    rows = sorted((t + "".join(r.choice("xy") * r.randrange(1, 99) for _ in range(3))[: r.randrange(200)].encode(), len(t) - 1) for t in texts for _ in range(3))
    for c in (by_pairs, by_groups):
        c.texts, c.right, c.times, c.full = [t for t, _ in rows], [n for _, n in rows], [1] * len(rows), list(range(len(rows)))
        c.shared = [0, *(suffixes.shared_prefix(a[0], b[0], 0) for a, b in zip(rows, rows[1:]))]
    monkeypatch.setattr(by_pairs, "_groups", by_pairs._pairs)
    want = list(by_pairs.verdicts())
    assert list(by_groups.verdicts()) == want and len(want) > 10


def test_suffix_dedup_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert suffixes.without_repeats(docs.where("false")).count() == 0
    assert {tuple(x)[:4] for x in suffixes.without_repeats(docs).collect()} == {(1, 1, 0, 0), (2, 0, 0, 0)}


def test_merge_knows_common_prefixes():
    r = random.Random(2)
    keys = ["".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode() for _ in range(500)]
    runs = []
    for k in range(7):
        (cells,) = [b.to_pylist()[0] for b in suffixes._coded([(0, t, len(t), i) for i, t in enumerate(keys[k::7])])]
        runs.append(suffixes.Run(cells))
    out = [(t, n) for t, n, _ in suffixes.merged(runs)]
    assert [t for t, _ in out] == sorted(x for k in range(7) for x in set(keys[k::7]))
    for (a, _), (b, n) in zip(out, out[1:]):
        assert n == len(os.path.commonprefix([a, b]))


def test_anchors_are_the_same_in_equal_strings(monkeypatch):
    r = random.Random(3)
    data = bytes(r.randrange(97, 101) for _ in range(5000))
    at = suffixes.anchors(data, np.array([0]), np.array([len(data)]))[0]
    for start in range(0, 4600, 37):
        one = data[start : start + 256]
        (own,) = suffixes.anchors(one, np.array([0]), np.array([256]))[0]
        assert start + own in at
    monkeypatch.setattr(suffixes, "BLOCK", 1500)
    found = set()
    for block, parts in suffixes._blocks(iter([data[:100], data, b""])):
        row, off, start, end, first, last = (np.array(x) for x in zip(*parts))
        places = suffixes.anchors(block, start, end, np.stack([first, last], axis=1))[0]
        part = np.searchsorted(start, places, side="right") - 1
        found |= {(int(row[p]), int(a - start[p] + off[p])) for a, p in zip(places, part)}
    assert found == {(1, int(a)) for a in at}


# personal data


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns():
    r = random.Random(2)
    for _ in range(8000):
        t = "".join(r.choice("0123456789" * 2 + "..@@--+ ()ab%_é") for _ in range(r.randrange(50)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "+1" * 1000) == []


@pytest.mark.parametrize("cases", [CASES, MORE])
def test_field_finds_held_out_entities(cases):
    """Sentences written by hand, which the generator of the training sentences has no part in."""
    weights = pii.trained()
    right = found = total = 0
    for text, want in cases:
        got = {(k, text[a:b]) for a, b, k in pii.spans(text, weights) if k in pii.ADDED}
        right, found, total = right + len(got & set(want)), found + len(got), total + len(want)
    assert right / total >= 0.9 and right / found >= 0.9


def test_stretches_are_decoded_whole(monkeypatch):
    """Secrets in one long stretch of digits and signs are found wherever they stand, and as in the whole text."""
    weights, r = pii.trained(), random.Random(4)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    for gap in range(0, 60, 7):
        parts, want = [], []
        for _ in range(60):
            parts.append("at 10:30, room 12 " * r.randrange(4) + "x " * gap + 'token = "')
            start = sum(map(len, parts))
            parts.append(secret())
            want.append((start, start + 40, "secret"))
            parts.append('" and ')
        text = "".join(parts)
        got = [s for s in pii.spans(text, weights) if s[2] in pii.ADDED]
        assert got == want
        whole = [s for s in pii.best(text, weights) if s[2] in pii.ADDED]
        assert whole == want
        monkeypatch.setattr(pii, "CHUNK", 7)
        assert pii.best(text, weights) == pii.best(text, weights, 0, len(text)) and [s for s in pii.best(text, weights) if s[2] in pii.ADDED] == want
        monkeypatch.undo()


def test_field_leaves_prose_alone():
    text = "Hast 3 the, with version 2.0 of 1999-12-31 and 45% or 12:30 in BY-NC 4.0. " * 40
    assert pii.spans(text, pii.trained()) == []


def test_tagged(spark):
    texts = [(1, "mail a.b@c.de, 4111 1111 1111 1111 or +1 (415) 555-0101 at 10.0.0.1"), (2, None), (3, ""), (3, ""), (None, "password=0123456789abcdef01 x"), (4, "9" * 50_000)]
    rows = pii.tagged(spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    assert collections.Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in rows) == collections.Counter([(1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (3, 0, 0, 0, 0), (None, 0, 0, 0, 0), (4, 0, 0, 0, 0)])
    by = {x.doc_id: x for x in rows}
    assert by[1].base_sha256 == hashlib.sha256(by[1].spans.encode()).hexdigest()
    assert by[None].spans == "secret:9:27" and by[None].n_spans == 1 and by[1].n_spans == 4
    masked = pii.masked(spark.createDataFrame(texts[:2], "doc_id long, text string"), pii.trained()).collect()
    assert {x.text for x in masked} == {"mail <email>, <card> or <phone> at <ip>", None}


# archives


def test_archives(spark):
    big = "x" * 1500
    rows = [(1, "http://a/é", big), (5, None, big), (3, "http://b", big), (None, "u", big), (7, "u", "y" * 10), (8, "u", "y" * 10), (9, "u", None), (10, "u", "é\r\n\r\n" * 400), (11, "a\r\nb", "z" * (17 << 20)), (12, "u", ""), (12, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "n": F.lit(1)})
    path = warc.scratch(spark, "warc-test")
    warc.write(warc.planned(pages), path)
    got = warc.load(spark, path).collect()
    assert collections.Counter((x.page_id, x.payload_bytes, x.payload_digest) for x in got) == collections.Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    kinds = collections.Counter((x.page_id, x.record_type, x.refers_to) for x in got if x.payload_bytes == 1500)
    assert kinds == collections.Counter([(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5)])
    assert {x.record_type for x in got if x.payload_bytes != 1500} == {"response"}
    assert warc.load(spark, path, ["page_id"]).columns == ["page_id"]
    none = warc.scratch(spark, "warc-test")
    warc.write(warc.planned(pages.where("false")), none)
    assert warc.load(spark, none).count() == 0


def test_archives_stay_small(spark, monkeypatch, tmp_path):
    """Large payloads that don't compress are spread over archives by their bytes."""
    r = random.Random(6)
    pages = spark.createDataFrame([(i, "u", "".join(chr(r.randrange(32, 127)) for _ in range(20_000))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 100_000)
    warc.write(warc.planned(pages), f"file://{tmp_path}/w")
    sizes = [os.path.getsize(tmp_path / "w" / x) for x in os.listdir(tmp_path / "w") if x.startswith("part")]
    assert len(sizes) >= 8 and max(sizes) <= 100_000
    assert warc.load(spark, f"file://{tmp_path}/w").count() == 40


def test_reader_checks_what_it_reads():
    good = warc.record(1, "http://a", b"payload" * 100, "response", None)
    two = list(warc.Reader(iter([good[:5], good[5:] + good[:7], good[7:]])))
    assert [x[0] for x in two] == [0, len(good)]
    assert warc.parsed(two[0][1], two[0][2])["page_id"] == 1
    with pytest.raises(warc.BadRecord):
        list(warc.Reader(iter([good[:-9]])))
    raw = zlib.decompress(good, 31)
    z = zlib.compressobj(wbits=31)
    changed = z.compress(raw.replace(b"payloadpayload", b"payloadpaylaod", 1)) + z.flush()
    (_, fields, block) = next(iter(warc.Reader(iter([changed]))))
    with pytest.raises(warc.BadRecord):
        warc.parsed(fields, block)
    z = zlib.compressobj(wbits=31)
    short = z.compress(raw.replace(b"payload", b"", 1)) + z.flush()
    with pytest.raises(warc.BadRecord):
        list(warc.Reader(iter([short])))


# BPE


@pytest.fixture(scope="module")
def coder():
    with open(bpe.vocabulary_path(), "rb") as f:
        return bpe.Tokenizer(f.read())


def test_bpe_is_the_librarys(coder):
    from tokenizers import Tokenizer

    public, r = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(1)
    kinds = [(32, 127), (0, 0x250), (0x300, 0x600), (0x1E00, 0x2100), (0x3000, 0xD7FF), (0x10000, 0x20000)]
    texts = ["", " ", "It's 'S we'll <|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "İΣΑΣ ÅΩ", "a" * 5000, "in" * 900, "#" * 700, "é" * 300, "Ᲊ\U0001246f#\U00012590#"]
    texts += ["".join(chr(r.randrange(*r.choice(kinds))) for _ in range(r.randrange(40))) for _ in range(1500)]
    for t, ids in zip(texts, coder.encode_many(texts)):
        want = public.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(t)
        assert coder.decode(ids) == public.decode(want, skip_special_tokens=False)


def test_marks_change_places_as_in_the_library(coder):
    """All pairs of marks that any table of normal forms sorts, and all characters that come apart."""
    import unicodedata

    from tokenizers import normalizers

    nfc = normalizers.NFC().normalize_str
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in plain if unicodedata.combining(c)]
    lower = lambda s: s.translate(coder.lower).lower()
    assert len(marks) > 900
    for a in marks:
        line = " ".join(f"o{a}{b}" for b in marks)
        assert coder.normal(line) == lower(nfc(line)), hex(ord(a))
    for form in ("NFC", "NFD"):
        line = " ".join(unicodedata.normalize(form, c) for c in plain)
        assert coder.normal(line) == lower(nfc(line))


def test_digests(spark, coder):
    texts = ["", None, "Plain words, and 12 numbers", "e\u0301 \u0898\u089b \U0001e4ed\U0001e4ef", "x" * 30_000 + " ünder", "Plain words, and 12 numbers"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(bpe.vocabulary_path())
    for i, t in enumerate(texts):
        ids = public.encode(t or "", add_special_tokens=False).ids
        back = public.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(rows[i])[1:] == want
    assert bpe.digests(docs.where("false")).count() == 0


def test_blocks_of_words_merge_as_single_ones(coder):
    r = random.Random(2)
    words = list({"".join(r.choice("aeinrst") for _ in range(r.randrange(1, 60))) for _ in range(400)})
    got = coder.learn(words)
    for w in words:
        ids = [*coder.byte_ids[list(w[:-1].encode())].tolist(), int(coder.end_ids[ord(w[-1])])]
        plain = list(ids)
        while True:  # the leftmost pair of lowest rank, again and again
            pairs = [(coder.ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in coder.ranks]
            if not pairs:
                break
            _, i = min(pairs)
            plain[i : i + 2] = [coder.ranks[plain[i], plain[i + 1]][1]]
        assert coder.merge(list(ids)) == plain == np.frombuffer(got[w], "<u4").tolist()


def test_encoded(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, None), (2, "", "y"), (2, "", "y")], "doc_id long, text string, ids string")
    rows = bpe.encoded(docs, bpe.vocabulary_path()).collect()
    assert sorted((x.doc_id or 0, x.n_tokens, x.decoded) for x in rows) == [(0, 0, ""), (1, 2, "a</w> b</w>"), (2, 0, ""), (2, 0, "")]
    assert bpe.encoded(docs.where("false"), bpe.vocabulary_path()).count() == 0


# top-k


def brute_top(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, dtype=float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, (q, x) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(ok) if b != a and len(y) == len(x))[:k]
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize(("block", "groups"), [(topk.SHARD_BLOCK, 0), (7, 3)])
def test_top_k(spark, monkeypatch, block, groups):
    monkeypatch.setattr(topk, "SHARD_BLOCK", block)
    r = random.Random(block)
    vector = lambda n=4: [r.choice([-1.0, -0.3, 0.0, 0.25, 0.7]) for _ in range(n)]
    rows = [(i, vector()) for i in range(90)] + [(100, vector(3)), (101, vector(3)), (40, vector()), (None, vector()), (200, None), (201, []), (220, [1.0, None, 0.0, 0.0]), (221, [float("nan")] * 4), (222, [float("inf"), 0.0, 0.0, 0.0])]
    rows.append(rows[20])
    df = topk.stored(topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"ord": F.lit(1), "v": F.lit(1)})), "vectors")
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, shard_groups=groups)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert collections.Counter(map(tuple, got.collect())) == brute_top(rows32)
    empty = topk.scaled(spark.createDataFrame([(20, []), (3, []), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>"))
    assert [tuple(x) for x in topk.top_k(empty.where("vec_id % 20 = 0"), empty).collect()] == [(20, 1, 3, 0)]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_large_products_stay_exact():
    q = np.array([[2**40, 3]], dtype=np.int64)
    assert topk._product(q, np.array([[2**20 + 1, 5]], dtype=np.int64)).tolist() == [[2**40 * (2**20 + 1) + 15]]


# queries


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["op3_warc", "op4_quality_rules", "op7_exact_top_k", "op8_line_dedup", "op10_license_scan"])
def test_queries_agree_with_sql(spark, name):
    from tessera.llm import queries

    oracle.agree(spark, queries.QUERIES[name], queries.SQL[name])
