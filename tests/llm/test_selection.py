"""Filter audit, importance resampling and embedding near-dedup against plain Python and SQL."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, importance, vectors

from .. import oracle

# filter audit


def brute_masks(rows, labels):
    """Counter of (part, mask) -> [n, good, toxic]."""
    out = collections.defaultdict(lambda: np.zeros(3, int))
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
        mask += 16 * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        own = [x for x in labels if x[0] == i and i is not None]
        out[source or "", mask] += [1, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)]
    return out


def brute_audit(counts, letters="ABCDE"):
    parts = {p for p, _ in counts}
    out = set()
    for part in parts:
        cells = [(m, *n) for (p, m), n in counts.items() if p == part]
        removed_by = collections.Counter()
        rows = []
        for order in itertools.permutations(letters):
            alive = list(cells)
            for step, x in enumerate(order, 1):
                bit = 1 << letters.index(x)
                fails = [c for c in alive if c[0] & bit]
                alive = [c for c in alive if not c[0] & bit]
                all_fails = sum(c[1] for c in cells if c[0] & bit)
                removed = sum(c[1] for c in fails)
                removed_by[x] += removed
                rows.append((part, "".join(order), step, sum(c[1] for c in alive), removed, all_fails - removed, sum(c[1] for c in cells if c[0] == bit), sum(c[2] for c in fails), sum(c[3] for c in fails), x))
        out |= {(*r[:-1], removed_by[r[-1]]) for r in rows}
    return {tuple(int(v) if isinstance(v, np.integer) else v for v in r) for r in out}


def audit_rows():
    r = random.Random(4)
    words = ["alpha", "BETA", "c#", "delta", "Ünder", "f"] + [f"w{i}" for i in range(90)]
    texts = [None, "", " \t\n", "x" * 5000, "A B C " * 60]
    texts += [" ".join(r.choice(words[: r.choice([3, 40, 96])]) for _ in range(r.choice([0, 3, 49, 50, 51, 400]))) for _ in range(60)]
    rows = [(i if i % 13 else None, r.choice(texts), r.choice([None, "", "s1", "s2", "s2", "s2"])) for i in range(220)]
    return rows + rows[:40]  # repeated rows


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 200, 3)] + [(3, 1, None), (6, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("x"), "mask": F.lit(1), "quality": F.lit(1), "n": F.lit(7)})
    counts = audit.mask_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = brute_masks(rows, labels)
    assert {(c.part, c["mask"]): [c.n, c.good, c.toxic] for c in counts.collect()} == {k: v.tolist() for k, v in want.items()}
    got = [tuple(x) for x in audit.audit(counts).collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == brute_audit(want)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.mask_counts(docs.where("false"), labels)).count() == 0
    assert audit.audit(audit.mask_counts(docs, labels.where("false"))).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_zeta_counts_survivors(k):
    counts = np.random.default_rng(k).integers(0, 9, (2, 4, 1 << k))
    got = audit.survivors(counts)
    for s in range(1 << k):
        assert (got[..., s] == counts[..., [m for m in range(1 << k) if not m & s]].sum(axis=-1)).all()


def test_shapley_values_share_out_what_goes():
    """Over all orders the filters' removals add up to what all of them remove."""
    counts = np.random.default_rng(1).integers(0, 99, (3, 1, 32))
    _, _, bit, before = audit.steps("ABCDE")
    found = audit.interactions(counts, bit, before)["shapley"][0]
    assert sum(found[list(bit).index(f)] for f in range(5)) == 120 * counts[0, 0, 1:].sum()


@pytest.mark.parametrize(("name", "of"), [("audit", audit), ("importance", importance), ("vectors", vectors)])
def test_query_agrees_with_sql(spark, name, of):
    query = {"audit": audit.op12_filter_audit if of is audit else None, "importance": getattr(of, "op13_importance_resampling", None), "vectors": getattr(of, "op11_embedding_near_dedup", None)}[name]
    oracle.agree(spark, query, of.SQL)


# importance resampling


def brute_features(text, ngrams):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, buckets=10_000, ngrams=1, percent=10, least=20, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    feats = [brute_features(t, ngrams) for _, t in rows]
    s = collections.Counter(bucket(x) for _, f in feats for x in f)
    t = collections.Counter(bucket(x) for text in target for x in brute_features(text, ngrams)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for (i, _), (words, f) in zip(rows, feats):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1], x[3]))
    for rank, x in enumerate(enough[: len(enough) * percent // 100], 1):
        x[5] = rank
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize(("ngrams", "buckets", "percent"), [(1, 10_000, 10), (2, 65_536, 50), (3, 97, 100)])
def test_importance_resampling(spark, ngrams, buckets, percent):
    r = random.Random(ngrams)
    pool = ["Alpha", "beta9", "GAMMA", "déjà", "Ünder", "ſtrange", "İ", "x-y", "a b", "日本", "[`q`]", "z\x7fw"] + [f"w{i}" for i in range(50)]
    texts = [None, "", "..,;", "A" * 4000, " ".join(pool) * 400] + [r.choice([" ", "\n", ", "]).join(r.choice(pool) for _ in range(r.choice([1, 19, 20, 21, 90]))) for _ in range(120)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    rows += rows[:60]
    target = [" ".join(r.choice(pool[:8]) for _ in range(40)), None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"rank": F.lit(1), "words": F.lit("x"), "score": F.lit(0)})
    got = importance.resampled(spark, docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets, ngrams, percent)
    assert collections.Counter(tuple(x) for x in got.collect()) == brute_resample(rows, target, buckets, ngrams, percent)


def test_importance_resampling_of_nothing(spark):
    docs, target = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x",)], "text string")
    assert importance.resampled(spark, docs.where("false"), target).count() == 0
    (one,) = importance.resampled(spark, docs, target.where("false"), min_words=1, percent=100).collect()
    assert (one.n_features, one["rank"]) == (2, 1)
    with pytest.raises(ValueError):
        importance.streams(docs, 70_000)


def test_streams_hold_every_document(monkeypatch):
    """Streams that end after each few buckets give what one stream gives."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, None, 4, 5], "text": ["a b c", None, "", "d " * 50, "e"]})
    whole = list(importance._packed(100, 1)(iter([batch])))
    monkeypatch.setattr(importance, "STREAM", 8)
    parts = list(importance._packed(100, 1)(iter([batch])))
    assert len(parts) > len(whole) == 1
    join = lambda bs, c: b"".join(b.column(c)[0].as_py() for b in bs)
    assert join(parts, "buckets") == join(whole, "buckets") and join(parts, "words") == join(whole, "words")
    assert [i for b in parts for i in b.column("ids")[0].as_py()] == [1, 2, None, 4, 5]


# embedding near-dedup


def brute_near(rows, threshold=0.93):
    def fit(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))

    n = len(rows)
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        (_, v, p), (_, w, q) = rows[i], rows[j]
        if p is not None and p == q and fit(v) and fit(w) and len(v) == len(w) and cosine(v, w) >= threshold:
            links[i].append(j)
            links[j].append(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            for k in links[todo.pop()]:
                if k not in part:
                    part.add(k)
                    todo.append(k)
        seen |= part
        ids = [rows[k][0] for k in part if rows[k][0] is not None]
        least = min(ids) if ids else None
        for k in part:
            out[k] = (rows[k][0], len(links[k]), least, rows[k][0] == least)
    return collections.Counter(out)


def vector_rows(dim, n, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = centers[r.integers(6)]
        v = (c * r.choice([1.0, 3.0, -1.0]) + r.normal(size=dim) * r.choice([0.0, 0.1, 0.35, 2.0])).astype(np.float32).tolist()
        rows.append((i * 7 % n if i % 11 else None, v, [None, 1, 2, 2, 2][r.integers(5)]))
    chain = [(5000 - i, [float(x) for x in np.eye(1, dim, 0)[0] * math.cos(i * 0.3) + np.eye(1, dim, 1)[0] * math.sin(i * 0.3)], 3) for i in range(20)]
    odd = [(9001, None, 2), (9002, [], 2), (9003, [0.0] * dim, 2), (9004, [float("nan")] + [1.0] * (dim - 1), 2), (9005, [None] + [1.0] * (dim - 1), 2), (9006, [float("inf")] * dim, 2)]
    odd += [(9007 + i, [1e-30 * (i + 1)] * dim, 2) for i in range(3)] + [(9010 + i, [1.0, 2.0], 2) for i in range(2)] + [(9012, [3e38] * dim, 2)]
    return rows + chain + odd + rows[:15]


@pytest.mark.parametrize(("dim", "n", "group"), [(8, 300, 4096), (8, 300, 16), (32, 200, 50), (2, 120, 9)])
def test_embedding_near_dedup(spark, monkeypatch, dim, n, group):
    """All pairs by hand, in one group and in many."""
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors, "TILE", min(group, 512))
    rows = vector_rows(dim, n, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"g": F.lit(1), "digest": F.lit("x"), "n_links": F.lit(9)})
    # the given numbers are single precision
    same = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], p) for i, v, p in rows]
    assert collections.Counter(tuple(x) for x in vectors.near_duplicates(df).collect()) == brute_near(same)


def test_embedding_near_dedup_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0], None)], "vec_id long, embedding array<double>, label string")
    assert vectors.near_duplicates(df.where("false")).count() == 0
    assert [tuple(x) for x in vectors.near_duplicates(df).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("threshold", [-0.5, 0.3, 0.93, 1.0])
def test_tiles_lose_no_pair(threshold):
    r = np.random.default_rng(7)
    x = r.normal(size=(90, 24)) + r.normal(size=24) * 3
    x[40:45] = x[:5] * 2
    basis = np.linalg.eigh(vectors.unit(x).T @ vectors.unit(x))[1][:, ::-1]
    row = {"vector": x.astype("<f8").tobytes(), "dim": 24, "digest": b"0" * 16 * 90, "low": np.arange(90).tobytes(), "times": np.ones(90, np.int64).tobytes()}
    cuts = [3, 6, 12, 24]
    side = vectors._Side(row, np.ascontiguousarray(basis), cuts)
    given = np.abs(x).max(axis=1, keepdims=True)
    cosine = np.einsum("id,jd->ij", x / given, x / given) / np.multiply.outer(side.norm, side.norm)
    for few in (0.0, 0.02, 1.0):
        vectors.FEW, before = few, vectors.FEW
        i, j = vectors._tile_links(side, slice(0, 60), side, slice(0, 60), cuts, threshold, True)
        p, q = vectors._tile_links(side, slice(0, 60), side, slice(60, 90), cuts, threshold, False)
        vectors.FEW = before
        clear = np.abs(cosine - threshold) > 1e-12
        got = np.zeros_like(clear)
        got[i, j] = got[p, q] = True
        want = np.triu(cosine >= threshold, 1)
        want[60:] = False
        assert (got == want)[clear].all()
