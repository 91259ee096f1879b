"""Line dedup, quality rules, SimHash, mixing and licenses against plain Python on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import licenses, lines, mixing, quality, simhash
from tessera.llm.common import joined_hot
from tessera.llm.graph import components

from .. import oracle

SPACE = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    full = [(i, t, *(rest or ("en", "a", 0))) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


ODD = [(None, None), (None, "x"), (5, ""), (6, "\n"), (7, None), (7, None)]


def test_line_dedup(spark):
    r = random.Random(3)
    pool = ["Shared line", " shared LINE\t", "ÄB", "äb", "Äb ", "rare", "", "  ", "tail\r"]
    texts = [*[(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 8)))) for i in range(40)], *ODD, (1000, "\n".join(["all"] * 3000)), (1000, "\n".join(["all"] * 3000))]
    docs = documents(spark, texts).withColumns({"_k": F.lit(1), "_rest": F.lit(2)})
    key = lambda s: lower(s.strip(SPACE))
    count = collections.Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in count.items() if k and n >= 10}
    want = collections.Counter((i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t in texts)
    got = collections.Counter((x.doc_id, x._n_lines, x._kept) for x in lines.dedup_lines(docs).select("doc_id", "_n_lines", "_kept").collect())
    assert got == want
    assert lines.dropped_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.where("false")).count() == 0


def quality_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)}
    real = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(real) - len(set(real)), len(covered)


def test_quality_rules(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    top, shares, rest = quality._listed("en")
    draw = lambda: r.choices([*top, r.choice(rest), word()], shares)[0]  # noqa: E731  # as often as in prose
    clean = [(i, ". ".join(" ".join(draw() for _ in range(12)) for _ in range(10))) for i in range(30)]
    junk = [(100 + i, " ".join(word() + "###$$$%%%" for _ in range(120))) for i in range(3)]
    loops = [(200, "one two three four five six seven\n" * 9), (201, "a b c"), (202, "x\t" * 4 + "a b | c\n\n|")]
    texts = clean + junk + loops + ODD
    rows = quality.judged(documents(spark, texts)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = collections.Counter((i, *quality_base(t)) for i, t in texts)
    assert collections.Counter((x.doc_id, *[x[c] for c in names]) for x in rows) == want
    for x in rows:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
    kept = {x.doc_id for x in rows if x.kept}
    assert kept >= set(range(30)) and not kept & {100, 101, 102, 200, 201}
    shares = lambda a: np.array(a) / sum(a)
    p, q = shares([1, 2, 0, 4.0]), shares([2.0, 0, 0, 1])
    m = (p + q) / 2
    js = sum(x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0) / 2
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p.tolist())), F.array(*map(F.lit, q.tolist())))).first()[0]
    assert got == pytest.approx(js**0.5)


def test_quality_other_languages_and_columns(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n))
    texts = [(1, prose(80), "xx"), (2, prose(80), None), (3, " ".join(f"{i}#%" for i in range(80)), None), (4, prose(80), "en"), (5, " ".join(r.choice(["the", "of"]) + "\t" * r.randrange(4) for _ in range(99)), "xx")]
    docs = spark.createDataFrame([(i, t, lang, None, 0) for i, t, lang in texts], SCHEMA).withColumns({"n_words": F.lit("mine"), "kept": F.lit("mine")})
    assert quality.good(docs).columns == docs.columns
    # words of no language: too few to judge in a language without a reference, too strange for others
    assert sorted(x.doc_id for x in quality.good(docs).collect()) == [1]
    assert quality.good(docs.where("false")).count() == 0


PROSE = {
    "en": "It was in the first week of the year that they came to the house on the hill, and there was no one at home but the old man who had been with them for as long as they could remember. He did not say much about what had happened, but it is clear from his letters that he was not at all sure that this would be the end of it. In the end they all went back to the town by the same road.",
    "de": "Es war in der ersten Woche des Jahres, dass sie zu dem Haus auf dem Hügel kamen, und es war niemand da als der alte Mann, der bei ihnen war, so lange sie sich erinnern konnten. Er hat nicht viel über das gesagt, was geschehen war, aber aus seinen Briefen ist klar, dass er sich nicht sicher war, ob das schon das Ende von allem sein würde. Am Ende gingen sie mit ihm auf der gleichen Straße in die Stadt zurück.",
    "es": "Fue en la primera semana del año cuando llegaron a la casa de la colina, y no había nadie más que el viejo que estaba con ellos desde que se podían acordar. No dijo mucho de lo que había pasado, pero es claro por las cartas que escribió que no estaba seguro de que eso fuera el fin de todo. Al final se fueron con él por el mismo camino que los había llevado hasta la ciudad en otro tiempo.",
    "fr": "Ce fut dans la première semaine de l'année qu'ils sont venus à la maison sur la colline, et il n'y avait pas un homme dans les environs, sauf le vieux qui était avec eux depuis le temps de la guerre. Il ne parlait pas de ce qui était arrivé, mais on voit par ses lettres qu'il n'était pas sûr que ce fût la fin de tout. Ils sont donc partis avec lui par la même route pour la ville, et on les a vus au port.",
}


def test_quality_words_decide(spark):
    """Prose is kept in its language and in none, rejected in another; words of no language are rejected in all."""
    r = random.Random(8)
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(n))
    texts = [(t, lang, lang == own or lang is None) for own, t in PROSE.items() for lang in [*PROSE, None]]
    texts += [(noise(n), lang, False) for lang in [*PROSE, None] for n in (60, 300)] + [(noise(300), "it", False), (noise(60), "it", True)]
    texts += [(" ".join(PROSE.values()), "it", True), (noise(40), "en", True)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang, _) in enumerate(texts)], SCHEMA)
    got = {x.doc_id: (x.kept, x.base_failed) for x in quality.judged(docs).collect()}
    assert [(i, texts[i][1]) for i, (kept, failed) in got.items() if failed or kept != texts[i][2]] == []


def test_quality_agrees_with_labels(spark):
    """No document that is labelled good is rejected for its words, and most tables are."""
    labels = spark.read.parquet(oracle.DATA + "/labels.parquet")
    judged = quality.judged(spark.read.parquet(oracle.DATA + "/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    assert judged.where("quality = 1 AND NOT kept").count() == 0


def test_quality_verdicts_do_not_depend_on_neighbours(spark):
    docs = spark.read.parquet(oracle.DATA + "/documents.parquet")
    every = {x.doc_id: x.kept for x in quality.judged(docs).collect()}
    some = {x.doc_id: x.kept for x in quality.judged(docs.where("doc_id % 7 = 3")).collect()}
    assert some and all(every[i] == k for i, k in some.items())


def test_quality_of_a_very_long_text(spark):
    text = "\n".join(f"line number {i} of a very long text, the end of which is far" for i in range(20_000))
    (row,) = quality.judged(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).collect()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == quality_base(text)


def test_joined_hot(spark):
    """Frequent and rare keys, keys that one side lacks, and null keys: what a plain join gives, and no frequent key in a shuffle."""
    values = [1] * 900 + [2] * 3 + [3, 4] + [None] * 50
    rows = spark.createDataFrame(list(enumerate(values)), "id int, k long")
    told = spark.createDataFrame([(1, 900, "a"), (2, 3, "b"), (3, 1, "c"), (5, 1, "e"), (None, 50, "n")], "k long, times long, say string")
    got = joined_hot(rows, told, "k")
    assert sorted((x.id, x.k, x.say) for x in got.collect()) == sorted((x.id, x.k, x.say) for x in rows.join(told, "k").collect())
    assert joined_hot(rows.limit(0), told, "k").isEmpty() and joined_hot(rows, told.limit(0), "k").isEmpty()


def test_simhash_large_component(spark):
    """A component of many fingerprints and one of many copies keep their smallest ids."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 400, 4)] + ["copy of one text " * 9] * 80 + [f"lone {i} text {i * 7}" for i in range(20)]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps, ids = [simhash.fingerprint(t.encode()) for t in texts], [1000 - i for i in range(len(texts))]
    assert len(set(fps[:100])) > 50
    want = dict(zip(ids, ids))
    while True:
        now = {a: min(want[b] for b, g in zip(ids, fps) if (f ^ g).bit_count() <= 3) for a, f in zip(ids, fps)}
        if now == want:
            break
        want = now
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()} == want


def test_simhash_fingerprints():
    for t in ["", "a", "A b", "a b c d e f g", "x " * 500, "é ü ñ a b"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in sh) for b in range(64)]
        assert simhash.fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))
    assert simhash.fingerprint(None) == 0


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(f))]


def test_every_near_pair_meets_at_an_anchor():
    r = random.Random(1)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(0, 4)):
            b ^= 1 << bit
        met = set()
        for block in (0, 1):
            rows, word, home = simhash._anchors_of(np.array([a, b], dtype=np.uint64) >> np.uint64(32 * block) & np.uint64(0xFFFFFFFF))
            at = {k: {(int(w)) for x, w in zip(rows, word) if x == k} for k in (0, 1)}
            homes = {int(w) for w, h in zip(word, home) if h}
            met |= at[0] & at[1] & homes
        assert met


def near_one_anchor(n, seed):
    """Distinct fingerprints whose low halves lie within 2 bits of one word."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        low = 0
        for bit in r.sample(range(31), r.randrange(3)):
            low ^= 1 << bit
        high = r.getrandbits(7) if r.random() < 0.5 else r.getrandbits(32)
        out.add(high << 32 | low)
    return sorted(out)


def test_hot_anchors_are_dealt_to_smaller_groups(spark, monkeypatch):
    signed = [f - (1 << 64) if f >> 63 else f for f in near_one_anchor(2000, 4)]
    fps = spark.createDataFrame([(f,) for f in signed], "fp long")
    sizes = {}
    for hot in (10_000, 200):
        monkeypatch.setattr(simhash, "HOT_HOMES", hot)
        per = simhash.dealt(fps).groupBy("anchor", "salt").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h"), F.countDistinct("fp").alias("d")).where("h > 0").collect()
        sizes[hot] = max(x.n for x in per)
        assert all(x.n == x.d for x in per) and max(x.h for x in per) <= (2000 if hot > 2000 else 2 * hot)
    assert sizes[200] < sizes[10_000] / 2


@pytest.mark.parametrize("limit", [3, 40, 20_000])
def test_large_groups_pass_by(monkeypatch, limit):
    """Groups that are held and groups that pass by in batches give the components that home to all pairs give."""
    monkeypatch.setattr(simhash, "HOT_HOMES", limit)
    r = random.Random(limit)
    rows = []
    for anchor in (1, 2, 3, 9):
        fps = near_one_anchor(r.choice([2, 150, 400]), anchor)
        rows += sorted((anchor, 0, -h, f) for f, h in ((f, int(r.random() < (1 if anchor == 2 else 0.1))) for f in fps))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int32()), pa.array(np.array([x[3] for x in part], dtype=np.uint64).view(np.int64)), pa.array([bool(x[2]) for x in part])], ["anchor", "salt", "fp", "home"])
        for part in (rows[i : i + 37] for i in range(0, len(rows), 37))
    ]
    edges = [(a % (1 << 64), b % (1 << 64)) for x in simhash._compare(iter(batches)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert len(edges) <= 2 * len(rows)  # never all pairs

    def groups(pairs):
        parent = {x[3]: x[3] for x in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return {frozenset(y for y in parent if find(y) == k) for k in {find(x) for x in parent}}

    all_near = {(x[3], y[3]) for x in rows for y in rows if bin(x[3] ^ y[3]).count("1") <= 3}
    homes = {(x[0], x[3]) for x in rows if x[2]}
    met = {(x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and (x[0], x[3]) in homes and (x[3], y[3]) in all_near}
    got, least, most = groups(edges), groups(met), groups(all_near)
    assert all(any(a <= b for b in got) for a in least) and all(any(a <= b for b in most) for a in got)


@pytest.mark.parametrize("hot", [simhash.HOT_HOMES, 5])
def test_links_join_all_near_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    r = random.Random(hot)
    fps = {0}
    for _ in range(20):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 25)):
            fps.add(x)
            for bit in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << bit
    for _ in range(60):  # a crowd around one word
        fps.add((1 << r.randrange(32)) | (r.getrandbits(32) << 32))
    fps = sorted(fps)
    of = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x.node: x.label for x in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, s, c in zip(fps, signed, of):
        groups[got.get(s, s)].add(f)
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (60, 70)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (50, 60, 70)} == {50} and 100 not in got


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [(9, base), (4, base.upper()), (4, base.upper()), (11, base + " tail"), (2, "something else entirely of other words"), (None, None), (3, ""), (None, "only null ids here, one"), (None, "and another text with a null id")]
    docs = documents(spark, texts).withColumns({"label": F.lit(1), "fp": F.lit(1)})
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t in texts]
    of = brute_components(fps)
    low = {c: min([i for (i, _), k in zip(texts, of) if k == c and i is not None], default=None) for c in of}
    want = collections.Counter((i, low[c]) for (i, _), c in zip(texts, of))
    assert collections.Counter((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()) == want
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.count() == len(set(of))
    assert simhash.one_of_each(docs.where("false")).count() == 0


def test_targets(spark):
    r = random.Random(5)
    sizes = [(s, r.randrange(0, 900)) for s in ["b", "a", "Z", "é", None, "c", "zz"]]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
    total, full = 1.5 * sum(n for _, n in sizes), set()
    while True:  # give out the excess again until no source is above its limit
        rest = total - sum(2 * n for s, n in sizes if s in full)
        level = rest / max(1e-9, sum(weight[s] for s, _ in sizes if s not in full))
        new = {s for s, n in sizes if s not in full and level * weight[s] > 2 * n}
        if not new:
            break
        full |= new
    for s, n in sizes:
        assert got[s] == pytest.approx(2 * n if s in full else level * weight[s])
    assert sum(got.values()) == pytest.approx(total)


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(0)
    p, size = np.array([0.3, 0.7, 0.5, 0.2, 0.9]), np.array([5.0, 1, 3, 8, 2])
    runs = np.array([mixing.pivot(p, size, rng) for _ in range(4000)])
    assert np.allclose((runs * size).sum(axis=1), (p * size).sum())
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 1).all()
    assert np.allclose(runs.mean(axis=0), p, atol=0.04)


@pytest.mark.parametrize("fan_in", [mixing.FAN_IN, 8])
def test_mix(spark, monkeypatch, fan_in):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(0, 60), "en", r.choice(["a", "b", "b", "b", None]), 0) for i in range(300)]
    rows += [rows[0], rows[0], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"copies": F.lit(1), "_s": F.lit("x")})
    out = mixing.mixed(docs).collect()
    assert sum(x.n for x in out) == len(rows)
    for s in ("a", "b", None):
        own = [x for x in out if x.source == s]
        taken = sum(x.copies * x["size"] * x.n for x in own)
        assert abs(taken - own[0].target) <= max(x["size"] * x.n for x in own) / 2 + 1
    assert all(0 <= x.copies <= 2 for x in out)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(x.copies * x.n for x in out)
    assert mixing.mix(docs.where("false")).count() == 0


def license_brute(t):
    words = lambda x: [w for w in re.split(r"[^\w]+|_", x.lower()) if w]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    s, out = sh(words(t or "")), set()
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        own = set(sh(words(text)))
        width = next(w for w in licenses.WIDTHS if w >= len(own))
        best = max((len(own & set(s[k : k + 2 * width])) / len(own) for k in range(0, len(s), width)), default=0)
        if best >= 0.8:
            out.add((name, i, round(best, 6)))
    return out


def test_licenses(spark):
    r = random.Random(7)
    filler = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    texts = [(500 + i, filler(r.randrange(40)) + "\n" + t + "\n" + filler(r.randrange(40))) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append((100 + i, filler(9) + " " + " ".join(w) + " " + filler(3)))
    texts += [(300, filler(400)), (301, "Released\tunder the\nMIT license"), *ODD, (302, filler(3000) + " Released under the MIT License. " + filler(3000))]
    got = collections.defaultdict(set)
    for x in licenses.scan(documents(spark, texts).withColumns({"license": F.lit("x"), "part": F.lit(1)})).collect():
        got[x.doc_id].add((x.license, x.template, round(x.containment, 6)))
    for i, t in texts:
        if i is not None:
            assert got[i] == license_brute(t), i
    assert licenses.scan(documents(spark, texts).where("false")).count() == 0


def test_digest_is_of_what_stays(spark):
    x = lines.dedup_lines(documents(spark, [(1, "a\nb")])).select(F.sha2(F.col("_kept").cast("binary"), 256)).first()[0]
    assert x == hashlib.sha256(b"a\nb").hexdigest()


def test_bands_retrieve_what_windows_hold(spark, tmp_path, monkeypatch):
    """Recall of the bands: damaged copies of templates of all sizes against exact containment in every window."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = lambda n: [r.choice(words) for _ in range(n)]
    sizes = [5, 6, 9, 12, 20, 33, 70, 140, 300, 900]
    templates = [(f"L{n}", " ".join(passage(n))) for n in sizes for _ in range(3)]
    for i, (name, text) in enumerate(templates):
        (tmp_path / f"{name}-{i}.txt").write_text(text)
    texts = []
    for i in range(240):
        ws = templates[i % len(templates)][1].split()
        for _ in range(len(ws) // 60):
            ws[r.randrange(len(ws))] = "changed"
        texts.append((i, " ".join(passage(r.randrange(400)) + ws + passage(r.randrange(400)))))
    table = licenses.read_templates(spark, str(tmp_path))
    assert table.count() == len(templates) and {x.license.split("-")[0] for x in table.collect()} == {n for n, _ in templates}
    got = {(x.doc_id, x.template): x.containment for x in licenses.scan(documents(spark, texts), templates).collect()}
    want = {}
    for i, t in texts:
        s = [tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)]
        for j, (_, u) in enumerate(templates):
            own = {tuple(u.split()[k : k + 5]) for k in range(len(u.split()) - 4)}
            width = next(w for w in licenses.WIDTHS if w >= len(own))
            best = max(len(own & set(s[a : a + 2 * width])) / len(own) for a in range(0, len(s), width))
            if best >= 0.8:
                want[i, j] = best
    assert set(got) <= set(want) and len(want) > 150 and len(got) >= 0.995 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)  # everything meets by shuffles
    assert {(x.doc_id, x.template): x.containment for x in licenses.scan(documents(spark, texts), templates).collect()} == got
    assert licenses.scan(documents(spark, texts), [("none", "too short")]).count() == 0
    assert licenses.scan(documents(spark, texts), table).count() == len(got)
