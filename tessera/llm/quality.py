"""Quality rules with DataFrame functions only: repetition, and divergence of histograms from language references.

A document's characters by class, and its share of each common word of its language, are compared with fixed
reference histograms by Jensen-Shannon distance (base 2, so between 0 and 1). The references don't depend on the
documents that are judged, so no document's verdict depends on its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, words

# The ten most common words of each language with their rounded shares of running words in percent, and
# the words that come next with their share together. English after the list of the British National Corpus (Leech,
# Rayson and Wilson 2001), Spanish after that of the CREA corpus (Real Academia Espanola), both by hand from counts a
# million; German and French by hand, words and shares of the size that lists of newspaper text give.
COMMON = {
    "de": ("der 3.5 die 3.4 und 2.5 in 1.8 den 1.2 von 1.0 zu 1.0 das 1.0 mit 0.9 sich 0.7", 24, "des auf für ist im dem nicht ein eine als auch es an werden aus er hat sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde kann gegen vom können schon wenn seine ihre dann unter wir ich eines diese dieser wieder keine seiner will zwischen immer was"),
    "en": ("the 6.2 of 2.9 and 2.7 to 2.6 a 2.2 in 1.8 it 1.1 that 1.1 is 1.0 was 0.9", 24, "for i you he be with on by at have are not this but had they his from she which or we an were as do been their has would there what will all if can her said who one so up them some when could him into its then out my about did your now me no other only just more these also any very"),
    "es": ("de 6.5 la 4.1 que 3.1 el 3.0 en 2.8 y 2.7 a 2.1 los 1.7 se 1.3 del 1.2", 17, "las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué sólo han yo hay vez puede todos"),
    "fr": ("de 5.0 la 2.9 le 2.4 et 2.2 les 2.0 des 1.8 à 1.8 en 1.5 un 1.2 du 1.2", 20, "une est que dans pour qui il par au sur pas ne plus se ce avec son sa ses mais ou comme cette on aux sont leur elle ont été nous vous être fait deux même tout sans y ces très bien dont aussi où entre si leurs peut après ils je lui avait était cela"),
}
# Rounded shares of letters, spaces, digits, punctuation and other characters in prose; German words are
# longer, French has more apostrophes. The last is for languages without words above.
CLASSES = {"de": [0.825, 0.140, 0.005, 0.027, 0.003], "en": [0.80, 0.165, 0.005, 0.027, 0.003], "es": [0.805, 0.165, 0.005, 0.022, 0.003], "fr": [0.795, 0.160, 0.005, 0.037, 0.003], "": [0.80, 0.165, 0.005, 0.027, 0.003]}
# Rounded shares of the most frequent word of a text, the next 4, the next 15, and all others, in prose.
RANKS = [0.06, 0.12, 0.16, 0.66]
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: Guards: shorter documents are not judged by their histograms.
MIN_CHARS_FOR_CLASSES = 100
MIN_WORDS_FOR_COMMON = 50
MIN_WORDS_FOR_RANKS = 200
MAX_CLASS_DISTANCE = 0.28
#: A text is apart from its language at this part of the distance that a text without one common word has.
MAX_COMMON_PART = 0.85
#: By how much the share of another language's words, as a part of what prose has, may be above that of its own.
MAX_FOREIGN = 0.1
MAX_RANK_DISTANCE = 0.25


def _listed(name: str) -> tuple[list[str], list[float], list[str]]:
    """A language's most common words, their shares with those of the next and of all others, and the next words."""
    top, next_share, rest = COMMON[name]
    parts = top.split()
    shares = [float(x) / 100 for x in parts[1::2]] + [next_share / 100]
    return parts[::2], [*shares, 1 - sum(shares)], rest.split()


def _distance(p: list[float], q: list[float]) -> float:
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def common_limit(name: str) -> float:
    """The distance from a language's common words above which a text is rejected."""
    shares = _listed(name)[1]
    return MAX_COMMON_PART * _distance([0.0] * (len(shares) - 1) + [1.0], shares)


def _share(counts: Column) -> Column:
    """Counts as parts of their sum; null if that is 0."""
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions of equal length; null if either is null."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _classes(text: Column) -> Column:
    """A struct of n (code points), space, symbols, and class: counts of letters, spaces, digits, punctuation, other characters."""
    size = F.char_length
    punct = lambda x: F.regexp_count(x, F.lit(r"""[.,;:!?'"()\-]"""))
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            F.regexp_replace(t, r"\p{L}+", ""),  # the letters go first; the rest is a fifth of a text
            lambda a: let(
                F.regexp_replace(a, r"[\x20\x09-\x0D]+", ""),
                lambda b: let(
                    F.regexp_replace(b, r"[0-9]+", ""),
                    lambda c: F.struct(
                        size(t).alias("n"),
                        (size(a) - size(b)).alias("space"),
                        F.regexp_count(c, F.lit(r"[#*$%&|<>]")).cast("long").alias("symbols"),
                        let(punct(c), lambda p: F.array(*[x.cast("double") for x in (size(t) - size(a), size(a) - size(b), size(b) - size(c), p, size(c) - p)])).alias("class"),
                    ),
                ),
            ),
        ),
    )


def _constant(shares: list[float]) -> Column:
    return F.array(*map(F.lit, shares))


def _apart(ws: Column, name: str) -> Column:
    """The distance of a text's words from a language's common ones, as a part of the limit: over 1 is too far."""
    top, shares, rest = _listed(name)
    number = lambda found, word: F.size(F.filter(found, lambda w: w == word)).cast("double")

    def counts(f: Column) -> Column:
        tops = F.array(*[number(f, word) for word in top])
        return let(tops, lambda t: F.concat(t, let(F.aggregate(t, F.lit(0.0), lambda a, x: a + x), lambda n: F.array(F.size(f) - n, (F.size(ws) - F.size(f)).cast("double")))))

    return js_distance(_share(let(F.filter(ws, lambda w: w.isin([*top, *rest])), counts)), _constant(shares)) / F.lit(common_limit(name))


def _cover(ws: Column, name: str) -> Column:
    """The share of a language's common words in a text, as a part of what prose has."""
    top, shares, rest = _listed(name)
    return F.size(F.filter(ws, lambda w: w.isin([*top, *rest]))) / F.size(ws) / F.lit(1 - shares[-1])


def _rank_distance(ws: Column) -> Column:
    """The distance of the shares of a text's most frequent words, whichever they are, from those of prose."""

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        runs = let(starts, lambda p: F.sort_array(F.transform(p, lambda at, k: (F.coalesce(F.get(p, k + 1), F.size(s)) - at).cast("double")), asc=False))
        total = lambda c, start, n: F.aggregate(F.slice(c, start, n), F.lit(0.0), lambda a, x: a + x)
        return let(runs, lambda c: F.array(total(c, 1, 1), total(c, 2, 4), total(c, 6, 15), total(c, 21, 2**30)))

    return js_distance(_share(let(F.array_sort(ws), of)), _constant(RANKS))


def _strange(text: Column, lang: Column) -> Column:
    """How far a text's words are from its language: over 1 is too far; null under the guards.

    Words are runs of letters, lower-cased. Those of a listed language are held against its common words, and must
    not be rather another's; those of a null one against all, of which the nearest counts; those of another language
    against the shares that most frequent words have in any prose.
    """
    ws = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")

    def judged_as(w: Column, name: str) -> Column:
        own = _cover(w, name)
        foreign = F.greatest(*[_cover(w, other) for other in COMMON if other != name]) - own
        return F.when(foreign > MAX_FOREIGN, 2.0).otherwise(_apart(w, name))

    def of(w: Column) -> Column:
        out = F
        for name in COMMON:
            out = out.when(lang == name, F.when(F.size(w) >= MIN_WORDS_FOR_COMMON, judged_as(w, name)))
        any_ = F.when(F.size(w) >= MIN_WORDS_FOR_COMMON, F.least(*[_apart(w, name) for name in COMMON]))
        return out.when(lang.isNull(), any_).otherwise(F.when(F.size(w) >= MIN_WORDS_FOR_RANKS, _rank_distance(w) / MAX_RANK_DISTANCE))

    return let(ws, of)


def _repeated(ws: Column) -> Column:
    """Number of words in windows of WINDOW words that occur twice or more in ws."""
    n = F.size(ws)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(order, lambda s: F.filter(s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"])))
        at = F.array_sort(F.transform(again, lambda e: e["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def judged(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, strangeness, kept.

    A null text has no words and fails. strangeness is the distance of the words from their language as a part of what
    is allowed: above 1 rejects. A document with a null language must be near one of the references; one in a language
    without a reference is judged by the shares of its own most frequent words. Those under the length guards are
    judged by the base rules alone; a missing distance is null and rejects nothing. Repeated rows get equal results. Columns of the results'
    names are replaced. Each document is judged by itself: nothing is shuffled, and one scan does.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "strangeness", "kept"]
    inputs = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    at = docs.select(*inputs)
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            _repeated(w).alias("repeated"),
        ),
    )
    class_reference = F
    for name in COMMON:
        class_reference = class_reference.when(F.col("lang") == name, _constant(CLASSES[name]))
    class_reference = class_reference.otherwise(_constant(CLASSES[""]))
    of_chars = let(
        _classes(F.col("text")),
        lambda c: F.struct(c["n"].alias("n"), c["space"].alias("space"), c["symbols"].alias("symbols"), F.when(c["n"] >= MIN_CHARS_FOR_CLASSES, js_distance(_share(c["class"]), class_reference)).alias("distance")),
    )
    failed = lambda w: (w["n"] < MIN_WORDS) | (100 * w["repeated"] > MAX_REPEATED_PERCENT * w["n"])
    apart = lambda c, d: (F.coalesce(c["distance"], F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce(d, F.lit(0.0)) > 1)
    # the verdict names each measure once, so a filter on it that Spark moves below computes each once
    verdict = let(F.struct(F.col("_c").alias("c"), F.col("_w").alias("w"), F.col("_f").alias("f")), lambda m: ~(failed(m["w"]) | apart(m["c"], m["f"])))
    return (
        at.withColumn("_w", of_words)
        .withColumn("_c", of_chars)
        .withColumn("_f", _strange(F.col("text"), F.col("lang")))
        .withColumn("_d", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .select(
            *inputs,
            F.col("_w.n").alias("n_words"),
            (F.col("_c.n") - F.col("_c.space")).cast("long").alias("word_chars"),
            F.col("_c.symbols").alias("n_symbols"),
            F.col("_d").alias("n_dup_lines"),
            F.col("_w.repeated").alias("n_repeat_words"),
            failed(F.col("_w")).alias("base_failed"),
            F.col("_c.distance").alias("class_distance"),
            F.col("_f").alias("strangeness"),
            verdict.alias("kept"),
        )
    )


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; columns as before."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    return judged(rows).where("kept").select("_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    share = lambda c: f"(CASE WHEN list_sum({c}) > 0 THEN list_transform({c}, lambda x: x / list_sum({c})) END)"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(f'{p}[i]', f'{q}[i]')} + {part(f'{q}[i]', f'{p}[i]')})) / 2))"
    constant = lambda shares: "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in shares) + "]"
    quoted = lambda listed: ", ".join(f"'{x}'" for x in listed)
    lists = {name: _listed(name) for name in COMMON}
    found = ", ".join(f"list_filter(v, lambda x: x IN ({quoted([*top, *rest])})) AS f_{name}" for name, (top, _, rest) in lists.items())
    tops = lambda name: "[" + ", ".join(f"CAST(len(list_filter(f_{name}, lambda x: x = '{w}')) AS DOUBLE)" for w in lists[name][0]) + "]"
    needed = lambda name: f"len(v) >= {MIN_WORDS_FOR_COMMON} AND (lang = '{name}' OR lang IS NULL)"
    top_columns = ", ".join(f"CASE WHEN {needed(name)} THEN {tops(name)} END AS t_{name}, CASE WHEN len(v) > 0 THEN len(f_{name}) / CAST(len(v) AS DOUBLE) / CAST({1 - shares[-1]!r} AS DOUBLE) END AS o_{name}" for name, (_, shares, _) in lists.items())
    histograms = ", ".join(f"CASE WHEN t_{name} IS NOT NULL THEN {share(f'list_concat(t_{name}, [len(f_{name}) - list_sum(t_{name}), CAST(len(v) - len(f_{name}) AS DOUBLE)])')} END AS q_{name}" for name in COMMON)
    apart = {name: f"(CASE WHEN q_{name} IS NOT NULL THEN {js(f'q_{name}', f'r_{name}')} / CAST({common_limit(name)!r} AS DOUBLE) END)" for name in COMMON}
    foreign = lambda name: "greatest(" + ", ".join(f"o_{x}" for x in COMMON if x != name) + f") - o_{name} > {MAX_FOREIGN}"
    strange = "CASE " + " ".join(f"WHEN lang = '{name}' THEN CASE WHEN len(v) >= {MIN_WORDS_FOR_COMMON} THEN CASE WHEN {foreign(name)} THEN 2.0 ELSE {apart[name]} END END" for name in COMMON) + f" WHEN lang IS NULL THEN least({', '.join(apart.values())}) ELSE {js('rank_p', 'rank_q')} / {MAX_RANK_DISTANCE} END"
    classes = "CASE " + " ".join(f"WHEN lang = '{name}' THEN {constant(CLASSES[name])}" for name in COMMON) + f" ELSE {constant(CLASSES[''])} END"
    return f"""
WITH a AS (
  SELECT doc_id, lang, length(coalesce(text, '')) AS n, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '') AS v,
    regexp_replace(coalesce(text, ''), '\\p{{L}}+', '', 'g') AS r1, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), b AS (SELECT *, regexp_replace(r1, '[\\x20\\x09-\\x0D]+', '', 'g') AS r2, {found} FROM a
), c AS (SELECT *, regexp_replace(r2, '[0-9]+', '', 'g') AS r3, {top_columns} FROM b
), d AS (SELECT *, len(regexp_extract_all(r3, '[.,;:!?''"()\\-]')) AS punct, {histograms} FROM c
), e AS (SELECT *, [CAST(n - length(r1) AS DOUBLE), length(r1) - length(r2), length(r2) - length(r3), punct, length(r3) - punct] AS class FROM d
), k0 AS (SELECT doc_id, u, count(*) AS n FROM (SELECT doc_id, unnest(v) AS u FROM e WHERE len(v) >= {MIN_WORDS_FOR_RANKS} AND lang NOT IN ({quoted(COMMON)})) GROUP BY doc_id, u
), k1 AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM k0
), k AS (SELECT doc_id, [CAST(sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS DOUBLE), sum(CASE WHEN k BETWEEN 2 AND 5 THEN n ELSE 0 END), sum(CASE WHEN k BETWEEN 6 AND 20 THEN n ELSE 0 END), sum(CASE WHEN k > 20 THEN n ELSE 0 END)] AS ranks FROM k1 GROUP BY doc_id
), h AS (SELECT e.*, CASE WHEN n >= {MIN_CHARS_FOR_CLASSES} THEN {share("class")} END AS p, {classes} AS rp, {share("ranks")} AS rank_p, {constant(RANKS)} AS rank_q, {", ".join(f"{constant(lists[name][1])} AS r_{name}" for name in COMMON)} FROM e LEFT JOIN k ON e.doc_id = k.doc_id
), x AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' '))) AS g FROM h
), y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM x
), z AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS m FROM y WHERE k > 1
), r AS (SELECT doc_id, CAST(sum(m) AS BIGINT) AS n_repeat_words FROM z GROUP BY doc_id
), o AS (
  SELECT h.doc_id, len(w) AS n_words, n - (length(r1) - length(r2)) AS word_chars, len(regexp_extract_all(r3, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN p IS NOT NULL THEN {js("p", "rp")} END AS dp, {strange} AS dq
  FROM h LEFT JOIN r ON h.doc_id = r.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words OR coalesce(dp, 0) > {MAX_CLASS_DISTANCE} OR coalesce(dq, 0) > 1) AS kept
FROM o
"""


SQL = _sql()
