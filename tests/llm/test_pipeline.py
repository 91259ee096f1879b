"""Each stage of the pipeline on its own input, against plain Python."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, lines, mixing, quality, simhash
from tessera.llm.common import read, stored

from .. import oracle
from .test_text_operators import brute_components, lower, quality_base

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no tables here")


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages(spark):
    docs = read(spark, oracle.DATA, "documents")
    (_, rules), (_, dedup), (_, near), (_, mix), (_, code) = corpus_pipeline.STAGES
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"

    kept = stored(rules(spark, docs, oracle.DATA), "t")
    verdict = {x.doc_id: x.kept for x in quality.judged(docs).collect()}
    base = {x.doc_id: quality_base(x.text) for x in docs.collect()}
    assert rows(kept) == collections.Counter(tuple(x) for x in docs.collect() if verdict[x.doc_id])
    assert all(not verdict[i] for i, b in base.items() if b[0] < 10 or 100 * b[4] > 20 * b[0])

    key = lambda s: lower(s.strip(" \t\n\x0b\f\r"))
    given = kept.collect()
    count = collections.Counter(k for x in given for k in {key(s) for s in x.text.split("\n")})
    shorter = stored(dedup(spark, kept, oracle.DATA), "t")
    want = {x.doc_id: "\n".join(s for s in x.text.split("\n") if not key(s) or count[key(s)] < lines.MIN_DOCUMENTS) for x in given}
    assert {x.doc_id: x.text for x in shorter.collect()} == want and shorter.columns == docs.columns

    single = stored(near(spark, shorter, oracle.DATA), "t")
    ids = sorted(want)
    of = brute_components([simhash.fingerprint(want[i].encode()) for i in ids])
    assert sorted(x.doc_id for x in single.collect()) == sorted(min(i for i, c in zip(ids, of) if c == k) for k in set(of))

    mixed = stored(mix(spark, single, oracle.DATA), "t")
    copies = {x.doc_id: x.copies for x in mixing.mixed(single).collect()}
    assert collections.Counter(x.doc_id for x in mixed.collect()) == collections.Counter({i: n for i, n in copies.items() if n})

    with open(bpe.vocabulary_path(), "rb") as f:
        coder = bpe.Tokenizer(f.read())
    for x in code(spark, mixed, oracle.DATA).collect():
        assert x.ids == coder.encode(want[x.doc_id]).tolist() and x.decoded == coder.decode(coder.encode(want[x.doc_id]))
    assert set(corpus_pipeline.run(spark, oracle.DATA).columns) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"}


def test_run_takes_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, clashing names and a very long text."""
    prose = "The house of the man is in the old town and it is near to the river, as all of them know well. "
    long = "\n".join(f"Line {i} of a long and quiet text that goes on with the story of the town {i * 7}" for i in range(3000))
    rows = [(1, prose * 1 + "One more thing.", "en", "a", 5), (1, prose * 1 + "One more thing.", "en", "a", 5), (None, prose + "Another end of it altogether, with words of its own.", None, None, None), (3, None, "en", "b", 0), (4, "", "de", "b", 0), (5, long, "en", "b", len(long))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("mine") for c in ("fp", "ids", "kept", "size", "_k", "n_words", "component")})
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    got = out.collect()
    assert {x.doc_id for x in got} <= {1, None, 5} and all(x.fp == "mine" and x.n_tokens > 0 for x in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_query_columns_of_near_duplicates(spark, tmp_path):
    """The hex form and the component of op6, and what op9 takes, from the queries themselves."""
    texts = ["", None, "one two three four five six seven eight", "one two three four five six seven eight", "quite another text than the others here"]
    rows = [(9 - i, t, "en", "s" if i % 2 else None, 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    near = {x.doc_id: x for x in simhash.op6_simhash_near_dedup(spark, str(tmp_path)).collect()}
    of = dict(zip([9 - i for i in range(5)], brute_components([simhash.fingerprint((t or "").encode()) for t in texts])))
    for i, t in ((9 - i, t) for i, t in enumerate(texts)):
        assert near[i].fingerprint == f"{simhash.fingerprint((t or '').encode()):016x}"
        assert near[i].component_id == min(j for j in of if of[j] == of[i])
    mix = mixing.op9_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in mix) == [5, 6, 7, 8, 9]
    assert all(x.taken in (0, x["size"], 2 * x["size"]) and x["size"] == len((texts[9 - x.doc_id] or "").split()) for x in mix)
