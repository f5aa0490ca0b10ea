"""The pipeline: each stage on its predecessor's rows, and the whole."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
from rillstone.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long, __gone int, runs string, name string, rep long"


def corpus(n=30):
    rng = random.Random(1)
    vocab = "the of and river stone walking house bridge green over".split()
    return [" ".join(rng.choice(vocab) for _ in range(40)).capitalize() + "." for _ in range(n)]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert 0 < len(rows) <= len(before) and set(rows) <= set(before)
        if name != "lines":
            assert all(before[k] == t for k, t in rows.items())
        before = rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    size = defaultdict(int)
    for p in pieces:
        size[p.sequence_id] += p.length
    assert {p.doc_id for p in pieces} == set(before) and max(size.values()) <= 4096


def test_run_over_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    vocab = "the of and river stone walking house bridge green over".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(40)).capitalize() + "." for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(50, texts[0], "en", "s", 1), (51, None, None, None, None), (52, "", "en", "s", 0), (None, "12", None, "s", 2), (50, texts[0], "en", "s", 1), (53, "Wow!! WOW!! " * 50, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= ids and not ids & {50, 51, 52, 53, None}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_each_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)


def test_stages_against_brute_force(spark):
    """Each stage on rows with clashing further columns, against the rule row by row."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from zlib import crc32

    from rillstone.llm import language_id, quality
    from test_operators import brute_documents, plain_features, plain_prediction

    texts = corpus() + ["WOW!! " * 60, "12 34", None, "", corpus(1)[0], "Das Haus und der Stein. " * 4, "a <|endoftext|> b " * 5, "WOW!! " * 60]
    texts[3] = texts[2].replace("river", "lake", 1)
    rows = [(i, t, "de" if t and "Haus" in t else "en", "s", len(t or ""), 1, "r", "n", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        assert df.columns == docs.columns
        return {r.doc_id for r in df.collect()}

    model = language_id.learn(docs)
    said = {i: plain_prediction(model, t) for i, t in enumerate(texts)}
    assert ids(stages["language"](spark, docs, "")) == {i for i, (lang, score) in said.items() if lang != "und" and score >= 0.6}
    scorer = quality.fit(docs)

    def good(t):
        f, n = plain_features(t)
        return n > 0 and sum(scorer.weight[b] * v**0.5 for b, v in f.items()) >= 0

    assert ids(stages["quality"](spark, docs, "")) == {i for i, t in enumerate(texts) if good(t)}
    assert ids(stages["lines"](spark, docs, "")) == {i for i, t in enumerate(texts) if t and (texts.index(t) == i or len(t.split()) < 50)}
    assert ids(stages["near"](spark, docs, "")) == {i for i, c in brute_documents([(i, t) for i, t in enumerate(texts)], 5, 80)[1].items() if i == c}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {r.doc_id: r for r in stages["packing"](spark, docs, "").collect()}
    for i, t in enumerate(texts):
        own = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (pieces[i].doc_tokens, pieces[i].ids_crc32) == (len(own), crc32(b"".join(x.to_bytes(4, "little") for x in own)))
