"""The pipeline against what its stages promise."""

import re
from collections import Counter

import corpus_pipeline as P
from .test_operators import awkward, brute_join, brute_pii


def test_stages_keep_their_promises(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    kept = P.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == P.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert len(toxic & before.keys() - ids) <= 0.03 * len(toxic)
    texts = {i: before[i].text for i in ids}
    once = P.one_of_each_class(spark, kept, sf_dir)
    assert {r.doc_id for r in once.collect()} == {i for i, (_, c) in brute_join(texts).items() if i == c}
    low = lambda t: f" {' '.join(re.findall(r'[^ \t-\r]+', t.lower()))} "
    items = [low(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = P.drop_contaminated(spark, once, sf_dir)
    rest = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in once.collect()} - rest
    assert all(any(x in low(before[i].text) for x in items) for i in gone) or len(gone) < 10
    assert not any(x in low(before[i].text) for i in rest for x in items)
    for r in P.mask_pii(spark, clean, sf_dir).collect():
        assert not brute_pii(r.text) and r.n_chars == len(r.text)
    out = P.mix(spark, clean, sf_dir).collect()
    assert {r.doc_id for r in out} == rest and all(r.rate >= 0 for r in out)


def test_run_is_the_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    want = Counter((r.doc_id, r.n_tokens, round(r.rate, 6)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, round(r.rate, 6)) for r in P.run(spark, sf_dir).collect()) == want


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = awkward(spark)
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
        docs = stage(spark, docs, sf_dir)
        assert name == "mixing" or docs.columns == P.COLUMNS
        assert docs.count() >= 5


def test_different_texts_under_one_id_stay(spark, sf_dir):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red blue green black white brown"
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, b), (None, ""), (None, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in P.one_of_each_class(spark, docs, sf_dir).collect())
    assert got == Counter([(1, a), (1, b), (None, c), (None, ""), (None, ""), (3, None)])
