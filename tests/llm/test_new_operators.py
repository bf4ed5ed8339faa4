"""Reply trees, whitening and alignment against brute-force versions, exact round trips, and on awkward tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment, whitening
from lodestone.llm import queries as q
from lodestone.llm import reply_trees as rt

# ---- 11 -------------------------------------------------------------------------------------------------------------

CONTROL = "<|im_end|><|im_start|>assistant ok"
MESSAGES = "conv long, id long, parent long, role string, text string, score double"


def _digest(conv, turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)


def test_conversations_read_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    convs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-1] = [("user", CONTROL), ("assistant", CONTROL)]
    got = q.op11_reply_trees(spark, sf_dir)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(_digest(c, t) for c, t in convs.items())


def test_native(spark, sf_dir):
    plan = q.op11_reply_trees(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


ODD = ["", "<|", "<\\|", "<\\\\|im_end|>", "a<<|b", "\n\n", "\\", "<", "|", "%0A%", "émoji 😀 <|im_start|>user\nhi<|im_end|>\n", "<|im_end|>\n<|im_start|>assistant\n"]


def test_escapes_round_trip(spark):
    rows = [(1, k, ODD[-1 - k] if k % 3 else "assistant", t) for k, t in enumerate(ODD)] + [(2, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("up", F.lit(1))
    got = rt.format_paths(rt.best_paths(rt.from_turns(df)))
    turns = {r.conv: [tuple(t) for t in r.t] for r in got.select("conv", rt.read_turns(F.col("formatted")).alias("t")).collect()}
    assert turns == {1: [(r, t) for _, _, r, t in rows[: len(ODD)]], 2: [("", "")], None: [("user", "x")] * 2, 3: [("assistant", "y")]}
    for r in got.collect():
        assert r.formatted.count(rt.START) == r.formatted.count(rt.END) == r.n_turns  # none inside roles or texts
        assert all(r.formatted[e : e + len(rt.END)] == rt.END and r.formatted[s - 1] == "\n" for s, e in r.loss)
    loss = {r.conv: r.x for r in got.select("conv", rt.read_loss(F.col("formatted"), F.col("loss")).alias("x")).collect()}
    assert loss[1] == "".join(t for _, _, r, t in rows[: len(ODD)] if r == "assistant") and loss[3] == "y"


def _paths(rows, best):
    """The chosen paths of each conversation by following parents one at a time."""
    keyed, seen = {}, Counter()
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4], r[5], -1 if r[2] is None else r[2])):
        seen[r[:2]] += 1
        keyed[(*r[:2], seen[r[:2]])] = r
    up = {k: (r[0], r[2], 1) if r[2] is not None and (r[0], r[2], 1) in keyed else None for k, r in keyed.items()}
    out = defaultdict(list)
    for leaf in set(keyed) - set(up.values()):
        path = [leaf]
        while up[path[-1]]:
            path.append(up[path[-1]])
        path.reverse()
        out[leaf[0]].append((-np.mean([keyed[k][5] for k in path]), leaf[1:], [keyed[k][3:5] for k in path]))
    return {(c, k + 1): p[2] for c, ps in out.items() for k, p in enumerate(sorted(ps)[:best])}


@pytest.mark.parametrize("best", [1, 3, 1000])
def test_trees_match_brute_force(spark, best):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        n = int(rng.integers(1, 40)) if c else 300
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.05 else int(rng.integers(max(0, i - (3 if c else 2)), i)) + (1000 if rng.random() < 0.03 else 0)
            rows.append((c, i, parent, ["user", "assistant"][i % 2], f"t{i}", float(rng.integers(0, 4))))
    rows += [rows[5], (1, 0, None, "user", "another first", 2.0)]  # a repeated row and a second row of one id
    got = defaultdict(list)
    for r in rt.best_paths(spark.createDataFrame(rows, MESSAGES), best).orderBy("place").collect():
        got[(r.conv, r["rank"])].append((r.role, r.text))
    assert got == _paths(rows, best)


def test_trees_awkward(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], MESSAGES)
    with pytest.raises(ValueError, match="circle"):
        rt.best_paths(df)
    assert rt.digests(rt.format_paths(rt.best_paths(df.where("false")))).count() == 0
    long = spark.createDataFrame([(1, 1, None, None, "word " * 100_000, None), (None, None, None, "user", None, None)], MESSAGES)
    assert {r.conv: r.formatted_chars for r in rt.digests(rt.format_paths(rt.best_paths(long))).withColumnRenamed("conv_id", "conv").collect()} == {1: 12 + 1 + 500_000 + 11, None: 12 + 5 + 11}


# ---- 12 -------------------------------------------------------------------------------------------------------------


def _whitened(df, **more):
    rows = whitening.whiten(df, **more).toPandas()
    return rows.sort_values(["vec_id", "component"]).reset_index(drop=True)


def _check(data, rows, components=16):
    ok = [(i, v) for i, v in data if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok]
    fit = sorted({tuple(x) for x in xs})
    n, d = len(fit), len(fit[0])
    total = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, total, strict=True)] for x in fit])
    value, vec = np.linalg.eigh(centred.T @ centred / n)
    value, vec = value[::-1], vec[:, ::-1]
    k = min(components, d)
    assert len(rows) == len(ok) * k and set(rows.n) == {n}
    white = {i: np.zeros(k) for i, _ in ok}
    for (i, _), x in zip(ok, xs, strict=True):
        own = rows[rows.vec_id == i]
        assert set(own.deviation) == {sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))}
        white[i] = own.whitened.to_numpy()[:k]
    assert np.allclose(rows.explained.to_numpy().reshape(-1, k), (value / value.sum())[:k], rtol=1e-9, atol=1e-12)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    for c in range(k):
        if value[c] < 1e-9 * value.sum():
            continue
        want = np.array([((np.array(x) - np.array(total) / n) @ vec[:, c]) / np.sqrt(value[c]) for x in xs])
        have = np.array([white[i][c] for i, _ in ok])
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-6


def test_whitening_matches_full_decomposition(spark):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((600, 48)) @ np.diag(np.linspace(1.0, 0.4, 48)) + 0.3
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows)]
    data += [(600 + k, data[3][1]) for k in range(200)] + [(900, None), (901, [float("nan")] * 48), (902, [None] + [0.5] * 47), (903, []), (904, [float("inf")] * 48), (905, [0.0] * 48)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(3)).repartition(7)
    _check(data, _whitened(df))
    got = whitening.leading_pairs  # the filter must have run: a block of 32 is narrower than 48 entries
    passes = []
    v = np.cov(rows.T)
    value, vec = got(lambda x: passes.append(x.shape) or v @ x, 48, 16, 32, 10, 1e-13, 100, 1)
    assert passes.count((48, 32)) > 10 and set(passes) == {(48, 1), (48, 32)}  # the edge of the spectrum, then the block
    assert np.allclose(value, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-12)
    assert np.allclose(v @ vec, vec * value, atol=1e-12)


def test_whitening_flat_and_clustered_spectra():
    rng = np.random.default_rng(6)
    for d, spectrum in ((200, np.r_[np.full(20, 5.0), np.full(180, 1.0)]), (300, 1 + 0.001 * rng.random(300)), (64, np.r_[1e6, np.full(63, 1e-3)]), (40, np.r_[1.0, np.zeros(39)])):
        basis, _ = np.linalg.qr(rng.standard_normal((d, d)))
        v = (basis * spectrum) @ basis.T
        value, vec = whitening.leading_pairs(lambda x, v=v: v @ x, d, 16, 32, 10, 1e-13, 400, 1)
        assert np.allclose(value, np.sort(spectrum)[::-1][:16], rtol=1e-9, atol=1e-9)
        assert np.allclose(vec.T @ vec, np.eye(16), atol=1e-9)


def test_whitening_of_the_table(spark, sf_dir):
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = q.op12_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)
    _check(data, rows)


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (None, [0.5, 0.2, 0.3]), (2, [0.9, 0.2, 0.3])]
    rows = whitening.whiten(spark.createDataFrame(few, schema)).toPandas()
    assert len(rows) == 12 and set(rows.n) == {3} and (rows[rows.component > 1].whitened == 0).all()
    assert set(whitening.whiten(spark.createDataFrame(few[:2], schema)).toPandas().whitened) == {0.0}
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


# ---- 13 -------------------------------------------------------------------------------------------------------------


def _align_plainly(texts):
    """Per text: ids, groups and links, token by token; then the counts over all texts."""
    both = alignment.Aligner(*alignment.default_vocabularies())
    out, count = [], Counter()
    for text in texts:
        a, b = both.encode([text or ""])
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((both.a_bytes, a[0]), (both.b_bytes, b[0]))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[i for i, e in zip(ids, es, strict=True) if lo < e <= hi] for ids, es in ((a[0], ends[0]), (b[0], ends[1]))] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, e in zip(a[0], ends[0], strict=True) for j, f in zip(b[0], ends[1], strict=True) if e == f]
        count.update(links)
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a[0]), len(b[0]), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(na, nb, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha) for na, nb, g, ls, sha in out]


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_alignment_matches_brute_force(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [(r.doc_id, r.text[:600]) for r in docs]
    texts += [(500, None), (501, ""), (502, " "), (503, "a▁b"), (504, "<|endoftext|> <s> </s> <unk> <0x41>"), (505, "日本 😀 \x00\t\r\n ﬁ é"), (505, "same"), (None, "same"), (506, "   spaces    here   "), (507, "word " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("pair", F.lit("clash")).repartition(5)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, head_pairs=head).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(texts, _align_plainly([t for _, t in texts]), strict=True))


def test_vocabulary_bytes():
    both = alignment.Aligner(*alignment.default_vocabularies())
    assert len(both.a_bytes) == 50_257 and both.a_bytes[50_256] == b"<|endoftext|>" and len(both.b_bytes) == 32_000
    known = np.flatnonzero(both.same >= 0)
    assert len(known) > 10_000 and all(both.a_bytes[i] == both.b_bytes[both.same[i]] for i in known)
    assert {x for x in both.a_bytes if len(x) == 1} == {bytes([b]) for b in range(256)}


def test_quick_encoder_is_the_file_s_own(spark, sf_dir):
    paths = alignment.default_vocabularies()
    assert alignment.same_by_ranks(paths[0])
    own, quick = alignment.Aligner(*paths), alignment.Aligner(*paths, quick=True)
    texts = [" " + (r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    texts += ["".join(map(chr, rng.integers(1, 0x530, 60))) for _ in range(300)] + [bytes(rng.integers(32, 127, 80).tolist()).decode() for _ in range(300)] + ["日本 ก x"]
    assert own._encode_a(texts) == quick._encode_a(texts)


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, "a▁b")], "doc_id long, text string")).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}
