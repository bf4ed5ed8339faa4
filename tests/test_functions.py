"""Hand-worked cases of functions that SQL does not check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking, html, pii
from lodestone.functions import predicates as P
from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.operators import graph, hybrid, keyword, vectors
from lodestone.operators import windows as W


def _norm(spark, scores):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "query_id long, i long, score double")
    return [r.norm for r in W.normalised_keyword(df).orderBy("i").collect()]


def test_keyword_normalisation(spark):
    from math import log1p

    assert _norm(spark, [3.0]) == [1.0]
    assert _norm(spark, [1.0, 3.0]) == pytest.approx([log1p(1) / log1p(3), 1.0])
    assert _norm(spark, [2.0, 2.0, 2.0]) == [0.0, 0.0, 0.0]
    assert _norm(spark, [1.0, 5.0, 5.0]) == [0.0, 0.5, 0.5]
    got = _norm(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    assert got[:2] == [0.0, 0.0] and got[2] == 0.0 or got[2] > 0
    assert got[-1] == 1.0


def test_bands(spark):
    rows = spark.createDataFrame([(1, "a", s) for s in (0.825, 0.80, 0.7999)], "query_id long, filename string, score double")
    r = A.file_statistics(rows).first()
    assert (r.high, r.medium, r.low) == (1, 1, 1)
    empty = A.search_statistics(rows.where("false"), rows.select("query_id").distinct()).first()
    assert (empty.total, empty.avg_score) == (0, 0.0)


def test_masks():
    assert pii.mask("010-1234-5678", "phone") == "010-****-****"
    assert pii.mask("user@domain.com", "email") == "u***@******.com"
    assert pii.mask("1234-5678-9012-3456", "credit_card") == "****-****-****-3456"
    assert pii.mask("1234567890", "account") == "123*****90"
    assert pii.mask("AA:BB:CC:DD:EE:FF", "mac_address") == "**:**:**:**:**:**"
    assert pii.generalize("900101-1234567", "resident_id") == "30대"
    assert pii.generalize("192.168.1.7", "ip_address") == "192.168.1.***"


def test_detection_priority_and_overlap():
    assert [k for k, _, _ in pii.detect("id 900101-1234567 mail a@b.co ip 10.0.0.1")] == ["resident_id", "email", "ip_address"]
    assert [k for k, _, _ in pii.detect("M12345678 11-22-333333-44 123-45-67890 02-123-4567")] == ["passport", "driver_license", "business_id", "telephone"]
    assert pii.detect(None) == [] and pii.detect("") == []


def test_pseudonyms_are_numbered_in_order():
    text = "b@x.io a@x.io b@x.io"
    assert pii.anonymize(text, pii.detect(text), "pseudonymize")[0] == "EMAIL_001 EMAIL_002 EMAIL_001"


def test_reduction(spark):
    rows = spark.range(100).select((F.col("id") < 40).alias("is_relevant"))
    r = A.reduction(rows).first()
    assert (r.total, r.selected, r.saved, r.rate, r.saved_tokens, r.saved_usd) == (100, 40, 60, 60.0, 15_360, 0.0015)


def test_activity_score(spark):
    rows = [(1, "SUCCESS" if i % 10 else "FAILED", f"s{i % 3}", f"t{i % 4}") for i in range(30)]
    r = A.activity_score(spark.createDataFrame(rows, "user_id long, success string, session_id string, action_type string")).first()
    assert r.score == 40 + 27 + 15 + 8


def test_recursive_split():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(5))
    parts = chunking.split_text(text, 100, 20)
    assert all(len(p) <= 100 for p in parts)
    assert set(text.split()) == {w for p in parts for w in p.split()}
    assert chunking.split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    with pytest.raises(ValueError):
        chunking.split_text("a", 10, 10)


def test_pack():
    assert chunking.pack(["aa", "bb", "cccccc"], 5) == ["aa bb", "ccccc", "c"]
    assert chunking.pack([], 5) == []


def test_pages():
    page = """<html><head><meta property="og:title" content="T"><meta name="description" content="D"></head><body><header>no</header>
    <div class="ad-box">buy</div><main><h1>Head</h1><p>{}</p><ul><li>one<li>two</ul><a href="/x">link</a></main></body></html>""".format("word " * 40)
    root = html.parse(page)
    assert html.metadata(root) == ("T", "D")
    html.clean(root)
    text = html.markdown(html.main_content(root))
    assert text.startswith("# Head") and "- one" in text and "[link](/x)" in text and "buy" not in text and "no" not in text.split()


def test_page_fallbacks():
    assert html.markdown(html.main_content(html.parse("<body><div class='content'>" + "x" * 60 + "</div><div>" + "y" * 90 + "</div></body>"))) == "x" * 60
    assert html.markdown(html.main_content(html.parse("<body><div>short</div></body>"))) == "short"
    assert html.markdown(html.main_content(html.parse(""))) == ""


def test_missing_values_of_row_functions(spark):
    df = spark.createDataFrame([(None,), ("",), ("null",), ("[1]",), ('{"a":1}',)], "t string")
    assert [r[0] for r in df.select(S.json_object("t")).collect()] == [None, None, None, None, '{"a":1}']
    assert spark.range(1).select(S.finite(F.lit(float("nan"))), S.finite(F.lit(float("inf"))), S.finite(F.lit(1.0))).first()[:] == (None, None, 1.0)
    assert spark.range(1).select(S.resident_id_date_valid(F.lit("900131-1234567")), S.resident_id_date_valid(F.lit("901331-1234567"))).first()[:] == (True, False)


def test_status_domain():
    with pytest.raises(ValueError):
        P.status_is("done")
    with pytest.raises(ValueError):
        P.matches({})


def test_fusion_and_rerank(spark):
    dense = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "query_id long, parsed_text string, dense_score double")
    key = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.4)], "query_id long, parsed_text string, keyword_score double")
    fused = hybrid.fuse(dense, key)
    got = {r.parsed_text: round(r.score, 6) for r in fused.collect()}
    assert got == {"a": 0.63, "b": 0.65, "c": 0.12}
    assert [r.parsed_text for r in hybrid.finish(fused, 0.2, 5).orderBy("rank").collect()] == ["b", "a"]
    assert hybrid.finish(fused, 0.0, 5).count() == 3


def test_vector_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.id, round(r.score, 6)) for r in vectors.dense_top_k(q, v, 10).orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert vectors.dense_top_k(q.where("false"), v, 3).count() == 0
    assert vectors.dense_top_k(q, v.where("false"), 3).count() == 0
    many = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    assert vectors.dense_top_k(many, v, 2).count() == 18


@pytest.mark.parametrize("kind", ["COSINE", "IP", "L2"])
def test_blocks_of_any_size(spark, monkeypatch, kind):
    """Restricted and plain searches over many small blocks, with ties, equal those by brute force."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 256)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = [(q, i) for q in range(0, 90, 9) for i in range(90) if (q + i) % 4 == 0]

    def best(allowed):
        out = set()
        for q in range(0, 90, 9):
            s = vectors._scores(x[[q]], x, kind)[0]
            order = sorted((i for i in range(90) if (q, i) in allowed), key=lambda i: (-round(s[i], 12), i))[:5]
            out |= {(q, i, k + 1, round(abs(s[i]) if kind == "L2" else s[i], 9) + 0.0) for k, i in enumerate(order)}
        return out

    for within, allowed in ((None, {(q, i) for q in range(0, 90, 9) for i in range(90)}), (spark.createDataFrame(pairs, "query_id long, id long"), set(pairs))):
        got = vectors.dense_top_k(asked, rows, 5, kind, within=within).collect()
        assert {(r.query_id, r.id, r["rank"], round(r.score, 9) + 0.0) for r in got} == best(allowed)


def test_neighbours_across_batches(spark):
    from lodestone.operators.windows import neighbour_similarity

    rng = np.random.default_rng(6)
    x = {(g, i): rng.standard_normal(3) for g in (1, 2, None) for i in range(25)}
    df = spark.createDataFrame([(g, i, [float(c) for c in v]) for (g, i), v in x.items()], "g long, pos int, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.g, r.pos): r.sim for r in neighbour_similarity(df, ["g"], "pos").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(x)
    for (g, i), v in x.items():
        w = x.get((g, i + 1))
        assert got[g, i] is None if w is None else abs(got[g, i] - v @ w / np.linalg.norm(v) / np.linalg.norm(w)) < 1e-6


def test_clustered_recall(spark, sf_dir, tmp_path):
    from lodestone.sources.tables import load
    from lodestone.sources.views import query_vectors

    e, q = load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir)
    exact = {(r.query_id, r.id) for r in vectors.dense_top_k(q, e, 10).collect()}
    centroids = vectors.fit_clusters(e, 64)
    vectors.write_clusters(e, str(tmp_path / "index"), centroids)
    near = {(r.query_id, r.id) for r in vectors.stored_top_k(q, str(tmp_path / "index"), 10, vectors.probes_for(e, centroids)).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_blank_query_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "  "), (2, "b")], "query_id long, query string")
    got = keyword.bm25_scores(keyword.query_terms(q), docs, "doc_id", "text").collect()
    assert [(r.query_id, r.doc_key) for r in got] == [(2, 1)]


def test_expansion_stops_at_hops(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")], "source_entity string, relation_type string, target_entity string")
    s = spark.createDataFrame([(1, "a")], "query_id long, entity string")
    assert {(r.entity, r.hop) for r in graph.expand(s, e, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        graph.expand(s, e, 3)


def test_redaction_hides_whatever_a_secret_holds(spark):
    rows = [('{"password":{"x":"p"},"private_key":"k","token":["a"],"n":{"Secret":1,"ok":[{"api_key":null},2]}}',), ("[1]",), ("null",), (None,), ("{bad",), ('{"a":"한"}',)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(S.redact_nested("t").alias("c")).collect()]
    hidden = '"[FILTERED]"'
    assert got == [f'{{"password":{hidden},"private_key":{hidden},"token":{hidden},"n":{{"Secret":{hidden},"ok":[{{"api_key":{hidden}}},2]}}}}', None, None, None, None, '{"a":"한"}']


def test_likeliest_div():
    small, large = "x" * 120, "y" * 600
    page = f'<body><div class="story">{small}</div><div id="a">{large}</div><div class="post text" id="main">{"z" * 60}</div></body>'
    # 2 + 1, 1 + 2, and 4 + 2 points
    assert html.main_content(html.parse(page)).attrs == {"class": "post text", "id": "main"}
    assert html.main_content(html.parse(f"<body><div>{'a' * 40}</div><p>b</p></body>")).tag == "body"
    assert html.main_content(html.parse(f"<body><div>{'a' * 51}</div><div>{'b' * 60}</div></body>")).text() == "b" * 60


def test_split_keeps_separators_at_the_beginning():
    assert chunking.split_text("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert chunking.split_text("one two\n\nthree", 8, 0) == ["one two", "three"]
    assert chunking.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.split_text("", 4, 1) == []


def test_next_times(spark):
    now = 1_718_000_000  # Monday, 06:13:20 UTC
    crons = ["0 * * * *", "14 * * * *", "30 3 * * *", "0 7 * * *", "0 0 * * 0", "13 6 * * 1", "*/5 * * * *", None, "bad", "60 * * * *", "* * * *", "5-1 * * * *", "*/0 * * * *", "0 0 31 2 *", "1,,2 * * * *"]
    got = [r.t for r in spark.createDataFrame([(c,) for c in crons], "c string").select(S.next_time("c", now).alias("t")).collect()]
    day = now - now % 86_400
    assert got == [day + 7 * 3600, day + 6 * 3600 + 14 * 60, day + 27 * 3600 + 1800, day + 7 * 3600, day + 6 * 86_400, day + 7 * 86_400 + 6 * 3600 + 13 * 60, day + 6 * 3600 + 15 * 60] + [None] * 8


def _values(field, lo, hi):
    out = set()
    for part in field.split(","):
        head, _, step = part.partition("/")
        a, _, b = head.partition("-")
        low, high = (lo, hi) if a == "*" else (int(a), int(b or (hi if step else a)))
        out |= set(range(low, high + 1, int(step or 1)))
    return np.array(sorted(out))


def test_next_times_minute_by_minute(spark):
    """Against every minute of five years, which have two February 29."""
    import datetime as dt

    begin = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) // 60
    t = np.arange(begin, begin + 5 * 366 * 1440)
    days = (np.datetime64("1970-01-01") + np.unique(t // 1440).astype("timedelta64[D]")).astype(object)
    by_day = {d: np.repeat([getattr(x, d) for x in days], 1440)[: len(t)] for d in ("day", "month")}
    week = np.repeat([(x.weekday() + 1) % 7 for x in days], 1440)[: len(t)]
    crons = ["* * * * *", "0 12 29 2 *", "15,45 */6 * * *", "0 0 13 * 5", "0 0 */10 * 5", "59 23 31 12 *", "7 3-9/2 1,15 1-12/3 *", "30 1 * * 7", "0 0 29 2 1", "*/25 20 * 2,8 2-4", "5/20 4 30 */5 *", "0 6 1-7 * 0,3"]
    for now in (1_709_164_799, 1_709_251_200, 1_735_689_540, 1_718_000_000, 1_727_740_799):
        rows = spark.createDataFrame([(c,) for c in crons], "c string").select("c", S.next_time("c", now).alias("t")).collect()
        after = t > now // 60
        for r in rows:
            f = r.c.split()
            m, h, d, mo, w = (_values(x, *b) for x, b in zip(f, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
            of_month, of_week = np.isin(by_day["day"], d), np.isin(week, w % 7)
            day = of_month | of_week if f[2][0] != "*" and f[4][0] != "*" else of_month & of_week
            hit = t[after & np.isin(t % 60, m) & np.isin(t // 60 % 24, h) & np.isin(by_day["month"], mo) & day]
            assert r.t == hit[0] * 60, (r.c, now)


def test_pages_by_seeking(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, f"t{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k int, t string")
    for order in ([("k", True), ("id", False)], [("k", False), ("t", True), ("id", True)]):
        want = [r.id for r in df.orderBy(*[F.desc(c) if x else F.asc(c) for c, x in order]).collect()]
        got, after = [], None
        while True:
            page, seen = W.page_after(df, order, 7, after)
            page = page.collect()
            assert seen.get["total"] == 60
            got += [r.id for r in page]
            if len(page) < 7:
                break
            after = page[-1].asDict()
        assert got == want


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    from lodestone.sources import tables as T

    path = str(tmp_path / "t")
    df = spark.range(40).select("id", (F.col("id") % 4).alias("g"), F.lit("old").alias("v"))
    df.write.partitionBy("g").parquet(path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    assert T.upsert_into(spark, path, "g", spark.createDataFrame([(1, 1, "new"), (101, 1, "new"), (9, 7, "new")], "id long, g long, v string"), ["id"])
    after = files()
    assert {p: t for p, t in before.items() if "g=1" not in str(p)}.items() <= after.items()
    assert not {p for p in before if "g=1" in str(p)} & set(after)
    T.delete_from(spark, path, "g", spark.createDataFrame([(7, 9), (2, 2)], "g long, id long"))
    assert {str(p.parent.name) for p in files()} == {"g=0", "g=1", "g=2", "g=3"}
    want = {(i, i % 4, "new" if i == 1 else "old") for i in range(40) if i != 2} | {(101, 1, "new")}
    assert {(r.id, r.g, r.v) for r in spark.read.parquet(path).collect()} == want


def test_folders_with_odd_names(spark, tmp_path):
    from lodestone.sources import tables as T

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a/b:c"), (2, "plain"), (3, "x=y z")], "id long, g string").write.partitionBy("g").parquet(path)
    T.delete_from(spark, path, "g", spark.createDataFrame([("a/b:c", 1), ("x=y z", 3)], "g string, id long"))
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "plain")]
    assert [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()] == ["g=plain"]
    with pytest.raises(ValueError, match="null"):
        T.delete_from(spark, path, "g", spark.createDataFrame([(None, 1)], "g string, id long"))


def test_csv_with_quotes(spark, tmp_path):
    import duckdb

    from lodestone.sources import tables as T

    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, ""), (4, None), (5, " blank ")]
    path = str(tmp_path / "out.csv")
    for _ in range(2):  # an older file is replaced
        T.write_csv(spark.createDataFrame(rows, "id long, t string").orderBy("id"), path)
    got = duckdb.sql(f"SELECT * FROM read_csv('{path}', header = true, quote = '\"', escape = '\"', columns = {{'id': 'BIGINT', 't': 'VARCHAR'}}) ORDER BY id").fetchall()
    assert [(i, t or "") for i, t in got] == [(i, t or "") for i, t in rows]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]


def test_stored_postings_equal_a_rebuild(spark, tmp_path):
    from lodestone.sources.postings import Index

    docs = {i: f"w{i % 5} w{i % 3} common" if i % 9 else "" for i in range(40)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_key long, text string")
    index = Index(spark, str(tmp_path / "a"))
    index.change(frame(docs))
    index.change(frame({3: "new words w1", 50: "w1 fresh"}), spark.createDataFrame([(4,), (99,)], "doc_key long"))
    index.change(frame({3: "again w1"}))
    (tmp_path / "a" / "postings" / "gen=3" / "bucket=0").mkdir(parents=True)  # a change that failed before its end
    now = docs | {3: "again w1", 50: "w1 fresh"}
    del now[4]
    fresh = Index(spark, str(tmp_path / "b"))
    fresh.change(frame(now))
    rows = lambda x: sorted(map(tuple, x.collect()))
    merged = index.compacted(str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, "w1"), (1, "common"), (2, "again"), (3, "nowhere")], "query_id long, term string")
    for other in (index, merged):
        assert rows(other.postings()) == rows(fresh.postings()) and rows(other.documents()) == rows(fresh.documents())
        assert [(q, k, round(s, 9)) for q, k, s in rows(other.bm25(asked))] == [(q, k, round(s, 9)) for q, k, s in rows(fresh.bm25(asked))]
    plan = fresh.postings([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:300]


def test_run_into_both_stores_or_none(spark, tmp_path, monkeypatch):
    from lodestone.plans import jobs

    fields = "id long, hash_sha256 string, group_id long, role_ids array<long>, category string, title string, filename string, status string, chunk_count long, token long, end_date long"
    meta = spark.createDataFrame([(i, f"h{i}", 1, [1], "c", "t", "f", "uploaded" if i == 3 else "registered", 0, 0, 0) for i in range(5)], fields)
    pages = spark.createDataFrame([(f"h{i}", 1, f"some words of document {i} " * 30) for i in range(4)], "hash_sha256 string, page_number int, text string")
    path, real, calls = str(tmp_path / "s"), jobs.write_counted, []

    def broken(df, to, *a, **b):
        calls.append(to)
        if "/postings/" in to:
            real(df.limit(1), to, None, mode="overwrite")
            raise OSError("no space")
        return real(df, to, *a, **b)

    monkeypatch.setattr(jobs, "write_counted", broken)
    out = {r.id: r.status for r in jobs.embedding_run(meta, pages, path, "r1", 9).collect()}
    assert out == {0: "failed", 1: "failed", 2: "failed", 3: "uploaded", 4: "failed"} and len(calls) == 2
    assert not list((tmp_path / "s").rglob("*.parquet"))
    monkeypatch.setattr(jobs, "write_counted", real)
    out = {r.id: (r.status, r.chunk_count > 0, r.end_date) for r in jobs.embedding_run(meta, pages, path, "r1", 9).collect()}
    assert out == {0: ("uploaded", True, 9), 1: ("uploaded", True, 9), 2: ("uploaded", True, 9), 3: ("uploaded", False, 0), 4: ("skipped", False, 9)}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    jobs.embedding_run(meta, pages, path, "r1", 9)
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}


def test_strategy_by_risk_and_kinds(spark):
    docs = spark.createDataFrame([("de", "a@x.io 010-1234-5678"), ("fr", "a@x.io"), ("xx", "a@x.io 10.0.0.1")], "file_type string, text string")
    config = spark.createDataFrame([("de", "risk", ["email", "phone"]), ("fr", "none", None)], "file_type string, strategy string, kinds array<string>")
    got = {r.file_type: r.clean_text for r in pii.anonymized(pii.with_strategy(docs, config), strategy_col="strategy", kinds_col="kinds").collect()}
    assert got == {"de": "EMAIL_001 010-****-****", "fr": "a@x.io", "xx": "a@*.io 10.0.0.1"}


def test_index_within_groups_of_any_size(spark):
    rows = spark.createDataFrame([(k % 2 if k % 10 else None, k, "x" if k % 4 < 2 else "y") for k in range(1000)], "g long, k long, v string")
    got = W.dense_index(rows, ["g"], ["k"], "i", rows_per_task=70).collect()
    for g in (0, 1, None):
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == sorted(r.k for r in got if r.g == g)
        assert sorted(r.i for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))
    shown = {r.k: r.v for r in W.blank_repeats(rows, ["g"], "k", ["v"], block=7).collect()}
    last = {}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        assert shown[r.k] == ("" if last.get(r.g) == r.v else r.v)
        last[r.g] = r.v


def test_categories_of_any_depth(spark):
    from lodestone.operators import joins as J

    tree = spark.createDataFrame([(0, "r", None)] + [(k, f"n{k}", k - 1) for k in range(1, 20)] + [(50, "loop", 51), (51, "loop", 50)], "id long, name string, parent_id long")
    got = {r.id: r.depth for r in J.category_paths(tree).collect()}
    assert got == {k: k for k in range(20)}


def _packed(title, headers, rows, size):
    """Rows packed one after the other."""
    head = "| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |\n"
    wide = len(f"{title}\n\n{head}") >= size
    base = len(f"{title}\n\n{chunking.WORDS_HEAD}\n\n") if wide else len(f"{title}\n\n{head}")

    def line(cells, k):
        cells = [(c or "").strip() for c in [*cells, *[None] * len(headers)][: len(headers)]]
        if wide:
            return f"{chunking.WORDS_ROW}{k}\n" + "".join(f"- **{h}**: {c}\n" for h, c in zip(headers, cells) if c)
        return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"

    groups, now, total = [], [], base
    for cells in rows:
        cost = len(line(cells, len(now) + 1)) + (2 if wide else 1)
        if now and total + cost > size:
            groups.append(now)
            now, total = [], base
        now.append(cells)
        total += cost
    groups += [now] if now else []
    out = []
    for k, g in enumerate(groups, 1):
        name = f"{title} (Part {k})" if k > 1 else title
        body = "\n".join(line(c, j) for j, c in enumerate(g, 1))
        out.append((f"{name}\n\n{chunking.WORDS_HEAD} ({len(g)}행)\n\n{body}" if wide else f"{name}\n\n{head}{body}", len(g)))
    return out


@pytest.mark.parametrize("size", [30, 60, 400, 900])
def test_table_chunks_do_not_depend_on_blocks(spark, size):
    import random

    rng = random.Random(size)
    rows = [(s, i, [("ab|c\n" * rng.randint(0, 4)) or None, " " + "x" * rng.randint(0, 30)][: rng.randint(0, 3)] + ["y"] * rng.randint(0, 2)) for s in ("a", "bb", None) for i in range(700)]
    rows += [("same", i, ["11", "22"]) for i in range(1500)] + [("long", i, ["z" * 1000, None]) for i in range(3)]
    df = spark.createDataFrame(rows, "sheet string, row long, cells array<string>").withColumn("text", F.lit(1))
    got = {}
    for r in chunking.table_chunks(df, ["k", "v"], size, block=64).orderBy("chunk_index").collect():
        got.setdefault(r.sheet, []).append((r.text, r.row_count))
    want = {s: _packed(f"# {s or ''}", ["k", "v"], [c for t, _, c in rows if t == s], size) for s in ("a", "bb", None, "same", "long")}
    assert got == want
    assert chunking.table_chunks(df.limit(0), ["k", "v"], size).count() == 0


def test_bold_runs(spark):
    cases = {
        "**a****b****c**": "**abc**", "**a ****b**": "**a b**", "**a** **b** c": "**a b** c", "x ** ** y": "x y", "**a  ** c": "**a** c", "***a***": "**a**", "** a**": "**a**", "a **": "a",
        "a **b": "a **b", "": "", " \n ": "", "plain  text": "plain text", "****": "", "**a** b **c**": "**a** b **c**",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", S.repair_bold("t").alias("x")).collect()} == cases
    assert spark.createDataFrame([(None,)], "t string").select(S.repair_bold("t").alias("x")).first().x is None


def test_next_times_of_many_expressions(spark):
    """Parsed once a row, and a day that no month has is not looked for; the expressions agree with a walk over the days."""
    import time
    from datetime import UTC, datetime, timedelta

    from lodestone.functions.schedules import next_due

    now = 1_718_000_000
    crons = [f"{k % 60} {k % 24} {1 + k % 31} {1 + k % 12} *" for k in range(372)] + ["0 0 31 4,6 *", "0 0 30 2 1", "0 0 29 2 *", "0 0 31 4 1", "0 0 */31 2 1"]
    rows = spark.range(8_000, numPartitions=8).select("id", F.element_at(F.array(*map(F.lit, crons)), (F.col("id") % len(crons) + 1).cast("int")).alias("cron"))
    begin = time.monotonic()
    got = {r.cron: r.at for r in rows.select("cron", next_due(F.col("cron"), now).alias("at")).collect()}
    assert time.monotonic() - begin < 40

    def walked(cron):
        m, h, d, mon, w = cron.split()
        t = datetime.fromtimestamp(now, UTC).replace(hour=int(h), minute=int(m), second=0)
        for _ in range(14_700):
            on_day, on_week = d == "*" or t.day == (1 if d[0] == "*" else int(d)), w == "*" or t.isoweekday() == int(w)
            if t.timestamp() > now and t.month in map(int, mon.split(",")) and (on_day | on_week if w != "*" and d[0] != "*" else on_day & on_week):
                return int(t.timestamp())
            t += timedelta(days=1)

    assert got == {c: walked(c) for c in crons}


def test_breaks_do_not_hang_on_the_last_bit(spark):
    """A cosine of one half is no break at one half, whichever way its sums were rounded."""
    sims = [0.49999999999999994, 0.5, 0.5000000000000001, 0.49999998, 0.4999, None]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)], "doc long, pos long, sim double")
    assert [r.group for r in W.breakpoint_groups(rows, ["doc"], "pos", 0.5).orderBy("pos").collect()] == [0, 0, 0, 0, 0, 1]


def test_probing_queries_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """Copies of queries for the clusters they probe are shuffled; with fewer or all clusters the best are those of brute force, in tiles too."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0)].astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    centroids = vectors.fit_clusters(e, 12)
    vectors.write_clusters(e, str(tmp_path / "index"), centroids)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    own, near = (x.astype(float) @ centroids.T).argmax(axis=1), np.argsort(-(x.astype(float) @ centroids.T), axis=1, kind="stable")
    monkeypatch.setattr(vectors, "TILE", 700, raising=False)
    for probes in (3, 12):
        found = vectors.stored_top_k(q, str(tmp_path / "index"), 5, probes)
        want = set()
        for i in range(0, len(x), 20):
            at = np.flatnonzero(np.isin(own, near[i, :probes]))
            want |= {(i, int(j)) for j in at[np.lexsort((at, -np.round(unit[at] @ unit[i], 12)))[:5]]}
        assert {(r.query_id, r.id) for r in found.collect()} == want
        if probes == 3:
            assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_meetings_of_blocks_are_scored_in_tiles(monkeypatch):
    """A full block of copies against a full block of queries: no more scores at a time than a tile, and ties by id as before."""
    import pyarrow as pa

    x, q = np.ones((4_096, 8), np.float32), np.random.default_rng(1).normal(size=(1_024, 8)).astype(np.float32)
    cells = [8, np.arange(1_024).tobytes(), q.tobytes(), np.arange(4_096)[::-1].tobytes(), x.tobytes()]
    kinds = (pa.int32(), *[pa.binary()] * 4)
    block = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["dim", "q_ids", "q_data", "ids", "data"])
    sizes, scores = [], vectors._scores
    monkeypatch.setattr(vectors, "_scores", lambda a, b, kind: sizes.append(len(a) * len(b)) or scores(a, b, kind))
    got = [(int(a), int(b)) for o in vectors._best_of_blocks(3, "COSINE")(iter([block])) for a, b in zip(o.column(0).to_numpy(), o.column(1).to_numpy(), strict=True)]
    assert got == [(i, j) for i in range(1_024) for j in range(3)] and max(sizes) <= 1 << 19
