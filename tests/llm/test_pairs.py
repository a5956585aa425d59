"""Jaccard join, top-k search, suffix dedup and the pipeline against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import jaccard, pivots, suffixdedup
from tests.llm.cases import BASE, documents, empty

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    ids = sorted({i for i, _ in rows})
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [(i, sets(t)) for i, t in rows]
    for a, x in s:
        for b, y in s:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: top(i) for i in ids}


def edited(n, seed=3):
    """An original among copies with few words changed, so that many copies are linked through it alone."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(90)]
    out = [" ".join(words)]
    for k in range(n):
        w = words[:]
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{k}x{rng.random():.6f}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect() if r["doc_id"] is not None]
    rows += [(100 + i, t) for i, t in enumerate(edited(40))]
    df = spark.createDataFrame([(i, t, "c", "t") for i, t in [*rows, (None, BASE)]], "doc_id long, text string, class string, token string")
    got = jaccard.components(df).collect()
    want = components(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]]
    sizes = {i: len(sets(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("seeds", [6, 0])
def test_jaccard_of_families(spark, monkeypatch, seeds):
    """Copies edited, cut short or put together, of many sizes, and texts around one passage; almost without seeds, too."""
    monkeypatch.setattr(jaccard, "SEEDS", seeds)
    monkeypatch.setattr(jaccard, "FEW", 10**9 if seeds == 0 else 0)
    rng = random.Random(11)
    texts, word = [], lambda: f"w{rng.randrange(10**9)}"
    for size in (6, 12, 30, 75, 140):
        base = [word() for _ in range(size)]
        lines = [base]
        for _ in range(60):
            w = list(rng.choice(lines))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                kind, at = rng.randrange(4), rng.randrange(len(w))
                if kind == 0:
                    w[at] = rng.choice([word(), "common", base[0]])
                elif kind == 1:
                    w.insert(at, word())
                elif kind == 2 and len(w) > 5:
                    del w[at]
                else:
                    w = w[: max(5, len(w) - rng.randrange(1, 2 + len(w) // 6))]
            lines.append(w)
        texts += [" ".join(w) for w in lines]
    passage = " ".join(word() for _ in range(60))
    for _ in range(60):
        texts.append(" ".join([word() for _ in range(rng.randrange(12))]) + " " + passage + " " + " ".join([word() for _ in range(rng.randrange(12))]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = components(rows)
    assert 20 < len(set(want.values())) < len(rows) // 2 + 60
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_representatives_keep_all_columns(spark):
    texts = {1: "a b c d e f", 2: "a b c d e f", 3: "", 4: "g h i j k l m", None: "a b c d e f"}
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in texts.items()], "doc_id long, text string, _kept_id string, component_id int")
    got = jaccard.representatives(df).collect()
    assert sorted((r["doc_id"] or 0, r["_kept_id"], r["component_id"]) for r in got) == [(0, "x", 7), (1, "x", 7), (3, "x", 7), (4, "x", 7)]


def test_jaccard_finds_components_of_few_links_in_one_task(spark, monkeypatch):
    from graphloom.operators import components

    def star(*_):
        raise AssertionError("joins for a few links")

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(6)] + [(9, "other words that stand on their own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(components, "_star", star)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    monkeypatch.setattr(jaccard, "SMALL", 0)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()} == got


def test_jaccard_empty(spark):
    assert jaccard.components(empty(spark)).count() == 0


def test_prefixes_keep_every_link():
    rng = np.random.RandomState(0)
    counts = rng.randint(1, 50, 3000)
    for _ in range(200):
        n = rng.randint(1, 60)
        x = rng.choice(3000, n, replace=False)
        y = np.unique(np.r_[rng.choice(x, max(1, int(n * 0.93)), replace=False), rng.choice(3000, rng.randint(0, 3))])
        if 100 * len(set(x) & set(y)) < 80 * len(set(x) | set(y)):
            continue
        got = []
        for s in (np.sort(x), np.sort(y)):
            c = np.where(np.isin(s, np.intersect1d(x, y)), np.maximum(counts[s], 2), counts[s])
            t, _, m, _ = jaccard._prefixes(s.astype(np.uint64), np.array([0, len(s)]), c, 80)
            got.append((set(t.tolist()), int(m[0])))
        assert len(got[0][0] & got[1][0]) >= min(got[0][1], got[1][1])


def test_top_k(spark):
    rng = np.random.RandomState(1)
    vecs = [(i, [float(v) for v in rng.randn(6)]) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(150)]
    rows = vecs + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (None, [1.0] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [])]
    df = spark.createDataFrame([(i, v, "b") for i, v in rows], "vec_id long, embedding array<double>, block string")
    got = {}
    for r in pivots.top_k(df, 10, "id % 100 = 0", pivots=8, block=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vecs}
    assert set(got) == {i for i, _ in vecs if i % 100 == 0}
    for i, found in got.items():
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert pivots.top_k(df.limit(0)).count() == 0 and pivots.top_k(df.where("vec_id = 100")).count() == 0
    assert pivots.top_k(df.where("vec_id in (100, 101, 102)")).count() == 2


def test_top_k_is_exact(spark):
    """Components beyond 32 bits, products beyond 2**53 and below 0, lengths apart, and what does not fit in a long."""
    rng = random.Random(4)
    big = [2.5e6, -2.5e6, 3e9 / 1024, -3e9 / 1024, 1.0, 0.25, -7e5, 1e-9]
    other = {300: [3e9, 1.0, 0.0, 2.0], 301: [1.0, 1.0, 1.0, 1.0], 302: [-2.0, 1e3, 0.0, 0.5], 303: [0.5, -9.0, 7.0, 1.0]}
    vecs = {i: [rng.choice(big) + rng.random(), rng.random(), rng.choice([-7e4, 0.5])] for i in range(60)} | {100: [2.5e6, 1.0, 0.0], 101: [-2.5e6, 0.0, 0.0], 200: [1.0, 2.0], 201: [5.0, -1.0], 203: [2.0**-20, 9.0]} | other
    got = {}
    for r in pivots.top_k(spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>"), 10, "id % 20 = 0", pivots=4, block=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vecs.items()}
    for i in (j for j in vecs if j % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in vecs if j != i and len(whole[j]) == len(whole[i]))[:10]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert any(abs(s) > 2**53 for found in got.values() for _, _, s in found)
    with pytest.raises(OverflowError):
        pivots.top_k(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_top_k_broadcasts_no_vectors(spark):
    """Blocks of repeated vectors are small files; as broadcast tables they filled the driver."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = pivots.top_k(df, 3, pivots=4, block=8)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 9


def test_longest_previous_factors():
    rng = np.random.RandomState(0)
    for _ in range(15):
        n = rng.randint(1, 80)
        text, owner = rng.randint(0, 3, n), np.sort(rng.randint(0, 5, n))
        got = suffixdedup.longest_previous_factors(text.astype(np.int64), owner, 128)
        for i in range(n):
            best = 0
            for j in np.flatnonzero(owner < owner[i]):
                k = 0
                while i + k < n and j + k < n and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert best == got[i]


def removed(rows, width=50):
    first, out = {}, {}
    for d, x in sorted(rows):
        for i in range(len(x) - width + 1):
            first[x[i : i + width]] = min(first.get(x[i : i + width], d), d)
    for d, x in rows:
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if first[x[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        out[d] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(8)
    base = [r for r in documents(spark).collect()]
    passage = "".join(rng.choice("abcde fgh") for _ in range(140))
    extra = [(200 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 60) : rng.randint(70, 140)] + "q" * rng.randint(0, 80)) for i in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in base] + extra
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, part int")
    got = suffixdedup.digests(suffixdedup.repeated_spans(df)).collect()
    assert len(got) == len(rows)
    want = removed([(i, (t or "").encode()) for i, t in rows if i is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert suffixdedup.digests(suffixdedup.repeated_spans(empty(spark))).count() == 0
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(suffixdedup.kept_digests(df).collect()) == key(got) and suffixdedup.kept_digests(empty(spark)).count() == 0
    assert key(suffixdedup.without_repeats(df).collect()) == key(suffixdedup.kept_texts(suffixdedup.repeated_spans(df)).collect())


def test_suffix_dedup_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "TEXT_BYTES", 300)
    rows = [(i, t) for i, t in enumerate(edited(25, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed([(i, t.encode()) for i, t in rows])
    for r in suffixdedup.digests(suffixdedup.repeated_spans(df)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    with pytest.raises(ValueError):
        suffixdedup.repeated_spans(df, width=5)


def test_suffix_dedup_of_a_crowded_anchor(spark, monkeypatch):
    """Many texts that go on differently after one passage, their windows dealt one by one."""
    monkeypatch.setattr(suffixdedup, "MANY", 3)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + passage + "".join(rng.choice("uv") for _ in range(60))) for i in range(80)]
    want = removed([(i, t.encode()) for i, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffixdedup.digests(suffixdedup.repeated_spans(df)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_suffix_dedup_of_one_id_with_two_texts(spark):
    passage = "a passage that the least document has and both texts of another, too, "
    rows = [(1, passage), (5, passage + "one end"), (5, passage + "another end"), (5, passage + "one end")]
    got = suffixdedup.digests(suffixdedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == sorted((i, len(t), 0 if i == 1 else len(passage)) for i, t in rows)


def test_suffix_dedup_of_long_plain_texts(spark):
    """Texts of one letter, where each window is a fragment of its own."""
    rows = [(1, "a" * 400_000), (2, "a" * 300_000 + "b"), (3, "ab" * 100_000 + "a" * 60), (4, "ab" * 40)]
    got = suffixdedup.digests(suffixdedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (0, 0), 2: (300_000, 1), 3: (60, 1), 4: (80, 1)}


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(now)
        if name != "packing":
            assert set(now.columns) == set(corpus_pipeline.COLUMNS)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    rows = [(r["doc_id"], r["text"]) for r in seen[0].collect() if r["doc_id"] is not None]
    comp = components(rows)
    assert ids(seen[1]) == sorted(i for i, c in comp.items() if i == c)
    assert set(ids(seen[2])) <= set(ids(seen[1])) and set(ids(seen[3])) == set(ids(seen[2]))
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())


def test_pipeline_keeps_rows_that_repeats_empty(spark):
    one, two = "the first passage, which is long enough to count as one " * 2, "another passage of the same kind, shared by later documents. "
    texts = {1: one + two, 2: two, 3: one, 4: "", 5: two + "and a few words of its own", 6: one + two + one}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {}
    for i, t in texts.items():
        gone = set()
        for p in range(len(t) - 49):
            if any(t[p : p + 50] in other for j, other in texts.items() if j < i):
                gone.update(range(p, p + 50))
        want[i] = "".join(c for p, c in enumerate(t) if p not in gone)
    assert want[2] == want[3] == ""
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline_on_nothing(spark, tmp_path):
    empty(spark).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pivot_sample_is_small_before_it_is_sorted(spark, monkeypatch):
    """What may be sent for the sample does not grow with the rows, and the rows taken are the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pivots, "PIVOT_ROWS", 50)
    rows = spark.range(5000).select("id")
    order = lambda df: [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    few = pivots._least(rows, 5000)
    assert few.count() < 400 and order(few) == order(rows)
    same = spark.range(5000).select(F.lit(7).cast("long").alias("id"))
    assert pivots._least(same, 5000).count() == 5000
