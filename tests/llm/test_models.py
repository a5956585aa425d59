"""Language model, toxicity, URL rules and HTML extraction."""

import collections
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import catalog, htmltemplates, languagemodel, toxicity, urlrules
from tests.llm.cases import documents, empty


def test_lm_base_and_score(spark):
    rows = languagemodel.score(documents(spark)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)) + ["\0end"]) for r in documents(spark).collect()]
    counts = collections.Counter()
    for i, w in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert languagemodel.score(empty(spark)).count() == 0


def _lm_rows():
    rng = np.random.RandomState(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[int(min(39, rng.exponential(6)))] for _ in range(rng.randint(0, 30)))) for i in range(150)]
    return [*rows, *[(None, "w1 w2 " * k) for k in range(20)], (3, "a second text of one id"), (7, None)]


def test_lm_score_by_brute_force(spark):
    """The same model from dictionaries: counts, held-out counts, expectation-maximisation by bucket, probabilities."""
    docs = [(i, [None, *re.findall(r"[^\x20\x09-\x0D]+", t or ""), None]) for i, t in _lm_rows()]  # None starts and ends a text
    train = [(i, w) for i, w in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    apart = [bool(languagemodel.held_out(np.array([i]))[0]) for i, _ in train]
    assert any(apart) and not all(apart)

    def count(which):
        word, pair = collections.Counter(), collections.Counter()
        for _, w in which:
            word.update(w[1:])
            pair.update(zip(w, w[1:]))
        return word, pair, sum(word.values())

    word, pair, n = count(train)
    part, part_pair, m = count([d for d, h in zip(train, apart) if not h])
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    step, size = languagemodel.STEP, len(word) + 1
    told = collections.Counter()
    for (_, w), h in zip(train, apart):
        for v, x in zip(w, w[1:]) if h else ():
            log = lambda c, of: round((math.log(c) - math.log(of) + math.log(size)) / step) if c else None
            told[bucket(part[v]), log(part_pair[v, x], part[v]) if part[v] else None, log(part[x], m)] += 1

    def learn(cells):
        w = [0.4, 0.4, 0.2]
        for _ in range(languagemodel.ROUNDS):
            total = [0.1] * 3
            for (_, a, b), k in cells.items():
                p = [w[0] * (math.exp(a * step) if a is not None else 0), w[1] * (math.exp(b * step) if b is not None else 0), w[2]]
                total = [t + k * q / sum(p) for t, q in zip(total, p)]
            w = [t / sum(total) for t in total]
        return w

    weights = {b: learn({c: k for c, k in told.items() if c[0] == b}) for b in {c[0] for c in told}}
    every = learn(told)
    want = []
    for i, w in docs:
        total = 0
        for v, x in zip(w, w[1:]):
            b = bucket(word[v])
            a2, a1, a0 = weights.get(b, every)
            if b == 0:
                a2, a1, a0 = 0, a1 / (a1 + a0), a0 / (a1 + a0)
            total += math.log10((a2 * pair[v, x] / word[v] if word[v] else 0) + a1 * word[x] / n + a0 / size)
        want.append((i is None, i or 0, round(total, 6)))
    got = languagemodel.score(spark.createDataFrame(_lm_rows(), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in got) == sorted(want)


def test_lm_scores_do_not_depend_on_settings(spark, monkeypatch):
    df, found, before = spark.createDataFrame(_lm_rows(), "doc_id long, text string"), set(), spark.conf.get("spark.sql.shuffle.partitions")
    for n, size in ((1, 8_000_000), (4, 8_000_000), (11, 8_000_000), (2, 500)):
        monkeypatch.setattr(languagemodel.P, "PART_BYTES", size)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(tuple(sorted((str(r["doc_id"]), r["n_tokens"], r["base_score"], r["score"]) for r in languagemodel.score(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_lm_weights_explain_held_out_counts():
    w = languagemodel.learn_weights(np.array([[3, 120, 40, 90], [3, -1000000, 40, 10], [0, -1000000, 20, 5]]))
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.5 and w[0, 0] == 0
    assert np.allclose(languagemodel.learn_weights(np.zeros((0, 4))).sum(1), 1)


def test_lm_probabilities_sum_to_one():
    w = languagemodel.Weights(languagemodel.learn_weights(np.zeros((0, 4))), 10, 4)
    word, pair = np.array([4, 3, 2, 1, 0]), np.array([2, 1, 0, 0, 0])
    assert w.probabilities(pair, np.full(5, 3), word).sum() == pytest.approx(1)
    assert w.probabilities(np.zeros(5), np.zeros(5), word).sum() == pytest.approx(1)


def _bags(n, seed):
    rng = np.random.RandomState(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(rng.randint(1, 9))]
        bad = i % 5 == 0
        if bad:
            sentences[rng.randint(len(sentences))] += " " + rng.choice(["grumbler", "grumbling", "nitwit"])
        out.append((". ".join(sentences) + ".", int(bad)))
    return out


def test_toxicity_finds_documents_and_sentences(spark):
    train, held = _bags(600, 1), _bags(200, 2)
    m = toxicity.fit(pa.array([t for t, _ in train]), np.array([y for _, y in train]))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, m).collect()}
    assert np.mean([got[i] == y for i, (_, y) in enumerate(held)]) > 0.97
    bad = toxicity.offending_sentences(df, m).collect()
    assert bad and np.mean([bool(re.search("grumbl|nitwit", r["sentence"])) for r in bad]) > 0.97
    for r in bad[:5]:
        assert held[r["doc_id"]][0][r["start"] : r["end"]] == r["sentence"]


def test_toxicity_scores_by_brute_force():
    """Sentence by sentence: the chance that none offends, less what clean sentences add, or the strongest sentence alone."""
    train = _bags(400, 1)
    m = toxicity.fit(pa.array([t for t, _ in train]), np.array([y for _, y in train]))
    weight = dict(zip(m.keys.tolist(), m.weights.tolist()))
    texts = [t for t, _ in _bags(60, 4)] + ["", "one", "grumbling. nitwit! grumbler?\n" * 3]
    got = m.scores(toxicity.Sentences(pa.array(texts)))
    for text, score in zip(texts, got):
        s, logit = toxicity.Sentences(pa.array([text])), collections.Counter()
        for h in s.features():
            for place, key in zip(s.sentence.tolist(), h.tolist()):
                logit[place] += weight.get(key, 0.0)
        clean = [1 / (1 + math.exp(logit[k] + m.bias)) for k in range(len(s.heads))]
        spared = math.prod(c * math.exp(toxicity.MARGIN * m.plain) for c in clean)
        assert score == pytest.approx(1 - min([spared, *clean]) if clean else 0.0, abs=1e-9)
    assert got[-1] > 0.9 > got[-2]


def test_toxicity_long_clean_texts_stay(spark):
    train = _bags(600, 1)
    m = toxicity.fit(pa.array([t for t, _ in train]), np.array([y for _, y in train]))
    clean = " ".join(t for t, y in _bags(500, 3) if not y)
    clean *= 5_000_000 // len(clean)
    df = spark.createDataFrame([(1, clean), (2, clean + " w1 w2 grumbling w3.")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(df, m).collect()} == {1: 0, 2: 1}
    assert [r["doc_id"] for r in toxicity.keep(df, m).collect()] == [1]


def test_toxicity_learns_from_long_rows(spark):
    rows = [(i, ("grumbler. " if i % 2 else "") + f"w{i} and so on. " * 10_000) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels)
    assert len(m.keys) and {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, m).collect()} == {i: i % 2 for i in range(12)}
    assert toxicity.learn(docs, labels, max_bytes=1).bias < -20  # one text, so one label


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.learn(documents(spark), labels)
    rows = toxicity.score(documents(spark), m).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 7))
    assert toxicity.learn(empty(spark), labels).bias < -20 and toxicity.score(empty(spark), m).count() == 0
    assert toxicity.keep(documents(spark), toxicity.Model()).count() == 15


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_html(spark):
    rows = []
    for i in range(8):
        rows.append((i, "http://a.example/x", page(f"<nav><ul><li><a>n{i}</a></li></ul></nav><div class='ad'>buy {i}</div><article><h1>T{i} &amp; more</h1><p>one\n  <b>two</b><p>three&nbsp;{i}<div class='comments'><p>c</p></div></article><footer>f</footer>")))
    rows += [(20, None, page("<main><p>x<br>y</p><form>q</form></main>")), (21, "http://b.example", None), (22, "no scheme", ""), (0, rows[0][1], rows[0][2]), (None, "http://a.example/z", page("<article><p>unclosed <i>tag</article"))]
    rows += [(30 + i, "http://plain.example/", page(f"<div class='menu'>m</div><div>Same words</div><div>own {i}</div><script>s</script>")) for i in range(6)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in htmltemplates.extract(df).collect()}
    assert got[3] == "T3 & more\none two\nthree 3" and got[20] == "x y" and got[21] == "" and got[22] == ""
    assert got[None] == "unclosed tag" and got[32] == "own 2"
    assert htmltemplates.extract(df).count() == len(rows) and htmltemplates.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<!", "<p><b>", "</x>", "<div></p>", "<a '\">", "<td><b></i>", "<?", "<script", "&amp;<", "<li class='a b c'>x"])
def test_html_takes_time_in_proportion_to_length(piece):
    began = time.perf_counter()
    p = htmltemplates.Page("<p>start</p>" + piece * (500_000 // len(piece)))
    assert p.text(set()).startswith("start") and p.tokens()
    assert time.perf_counter() - began < 20  # a quadratic scan of half a megabyte takes hours


def test_html_comment_without_end():
    assert htmltemplates.Page("<p>a</p><!-- b <i>c</i> d").text(None) == "a" == htmltemplates.Page("<p>a</p><!-- b").text(None)
    assert htmltemplates.Page("<p>a</p><!-- b --> c <d").text(None) == "a\nc"


def test_html_names_do_not_cut_the_article():
    def text(body):
        return htmltemplates.Page(page(body)).text(None)

    story = "<article><h1>T</h1><p>words of it</p></article>"
    for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<div class='layout with-sidebar'>{}</div>", "<div class='sidebar'>{}</div>", "<div id='search'><div>{}</div></div>", "<form>{}</form>"):
        assert text(wrap.format(story) + "<div class='sidebar'><p>other</p></div><footer>f</footer>") == "T\nwords of it", wrap
    assert text("<article class='post has-comments'><p>x</p></article>") == "x" == text("<article class='promo'><p>x</p></article>")
    for mark in ("id='discussion'", "class='discussion'", "class='legal'", "id='related'", "class='related'"):
        assert text(f"<article><p>x</p><section {mark}><h2>More</h2><p>y</p></section></article>") == "x\nMore\ny", mark
    assert text("<article><p>x</p><section class='related'><p><a>l</a></p></section><div class='comments'>c</div><span class='ad'>a</span></article>") == "x"
    assert text(story + "<div class='related'><article>teaser</article></div>") == "T\nwords of it"
    assert text("<div class='menu'><p>a text without an article</p></div><div class='menu'><a>l</a></div>") == "a text without an article"


def test_html_template_decides(spark):
    note = "All of this is printed again and again by the same people at the same place. " * 5
    a = [(i, "http://a.example/", page(f"<article id='post-{i}'><h1>Title {i}</h1><div class='x'>{note}</div><p>own <b>text</b> {i}.</p><p><a>Print this page on your printer</a> on day {i}</p><span>More</span><p>Read on</p><h2>Tools</h2></article>")) for i in range(8)]
    plain = [(20 + i, "http://b.example/", page(f"<div class='x1'><ul><li><a>to {i}</a></li><li><a>and {i + 1}</a></li></ul></div><div class='y'>{note}<p>story {i} with a <a>link</a></p></div>")) for i in range(8)]
    copies = [(40 + i, "http://c.example/", page("<article><p>one story in many copies</p></article>")) for i in range(12)]
    df = spark.createDataFrame(a + plain + copies, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltemplates.extract(df).collect()}
    assert got[3] == "Title 3\nown text 3.\non day 3\nRead on" and got[23] == "story 3 with a link" and got[41] == "one story in many copies"


def test_html_main_slot_of_a_template(spark):
    """Names that say nothing: where most text of the host's pages lies decides, and without the template it does not."""
    rng = np.random.RandomState(3)
    say = lambda n: " ".join(f"w{k}" for k in rng.randint(0, 900, n))
    rows = []
    for i in range(9):
        side = "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(6))
        rows.append((i, "http://s.example/", page(f"<div class='q1'><ul>{side}</ul></div><div class='q2'><div class='q3'><h2>{say(4)}</h2><div>{say(40)}</div><div>{say(30 * (i + 1))}</div></div><div class='q4'>{say(9)}</div></div><div class='q5'>{say(7)}</div>")))
    got = {r["page_id"]: r["text"] for r in htmltemplates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        want = "\n".join(re.findall(r"<h2>(.*?)</h2><div>(.*?)</div><div>(.*?)</div>", html)[0])
        assert got[i] == want != htmltemplates.Page(html).text(None)
    t = {r["host"]: r["slot"] for r in htmltemplates.deduce(spark.createDataFrame([("s", h) for _, _, h in rows], "host string, html string")).collect()}
    assert t["s"] == htmltemplates._hash("/html/body/div.class=q2 div class=q3")


def test_html_classes_pair_starts_and_ends(spark):
    df = spark.createDataFrame([("a", page(f"<div class='x'><article>{i}</article><section>")) for i in range(8)], "host string, html string")
    t = {r["host"]: set(r["template"]) for r in htmltemplates.deduce(df).collect()}["a"]
    assert htmltemplates._hash("/html/body/div.class=x article") in t and htmltemplates._hash("/html/body/div.class=x/article /article") in t
    assert htmltemplates._hash("/html/body/div.class=x section") not in t and htmltemplates._hash("/html/body div class=x") not in t


def test_html_template_groups_tokens(spark):
    df = spark.createDataFrame([("a", page(f"<article><h1>{i}</h1>{'<p>x</p>' * (i + 1)}</article>")) for i in range(6)], "host string, html string")
    t = {r["host"]: set(r["template"]) for r in htmltemplates.deduce(df).collect()}
    assert htmltemplates._hash("/html/body article") in t["a"] and htmltemplates._hash("/html/body/article/p /p") in t["a"]


def test_url_rules(spark):
    urls = [("http://Shop.Example.org/es/1?x=1", "shop.example.org", "/es/1", "example.org/es/", "block"), ("https://a.org/p", "a.org", "/p", "org/", "allow"), ("http://x.com/fr/9#t", "x.com", "/fr/9", "com/fr/", "allow"), ("http://x.com/de/9", "x.com", "/de/9", "com/de/", "block"), ("http://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"), ("ftp.example.org", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://notorg/", "notorg", "/", None, "allow"), ("http://a.org", "a.org", "", None, "allow")]
    df = spark.createDataFrame([(i, u[0], "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = urlrules.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {r["page_id"]: r for r in urlrules.judge(df, rules, catalog.URL_RULES).collect()}
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == u[1:]
    assert urlrules.judge(df.limit(0), rules, catalog.URL_RULES).count() == 0


def test_url_mining_needs_the_same_count_at_every_size(spark):
    bad = [(f"http://spam.example.net/win/{i}", True) for i in range(30)]
    for n in (200, 40_000):
        good = spark.range(n).selectExpr("concat('http://good', id % 7, '.example.org/news/', id) as url", "false as bad")
        rules = urlrules.mine(spark.createDataFrame(bad, "url string, bad boolean").union(good))
        assert any("path=win" in r["tokens"] for r in rules.collect()), n
    few = spark.createDataFrame(bad[:24] + [("http://a.org/", False)] * 50, "url string, bad boolean")
    assert urlrules.mine(few).count() == 0


def test_url_mining_by_brute_force(spark):
    """All token combinations counted one by one, then the rules matched with all urls, by either form of the index."""
    rng = np.random.RandomState(7)
    rows = []
    for i in range(300):
        host, word, name = rng.choice(["a.x.org", "b.x.org", "c.net"]), rng.choice(["win", "news", "free", str(i)]), rng.choice(["", "?ref=1", "?id=2#t"])
        rows.append((f"http://{host}/{word}{name}", bool(rng.rand() < 0.15 + 0.5 * (word == "win") + 0.3 * (host == "c.net" and name == "?ref=1"))))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {r["url"]: frozenset(r["t"]) for r in df.select("url", urlrules.tokens_of(df["url"]).alias("t")).distinct().collect()}
    held, wrong = collections.Counter(), collections.Counter()
    for url, bad in rows:
        for n in range(1, len(tokens[url]) + 1):
            for some in itertools.combinations(sorted(tokens[url]), n):
                held[some] += 1
                wrong[some] += bad
    need = max(0.5, 1.5 * sum(b for _, b in rows) / len(rows))
    good = {t: wrong[t] / held[t] for t in held if wrong[t] >= 10 and wrong[t] / held[t] >= need}
    want = {t: c for t, c in good.items() if not any(set(f) < set(t) and good[f] >= c for f in good)}
    rules = urlrules.mine(df, min_count=10, min_confidence=0.5)
    assert len(want) > 3 and {tuple(r["tokens"]): pytest.approx(r["confidence"]) for r in rules.collect()} == want
    for small in (100, 0):
        got = {r["url"]: (tuple(r["mined"]), r["confidence"]) for r in urlrules.match(df, rules, small=small).collect()}
        assert set(got) == {u for u, t in tokens.items() if any(set(w) <= t for w in want)}
        assert all(set(m) <= tokens[u] and c == pytest.approx(max(want[w] for w in want if set(w) <= tokens[u])) for u, (m, c) in got.items())


def test_url_mining_and_matching(spark):
    rows = [(f"http://spam{i % 3}.example.net/win/{i}?ref=a", True) for i in range(60)] + [(f"http://good{i % 7}.example.net/news/{i}", i % 20 == 0) for i in range(200)] + [("x://y", None)]
    rules = urlrules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    mined = rules.collect()
    assert any(r["tokens"] == ["path=win"] for r in mined) and all(r["confidence"] >= urlrules.MIN_CONFIDENCE for r in mined)
    tests = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[:-1])] + [(999, rows[0][0])], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in urlrules.judge(tests, rules, []).collect()}
    found = {r["page_id"]: set(r["t"]) for r in tests.select("page_id", urlrules.tokens_of(tests["url"]).alias("t")).collect()}
    for i, t in found.items():
        assert (got[i][0] == "block") == any(set(r["tokens"]) <= t for r in mined)
