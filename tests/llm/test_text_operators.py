"""URL filter, toxicity, language model, HTML text and decontamination."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from surveyspark.llm import decontaminate, html_text, lm_score, toxicity, url_filter

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --------------------------------------------------------------------- URL filter


def brute_url(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate(str.maketrans(url_filter._UPPER, url_filter._UPPER.lower()))
    fits = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a=1#b", "https://example.com/en/",
    "https://example.com/en", "https://notexample.com/en/1", "http://a.net/es/1", "http://net/fr/1",
    "http://a.net/de/1", "http://x.org/en/1?a=1&b=2", "http://com", "http://com/", "x://y://z.com/en/",
    "http://É.com/É?é", "http://a.com?x=/en/", "http://a.net#/es/", "http://" + "a" * 5000 + ".org/" + "1" * 5000,
    "http://a.org/en/\nline", "http://example.com/en/1", "http://example.com/en/1",
]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x", "x") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    tiny = spark.read.parquet(f"{TINY}/pages.parquet")
    for source in (pages, tiny):
        got = {r["page_id"]: r for r in url_filter.judge(source).collect()}
        for r in source.collect():
            host, path, rule, action = brute_url(r["url"])
            found = got[r["page_id"]]
            assert (found["host"], found["path"], found["rule"]) == (host, path, rule)
            assert found["verdict"] in ("allow", "block") and (action is None or found["verdict"] == action)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(3)

    def make(bad):
        name = "".join(rng.choice("abcdefgh") for _ in range(8))
        if bad:
            return f"http://{name}{rng.randint(1000, 9999)}.org/{rng.randint(10**6, 10**7)}?a=1&b=2&c={rng.randint(0, 9)}"
        return f"http://{name}.org/news/{name}"

    rows = [(k, make(k % 2), float(k % 2)) for k in range(600)]
    train = spark.createDataFrame([r[1:] for r in rows[:400]], "url string, label double")
    pages = spark.createDataFrame([r[:2] for r in rows[400:]], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, train, rules=(("allow", "com/"),)).collect()}
    right = sum(got[k] == ("block" if label else "allow") for k, _, label in rows[400:])
    assert right >= 195
    one = train.filter("label = 1")
    assert {r["verdict"] for r in url_filter.judge(pages, one, rules=(("allow", "com/"),)).collect()} == {"block"}
    none = url_filter.judge(pages, train.limit(0), rules=(("allow", "com/"),)).collect()
    assert {r["verdict"] for r in none} == {"allow"}


def test_entropy_and_counts(spark):
    pages = spark.createDataFrame([(0, "http://a.b.org/aab/1?x=1&y=2#f")], "page_id long, url string")
    row = url_filter.lexical(url_filter.split_url(pages)).first()
    url = row["url"]
    share = np.array(list(Counter(url).values())) / len(url)
    assert math.isclose(row["entropy"], -(share * np.log2(share)).sum())
    assert (row["depth"], row["params"], row["labels"], row["digits"]) == (2, 2, 3, 3 / len(url))


# ----------------------------------------------------------------------- toxicity


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_on_sample(docs, labels)
    held = labels.filter(toxicity.fold() == 0).select("doc_id", "toxic")
    rows = toxicity.scores(docs, model).join(held, "doc_id").collect()
    wrong = sum((r["score"] >= 0.5) != (r["toxic"] == 1) for r in rows)
    assert len(rows) > 500 and wrong / len(rows) < 0.02


def test_score_needs_the_text_only(spark, frame, edge_rows, clash):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on_sample(docs, labels)
    some = docs.filter("doc_id < 50")
    moved = some.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    one = {r["doc_id"]: r["score"] for r in toxicity.scores(some, model).collect()}
    two = {r["doc_id"] - 7: r["score"] for r in toxicity.scores(moved, model).collect()}
    assert len(one) == 50
    assert all(math.isclose(one[k], two[k], rel_tol=1e-4) for k in one)
    edge = clash(frame(edge_rows))
    rows = toxicity.scores(edge, model).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.reject(edge, model)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["score"] < 0.5)
    assert toxicity.scores(edge.limit(0), model).count() == 0


def test_long_labelled_texts_are_fitted(spark, frame):
    """All labelled texts have more than 50,000 characters."""
    kinds = ["maple", "birch", "cedar"], ["viper", "adder", "cobra"]
    rows = [(k, " ".join(kinds[k % 2][w % 3] * 200 + str((w * 7 + k) % 50) for w in range(51))) for k in range(120)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t in rows) > 50_000
    model = toxicity.fit_on_sample(frame(rows), labels)
    found = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scores(frame(rows), model).collect()}
    assert all(found[k] == (k % 2 == 1) for k, _ in rows)


def test_all_labelled_rows_are_fitted_part_by_part(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    usable = labels.filter("toxic IN (0, 1)").filter(toxicity.fold() != 0)
    marked = toxicity._marked(docs.select("doc_id", "text"), usable)
    assert usable.join(docs, "doc_id").join(marked, "doc_id", "left_anti").count() == 0
    assert marked.count() < 1.1 * usable.count()
    ids = [(part, len(texts), ends) for part, texts, _, ends in toxicity._parts(
        [pd.DataFrame({"part": [0] * 40 + [2] * 3, "text": ["x" * 1_000_000] * 43, "toxic": 0})])]
    assert ids == [(0, 16, False), (0, 16, False), (0, 8, True), (2, 3, True)]
    one, two = (toxicity.fit_on_labels(docs, labels, part_rows=100) for _ in range(2))
    assert one == two  # the mean of the parts does not depend on the order they come in


def test_labelled_texts_are_shuffled_once(spark):
    """The same rows as a join by id, null and repeated ids included, with no text in a second exchange."""
    rows = [(k if k % 11 else None, f"text {k} " + "w " * (k % 7)) for k in range(300)] + [(5, "again"), (5, "again"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usable = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 3)] + [(5, 1)], "doc_id long, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity._labelled(docs, usable, 4).sortWithinPartitions("part", "spot", "text")
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = docs.join(usable, "doc_id").select("doc_id", "text", "toxic")
        assert sorted(got.select("doc_id", "text", "toxic").collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1, plan


def test_changes_are_averaged_over_the_parts_that_met_a_bucket():
    model = toxicity.initial()
    local = [toxicity.Descent(model, 0.5, k) for k in range(2)]
    for texts, d in zip((["alpha beta", "gamma"], ["alpha", "delta"]), local):
        d.passes(texts, np.array([1, 0], np.float32), [0.01, 0.01])
    frame = pd.concat([d.changes(model, k) for k, d in enumerate(local)]).sort_values(["piece", "part"])
    moved = toxicity._moved(model, pd.concat(list(toxicity._averaged([frame]))).to_dict("records"))
    met = np.stack([d.met for d in local])[..., None]
    assert ((met > 0).sum(axis=0) == 2).any() and ((met > 0).sum(axis=0) == 1).any()
    change = sum((d.model["table"] - model["table"]) * m for d, m in zip(local, met)) / np.maximum(met.sum(axis=0), 1)
    assert np.allclose(moved["table"], model["table"] + change, atol=1e-6)
    assert np.allclose(moved["bias"], sum(d.model["bias"] for d in local) / 2, atol=1e-6)


def test_labels_of_one_kind_or_none(spark, frame, edge_rows):
    docs = frame(edge_rows)
    schema = "doc_id long, quality int, toxic int"
    for rows, want in (([], 0.0), ([(k, 0, 1) for k in range(20)], 1.0), ([(None, 1, 1), (4, 1, None)], 0.0)):
        model = toxicity.fit_on_sample(docs, spark.createDataFrame(rows, schema))
        assert {r["score"] for r in toxicity.scores(docs, model).collect()} == {want}


def test_words_have_the_same_buckets_in_any_company():
    one = toxicity.word_buckets(["", "a", "abcd", "abcdefgh", "ünï"])
    two = toxicity.word_buckets(["abcdefgh", "zz", "abcd", "ünï"])
    assert (one[3] == two[0]).all() and (one[2] == two[2]).all() and (one[4] == two[3]).all()
    assert one[2, 1] == one[3, 1] and (one[1, 1:] == 0).all()


def test_url_verdicts_of_rows_held_out(spark):
    """Labels by host suffix and digits, one in twenty turned; learned from half of the URLs."""
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        suffix, digits = rng.choice(["org", "info", "shop", "dev"]), rng.randint(0, 9)
        label = int(suffix == "shop" or (suffix == "info" and digits > 4))
        url = f"http://h{rng.randint(0, 400)}.{suffix}/{'p/' * rng.randint(0, 3)}{'7' * digits}x"
        rows.append((k, url, label, 1 - label if rng.random() < 0.05 else label))
    urls = spark.createDataFrame(rows, "page_id long, url string, truth int, label int")
    got = url_filter.judge(urls.filter("page_id % 2 = 0"), urls.filter("page_id % 2 = 1").select("url", "label"), rules=())
    truth = {r[0]: r[2] for r in rows}
    right = [(r["verdict"] == "block") == bool(truth[r["page_id"]]) for r in got.collect()]
    assert len(right) == 1500 and sum(right) >= 0.95 * len(right)


def test_shares_leave_a_rows_own_label_out(spark):
    rows = [("u1", 1.0, "a", "x.a"), ("u2", 0.0, "a", "y.a"), ("u3", 1.0, "b", "x.b")]
    labelled = spark.createDataFrame(rows, "url string, label double, _last string, _two string")
    got = {r["url"]: r["share_last"] for r in url_filter.with_shares(labelled, labelled, 0.5, 2.0, own=True).collect()}
    assert got == {"u1": 1.0 / 3, "u2": 2.0 / 3, "u3": 0.5}


# ----------------------------------------------------------------- language model


def lm_tokens(text):
    lowered = (text or "").translate(str.maketrans(url_filter._UPPER, url_filter._UPPER.lower()))
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def brute_base(rows):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    seen = Counter(w for i, t in rows if not fold(i) for w in lm_tokens(t))
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, t in rows:
        own = lm_tokens(t)
        score = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, fold(i), len(own), sum(seen[w] > 0 for w in own), n, score))
    return out


def same_base(found, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for got, expect in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert got[:5] == expect[:5] and math.isclose(got[5], expect[5], rel_tol=1e-9)


@pytest.mark.parametrize("chunk", [1_000_000, 5_000])
def test_base_scores_match_brute_force(spark, frame, edge_rows, clash, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    tiny = spark.read.parquet(f"{TINY}/documents.parquet")
    for source in (tiny, clash(frame(edge_rows))):
        rows = [tuple(r) for r in source.select("doc_id", "text").collect()]
        found = lm_score.lm_scores(source)
        same_base([tuple(r) for r in found.select(*names).collect()], brute_base(rows))
    assert lm_score.lm_scores(tiny.limit(0)).count() == 0


def test_model_is_a_mixture_that_beats_the_base(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lm_score.lm_scores(docs).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.05 * abs(sum(r["base_score"] for r in rows))


def test_weights_reach_the_best_likelihood(spark):
    rng = np.random.default_rng(1)
    two, one = rng.random(4000) * (rng.random(4000) < 0.5), rng.random(4000) * 0.01
    events = spark.createDataFrame(
        pd.DataFrame({"bucket": 3, "n": 1.0, "two": two, "one": one}), "bucket int, n double, two double, one double")
    weights = lm_score.learn_weights(events, 999)
    parts = np.stack([two, one, np.full(4000, 0.001)], 1)
    best = np.log(parts @ weights[3]).sum()
    for a in np.linspace(0.01, 0.98, 40):
        for b in np.linspace(0.01, 0.99 - a, 20):
            assert np.log(parts @ [a, b, 1 - a - b]).sum() <= best + 1.0
    assert np.allclose(weights.sum(axis=1), 1.0) and (weights[0, 0], weights[5].tolist()) == (0.0, weights[3].tolist())
    none = lm_score.learn_weights(events.limit(0), 999)
    assert np.allclose(none[4], 1 / 3) and np.allclose(none[0], [0, 0.5, 0.5])


def brute_mixture(rows):
    """The model from plain counts: every training token an event without its own document,
    in the bucket of its context, and expectation maximisation over the single events."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    grams = lambda own: list(zip(["<start>", *own], own))
    texts = [(i, lm_tokens(t), fold(i)) for i, t in rows]
    one, two = Counter(), Counter()
    for _, own, out in texts:
        if not out:
            one.update(own)
            two.update(grams(own))
    starts = sum(not out for _, _, out in texts)
    tokens, words = sum(one.values()), len(one)
    bucket = lambda c: min(int(math.log2(c)) + 1, lm_score.BUCKETS - 1) if c > 0 else 0
    events = {}
    for _, own, out in texts:
        if out:
            continue
        mine, pairs = Counter(own), Counter(grams(own))
        for before, word in grams(own):
            context = starts - 1 if before == "<start>" else one[before] - mine[before]
            chance = (two[before, word] - pairs[before, word]) / context if context else 0.0
            events.setdefault(bucket(context), []).append((chance, (one[word] - mine[word]) / max(tokens - len(own), 1)))
    weights = {}
    for b, found in [*events.items(), ("all", sum(events.values(), [])), ("none", sum(events.values(), []))]:
        parts = np.column_stack([np.array(found), np.full(len(found), 1 / (words + 1))])
        free = [1, 2] if b in (0, "none") else [0, 1, 2]
        w = np.zeros(3)
        w[free] = 1 / len(free)
        for _ in range(3000):
            share = parts * w
            now = (share / share.sum(1, keepdims=True)).sum(0)
            now[free] += 0.5
            w, last = now / now.sum(), w
            if np.abs(w - last).max() < 1e-7:
                break
        weights[b] = w
    out = {}
    for i, own, _ in texts:
        total = 0.0
        for before, word in grams(own):
            context = starts if before == "<start>" else one[before]
            b = bucket(context)
            w = weights.get(b, weights["all" if b else "none"])
            total += math.log10(w @ [two[before, word] / context if context else 0.0, one[word] / tokens, 1 / (words + 1)])
        out[i] = total
    return out


def test_mixture_scores_match_brute_force(spark):
    """All but for the cells in which events are counted together."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet").filter("length(text) < 3000")
    want = brute_mixture([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for r in lm_score.lm_scores(docs).collect():
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=2e-3), r


def test_packed_integers_come_back():
    for values in ([], [0], [1, 2, 3], [2**64 - 1, 0, 7], list(range(1000))):
        array = np.array(values, np.uint64)
        assert lm_score.unpack(lm_score.pack(array)).tolist() == array.tolist()


# ---------------------------------------------------------------------- HTML text


ARTICLE = "<p>Some text, with words. More of it; yes.</p><p>Short.</p>"
PAGES = [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p></p>", ""),
    (f"<html><body><article><h1>Title</h1>{ARTICLE}</article></body></html>", "Title\nSome text, with words. More of it; yes.\nShort."),
    ("<article><p><b>One.<br><p>Two &amp;amp; three&nbsp;&lt;b&gt; &am", "One.\nTwo &amp; three <b> &am"),
    (f"<nav><a href=x>Home</a></nav><header>Site</header><div id=main>{ARTICLE}</div><aside>More, more. More.</aside>"
     "<div class='cookie-notice'>We use cookies, yes. Really.</div><form><p>Name, please.</p></form>"
     "<section class='comments'><p>Nice, very nice. I like it.</p></section><footer>&copy; x</footer>",
     "Some text, with words. More of it; yes.\nShort."),
    ("<article><script>var t='</p><p>no</p>';</script><style>p{}</style><p>a <i>b</i><span>c</span>\n d</p><ul><li>x<li>y</ul>"
     "<div class=ad>Buy, now. Now.</div><p>end</article><p>after</p>", "a bc d\nx\ny\nend"),
    ("<article><p>unclosed <b>tag", "unclosed tag"),
    ("<article>" + "<p>Line, of text.</p>" * 5000 + "</article>", "\n".join(["Line, of text."] * 5000)),
]


def test_pages(spark):
    rows = [(k, f"http://{k}", h, "x") for k, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[4:5], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(pages).collect())
    assert got == sorted([(k, t) for k, (_, t) in enumerate(PAGES)] + [(4, PAGES[4][1])])
    assert html_text.extract(pages.limit(0)).count() == 0


LONG = "This is a long paragraph, with several clauses; it has commas, and it goes on for a while. It ends here."


@pytest.mark.parametrize(("page", "want"), [
    # Words in names that also stand for parts of an article do not drop them.
    (f"<article><div class='section-header'><h1>Big title</h1></div><p>{LONG}</p></article>", f"Big title\n{LONG}"),
    (f"<article><header><h2>Own header</h2></header><p>{LONG}</p></article>", f"Own header\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='search-results'><p>{LONG}</p></div></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><p class='social'>Social life, short.</p></article>", f"{LONG}\nSocial life, short."),
    # Reader comments go, whatever they are called.
    (f"<article><p>{LONG}</p><div class='reader-opinions'><p>Nice, I like it.</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", LONG),
    # Without an article element.
    (f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div>Site map</div></body>", f"Title\n{LONG}\n{LONG}"),
    (f"<body><div class='x1'>Home</div><div class='q7'><h2>Head</h2><p>{LONG}</p><p>Short one.</p><ul><li>a</li></ul></div>"
     "<div class='z9'><p>Imprint</p></div></body>", f"Head\n{LONG}\nShort one.\na"),
    # Of two plain elements the ratio decides.
    (f"<div class=a><p>Top</p><p>News</p><p>Sport</p></div><div class=b><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
])
def test_ratios_decide_and_names_are_evidence(page, want):
    assert html_text.main_text(page) == want


def plain_ratios(leaves, share=0.5):
    """Path ratios step by step, without arrays."""
    punctuation = set(".,;:!?…。，、؟¿¡")
    per_leaf = []
    for path, _, _ in leaves:
        same = [t for p, _, t in leaves if p == path]
        per_leaf.append((sum(map(len, same)) / len(same), sum(c in punctuation for t in same for c in t) / len(same)))
    fused = []
    for k, (_, weight, _) in enumerate(leaves):
        left, right = per_leaf[max(k - 1, 0)], per_leaf[min(k + 1, len(leaves) - 1)]
        chars, marks = ((left[i] + 2 * per_leaf[k][i] + right[i]) / 4 for i in (0, 1))
        fused.append(chars * (1 + marks) * weight)
    limit = share * sum(f * len(t) for f, (_, _, t) in zip(fused, leaves)) / sum(len(t) for _, _, t in leaves)
    values = {}
    for f, (path, _, _) in zip(fused, leaves):
        values.setdefault(path, []).append(f)
    return {p for p, v in values.items() if sum(v) / len(v) >= limit}


def made_page(rng):
    """A page without article tags whose element names say nothing."""
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "eps"]) for _ in range(n))
    name = lambda: "".join(rng.choice("klmnop") for _ in range(5))
    body = [f"<h1>{words(4)}</h1>"] + [f"<p>{words(rng.randint(40, 90))}</p>" for _ in range(rng.randint(3, 8))]
    other = ["".join(f"<p>{words(2)}</p>" for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 3))]
    parts = [f"<div class='{name()}'>{o}</div>" for o in other]
    at = rng.randint(0, len(parts))
    parts.insert(at, f"<div class='{name()}'>{''.join(body)}</div>")
    return "<html><body>" + "".join(parts) + "</body></html>", "\n".join(re.sub("<.*?>", "", b) for b in body)


def test_ratios_equal_a_plain_implementation_and_find_planted_text():
    rng = random.Random(12)
    same = 0
    for _ in range(60):
        page, want = made_page(rng)
        parser = html_text.Leaves()
        parser.feed(page)
        parser.end_block()
        assert html_text.content_paths(parser.blocks) == plain_ratios(parser.blocks)
        assert html_text.main_text(page) == want
        # Without the ratios everything on the page would stay.
        same += html_text.main_text(page, lambda leaves: {p for p, _, _ in leaves}) == want
    assert same == 0


def test_article_blocks_of_the_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.op9_html_text(spark, SMALL).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# ---------------------------------------------------------------- decontamination


def brute_pairs(docs, items):
    """Pairs by the definition alone: every window of every text, no passages, no scores."""
    out = set()
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item, t in items:
            question, answer = decontaminate.parts(t or "")
            size = len(question) + len(answer)
            if not size or not set(question + answer) & set(words):
                continue
            n = min(5, len(question))
            own = [question[k : k + n] for k in range(len(question) - n + 1)] if n else []
            for at in range(max(1, len(words))):
                part = words[at : at + 2 * size + 32]
                pieces = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
                asked = sum(tuple(s) in pieces for s in own) >= 0.8 * len(own) - 1e-9
                if asked and sum(w in part for w in answer) >= 0.8 * len(answer) - 1e-9:
                    out.add((i, item))
                    break
    return out


def small_benchmark(rng, vocabulary):
    common = vocabulary[:30]
    word = lambda: rng.choice(common if rng.random() < 0.6 else vocabulary)
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    return word, sentence, [(k, " ".join(sentence(rng.randint(3, 12)) for _ in range(rng.randint(1, 4)))) for k in range(60)]


@pytest.mark.parametrize("block_items", [50_000, 7])
def test_pairs_match_brute_force(spark, frame, clash, block_items):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(500)]
    word, sentence, items = small_benchmark(rng, vocabulary)
    # A null and a repeated id are items of their own.
    items += [(100, None), (101, ""), (102, "one"), (0, sentence(20)), (None, sentence(18)), (3, items[3][1])]
    docs = [(k, " ".join(sentence(rng.randint(3, 20)) for _ in range(rng.randint(0, 20)))) for k in range(40)]
    for k in range(60, 140):  # copies with edits and words put in between, around the threshold
        own = rng.choice([t for _, t in items if t]).split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        if k % 2:
            own.insert(rng.randrange(len(own) + 1), " ".join(word() for _ in range(rng.randint(5, 70))))
        docs.append((k, f"{sentence(rng.randint(1, 90))} {' '.join(own).upper()} {sentence(rng.randint(1, 90))}"))
    docs += [(900, None), (901, ""), (902, "one"), (60, docs[40][1]), (903, items[-2][1]), (904, items[-3][1])]
    source = clash(frame(docs))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(source, benchmark, block_items)
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = brute_pairs(docs, items)
    assert pairs == want and found.count() == len(pairs) and any(i is None for _, i in pairs)
    if block_items > 7:
        kept = decontaminate.decontaminate(source, benchmark)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in pairs}
        assert decontaminate.contaminated(source.limit(0), benchmark).count() == 0
        assert decontaminate.contaminated(source, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("companions", [0, 1, 5])
def test_a_stretched_copy_is_found_at_every_offset(spark, companions):
    """40 words with 20 put between question and answer, behind 0 to 199 words; other items do not matter."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    question, answer = rng.sample(words, 32), rng.sample(words, 8)
    items = [("x", " ".join(question) + ". " + " ".join(answer) + ".")]
    items += [(f"o{k}", " ".join(rng.choices(words, k=60 + k)) + ".") for k in range(companions)]
    benchmark = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(items)], "item_id long, text string")
    filler = [f"f{k}" for k in range(500)]
    texts = [(n, " ".join([*rng.choices(filler, k=n), *question, *rng.choices(filler, k=20), *answer, *rng.choices(filler, k=300)]))
             for n in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).filter("item_id = 0").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(200))
    assert all(r["first_word"] == r["doc_id"] for r in found)
    assert len({round(r["bm25"], 9) for r in found}) == 1


def test_runs_are_skipped_and_nothing_is_lost():
    """Against adding up all postings, for many items; memory of one large slice stays small."""
    rng = random.Random(5)
    rare = [f"r{k}" for k in range(20_000)]
    common = [f"c{k}" for k in range(1000)]
    pick = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(f"{k:04}", " ".join(pick(rng.randint(15, 50))) + ".") for k in range(4000)]
    sizes = {i: len(decontaminate.words_of(t)) for i, t in items}
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    found = pd.DataFrame([
        (i, w, math.log(1 + (4000 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sizes[i] / 32)))
        for i, t in items for w, n in Counter(decontaminate.words_of(t)).items()
    ], columns=["item", "word", "impact"])
    index = decontaminate.Index(decontaminate.index_data(items, found))
    texts = [" ".join(pick(150) + (rng.choice(items)[1].split() if k % 5 == 0 else []) + pick(100)) for k in range(400)]
    split = [[index.terms.get(w, -1) for w in decontaminate.words_of(t)] for t in texts]
    term = np.concatenate([np.array(sorted({c for c in s if c >= 0})) for s in split])
    passage = np.concatenate([np.full(len({c for c in s if c >= 0}), k) for k, s in enumerate(split)])
    tracemalloc.start()
    got = set(index.candidates(term, passage))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by_word = {}
    for code, item, impact in zip(np.repeat(np.arange(len(index.terms)), np.diff(index.block_start[index.term_start])), index.items, index.impacts):
        by_word.setdefault(int(code), []).append((int(item), impact))
    want, everything = set(), 0
    for k, s in enumerate(split):
        score = Counter()
        for c in set(s) - {-1}:
            everything += len(by_word[c])
            for item, impact in by_word[c]:
                score[item] += impact
        want |= {(k, i) for i, v in score.items() if v >= index.limits[i]}
    assert got == want and len(want) >= 80
    assert index.scored < 0.1 * everything and peak < 300e6


def test_only_the_contaminated_rows_of_an_id_go(spark, frame):
    item = "The quick brown fox jumps over the lazy dog today. It was seen twice."
    rows = [(None, item), (None, "clean"), (1, item), (1, "clean too"), (2, "other")]
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(frame(rows), benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "clean"), (1, "clean too"), (2, "other")]


def test_whole_items_in_the_given_documents(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op10_decontaminate(spark, SMALL).collect()}
    assert got == want and want
