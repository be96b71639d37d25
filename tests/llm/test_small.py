"""The corpus operators on small tables: awkward rows, and brute force where SQL is no oracle."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bpe, dartminhash, decontam, licenses, linerules, preference, registry, substring, unigram, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, class_id string, `_t` string, words int"
rng = np.random.default_rng(5)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


BASE = prose(80)
LONG = prose(3000)
NEAR = BASE.split()
NEAR[40] = "changed"
TEXTS = [
    None, "", " \n\t ", "one", BASE, BASE, BASE.replace(" ", "\n", 3), " ".join(NEAR), LONG, prose(20) + " " + BASE[:200] + " " + prose(20), "a a a a " * 40,
    "é ü 日本 😀 \x0b x", "Licensed under the MIT License.", "x\n" * 30, "z" * 100_000,
]
ROWS = [(k, t, "en", "s", 1, "x", "y", "z", 1) for k, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None, None, None, None), (4, BASE, "en", "s", 1, "x", "y", "z", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


# ---- 1 ----


def brute_repeats(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - window + 1) for j in range(window) if i is not None and first[tuple(w[k : k + window])] < i}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_frequent_windows_in_the_order_of_a_task(spark, monkeypatch):
    """A window of all texts: a task settles what is larger than it has seen, the shard holds the first of a key; with a memory of one window too."""
    common = " ".join(f"c{k}" for k in range(20))
    ids = [50, 3, 40, 2, 60, 2, 1, 70]
    rows = [(i, f"{prose(30)} {common} {prose(15)}") for i in ids]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = sorted((i, r[1]) for i, r in zip(ids, [(i, n) for i, n in ((i, 0 if i == 1 else 20) for i in ids)]))
    monkeypatch.setattr(substring, "rounds", lambda batches, **_: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    got = substring.remove_repeats(d, frequent=1).select("doc_id", "n_removed").collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == want
    known = substring.Smallest()
    see = lambda w, i: known.settled(np.array(w, np.uint64), np.array(i)).tolist()
    assert see([5, 9, 5], [7, 7, 7]) == [False] * 3 and see([9, 5], [8, 6]) == [True, False] and see([5, 1], [7, 1]) == [True, False]
    monkeypatch.setattr(substring, "REMEMBERED", 3)
    assert see([2], [9]) == [False] and see([2], [10]) == [False] and see([1], [2]) == [True]


@pytest.mark.parametrize("options", [{}, {"frequent": 1}, {"block": 40}])
def test_substring(docs, options):
    got = substring.remove_repeats(docs, outputs=("kept_sha256",), **options).collect()
    want = brute_repeats([(r[0], r[1]) for r in ROWS])
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substring_keeps_spacing(spark):
    d = spark.createDataFrame([(1, "p\nq  r " + BASE), (2, "a\tb\n" + BASE + "\nc  d")], "doc_id bigint, text string")
    got = by_id(substring.remove_repeats(d, outputs=("clean_text",)), "clean_text")
    assert got == {1: "p\nq  r " + BASE, 2: "a\tb c  d"}


def test_substring_of_an_id_with_two_texts(spark):
    a, b = prose(60), prose(60)
    rows = [(1, a + " one"), (2, b + " two"), (5, "x " + a), (5, "y " + b), (7, "u " + prose(50)), (7, "v " + prose(50))]
    rows += [(9, rows[4][1] + " z"), (9, rows[5][1] + " z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = substring.remove_repeats(d).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in got if r["doc_id"] in (5, 9)) == [(5, "x"), (5, "y"), (9, "z"), (9, "z")]


# ---- 2 ----


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/y.py", "Licensed under CC BY-NC 4.0.\n" + BASE), (4, "z/q.py", None), (5, None, "code"), (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/b/c/d/e.txt", ""), (7, "a/b/c/d/e.txt", ""),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("name", F.lit("clash"))
    got = licenses.scan_licenses(d).collect()
    found = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert len(got) == len(rows)
    assert found == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a/b"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 4: (None, None, None), 5: (None, None, None),
        6: ("GPL-3.0", "GPL-3.0", None), 7: (None, "GPL-3.0", "a/b"),
    }


def test_whole_licence_files(spark):
    """Licence files as projects have them: with a year and a holder, wrapped anew, with something added; and none that are prose."""
    texts = dict(licenses.whole_texts())
    mine = {k: t.replace("<year>", "2019").replace("<copyright holders>", "Ada Example") for k, t in texts.items()}
    rows = [(k, f"{n}/LICENSE", t) for k, (n, t) in enumerate(mine.items())]
    rows += [(100 + k, f"{n}/src/deep/a.py", "x = 1") for k, n in enumerate(mine)]
    rows += [
        (200, "w/COPYING.txt", " ".join(mine["Apache-2.0"].split())), (201, "w/a.py", None), (202, "p/LICENSE", prose(900)), (203, "p/a.py", ""), (204, "m/license.md", "My project\n\n" + mine["MIT"] + "\nThanks to all."), (205, "m/a/b.py", "y"),
        (206, "q/LICENSE", prose(100_000)), (207, "q/notes.txt", mine["GPL-3.0"]), (208, "v/NOTICE", mine["MIT"]), (208, "v/NOTICE", mine["MIT"]),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    for c in ("unit", "key", "part", "named", "dir", "name", "best"):
        d = d.withColumn(c, F.lit(1))
    got = licenses.scan_licenses(d).collect()
    found = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert len(got) == len(rows)
    for k, n in enumerate(mine):
        assert found[k] == (n, n, None) and found[100 + k] == (None, n, n)
    assert found[200][0] == "Apache-2.0" and found[201] == (None, "Apache-2.0", "w") and found[202] == found[206] == (None, None, None) and found[203][1] is None
    assert found[204][0] == "MIT" and found[205] == (None, "MIT", "m") and found[208] == ("MIT", "MIT", None)


def test_licence_ties(spark):
    """Two licences equally often in a directory: the name that sorts first; a notice that two templates fit alike: the same."""
    d = spark.createDataFrame([(1, "a/LICENSE", "one two"), (2, "a/COPYING", "three four"), (3, "a/x", "code"), (4, "b/LICENSE", "five six")], "doc_id bigint, path string, text string")
    got = licenses.scan_licenses(d, templates=(("Z", "one two"), ("B", "three four"), ("N", "five six"), ("M", "six five")), texts=()).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {1: "Z", 2: "B", 3: "B", 4: "M"}


# ---- 3 ----


def test_bpe_equals_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    odd = ["it's WE'LL I'D", "<|endoftext|> x<|startoftext|>", "ΑΣ Σ", "İ ǅ", "\x1c a\x85b\u3000c", "1234 !!! ##", "aaaaaaaaa" * 9]
    encoder = bpe.Encoder(bpe.load(path))
    for text, (ids, n, decoded) in zip(odd, encoder.encode(odd)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs, path).collect()}
    for i, t, *_ in ROWS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
    back = by_id(bpe.decode_ids(bpe.encode_texts(docs, path), path), "text")
    assert back == {i: r["decoded"] for i, r in got.items()}


# ---- 4 ----


def test_urls(spark):
    urls = [
        "http://A.example.net/en/1", "http://a.example.net/de/1", "https://x.example.com/de/2?q", "https://x.example.org/fr/1", "https://free-bets.example.com/en/1", "https://cheappills.example.com/en/1",
        "https://www.myblog.example.com/en/", None, "nothing", "http://h", "http://net?x/", "http://net/", "http://cabinet/x", "a://b://c/d", "http://" + "ab" * 20_000 + ".com/" + "x" * 50_000, "http://h", "http://credit" + "union.org/",
    ]
    d = spark.createDataFrame([(k, u, "w", "z", 1) for k, u in enumerate(urls)] + [(None, "http://net/", None, None, None), (9, "http://h", "w", "z", 1)], "page_id bigint, url string, words string, host string, log_odds int")
    rows = urlfilter.filter_urls(d).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls) + 2 and got[None] == got[11]
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block")
    assert got[2] == ("x.example.com", "/de/2", "example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == got[15] == ("h", "", None, "allow") and got[10][:3] == ("net", "", None)
    assert got[11][2:] == ("net/", "block") and got[12][2] is None and got[13][:2] == ("b:", "//c/d")
    assert got[14][1:] == ("/" + "x" * 50_000, None, "allow") and got[16][2:] == (None, "allow")


def test_url_rules_of_equal_length(spark):
    d = spark.createDataFrame([(1, "http://a.bc/de/f")], "page_id bigint, url string")
    for rules in ([("allow", "a.bc/d"), ("block", "bc/de/")], [("block", "bc/de/"), ("allow", "a.bc/d")]):
        assert [r["verdict"] for r in urlfilter.filter_urls(d, rules).collect()] == [rules[0][0]]


def brute_split(model, label):
    """The cheapest of all splits into parts that are known, or unknown and not side by side."""
    if label in model.lexicon:
        return 0.0
    best = {}

    def cheapest(i, open_):
        if i == len(label):
            return 0.0
        if (i, open_) not in best:
            costs = []
            for j in range(i + 1, len(label) + 1):
                if label[i:j] in model.cost:
                    costs.append(model.cost[label[i:j]] + cheapest(j, True))
                if open_:
                    costs.append(urlfilter.UNKNOWN_BASE + urlfilter.UNKNOWN_LETTER * (j - i) + cheapest(j, False))
            best[i, open_] = min(costs, default=float("inf"))
        return best[i, open_]

    return cheapest(0, True)


def test_url_words_equal_brute_force():
    model = urlfilter.Model({"shop": 9, "tion": 40, "cheappills": 50, "ing": 30, "es": 999, "news": 5})
    assert "es" not in model.cost and "cheappills" not in model.cost and "tion" in model.cost
    pieces = [*sorted(model.cost), "xq", "zzz", "a"]
    for _ in range(300):
        label = "".join(rng.choice(pieces, rng.integers(1, 5)))
        parts = model.split(label)
        assert "".join(parts) == label
        cost = 0.0 if label in model.lexicon else sum(model.cost.get(p, urlfilter.UNKNOWN_BASE + urlfilter.UNKNOWN_LETTER * len(p)) for p in parts)
        assert abs(cost - brute_split(model, label)) < 1e-9
    assert model.split("cheappillsonline") == ("cheap", "pills", "online") and model.split("essexuniversity") == ("essex", "university")


def test_url_verdicts_equal_plain_naive_bayes():
    model = urlfilter.Model({})
    words = {k: [w for a in v.split() for w in a.split("-")] for k, v in urlfilter.ADDRESSES.items()}
    vocabulary = set(words["block"]) | set(words["allow"])
    for host in ("casino-win.com", "creditunion.org", "free.software.book", "unheard.of"):
        got, found = model.log_odds(host, "/Poker/1")
        want = np.log(len(urlfilter.ADDRESSES["block"].split()) / len(urlfilter.ADDRESSES["allow"].split()))
        for w in found:
            if w in vocabulary:
                a, b = ((words[k].count(w) + 1) / (len(words[k]) + len(vocabulary)) for k in ("block", "allow"))
                want += np.log(a) - np.log(b)
        assert abs(got - want) < 1e-9


def test_held_out_addresses():
    """Ten folds: each address, its words joined, is judged by a model of the other nine tenths."""
    listed = [(a, k) for k, v in urlfilter.ADDRESSES.items() for a in v.split()]
    order = np.random.default_rng(1).permutation(len(listed))
    wrong = 0
    for fold in range(10):
        model = urlfilter.Model({}, {k: [listed[i][0] for n, i in enumerate(order) if n % 10 != fold and listed[i][1] == k] for k in urlfilter.ADDRESSES})
        for i in order[fold::10]:
            wrong += (model.log_odds(listed[i][0].replace("-", "") + ".com", "/")[0] > 0) != (listed[i][1] == "block")
    assert wrong <= 0.15 * len(listed), wrong


def test_url_words_are_counted_by_hosts(spark):
    urls = ["http://a.shop.com/news/x", "http://b.shop.com/zebra", "http://b.shop.com/zebra/zebra"] + ["http://c.org/hot"] * 50 + ["http://d.org/zebra/Ab/ab"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = urlfilter.word_counts(pages)
    assert got == {"shop": 2, "hot": 1, "news": 1, "x": 1}  # labelled words alone
    lexicon = spark.createDataFrame([("Zebra", 40), ("zebra", 2), ("shop", 7), (None, 3), ("crossing", 5), ("none", 0)], "word string, count int")
    assert urlfilter.word_counts(pages, lexicon=lexicon) == {"shop": 2, "hot": 1, "news": 1, "x": 1, "zebra": 42, "crossing": 5}


def test_url_words_and_labels_of_the_caller(spark, monkeypatch):
    table = spark.createDataFrame([("Zebra-crossing", "allow"), ("road-sign", "allow"), ("zebra-hunt", "block"), ("hunt-trophy", "block"), (None, "block"), ("x", "maybe")], "address string, verdict string")
    labels = urlfilter.labelled(table)
    assert {k: sorted(v) for k, v in labels.items()} == {"block": ["hunt-trophy", "zebra-hunt"], "allow": ["road-sign", "zebra-crossing"]}
    pages = spark.createDataFrame([(1, "http://trophyhunters.com/"), (2, "http://zebracrossingsafari.com/")], "page_id int, url string")
    lexicon = spark.createDataFrame([("safari", 5), ("ers", 1)], "word string, count int")
    got = {r["page_id"]: (r["words"], r["verdict"]) for r in urlfilter.filter_urls(pages, (), labels, lexicon).collect()}
    assert got == {1: (["trophy", "hunt", "ers", "com"], "block"), 2: (["zebra", "crossing", "safari", "com"], "allow")}
    monkeypatch.setattr(urlfilter, "LEXICON_ROWS", 1)
    with pytest.raises(ValueError, match="more than"):
        urlfilter.filter_urls(pages, lexicon=lexicon)
    with pytest.raises(ValueError, match="more than"):
        urlfilter.labelled(table, 2)


# ---- 5 ----


def test_quality_learns_only_from_its_part(spark):
    good = [(k, prose(60).capitalize() + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(w + "%%%" for w in prose(60).split())) for k in range(80)]
    d = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id bigint, text string")
    y = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad], "doc_id bigint, quality int, toxic int")
    ranker = preference.train(d, y)
    rows = preference.classify(d, ranker).collect()
    assert len(rows) == 382 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == (r["doc_id"] < 1000) for r in rows if r["doc_id"] < 5000)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    flipped = y.withColumn("quality", F.when(preference.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(preference.train(d, flipped).weights, ranker.weights)
    assert preference.train(d, y.where("quality = 1")).score(np.zeros((1, len(preference.FEATURES))))[0] == 0.5


def plain_features(text):
    """The classifier's features letter by letter."""
    t = text or ""
    b, w = t.encode(), [x.encode() for x in words(t)]
    share = lambda letters: sum(c in letters for c in b)
    some, lines = max(len(w), 1), t.count("\n") + 1
    stopped = sum(x.endswith((".", "!", "?")) for x in t.split("\n"))
    return [
        np.log1p(len(w)), sum(map(len, w)) / some, share(range(0x41, 0x5B)) / max(len(b), 1), share(b"0123456789") / max(len(b), 1), share(b"#*$%&|<>@^~=+_\\{}[]") / some,
        share(b".!?") / some, share(b",;:") / some, share(range(0x80, 0x100)) / max(len(b), 1), np.log1p(len(w) / lines), len(set(w)) / some, sum(x == y for x, y in zip(w, w[1:])) / some,
        sum(x[-1] in b"#*$%&|<>@^~=+_\\{}[]" for x in w) / some, sum(0x41 <= x[0] <= 0x5A for x in w) / some, stopped / lines, np.log1p(max(map(len, w), default=0)),
    ]


def test_quality_features_equal_plain_counts():
    texts = [t for t in TEXTS if t is None or len(t) < 20_000] + ["A b. C!\nd?\n\nE e e, $5 #x%", ".\n.", "\n"]
    import pyarrow as pa

    from pagemill.llm.common import string_buffers

    for group in (texts, *[[t] for t in texts]):
        got = preference.text_features(*string_buffers(pa.array(group, pa.string())))
        assert np.allclose(got, [plain_features(t) for t in group], atol=1e-12)


def test_quality_fit_equals_plain_descent():
    """The pairwise loss by plain gradient descent over all pairs, and the threshold by trying every place between two scores."""
    r = np.random.default_rng(3)
    y = (r.random(60) < 0.5).astype(int)
    x = r.normal(size=(60, len(preference.FEATURES))) + y[:, None] * r.normal(size=len(preference.FEATURES)) * 0.4
    ranker = preference.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -preference.CLIP, preference.CLIP)
    d = np.array([z[i] - z[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + preference.RIDGE / 2 * w @ w
    w = np.zeros(d.shape[1])
    for _ in range(20_000):
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + preference.RIDGE * w)
    assert loss(ranker.weights) <= loss(w) + 1e-9 and np.allclose(ranker.weights, w, atol=1e-2)
    s = z @ ranker.weights
    right = lambda t: ((s >= t) == (y == 1)).sum()
    edges = np.sort(s)
    assert right(ranker.threshold) == max(right(t) for t in [*(edges[1:] + edges[:-1]) / 2, edges[0] - 1, edges[-1] + 1])
    assert ((ranker.score(x) >= 0.5) == (s >= ranker.threshold)).all()


def test_quality_of_awkward_rows(docs, spark):
    """Equal texts score alike whatever the rest of their rows; labels that are null, double or of no document are borne."""
    d = docs.unionByName(spark.createDataFrame([(50 + k, "t" * 9, "en", "s", 1, "x", "y", "z", 1) for k in range(4)], DOCS)).withColumn("features", F.lit(1)).withColumn("quality", F.lit(1))
    y = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (3, 0, 0), (4, 1, 0), (8, 1, 0), (10, 0, None), (14, None, 0), (None, 1, 1), (777, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = preference.classify(d, preference.train(d, y)).collect()
    assert len(rows) == len(ROWS) + 4 and len({r["score"] for r in rows if (r["doc_id"] or 0) >= 50}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, None)}) == 1 and all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert all(0 <= r["score"] <= 1 for r in rows)


def all_pairs_gradient(z, good, bad, w):
    """The gradient of the loss over all pairs; z has distinct rows, of which `good` and `bad` are the numbers of documents."""
    gradient = preference.RIDGE * w
    for i in np.flatnonzero(good):
        p = 1 / (1 + np.exp((z[i] - z) @ w))
        gradient = gradient - good[i] * (bad * p) @ (z[i] - z) / good.sum() / bad.sum()
    return gradient


def most_right(s, good, bad):
    """The most documents that a threshold can class rightly."""
    edges = np.unique(s)
    return max(good[s >= t].sum() + bad[s < t].sum() for t in [*edges, np.inf])


def test_quality_fit_takes_every_pair():
    """Over half a million pairs: the loss of all of them is at its least, and no threshold, between quantiles or not, is better."""
    r = np.random.default_rng(11)
    y = (r.random(1700) < 0.4).astype(int)
    x = r.normal(size=(1700, len(preference.FEATURES))) + y[:, None] * r.normal(size=len(preference.FEATURES)) * 0.3
    ranker = preference.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -preference.CLIP, preference.CLIP)
    assert np.abs(all_pairs_gradient(z, y == 1, y == 0, ranker.weights)).max() < 1e-8
    s = ranker.raw(x)
    assert ((s >= ranker.threshold) == (y == 1)).sum() == most_right(s, y == 1, y == 0)


def test_quality_of_equal_texts_goes_with_most():
    x = np.ones((30, len(preference.FEATURES)))
    for bad in (24, 6):
        ranker = preference.fit(x, (np.arange(30) >= bad).astype(int))
        assert ((ranker.score(x) >= 0.5) == (bad < 15)).all()


def test_quality_trains_on_every_label(spark):
    """36,000 labelled documents of 24 texts: means, pairs and threshold are those of all that are not held out."""
    import zlib

    texts = [(prose(5 + k) + (". " + "A%d$ " * (k % 5) + "\n" * (k % 4)) * (k % 3)).strip() for k in range(24)]
    ids = np.arange(36_000)
    kind, labels = ids * 7 // 5 % 24, ((ids * 2_654_435_761 >> 7) % 100 < 20 + ids * 7 // 5 % 24 * 2 + ids // 1200).astype(int)
    d = spark.createDataFrame(list(zip(ids.tolist(), (texts[k] for k in kind))), "doc_id bigint, text string")
    y = spark.createDataFrame([(i, q, 0) for i, q in zip(ids.tolist(), labels.tolist())], "doc_id bigint, quality int, toxic int")
    ranker = preference.train(d, y)
    used = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in ids])
    good, bad = (np.bincount(kind[used & (labels == q)], minlength=24) for q in (1, 0))
    assert good.sum() + bad.sum() == used.sum() > 20_000
    x = np.array([plain_features(t) for t in texts])
    mean = (good + bad) @ x / used.sum()
    scale = np.sqrt((good + bad) @ (x - mean) ** 2 / used.sum())
    assert np.allclose(ranker.mean, mean, rtol=1e-9) and np.allclose(ranker.scale, np.maximum(scale, 1e-6), rtol=1e-8)
    z = np.clip((x - ranker.mean) / ranker.scale, -preference.CLIP, preference.CLIP)
    assert np.abs(all_pairs_gradient(z, good, bad, ranker.weights)).max() < 1e-8
    s = ranker.raw(x)
    assert good[s >= ranker.threshold].sum() + bad[s < ranker.threshold].sum() == most_right(s, good, bad)
    again = preference.fit(np.repeat(x, good + bad, 0), np.concatenate([np.repeat([1, 0], [g, b]) for g, b in zip(good, bad)]))
    assert np.allclose(ranker.weights, again.weights, atol=1e-7) and np.isclose(ranker.threshold, again.threshold) and np.isclose(ranker.slope, again.slope)


# ---- 6 ----


def test_token_counts_equal_plain_dynamic_programming(docs):
    path = unigram.vocabulary_path()
    pieces = unigram.load(path)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    score = {sp.id_to_piece(i): -float(np.log(r + 1 + unigram.ZIPF_SHIFT)) for r, i in enumerate(plain)}

    def brute(w):
        w, best = unigram.MARK + w, [(0.0, 0)]
        for i in range(1, len(w) + 1):
            n = len(w[i - 1].encode())
            c = (best[i - 1][0] + pieces.byte_score * n, best[i - 1][1] + n)
            for j in range(max(0, i - pieces.longest), i):
                if (s := score.get(w[j:i])) is not None:
                    x = (best[j][0] + s, best[j][1] + 1)
                    if x[0] > c[0] + 1e-9 or x[0] > c[0] - 1e-9 and x[1] < c[1]:
                        c = x
            best.append(c)
        return best[-1][1]

    got = by_id(unigram.count_tokens(docs, path), "n_tokens")
    for i, t, *_ in ROWS:
        if t is None or len(t) < 50_000:
            assert got[i] == sum(map(brute, words(t)))
        else:
            assert got[i] == sum(unigram.long_count(w, pieces) for w in words(t))
    r = np.random.default_rng(2)
    for letters in ("abcdeéß日", "the of and", "z"):
        for n in (255, 256, 257, 300, 2000):
            w = "".join(r.choice(list(letters.replace(" ", "")), n))
            assert unigram.token_counts([w, w[:20], w[:300]], pieces).tolist() == [brute(w), brute(w[:20]), brute(w[:300])]
            assert unigram.long_count(w, pieces, chunk=7) == brute(w)


def test_a_word_of_a_million_letters():
    import time

    r = np.random.default_rng(2)
    w = "".join(r.choice(list("ABCDefgh0123+/"), 1_000_000))
    began = time.process_time()
    n = unigram.token_counts([w], unigram.load(unigram.vocabulary_path()))[0]
    assert 300_000 < n < 1_000_000 and time.process_time() - began < 30


# ---- 7 ----


def test_leaks(spark):
    items = [(k, prose(int(rng.integers(15, 60))) + ". " + prose(8)) for k in range(40)] + [(90, None), (91, "...")]
    changed = items[3][1].split()
    changed[5] = "other"
    rows = [(k, prose(300)) for k in range(60)]
    rows += [(100, prose(100) + " " + items[0][1] + " " + prose(100)), (101, items[1][1].upper()), (102, prose(40) + " " + " ".join(changed) + " " + prose(70)), (103, None), (104, "")]
    d = spark.createDataFrame(rows + rows[-4:], "doc_id bigint, text string").withColumn("item_ids", F.lit(1))
    got = decontam.leaks(d, decontam.fitted(d, spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert len(got) == len(rows) + 4
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"]} == {100: [0], 101: [1], 102: [3]}


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    """Its words are in more passages than the search gives weight to; so are those of an item of common words."""
    r = np.random.default_rng(7)
    common = [f"c{k}" for k in range(20)]
    text = lambda k, n: [str(r.choice(common)) if r.random() < 0.1 else f"d{k}x{j}" for j in range(n)]
    hot, plain = " ".join(f"hot{k}" for k in range(30)), " ".join(r.permutation(common))
    items = [(0, hot), (1, plain), (2, "one more item of words that no text has at all"), (3, " ".join(f"rare{k}" for k in range(25)))]
    rows, want = [], {}
    for k in range(300):
        w = text(k, 300)
        held = ([hot] if k % 3 == 0 else []) + ([plain] if k % 50 == 1 else []) + ([items[3][1]] if k % 100 == 3 else [])
        at = 0
        for h in held:
            at += 70
            w[at:at] = h.split()
        if held:
            want[k] = [i for i, t in items if t in held]
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontam.leaks(d, decontam.fitted(d, spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"]} == want


def test_leaks_of_long_items(spark):
    """Copies of items longer than the passages, word by word and with other words between."""
    r = np.random.default_rng(8)
    names = lambda k, n: [f"i{k}x{j}" for j in range(n)]
    sizes = {0: 300, 1: 190, 2: 120, 3: 3000, 4: 30}
    items = [(k, " ".join(names(k, n))) for k, n in sizes.items()]
    loose = [w for j, x in enumerate(names(2, 120)) for w in ([x, "between"] if j % 2 else [x])]
    rows = [(k, " ".join(r.choice(VOCABULARY, 400))) for k in range(30)]
    filled = lambda w: " ".join([prose(90), *w, prose(90)])
    rows += [(100, filled(names(0, 300))), (101, filled(names(1, 190))), (102, filled(loose)), (103, filled(names(3, 3000))), (104, filled(names(4, 30)))]
    rows += [(105, filled(names(0, 300)[:140])), (106, filled(names(3, 3000)[500:1500]))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontam.leaks(d, decontam.fitted(d, spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert {r["doc_id"]: (r["item_ids"], r["share"]) for r in got if r["contaminated"]} == {100 + k: ([k], 1.0) for k in sizes}


def test_leaks_of_more_blocks_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 1)
    items = spark.createDataFrame([(k, " ".join(f"b{k}x{j}" for j in range(20))) for k in range(5)], "item_id bigint, text string")
    held = lambda *ks: " ".join([prose(30), *(f"b{k}x{j}" for k in ks for j in range(20)), prose(30)])
    both = held(4, 0)
    d = spark.createDataFrame([(1, both), (1, both), (2, held(3)), (3, prose(90)), (None, held(1)), (5, None), (6, ""), (2, prose(90))], "doc_id bigint, text string")
    got = decontam.leaks(d, decontam.fitted(d, items)).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"], r["item_ids"], r["share"]) for r in got) == [
        (0, True, [1], 1.0), (1, True, [0, 4], 1.0), (1, True, [0, 4], 1.0), (2, False, [], 0.0), (2, True, [3], 1.0), (3, False, [], 0.0), (5, False, [], 0.0), (6, False, [], 0.0),
    ]
    clean = decontam.keep_clean(d, decontam.fitted(d, items))
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 5, 6]


def test_leaks_equal_an_exhaustive_search(spark):
    """Verbatim, cut, reworded and shuffled copies of items of 8 to 150 words: what every window of twice an item's words holds."""
    r = np.random.default_rng(21)
    items = [(k, " ".join(r.choice(VOCABULARY, int(n)))) for k, n in enumerate(r.integers(8, 150, 30))]
    rows = []
    for k in range(120):
        w = items[k % 30][1].split()
        kind = k // 30
        if kind == 1:
            w = [x if r.random() < 0.85 else "other" for x in w]
        elif kind == 2:
            w = w[: int(len(w) * r.uniform(0.4, 1))]
        elif kind == 3:
            w = list(r.permutation(w))
        rows.append((k, prose(int(r.integers(1, 120))) + " " + " ".join(w) + " " + prose(int(r.integers(1, 120)))))
    rows += [(1000 + k, prose(250)) for k in range(60)]
    want = set()
    for i, t in rows:
        w = t.split()
        for n, text in items:
            seq = text.split()
            masks = {}
            for k, x in enumerate(seq):
                masks[x] = masks.get(x, 0) | 1 << k
            if decontam.common(masks, len(seq), w) >= decontam.LEAK * len(seq):
                reach = 2 * len(seq)
                if max(decontam.common(masks, len(seq), w[a : a + reach]) for a in range(0, max(1, len(w) - reach + 1), 2)) >= decontam.LEAK * len(seq):
                    want.add((i, n))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], n) for r in decontam.leaks(d, decontam.fitted(d, spark.createDataFrame(items, "item_id bigint, text string"))).collect() for n in r["item_ids"]}
    assert len(want) >= 60 and len(want & got) >= 0.95 * len(want), (len(want), len(want - got))
    assert len(got - want) <= 0.05 * len(got), got - want  # windows of another width


def test_leaks_of_items_without_an_id(spark):
    """A null item_id is reported as null, after the others."""
    a, b, c = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    items = spark.createDataFrame([(None, a), (3, b), (None, c), (7, None)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, a + " " + b), (2, b), (3, c), (4, prose(40))], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontam.leaks(d, decontam.fitted(d, items)).collect()}
    assert got == {1: (True, [3, None]), 2: (True, [3]), 3: (True, [None]), 4: (False, [])}


@pytest.mark.parametrize("blocks", [16, 1])
def test_the_largest_share_of_an_id_counts(spark, monkeypatch, blocks):
    """One text of an id is held whole, the other in part: in one pass and in several."""
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", blocks)
    a, b = ([f"{c}{k}" for k in range(30)] for c in "ab")
    for first, second in ((a, b), (b, a)):
        items = spark.createDataFrame([(1, " ".join(first)), (1, " ".join(second))], "item_id bigint, text string")
        d = spark.createDataFrame([(5, " ".join(a + b[:24])), (6, prose(50))], "doc_id bigint, text string")
        got = {r["doc_id"]: (r["item_ids"], r["share"]) for r in decontam.leaks(d, decontam.fitted(d, items)).collect()}
        assert got == {5: ([1], 1.0), 6: ([], 0.0)}


def test_leaks_of_a_repeated_item(spark):
    """Two texts of one item_id are two items; each is reported by that id, once."""
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    items = spark.createDataFrame([(1, a), (1, b), (1, a)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b), (4, prose(40)), (5, "z" * 200_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.leaks(d, decontam.fitted(d, items)).collect()}
    assert got == {1: [1], 2: [1], 3: [1], 4: [], 5: []}


def test_common_subsequence():
    masks = {1: 0b0101, 2: 0b1010}
    assert decontam.common(masks, 4, [1, 2, 1, 2]) == 4 and decontam.common(masks, 4, [2, 9, 1]) == 2 and decontam.common(masks, 4, []) == 0


# ---- 8 ----


def brute_classes(rows, threshold=0.8, weighted=True):
    """Components of exhaustive (weighted) Jaccard similarity: a shingle's occurrences are elements of their own."""
    sets = {}
    for i, t in rows:
        w = words(t)
        if w and i is not None:
            grams = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            sets[i] = frozenset((g, k) for g, n in grams.items() for k in range(n if weighted else 1))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) < threshold * max(len(sets[a]), len(sets[b])):
                continue
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("weighted", [True, False])
def test_near_duplicates(docs, weighted):
    got = dartminhash.near_duplicates(docs, weighted=weighted).collect()
    want = brute_classes([(r[0], r[1]) for r in ROWS], weighted=weighted)
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] == 4
        else:
            assert r["class_id"] == want.get(r["doc_id"], r["doc_id"])


def test_near_duplicate_families(spark):
    """Variants of one text that are unlike one another meet through it, whatever their ids."""
    base, rows = prose(200).split(), []
    for k in range(60):
        v = list(base)
        for p in rng.choice(200, 1 + k % 5, replace=False):
            v[p] = f"own{k}x{p}"
        rows.append((k, " ".join(v)))
    rows.append((999, " ".join(base)))
    rows += [(2000 + k, prose(100)) for k in range(40)]
    got = by_id(dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "class_id")
    assert got == brute_classes(rows)


def test_near_duplicates_are_weighted(spark):
    """Texts of the same shingles are alike only if they have them about as often."""
    line = prose(12)
    rows = [(1, " ".join([line] * 10)), (2, " ".join([line] * 9)), (3, " ".join([line] * 4)), (4, line), (5, " ".join([line] * 1000)), (6, " ".join([line] * 999))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_id(dartminhash.near_duplicates(d), "class_id") == brute_classes(rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert by_id(dartminhash.near_duplicates(d, weighted=False), "class_id") == brute_classes(rows, weighted=False)


def test_strangers_of_families_meet(spark, monkeypatch):
    """With one pivot a bucket at most and no rare shingles, links between components come from the frequent ones alone."""
    monkeypatch.setattr(dartminhash, "RARE", 1)
    sets, rows = [], []
    for family in range(4):
        base = [f"f{family}x{j}" for j in range(100)]
        for k in range(8):
            rows.append((family * 100 + k, 0, family if k < 6 else family * 100 + k, [hash((w, 7)) % 2**31 for w in base[: 100 - k]]))
    placed = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, comp bigint")
    sets = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id bigint, text int, shingles array<int>")
    got = {(r["a"], r["b"]) for r in dartminhash._prefix_pairs(placed, sets, 0.8).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2] and len(set(x[3]) & set(y[3])) >= 0.8 * len(set(x[3]) | set(y[3]))}
    assert want and want <= got and all(a < b for a, b in got)


def test_pages_of_a_template_do_not_meet(spark, monkeypatch):
    """Pages of one template with 30 words of their own: no two reach 0.8, and what is compared grows as their number, not as its square."""
    monkeypatch.setattr(dartminhash, "RARE", 8)
    made = {}
    for n in (200, 400):
        rows = [(k, k, [*range(196), *range(1000 + 40 * k, 1034 + 40 * k)]) for k in range(n)]  # 196 shingles of the template
        rows += [(k, k, [*range(196), *range(900_000 + 40 * k, 900_020 + 40 * k)]) for k in range(n, n + 5)]  # five that are alike
        placed = spark.createDataFrame([(i, c if i < n else n) for i, c, _ in rows], "doc_id bigint, comp bigint")
        sets = spark.createDataFrame([(i, 0, s) for i, _, s in rows], "doc_id bigint, text int, shingles array<int>")
        rare = dartminhash.stored(dartminhash._prefixes(placed, sets, 0.8), "prefixes")
        made[n] = dartminhash.frequent_meetings(rare, 0.8).count()
        assert dartminhash._prefix_pairs(placed, sets, 0.8).isEmpty()
    assert made[200] == made[400] == 0


def test_frequent_meetings_lose_no_pair(spark, monkeypatch):
    """Sets of frequent shingles of many sizes: every pair that reaches the threshold without a rare shingle in common meets."""
    monkeypatch.setattr(dartminhash, "RARE", 3)
    r = np.random.default_rng(3)
    rows = []
    for k in range(150):
        base = np.arange(60) + 100 * (k % 3)
        own = [10_000 + 50 * k + j for j in range(int(r.integers(0, 12)))]
        rows.append((k, sorted({*r.choice(base, int(r.integers(45, 61)), replace=False).tolist(), *own})))
    placed = spark.createDataFrame([(i, i // 4) for i, _ in rows], "doc_id bigint, comp bigint")
    sets = spark.createDataFrame([(i, 0, s) for i, s in rows], "doc_id bigint, text int, shingles array<int>")
    got = {(x["a"], x["b"]) for x in dartminhash._prefix_pairs(placed, sets, 0.8).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and i // 4 != j // 4 and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    # of the largest component of a shingle and step none meet one another, but here components are of four
    assert len(want) > 200 and want <= got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_near_duplicates_of_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = by_id(dartminhash.query(spark, "/root/testdata/sf0.01"), "class_id")
    want = brute_classes(rows)
    assert {i: c for i, c in got.items() if i in want} == want


def test_signatures_estimate_similarity():
    for weights in (None, True):
        hits = []
        for _ in range(40):
            e = rng.integers(0, 2**63, 3, dtype=np.uint64)
            w = np.array([3, 1, 5, 1, 2, 5.0]) if weights else None
            s = dartminhash.signatures(np.concatenate([e, e]) if weights else np.concatenate([e, e[:2]]), np.array([3, 3] if weights else [3, 2]), 240, w)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - (0.7 if weights else 2 / 3)) < 0.03


def test_near_duplicates_of_an_id_with_several_texts(spark):
    rows = []
    for k in range(6):
        t = prose(200).split()
        rows.append((1, " ".join(t)))
        rows.append((10 + k, " ".join([*t[:100], "changed", *t[101:]])))
    got = dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and {r["class_id"] for r in got} == {1}


# ---- 9 ----


def test_line_rules(docs):
    got = {r["doc_id"]: r for r in linerules.line_clean(docs).collect()}
    for i, t, *_ in ROWS:
        w = words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        full = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["n_dup_lines"] == len(full) - len(set(full)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_lines_are_removed(spark):
    good = "This is a sentence of several words, and it ends well."
    text = "\n".join([good] * 1 + ["Home | News | Sport | More", "We use cookies: see our cookie policy.", "an open line that never comes to its end", good.replace("This", "That")])
    r = linerules.line_clean(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r["clean_text"].split("\n") == [good, good.replace("This", "That")] and r["lines_removed"] == 3


# ---- 10 ----


@pytest.mark.parametrize("compressed", ["true", "false"])
def test_warc_round_trip(spark, tmp_path, compressed):
    body = "<p>é</p>" * 40
    pages = spark.createDataFrame([(1, "http://a/\nb", body), (2, None, body), (3, "u", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 30)], "page_id bigint, url string, html string")
    warc.register(spark)
    folder = f"file://{tmp_path}/w"
    warc.page_records(pages).write.format("warc").option("compressed", compressed).mode("append").save(folder)
    assert not [f for f in os.listdir(f"{tmp_path}/w") if f.startswith("_")]
    read = spark.read.format("warc").load(folder)
    got = {r["record_id"]: r for r in read.collect()}
    assert len(got) == 7 and got["<urn:page:2>"]["record_type"] == "revisit" and got["<urn:page:2>"]["refers_to"] == "<urn:page:1>"
    for i, html in ((1, body), (3, ""), (4, ""), (5, "short"), (6, "short"), (7, "WARC/1.1\r\n\r\n" * 30)):
        r = got[f"<urn:page:{i}>"]
        assert r["record_type"] == "response" and bytes(r["payload"]) == html.encode() and r["payload_digest"] == warc.payload_digest(html.encode())
    assert got["<urn:page:2>"]["http_length"] == len(body.encode()) and got["<urn:page:2>"]["payload"] is None
    assert read.where("record_type = 'revisit'").count() == 1 and read.where("record_type IN ('response', 'revisit') AND target_uri = 'u'").count() == 5
    assert read.where("record_type = 'warcinfo'").count() == 0


def test_warc_reader_parses_headers_before_payloads(tmp_path):
    data = b"".join(warc.gzip_member(warc.record_bytes({"record_type": t, "record_id": f"<{k}>", "payload": b"x" * 50_000})) for k, t in enumerate(["response", "metadata", "response"]))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    import gzip

    assert gzip.open(path).read().count(b"WARC/1.1") == 3
    with open(path, "rb") as f:
        got = list(warc.read_records(f, True, {"record_type": frozenset(["metadata"])}))
    assert [g["record_id"] for g in got] == ["<1>"] and len(got[0]["payload"]) == 50_000


@pytest.mark.parametrize("told", [False, True])
def test_warc_records_of_one_member(tmp_path, told):
    import gzip

    kinds = ["response", "metadata", "response", "metadata"]
    data = b"".join(warc.record_bytes({"record_type": t, "record_id": f"<{k}>", "payload": rng.bytes(200_000) if k % 2 else b"x" * 9}) for k, t in enumerate(kinds))
    path = tmp_path / "a.warc.gz"
    path.write_bytes((warc.gzip_member(data) if told else gzip.compress(data)) + warc.gzip_member(warc.record_bytes({"record_type": "metadata", "record_id": "<4>", "payload": b"y"})))
    read = lambda wanted, payloads=True: [r["record_id"] for r in warc.read_records(open(path, "rb"), True, wanted, payloads)]
    assert read({}) == read({}, False) == ["<0>", "<1>", "<2>", "<3>", "<4>"]
    assert read({"record_type": frozenset(["metadata"])}) == ["<1>", "<3>", "<4>"]


def test_warc_of_awkward_pages(spark, tmp_path):
    """Repeated and null ids, large payloads, clashing columns, and a table of nothing."""
    large, other = "x" * 3_000_000, "y" * 150
    rows = [(1, "u", large), (2, "v", large), (None, "n", other), (5, "w", other), (5, "w", other), (7, "w", other), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("payload", "digest", "record_type", "_d", "_p", "_n", "_first"):
        pages = pages.withColumn(c, F.lit("clash"))
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").collect()
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["http_length"]) for r in got)
    assert kinds == [
        ("<urn:page:1>", "response", "", 3_000_000), ("<urn:page:2>", "revisit", "<urn:page:1>", 3_000_000), ("<urn:page:5>", "response", "", 150), ("<urn:page:5>", "response", "", 150),
        ("<urn:page:7>", "revisit", "<urn:page:5>", 150), ("<urn:page:>", "response", "", 0), ("<urn:page:>", "response", "", 150),
    ]
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


# ---- all ----


def test_empty_tables(spark, empty):
    path, uni = bpe.vocabulary_path(), unigram.vocabulary_path()
    bench = spark.createDataFrame([(1, prose(20))], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert substring.remove_repeats(empty).count() == 0
    assert licenses.scan_licenses(licenses.document_paths(empty)).count() == 0
    assert bpe.encode_texts(empty, path).count() == 0 and unigram.count_tokens(empty, uni).count() == 0
    assert urlfilter.filter_urls(pages).count() == 0
    assert preference.classify(empty, preference.train(empty, labels)).count() == 0
    assert decontam.leaks(empty, decontam.fitted(empty, bench)).count() == 0
    assert dartminhash.near_duplicates(empty).count() == 0
    assert linerules.line_clean(empty).count() == 0


def test_registry_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]
