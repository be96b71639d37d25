"""Operators beyond the registered queries: sources, sinks, streams, state, configuration, small crawls."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators import archive, config, cookies, crawl, crawl_log, images, manifest, policy, robots, state
from pagemill.sources import files
from pagemill.streaming import policies

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("body", "declared", "text", "charset"),
    [
        ("é".encode(), None, "é", "utf-8"), (b'<meta charset="windows-1252">\xe9', None, '<meta charset="windows-1252">é', "cp1252"), (b"\xef\xbb\xbfa", None, "a", "utf-8-sig"),
        (b'<meta charset="utf-8">\xe9', "iso-8859-1", '<meta charset="utf-8">é', "iso8859-1"), (b"\xe9", None, "é", "cp1252"), ("a".encode("utf-16"), None, "a", "utf-16"),
    ],
)
def test_charsets(body, declared, text, charset):
    assert files.decode_html(body, declared) == (text, charset, None)


def test_bad_charsets():
    assert "unknown charset" in files.decode_html(b"x", "not-a-codec")[2]
    assert "not valid utf-8" in files.decode_html(b"\xff", "utf-8")[2]
    assert files.decode_html(b"\x81")[2]


def test_responses(spark):
    rows = [
        ("a", 200, {"Content-Type": "text/html; charset=utf-8"}, b"<p>x"), ("b", 200, {"content-type": "image/png"}, b"x"), ("c", 200, {}, b"<p>y"), ("d", 404, {}, b"x"), ("e", 200, {}, b"  "), ("f", 200, {}, None),
        ("g", 200, {}, b"x" * 100),
    ]
    d = spark.createDataFrame([(u, u, s, h, c) for u, s, h, c in rows], "requested_url string, final_url string, status_code int, headers map<string,string>, content binary")
    got = {r["requested_url"]: (r["html"], r["media_type"], r["error"]) for r in files.pages_from_responses(d, 50).collect()}
    assert got["a"] == ("<p>x", "text/html", None) and got["c"][0] == "<p>y"
    assert got["b"][2] == "expected HTML, received image/png" and got["d"][2] == "HTTP 404" and got["e"][2] == "empty page" and got["f"][2] and got["g"][2]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é</p>", "utf-8")
    (tmp_path / "b.html").write_bytes(b"\xff")
    (tmp_path / "c.html").write_text(" \n")
    got = {r["url"].rsplit("/")[-1]: (r["html"], r["error"]) for r in files.local_pages(spark, f"{tmp_path}/*.html").collect()}
    assert got == {"a.html": ("<p>é</p>", None), "b.html": (None, "not valid UTF-8"), "c.html": (None, "empty page")}
    assert files.link_lists(spark, f"{tmp_path}/*.html", lenient=True).count() == 2
    d = spark.createDataFrame([("h/a.md", "A"), ("../x.md", "B"), ("h/n.md", None)], "output_path string, markdown string")
    errors = {r["output_path"]: r["error"] for r in files.write_markdown(d, f"file://{tmp_path}/out").collect()}
    assert errors["h/a.md"] is None and errors["../x.md"] and errors["h/n.md"]
    assert (tmp_path / "out/h/a.md").read_text() == "A" and [p.name for p in (tmp_path / "out/h").iterdir()] == ["a.md"]


def test_identities(spark):
    rows = ["HTTPS://Example.COM:443/docs/page?view=full#part", "http://example.com:80", "https://bücher.example/", "http://[::1]:8080/x", "ftp://x", None, "http://a..b/", "http://e.org:0/"]
    got = {r["url"]: r["identity"] for r in U.with_identity(spark.createDataFrame([(u,) for u in rows], "url string")).collect()}
    assert got[rows[0]] == "https://example.com/docs/page?view=full" and got[rows[1]] == "http://example.com/"
    assert got[rows[2]] == "https://xn--bcher-kva.example/" and got["ftp://x"] is None and got[rows[6]] is None


def test_relative_paths(spark):
    d = spark.createDataFrame([("a/b/c.md", "a/b/d.md"), ("a/c.md", "a/b/d.md"), ("c.md", "a/d.md"), ("x/y.md", "d.md")], "t string, s string")
    assert [r[0] for r in d.select(U.relative_path(F.col("t"), F.col("s"))).collect()] == ["c.md", "../c.md", "../c.md", "x/y.md"]


def test_rewrite(spark):
    docs = spark.createDataFrame([(1, "e.org/a.md", "[x](https://e.org/b?q=1#f) [y](https://e.org/c?z) [w](https://other.org/) ![i](https://e.org/b)")], "doc int, output_path string, markdown string")
    names = spark.createDataFrame([("https://e.org/b", "e.org/b.md"), ("https://e.org/c?z", "e.org/c.md")], "identity string, output_path string")
    assert archive.rewrite(docs, names).first()["markdown"] == "[x](b.md?q=1#f) [y](c.md) [w](https://other.org/) ![i](https://e.org/b)"


def queue_crawl(seeds, answers, links, start, max_depth, max_pages, allowed, done=(), attempted=0, scope=lambda u, base: True):
    """The same crawl with a queue, one page after another."""
    queue, seen, made, base = [s for s in seeds if s[0] not in done], {s[0] for s in seeds} | set(done), [], start
    while queue and attempted < max_pages:
        url, depth, retries = queue.pop(0)
        attempted += 1
        status, final, hops = (answers.get(url) or [(None, None, [])])[min(retries, max(len(answers.get(url, [])) - 1, 0))]
        if not allowed(url):
            made.append((url, depth, "blocked"))
            continue
        targets = {h for h in [*(hops or []), final] if h and h != url}
        if not all(map(allowed, targets)) or (url != start or depth) and not all(scope(h, base) for h in targets):
            made.append((url, depth, "failed"))
        elif status == 429 and retries < crawl.RETRIES:
            made.append((url, depth, "retry"))
            queue.append((url, depth, retries + 1))
        elif status is None or not 200 <= status < 400:
            made.append((url, depth, "failed"))
        else:
            made.append((url, depth, "processed"))
            base = final if url == start and not depth else base
            for target in links.get(url, []) if depth < max_depth else []:
                if target not in seen and scope(target, base) and allowed(target):
                    seen.add(target)
                    queue.append((target, depth + 1, 0))
    return made, queue


def as_tables(spark, seeds, answers, links):
    return (
        spark.createDataFrame([(*s, k) for k, s in enumerate(seeds)], "url string, depth int, retries int, ordinal int"),
        spark.createDataFrame([(u, k + 1, *a) for u, rows in answers.items() for k, a in enumerate(rows)], "url string, attempt int, status int, final_url string, hops array<string>"),
        spark.createDataFrame([(u, k, t) for u, ts in links.items() for k, t in enumerate(ts)], "url string, pos int, target string"),
    )


def did(run):
    return [(r["url"], r["depth"], r["outcome"]) for r in run.attempts.orderBy("rank").collect()], [(r["url"], r["depth"], r["retries"]) for r in run.queue.orderBy("place").collect()]


def random_site(spark, seed):
    """Pages that answer in every way: retries, failures, redirects in and out of the scope and to where robots rules forbid, told by hops or by the
    final address alone; the start page's own redirect moves the scope."""
    import random

    r = random.Random(seed)
    site = lambda k: f"https://{'www.' * (k % 3 == 1)}e.org/{k}" if k % 7 else f"https://other.org/{k}"
    urls = [site(k) for k in range(1, 40)]
    links = {u: r.sample(urls, 4) + [u] for u in urls}
    answers = {u: [(r.choice([200, 200, 200, 429, 404, 500]), u, [])] for u in urls} | {u: [(429, u, []), (200, u, [])] for u in urls[5::9]} | {u: [(200, "https://other.org/", ["https://other.org/"])] for u in urls[7::11]}
    blocked = set(urls[3::8])
    answers |= {u: [(200, r.choice(urls), None if k % 2 else [r.choice(urls)])] for k, u in enumerate(urls[2::5])} | {urls[9]: [(429, sorted(blocked)[0], [])], urls[10]: [(200, None, [sorted(blocked)[1], urls[10]])]}
    start = urls[1]
    answers[start] = [(200, "https://e.org/start" if seed % 2 else start, [])]
    robots = spark.createDataFrame([(u, False) for u in blocked], "url string, allowed boolean")
    scope = lambda u, base: u.split("/")[2] == base.split("/")[2] or u.split("/")[2].endswith("." + base.split("/")[2])
    return start, answers, links, robots, (lambda u: u not in blocked), scope


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_equals_a_queue(spark, seed):
    start, answers, links, robots, allowed, scope = random_site(spark, seed)
    for max_pages in (9, 100):
        want, queue = queue_crawl([(start, 0, 0)], answers, links, start, 3, max_pages, allowed, scope=scope)
        run = crawl.crawl(*as_tables(spark, [(start, 0, 0)], answers, links), start, "subdomain", 3, max_pages, robots)
        assert did(run) == (want, queue)


@pytest.mark.parametrize("seed", [3])
def test_a_killed_crawl_ends_as_an_unbroken_one(spark, tmp_path, seed, monkeypatch):
    """Killed after every round, and in the middle of one: what it had written is there without its commit. Budgets grow from run to run."""
    monkeypatch.setattr(crawl_log, "PARTS", 3)
    monkeypatch.setattr(crawl_log, "CHECKPOINT_PAGES", 6)
    start, answers, links, robots, allowed, scope = random_site(spark, seed)
    tables = as_tables(spark, [(start, 0, 0)], answers, links)
    folder = f"file://{tmp_path}/log"
    put = crawl_log.CrawlLog._put
    for k, budget in enumerate([1, 4, 9, 100, 100]):
        if k == 3:  # dies as it commits

            def die(*_):
                raise KeyboardInterrupt

            monkeypatch.setattr(crawl_log.CrawlLog, "_put", die)
            with pytest.raises(KeyboardInterrupt):
                crawl.crawl(*tables, start, "subdomain", 3, budget, robots, log=folder)
            monkeypatch.setattr(crawl_log.CrawlLog, "_put", put)
        run = crawl.crawl(*tables, start, "subdomain", 3, budget, robots, log=folder, rounds=1)
        if k == 1:
            assert run.attempts.count() <= 4
    run = crawl.crawl(*tables, start, "subdomain", 3, 100, robots, log=folder)
    want, queue = queue_crawl([(start, 0, 0)], answers, links, start, 3, 100, allowed, scope=scope)
    assert did(run) == (want, queue) and queue == []
    assert run.scope == (answers[start][0][1])
    with pytest.raises(ValueError, match="is of a crawl"):
        crawl.crawl(*tables, "https://else.org/", log=folder)
    log = crawl_log.CrawlLog(spark, folder)
    assert len(log.last()["attempts"]) <= 3 and not [p for p in (tmp_path / "log/commits").iterdir() if p.name.startswith("_")]


def test_the_log_keeps_ten_checkpoints(spark, tmp_path):
    log = crawl_log.CrawlLog(spark, f"file://{tmp_path}/log", pages=1)
    rows = spark.createDataFrame([(1, "u", 0, 0, 200, "u", "processed")], crawl_log.ATTEMPTS)
    state = None
    for k in range(15):
        part = log.new_part()
        for name in ("queue", "seen"):
            log.write(part, name, rows)
        if state is None:
            state = log.begin(part, start="s", scope="s", placed=1, queued=1)
        else:
            log.write(part, "attempts", rows)
            state = log.append(state, part, 1 if k != 7 else 0, scope="s", placed=1)
    assert len(state["checkpoints"]) == 10 and state["round"] == 14 and state["attempted"] == 13
    assert log.commits() == [c["round"] for c in state["checkpoints"]] == [*range(4, 7), *range(8, 15)]
    assert {c["trigger"] for c in state["checkpoints"]} == {"pages"}
    assert log.table(log.last(), "attempts").count() == 14 and log.table(log.read(4), "seen").count() == 5
    with pytest.raises(RuntimeError, match="another crawl"):
        log._put(log.last(), None)
    timed = crawl_log.CrawlLog(spark, f"file://{tmp_path}/timed", seconds=-1)
    part = timed.new_part()
    timed.write(part, "queue", rows)
    timed.write(part, "seen", rows)
    timed.write(part, "attempts", rows)
    state = timed.append(timed.begin(part, start="s", scope="s", placed=1, queued=1), part, 1, scope="s", placed=1)
    assert [c["trigger"] for c in state["checkpoints"]] == ["start", "time"]


def test_redirects_of_a_crawl(spark):
    """Redirects to where robots rules forbid, and final addresses out of the scope without a hop told, are failures; so is a start page that is led there."""
    a, b, c, d = "https://e.org/", "https://e.org/b", "https://e.org/c", "https://e.org/d"
    robots = spark.createDataFrame([("https://e.org/private", False)], "url string, allowed boolean")
    answers = {a: [(200, a, [])], b: [(200, "https://e.org/private#x", ["https://e.org/private#x"])], c: [(200, "https://x.org/", None)], d: [(200, "https://e.org/e", ["https://e.org/e"])]}
    run = crawl.crawl(*as_tables(spark, [(a, 0, 0)], answers, {a: [b, c, d, "https://e.org/private"]}), a, "host-only", robots=robots)
    assert did(run)[0] == [(a, 0, "processed"), (b, 1, "failed"), (c, 1, "failed"), (d, 1, "processed")]
    run = crawl.crawl(*as_tables(spark, [(a, 0, 0)], {a: [(200, "https://e.org/private", None)]}, {a: [b]}), a, robots=robots)
    assert did(run)[0] == [(a, 0, "failed")] and run.scope == a


def test_crawl_goes_on(spark):
    """A page that always answers 429, with a budget of one attempt more in each run, is failed at the third; as a queue has it."""
    u, tables = "https://e.org/", lambda seeds: as_tables(spark, seeds, {"https://e.org/": [(429, None, [])]}, {"https://e.org/": ["https://e.org/b"]})
    seeds, outcomes = [(u, 0, 0)], []
    for budget in (1, 2, 3):
        run = crawl.crawl(*tables(seeds), u, max_pages=budget, attempted=len(outcomes))
        made, seeds = did(run)
        outcomes += [m[2] for m in made]
    assert outcomes == ["retry", "retry", "failed"] and seeds == []
    done = spark.createDataFrame([(u,)], "url string")
    assert did(crawl.crawl(*tables([(u, 0, 0)]), u, done=done, attempted=1)) == ([], [])


def test_crawl_scope_follows_the_start_page(spark):
    a, b, c = "https://e.org/", "https://www.e.net/", "https://www.e.net/x"
    run = crawl.crawl(*as_tables(spark, [(a, 0, 0)], {a: [(200, b, [b])], c: [(200, c, [])]}, {a: [c, "https://e.org/y"]}), a, "host-only")
    assert did(run)[0] == [(a, 0, "processed"), (c, 1, "processed")] and run.scope == b
    assert run.result().first()["message"] == "completed"


def plain_manifest(pages):
    """Claims in their order, one page after another; path is what an identity's own file is called."""
    found, out, clashes = {}, [], set()
    for ordinal, requested, final in pages:
        new = final not in found
        path = found.setdefault(final, f"file of {final}")
        if found.setdefault(requested, path) != path:
            clashes.add((requested, found[requested], path, ordinal))
        out.append((ordinal, final, path, not new))
    return found, out, clashes


@pytest.mark.parametrize("parts", [1, 4])
def test_manifest_in_parts(spark, tmp_path, parts, monkeypatch):
    """Chains of aliases, conflicts, popular identities and invalid urls; more runs than are kept apart, a filter that outgrows its size."""
    import random

    monkeypatch.setattr(manifest, "MERGE", 2)
    monkeypatch.setattr(manifest, "output_path", lambda identity, layout: F.concat(F.lit("file of "), identity))
    r = random.Random(7)
    url = lambda: f"https://e.org/{r.choice([0, r.randrange(40), r.randrange(900)])}"
    pages = [(k, url(), url()) for k in range(420)]
    found, want, clashes = plain_manifest(pages)
    folder = f"file://{tmp_path}/m"
    got, conflicts = [], set()
    size = -(-len(pages) // parts)
    for k in range(parts):
        part = [(o, a.upper().replace("HTTPS", "https").replace("E.ORG", "E.org"), f + "#x") for o, a, f in pages[k * size : (k + 1) * size]] + [(1000 + k, "nothing", "https://e.org/1")]
        made = manifest.Manifest(spark, folder, buckets=4, capacity=100).archive(spark.createDataFrame(part, "ordinal int, requested_url string, final_url string"))
        rows = made.pages.collect()
        assert [r["error"] for r in rows if r["ordinal"] >= 1000] == ["not an HTTP(S) url without credentials"]
        got += [(r["ordinal"], r["identity"], r["output_path"], r["reused"]) for r in rows if r["ordinal"] < 1000]
        conflicts |= {tuple(r) for r in made.conflicts.collect()}
    assert sorted(got) == want and conflicts == clashes and clashes
    kept = manifest.Manifest(spark, folder)
    assert {r["identity"]: r["output_path"] for r in kept.table().collect()} == found
    assert kept.state["identities"] == len(found) and len(kept.state["runs"]) == {1: 1, 4: 2}[parts] and kept.state["buckets"] == 4
    asked = spark.createDataFrame([("https://e.org/0#f",), ("https://e.org/none",), ("nothing",)], "url string")
    assert {r["url"]: r["output_path"] for r in kept.resolve(asked).collect()} == {"https://e.org/0#f": found.get("https://e.org/0"), "https://e.org/none": None, "nothing": None}


def test_manifest_reads_its_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    page = lambda ids: spark.createDataFrame([(k, f"https://e.org/{k}", f"https://e.org/{k}") for k in ids], "ordinal int, requested_url string, final_url string")
    manifest.Manifest(spark, folder, buckets=4, capacity=5000).archive(page(range(3000)))
    kept = manifest.Manifest(spark, folder)
    # what the filter lets through: all that are there, few of the others
    ids = kept.table().select("identity").unionByName(spark.range(3000).select(F.concat(F.lit("https://no.org/"), F.col("id").cast("string")).alias("identity")))
    rows = manifest.maybe_in(ids, kept._filter(), 4, kept.state["words"]).groupBy(F.col("identity").startswith("https://e.org").alias("there"), "maybe").count().collect()
    counts = {(r["there"], r["maybe"]): r["count"] for r in rows}
    assert counts[(True, True)] == 3000 and (True, False) not in counts and counts.get((False, True), 0) < 100
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.known(page(range(10)).select(F.col("final_url").alias("identity")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan[plan.rindex("SortMergeJoin") :]
    assert "Bucketed: true" in scan
    below = scan[: scan.index("Bucketed: true")].splitlines()[-1]
    above = [line for line in scan.splitlines()[: len(scan[: scan.index("Bucketed: true")].splitlines())] if "Exchange" in line]
    assert all(line.index("Exchange") != below.index("FileScan") for line in above) and "SelectedBucketsCount: 4 out of 4" in scan
    # a run that was killed before its commit leaves nothing that counts
    torn = manifest.Manifest(spark, folder)
    torn._insert(2, "SELECT 'https://e.org/torn' AS identity, 'x' AS output_path")
    again = manifest.Manifest(spark, folder)
    assert again.table().count() == 3000
    again.archive(page(range(2990, 3010)))
    assert manifest.Manifest(spark, folder).table().count() == 3010
    with pytest.raises(RuntimeError, match="another run"):
        torn.archive(page([1]))


def test_image_names_never_meet(spark):
    rows = [("a.png",), ("x/a.png",), ("a_1.png",), ("a.gif",), ("y/a.png",), ("n" * 300 + ".png",), ("m/" + "n" * 300 + ".png",), ("a_1_1.png",)]
    d = spark.createDataFrame([(1, k, f"https://e.org/{u}", "image/gif" if u.endswith("gif") else "image/png") for k, (u,) in enumerate(rows)], "doc int, pos int, url string, mime string")
    got = [r["filename"] for r in images.unique_names(d, "doc").orderBy("pos").collect()]
    assert got == ["a.png", "a_1.png", "a_1_1.png", "a.gif", "a_2.png", "n" * 196 + ".png", "n" * 194 + "_1.png", "a_1_1_1.png"]


def test_redaction_of_addresses(spark):
    texts = {
        "go https://me:pw@h.org/x?a=1 now": "go https://[REDACTED]@h.org/x?a=1 now", "https://h.org/?token=1&b=2;sig=3#state=4": "https://h.org/?token=[REDACTED]&b=2;sig=[REDACTED]#state=[REDACTED]",
        "HTTPS://u@H.org": "https://[REDACTED]@H.org", "https://h.org/?a=b#": "https://h.org/?a=b#", "https://[::1]:8/?api%5Fkey=1": "https://[::1]:8/?api%5Fkey=[REDACTED]", "https://u@[x/y": "https://u@[x/y",
        "no address": "no address", None: None, "'https://a@b.c','https://d.e'": "'https://[REDACTED]@b.c','https://d.e'",
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.redact_addresses(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == texts
    m = spark.range(1).select(X.redact_mapping(F.create_map(F.lit("u"), F.lit("https://me:pw@h.org/x?a=1"), F.lit("password"), F.lit("x"))).alias("m")).first()["m"]
    assert m == {"u": "https://[REDACTED]@h.org/x?a=1", "password": "[REDACTED]"}


def test_archives_of_hosts_in_any_script(spark):
    rows = [(0, "https://bücher.example/x", "https://bücher.example/x#y"), (1, "https://xn--bcher-kva.example/x", "https://xn--bcher-kva.example/x"), (2, "nothing", "nothing")]
    d = spark.createDataFrame(rows, "ordinal bigint, requested_url string, final_url string")
    got = {r["ordinal"]: (r["identity"], r["reused"], r["error"] is None) for r in archive.archive_once(d).collect()}
    assert got[0] == ("https://xn--bcher-kva.example/x", False, True) and got[1] == ("https://xn--bcher-kva.example/x", True, True) and got[2][0] is None and not got[2][2]
    first = archive.batch_urls([d.where("ordinal < 2").select("ordinal", F.col("final_url").alias("url"))]).collect()
    assert [(r["identity"], r["ordinal"]) for r in first] == [("https://xn--bcher-kva.example/x", 0)]
    names = archive.aliases(archive.archive_once(d))
    docs = spark.createDataFrame([(1, "xn--bcher-kva.example/a.md", "[x](https://bücher.example/x?q=1#f)")], "doc int, output_path string, markdown string")
    assert archive.rewrite(docs, names).first()["markdown"].startswith("[x](x-")


@pytest.mark.parametrize("bad", [{"max_depth": -1}, {"max_pages": 0}, {"delay": float("inf")}, {"rate_limit": 0}, {"rule": "("}])
def test_crawl_policy(bad):
    with pytest.raises(Exception):  # noqa: B017
        U.check_crawl_policy(**bad)


def test_breaker():
    b = policy.Breaker(policy.Limits(failures=2, recovery=10, tests=2))
    assert [b.ask(True, t) for t in (0, 1, 2)] == [True, True, False] and b.state == "OPEN" and b.failures == 2
    assert not b.on(policy.ASKED, 10.9) and b.ask(False, 11) and b.state == "HALF_OPEN"
    assert b.ask(False, 12) and b.state == "CLOSED" and b.failures == 0
    assert b.ask(True, 13) and b.ask(False, 14) and b.failures == 0 and b.ask(False, 15) and b.failures == 0
    b = policy.Breaker(policy.Limits(failures=1, recovery=5, tests=2))
    assert b.ask(True, 0) and b.ask(True, 5) and b.state == "OPEN" and not b.ask(False, 9) and b.ask(False, 10) and b.state == "HALF_OPEN"
    assert set(policy.Breaker(held={"state": "OPEN"}).held) == {"state", "failures", "blamed_at", "passed"}
    assert all(g in policy.GUARDS and e in policy.EFFECTS for rules in policy.RULES.values() for g, _, e in rules)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", (F.col("value") < 50).alias("failed"))
    for k in range(3):  # in the order of time, so that batches meet in it
        events.orderBy("ts", "event_id").withColumn("k", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))).where(F.col("k") == k + 1).drop("k").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    limits = policy.Limits(requests_per_minute=2, window=86400.0, failures=2, recovery=3600.0, tests=1)
    for name, batch, stream in (("a", policy.admissions, policies.admissions), ("b", policy.breaker_states, policies.breaker_states)):
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = stream(source, "user_id", limits).writeStream.format("memory").queryName(f"policy_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c{name}").start()
        q.processAllAvailable()
        q.stop()
        got = {tuple(r) for r in spark.table(f"policy_{name}").collect()}
        assert got == {tuple(r) for r in batch(events, "user_id", limits).collect()}


def test_state_store(spark, tmp_path):
    store = state.StateStore(spark, f"{tmp_path}/s")
    row = spark.createDataFrame([('{"crawl_id":"crawl-0001","last_checkpoint":"2024","progress":{"urls_visited":{"u":"f"}}}',)], "j string").select(F.from_json("j", state.SCHEMA).alias("s")).select("s.*")
    store.save(row, "crawl-0001")
    new = store.import_state(row)
    assert store.resolve("crawl-00") == "crawl-0001" and store.load(new).first()["attempted_count"] == 1
    assert store.listing().count() == 2
    later = row.withColumn("start_url", F.lit("later"))
    store.save(later, "crawl-0001")
    assert {p.name for p in (tmp_path / "s").glob("crawl-0001.*")} == {"crawl-0001.json", "crawl-0001.bak"}
    assert store.load("crawl-0001").first()["start_url"] == "later"
    store.export("crawl-0001", f"{tmp_path}/out/e.json")
    assert '"later"' in (tmp_path / "out/e.json").read_text()
    for broken in ("{", '{"crawl_id":"another"}', '{"crawl_id":"crawl-0001","version":"9"}'):  # the backup is there for each of these
        (tmp_path / "s/.crawl-0001.json.crc").unlink(missing_ok=True)
        (tmp_path / "s/crawl-0001.json").write_text(broken)
        assert [(r["start_url"], r["error"]) for r in store.load("crawl-0001").collect()] == [(None, None)]
    assert store.clean(1, F.current_timestamp()) == 0 and store.clean(-1, F.current_timestamp()) == 2
    assert not [*(tmp_path / "s").glob("*.json"), *(tmp_path / "s").glob("*.bak")]
    for bad in ("../x", "", "craw"):
        with pytest.raises(ValueError):
            store.resolve(bad)
    kept = spark.range(1).select(state.with_checkpoint(F.array(*map(F.lit, range(10))), F.lit(99)).alias("c")).first()["c"]
    assert kept == [*range(1, 10), 99]


def test_config_files(tmp_path):
    place, defaults = tmp_path / "c" / "config.json", {"a": 1, "p": {"q": "x"}}
    assert config.load(defaults, place) == (defaults, None)
    for k in range(8):
        config.save({"a": k}, place)
    assert config.load(defaults, place) == ({"a": 7, "p": {"q": "x"}}, str(place)) and len(list(place.parent.iterdir())) == 6
    assert config.load_private(place) == {"a": 7}
    for bad in ("{", "[]", '{"a": "text"}'):
        place.write_text(bad)
        found, source = config.load(defaults, place)
        assert found["a"] == 6 and source.endswith(".bak.json")
    place.write_text("{")
    with pytest.raises(config.ConfigError):
        config.load_private(place)
    place.write_text('"' + "x" * config.PRIVATE_BYTES + '"')
    with pytest.raises(config.ConfigError):
        config.load_private(place)
    place.write_text("1")
    place.chmod(0o644)
    with pytest.raises(config.ConfigError):
        config.load_private(place)
    (tmp_path / "link").symlink_to(place)
    with pytest.raises(OSError):
        config.load_private(tmp_path / "link")
    assert config.json_safe({1: (place, {2}), "k": None}) == {"1": [str(place), [2]], "k": None}


def test_patterns(spark, tmp_path):
    for n in ("b.md", "a.md", ".hidden.md", "c.txt"):
        (tmp_path / n).write_text("x")
    found, unmatched = files.expand_patterns(spark, [f"{tmp_path}/*.md", f"{tmp_path}/none*", f"{tmp_path}/a.md", f"file:{tmp_path}/c.*"])
    assert found == [f"{tmp_path}/a.md", f"{tmp_path}/b.md", f"{tmp_path}/a.md", f"file:{tmp_path}/c.txt"] and unmatched == [f"{tmp_path}/none*"]


BASES = [
    "http://a/b/c/d;p?q", "https://e.org", "https://e.org/", "https://e.org/x/y/?a=b#c", "HTTP://E.org:80//x//y", "https://u:p@[2001:db8::1%z]:8/a/b", "https://[v1.x]/a", "https://[::1/a", "https://]/a",
    "https://[1.2.3.4]/", "https://[::ffff:1.2.3.4]/q/", "file:///a/b", "ftp://h/a;type=i", "mailto:a@b.c", "data:text/plain,x", "a/b", "/a/../b", "", "?q", "//h/x", "  https://e.org/\ta/b\n", "x:y", "https://\u2100.org/", "svn+ssh://h/a/b",
]
REFERENCES = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
    "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "https:g", "HTTPS://x.org/a/../b", "//[::1]:80/x", "//[::1", "//x]", "//[zz]/", " g ", "g\th", "g//h", "//", "///x", "a//../b", ";", "..;x", "g;", "?", "#", "javascript:x", "é/ü?ß", "/%2e%2e/x",
    "//\uff0f.org/",
]


def test_native_url_join(spark):
    from urllib.parse import urljoin

    def want(b, r):
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    pairs = [(b, r) for b in BASES for r in REFERENCES] + [(None, "x"), ("https://e.org/", None)]
    d = spark.createDataFrame(pairs, "b string, r string").select("b", "r", U.url_join(F.col("b"), F.col("r")).alias("j"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    wrong = [(x["b"], x["r"], x["j"], want(x["b"], x["r"])) for x in d.collect() if x["b"] is not None and x["r"] is not None and x["j"] != want(x["b"], x["r"])]
    assert not wrong, wrong[:10]
    assert d.where("b IS NULL OR r IS NULL").where("j IS NOT NULL").isEmpty()


def test_robots_rules_meet_by_prefixes(spark):
    """A thousand rules an origin: as testing each of them in order; no join but of equal keys."""
    import random

    r = random.Random(4)
    path = lambda n: "/" + "/".join(r.choice("abc") for _ in range(r.randrange(n)))
    rules = {o: [(r.choice(["Allow", "Disallow"]), r.choice([path(7), path(7), path(9), "*" if k == 950 else path(8), "/é", "/a%20b", "/q?x"])) for k in range(1000)] for o in ("https://a.org", "https://b.org")}
    files_ = [(o, 200, "User-agent: *\n" + "\n".join(f"{f}: {p}" for f, p in rs)) for o, rs in rules.items()] + [("https://c.org", 404, None), ("https://d.org", 500, None)]
    urls = [f"{o}{path(12)}" for o in [*rules, "https://c.org", "https://d.org"] for _ in range(150)] + ["https://a.org", "https://a.org/q?x=1", "https://b.org/%C3%A9", "https://b.org/a b", "https://none.org/"]

    def allowed(u):
        o = "/".join(u.split("/")[:3])
        if o not in rules:
            return o == "https://c.org"
        p = (u[len(o) :] or "/").replace("%C3%A9", "é")
        return next((f == "Allow" for f, x in rules[o] if x == "*" or p.startswith(x.replace("%20", " "))), True)

    d = robots.decisions(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(files_, "origin string, status int, content string"), "mill")
    assert {x["url"]: x["allowed"] for x in d.collect()} == {u: allowed(u) for u in urls}
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in d._jdf.queryExecution().executedPlan().toString()


def test_robots_contents(spark):
    rows = spark.createDataFrame([("a", 200, "x"), ("b", 404, "y"), ("c", 503, "z"), ("d", None, None), ("e", 204, None)], "origin string, status int, body string")
    assert {r["origin"]: r["content"] for r in robots.contents(rows).collect()} == {"a": "x", "b": "", "c": None, "d": None, "e": ""}


def test_cookie_mapping_needs_a_host(spark):
    rows = spark.createDataFrame([(1, ' {"a": "1"}'), (2, None), (3, "[]")], "export_id int, json string")
    assert [(r["name"], r["domain"], r["host_only"]) for r in cookies.from_export(rows, "e.org").collect()] == [("a", "e.org", True)]
    with pytest.raises(Exception, match="target host"):
        cookies.from_export(rows).collect()


def _executions(spark) -> list[int]:
    """Those that the session remembers: not all of a long one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(k).executionId() for k in range(runs.size())]


def _joined(spark, since: int) -> int:
    """Rows that the joins of later executions have made."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for run in (x for x in _executions(spark) if x > since):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if "Join" in node.name() else ():
                value = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and value.isDefined():
                    total += int(value.get().replace(",", ""))
    return total


def test_cookie_headers_are_not_made_url_by_url(spark):
    n = 400
    jar = spark.range(n).selectExpr("id AS pos", "'c' AS name", "CAST(id AS string) AS value", "'e.org' AS domain", "IF(id % 2 = 0, '/', '/en') AS path", "CAST(NULL AS bigint) AS expires", "id % 3 = 0 AS secure", "true AS host_only")
    asked = spark.range(2 * n).selectExpr("concat(IF(id % 3 = 0, 'https', 'http'), '://e.org/', IF(id % 4 = 0, 'en/', 'english/'), id % 400) AS url")
    since = max(_executions(spark), default=-1)
    got = {r["url"]: r["header"] for r in cookies.cookie_header(asked, jar, F.lit(100)).collect()}
    assert 0 < _joined(spark, since) < 30 * n
    assert len(got) == asked.distinct().count()
    for url, header in got.items():
        sent = [k for k in range(n) if (k % 3 or url.startswith("https:")) and (k % 2 == 0 or "/en/" in url)]
        assert header == "; ".join(f"c={k}" for k in sorted(sent, key=lambda k: (k % 2 == 0, k)))


def test_config(spark):
    defaults = {"crawl": {"depth": 3, "delay": 0.5, "polite": False}, "out": "x", "headers": {}}
    merged = config.merge(defaults, {"crawl": {"depth": 5}, "new": 1, "headers": {"A": "b"}})
    assert merged == {"crawl": {"depth": 5, "delay": 0.5, "polite": False}, "out": "x", "new": 1, "headers": {"A": "b"}}
    with pytest.raises(config.ConfigError):
        config.merge(defaults, {"crawl": {"depth": "x"}})
    assert config.merge(defaults, {"crawl": {"depth": "x"}}, strict=False)["crawl"]["depth"] == 3
    assert config.get_path(merged, "crawl.depth") == 5 and config.parse_value("yes", True) is True and config.parse_value("[1]", None) == [1]
    with pytest.raises(config.ConfigError):
        config.get_path(merged, "a..b")
    rows = {r["path"]: r["value"] for r in config.merged_leaves(config.leaves(spark, defaults), config.leaves(spark, {"crawl": {"depth": 5}})).collect()}
    assert rows["crawl.depth"] == "5" and rows["out"] == '"x"'


def test_small_facts(spark):
    """Rows by hand of what the queries derive from large tables."""
    sets = [("a.png 1x, b.png 2x", "a.png 1x, b.png 2x", 2), ("a.png", "a.png", 1), ("", "", 0), ("data:image/png;base64,AA, b", "data:image/png;base64,AA, b", 1), ("  a.png   100w ,, b.png ", "a.png 100w, b.png", 2)]
    d = spark.createDataFrame(sets, "v string, s string, n int").select("*", U.parse_srcset(F.col("v")).alias("c"))
    assert all(r["s"] == r["t"] and r["n"] == r["m"] for r in d.select("s", "n", U.format_srcset(F.col("c")).alias("t"), F.size("c").alias("m")).collect())
    types = [("text/html; charset=UTF-8", "text/html", "UTF-8"), ("TEXT/HTML", "text/html", None), ('application/xhtml+xml; q=1; Charset="iso-8859-1"', "application/xhtml+xml", "iso-8859-1"), ("", "", None)]
    d = spark.createDataFrame(types, "h string, m string, c string").select("m", "c", X.content_type(F.create_map(F.lit("Content-Type"), F.col("h"))).alias("t"))
    assert all((r["m"], r["c"]) == tuple(r["t"]) for r in d.collect())
    jar = [(0, "a", "1", "e.org", "/", None, False, True), (1, "b", "2", ".e.org", "/docs", None, False, False), (2, "c", "3", ".e.org", "/", 50, False, False), (3, "d", "4", ".e.org", "/", None, True, False), (4, "x", "5", "other.org", "/", None, False, True)]
    jar = spark.createDataFrame(jar, "pos int, name string, value string, domain string, path string, expires bigint, secure boolean, host_only boolean")
    asked = spark.createDataFrame([(u,) for u in ("https://e.org/docs/a", "http://sub.e.org/docsx", "http://sub.e.org/docs", "https://evil-e.org/")], "url string")
    assert {r["url"]: r["header"] for r in cookies.cookie_header(asked, jar, F.lit(100)).collect()} == {"https://e.org/docs/a": "b=2; a=1; d=4", "http://sub.e.org/docs": "b=2"}
    sizes = [(1, 0, 30, True), (1, 1, 45, False), (1, 2, 25, True), (1, 3, 40, True), (1, 4, 6, False), (1, 5, 5, True), (2, 0, 10, True)]
    d = images.within_budget(spark.createDataFrame(sizes, "doc int, pos int, size bigint, want boolean"), "doc", 40, 100)
    assert all(r["want"] == r["accepted"] for r in d.collect())
    bots = [
        ("https://a.org", 200, "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: mill\nCrawl-delay: 2\nDisallow: /private\nAllow: /"), ("https://b.org", 404, ""), ("https://c.org", 503, None),
        ("https://d.org", 200, "User-agent: not-mill\nDisallow: /\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: x\nCrawl-delay: 1.5\nDisallow: /x # c"), ("https://e.org", 200, ""),
    ]
    bots = spark.createDataFrame(bots, "origin string, status int, content string")
    want = {"https://a.org/private/1": False, "https://a.org/a": True, "https://b.org/x": True, "https://c.org/x": False, "https://d.org/xy": False, "https://d.org/y": True, "https://e.org/": True, "https://f.org/": False}
    assert {r["url"]: r["allowed"] for r in robots.decisions(spark.createDataFrame([(u,) for u in want], "url string"), bots, "mill/1.0").collect()} == want
    assert {r["origin"][8]: r["delay"] for r in robots.crawl_delays(bots, "mill/1.0").collect()} == {"a": 2.0, "b": None, "c": None, "d": 1.5, "e": None}


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from pagemill.session import scratch, shared_folder, stored

    kept = shared_folder(spark, "kept")
    with scratch(spark):
        inner = stored(spark.range(3), "inner")
        with scratch(spark):
            deeper = stored(inner, "deeper").inputFiles()[0]
        assert not Path(deeper.removeprefix("file://")).exists()
        held = inner.inputFiles()[0]
        inner.write.parquet(kept)
    assert not Path(held.removeprefix("file://")).exists() and spark.read.parquet(kept).count() == 3
    assert "scratch" in held and "scratch" not in shared_folder(spark, "x")
