"""Host rules, word splitting and verdicts."""

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revq.llm import urls

SCHEMA = "page_id long, url string"


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


def rule(host, path):
    fitting = [
        (len(h + p), h + p, verdict) for h, p, verdict in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fitting)[1:] if fitting else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/ES/x", "http://example.org/es/x", "https://a.example.org/en/12?q#f",
    "http://example.org", "http://x.com/fr/", "http://x.com/de/1", "http://com/de/1", "http://notcom/de/1", "http://a.org?x=/es/",
    "x://ÀB.Com/fr/é#t", "http://a.com/x?u=http://b.org/es/", "http://a.net/y\nz", "http://example.org.evil.net/es/", "a://b://c/d",
]


def model(**counts):
    total = sum(counts.values())
    return urls.Model({w: math.log(c / total) for w, c in counts.items()}, math.log(10 / total), {}, 0.0, -1.0)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), SCHEMA).withColumns({"host": F.lit(1), "rule": F.lit(2)})
    rows = urls.judge(pages, model(a=1)).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = split(URLS[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or "allow")


def test_best_split_equals_all_splits():
    m = model(cheap=50, pills=30, ch=5, eap=5, pill=20, s=3, now=10, casino=9, win=20, cas=4, inow=1)

    def score(words):
        return sum(m.words.get(w, m.unknown - len(w) * math.log(10)) for w in words)

    for name in ("cheappills", "casinowin", "winnow", "xcheap", "zzz", "chpills", ""):
        every = [
            [name[a:b] for a, b in itertools.pairwise([0, *cuts, len(name)])]
            for n in range(len(name))
            for cuts in itertools.combinations(range(1, len(name)), n)
        ] or [[]]
        assert score(m.split(name)) == pytest.approx(max(map(score, every)))
    assert m.split("cheappills") == ["cheap", "pills"]


def test_concatenated_names_are_judged_by_their_words(spark):
    good = [f"http://garden-{w}.net/en/{i}" for i in range(40) for w in ("books", "plants")]
    bad = [f"http://{w}.net/en/{i}" for i in range(20) for w in ("casino-royal", "royal-bets")]
    odd = ["http://royalcasino.net/en/x", "http://plantsgarden.net/en/x", None]
    pages = spark.createDataFrame(list(enumerate(good + bad + odd)), SCHEMA)
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, urls.fit(pages)).collect()}
    assert [verdicts[i] for i in range(len(good))] == ["allow"] * len(good)
    assert [verdicts[len(good) + i] for i in range(len(bad) + 3)] == ["block"] * (len(bad) + 1) + ["allow"] * 2


def test_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert urls.judge(pages, urls.fit(pages)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/x")] * 2 + [(None, None)], SCHEMA)
    rows = urls.judge(twice, urls.fit(twice)).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and {r.verdict for r in rows} == {"allow"}


def test_all_urls_decide_not_a_sample(spark):
    hosts = ["garden-books.net", "garden-plants.net", "daily-news.net"]
    rows = [f"http://{hosts[i % 3]}/en/{i}" for i in range(24_000)] + ["http://viagra.net/en/x", "http://cheap-viagra.net/buy"]
    pages = spark.createDataFrame(list(enumerate([*rows, rows[-1]])), SCHEMA)
    fitted = urls.fit(pages)
    known = urls.Model({r.word: r.p for r in fitted.words.collect()}, fitted.unknown, {}, 0.0, 0.0)

    def tokens(url):
        return [
            f"{kind}:{w}" for kind, text in zip("hp", split(url), strict=True)
            for name in "".join(c if c.isalpha() else " " for c in text).split() for w in known.split(name)
        ]

    seen, n = {True: Counter(), False: Counter()}, Counter()
    for url in rows:
        bad = "viagra" in url
        seen[bad].update(tokens(url))
        n[bad] += 1
    names = seen[True] | seen[False]
    sums = {k: v.total() + len(names) + 1 for k, v in seen.items()}
    got = {r.page_id: r.log_odds for r in urls.judge(pages, fitted).collect()}
    assert len(got) == len(rows) + 1
    for i in (0, 1, 2, 24_000, 24_001, 24_002):
        want = math.log(n[True] / n[False]) + sum(
            math.log((seen[True][t] + 1) / sums[True]) - math.log((seen[False][t] + 1) / sums[False])
            for t in tokens(([*rows, rows[-1]])[i])
        )
        assert got[i] == pytest.approx(want)


def test_no_counted_word_is_dropped(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = ["q" + "".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 50_100)]
    rows = [f"http://a.net/{'/'.join(many[i::100])}" for i in range(100)]
    stem = "abcdefghijklmnopqrstuvwx"
    long = [stem, stem + "yz", stem + "yzyz", stem[1:] + "yzyz", "z" * 60]
    rows += [f"http://{w}.net/x/{w}" for w in long] + [f"http://xx{stem}yzyzqaaab.net/{'z' * 70}/qaaabqzzzz"]
    pages = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    fitted = urls.fit(pages)
    words = {r.word: r.p for r in fitted.words.collect()}
    assert set(many) | set(long) <= set(words)

    block = pages.where("page_id >= 100").select(
        F.lit(0).cast("long").alias("block"),
        urls._names(urls.host_of(F.col("url"))).alias("host_names"), urls._names(urls.path_of(F.col("url"))).alias("path_names"),
    )
    names = {n for r in block.collect() for n in (*r.host_names, *r.path_names)}
    held = {r.word: r.p for r in urls._words_of(block, fitted.words).collect()}
    assert held == {w: p for w, p in words.items() if any(w in n for n in names)}

    known = urls.Model(held, fitted.unknown, {}, 0.0, 0.0)
    cost = lambda w: words.get(w, fitted.unknown - len(w) * math.log(10))
    for name in names:
        best = [0.0] + [-math.inf] * len(name)
        for a, b in sorted(itertools.combinations(range(len(name) + 1), 2)):
            best[b] = max(best[b], best[a] + cost(name[a:b]))
        parts = known.split(name)
        assert "".join(parts) == name and sum(map(cost, parts)) == pytest.approx(best[-1])
    assert known.split(stem + "yzyz") == [stem + "yzyz"]
