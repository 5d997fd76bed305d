"""Personal data: plain spans against backtracking patterns, disguised ones against examples."""

import hashlib
import random
import re
import time

import corpus
import pytest

from revq.llm import personal, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {
        kind: [m.span() for m in re.finditer(pattern, text) if passes(kind, m.group())]
        for kind, pattern in PATTERNS.items()
    }


@pytest.mark.parametrize("alphabet, length", [
    ("a.@-", 14), ("1.2 5", 18), ("0123456789 -", 40), ("+1 ().-2", 24), ("a1.@+- (5)\n", 30), ("é@a.１1", 14),
])
def test_plain_spans_equal_patterns(alphabet, length):
    rnd = random.Random(length)
    for _ in range(6000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, length)))
        assert personal.plain_spans(text) == brute(text), text


def test_cards_are_found():
    found = personal.plain_spans("pay 4111 1111-1111 1111, 4111111111111112, 41111111111111110000")
    assert found["card"] == [(4, 23)]


def found(text):
    return [(s["kind"], text[s["start"] : s["end"]], s["plain"]) for s in personal.spans(text)]


@pytest.mark.parametrize("kind, disguise", [
    ("email", "ann (at) example [dot] org"),
    ("email", "ann.lee{AT}example.co.uk"),
    ("email", "ann&#64;example&#46;org"),
    ("email", "ann%40example.org"),
    ("email", "ann dot lee at mail dot example dot com"),
    ("email", "ana arroba example punto com"),
    ("email", "ann @ example . org"),
    ("email", "аnn@exаmple.com"),
    ("email", "ann＠example.com"),
    ("email", "ann@exam​ple.com"),
    ("phone", "plus four nine one seven double six five five five one two three"),
    ("phone", "+1 (4O3) 555-l234"),
    ("phone", "plus eins, zwei, drei, vier, fünf, sechs, sieben, acht, neun"),
    ("phone", "plus uno dos tres cuatro cinco seis siete ocho nueve"),
    ("phone", "+١٢٣ 456 7890"),
    ("card", "4111 1111 1111 one one one one"),
    ("card", "４111 1111 1111 1111"),
    ("ip", "one two seven dot zero dot zero dot one"),
    ("ip", "10 dot 0 dot 0 dot 1"),
    ("ip", "10[.]0[.]0[.]1"),
])
def test_disguises(kind, disguise):
    for before, after in (("", ""), ("Write to ", " today, please."), ("né, ", "\nüber")):
        text = before + disguise + after
        assert found(text) == [(kind, disguise, False)], text


@pytest.mark.parametrize("text", [
    "one or two of the three were at the dot", "meet at noon, look at this dot and that", "six one-act plays and ten others",
    "the point of it at last", "un deux trois soleil", "version 1.2.3 and 10 20 30 (see [at] least)", "Привет, мир. Ρώμη",
    "a <b> {c} [d] (e) & #5 100%", "Look @ that", "dot com at once",
])
def test_clean_texts_have_no_spans(text):
    assert personal.spans(text) == []


def test_plain_spans_stay():
    assert found("a@b.co and c [at] d.org, a@b.co") == [
        ("email", "a@b.co", True), ("email", "c [at] d.org", False), ("email", "a@b.co", True)
    ]
    # A wider find that the rewriting makes stands beside the plain one that it holds.
    assert found("ann (dot) lee@b.co") == [("email", "ann (dot) lee@b.co", False), ("email", "lee@b.co", True)]
    text = "x a@b.co, +1 (555) 555-5555 y é ann (dot) lee@b.co"
    assert personal.redacted(text, personal.spans(text)) == "x <EMAIL>, <PHONE> y é <EMAIL>"


@pytest.mark.parametrize("piece", [" ", "1", "a", "1 ", "a.", "one ", "dot ", "a dot ", "(", "( ", "[at]", "@", "a@", "+1 ", "O0l", "1.", "а"])
def test_time_is_linear(piece):
    def seconds(n):
        start = time.perf_counter()
        personal.spans((piece * n)[:n])
        return time.perf_counter() - start

    assert seconds(400_000) < 5 + 40 * seconds(40_000)


def digest(doc_id, text):
    plain = brute(text or "")
    listed = ",".join(f"{kind}:{a}:{b}" for kind in PATTERNS for a, b in plain[kind])
    return doc_id, *(len(plain[kind]) for kind in PATTERNS), hashlib.sha256(listed.encode()).hexdigest()


def test_query(spark, tmp_path):
    texts = ["x", None, "", "a@b.co", "a@b.co", "b (at) c.de", "é 1.2.3.4 +1 555-555-555 a@b.co", "1.2.3.4 " * 40_000]
    ids = [1, 2, 3, 4, 4, None, 6, 7]
    corpus.clashing(corpus.documents(spark, texts, ids=ids)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op12_personal_data(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((digest(i, t) for i, t in zip(ids, texts)), key=str)
    assert {r.doc_id: r.spans for r in rows if r.doc_id in (None, 2, 4, 6)} == {
        None: "email:0:11", 2: "", 4: "email:0:6", 6: "email:25:31,ip:2:9,phone:10:24",
    }
    empty = personal.find(corpus.documents(spark, []), redact=True)
    assert empty.collect() == [] and empty.columns == ["doc_id", "spans", "text"]


def test_query_on_the_tables(spark):
    docs = spark.read.parquet(f"{corpus.SMALL}/documents.parquet").collect()
    rows = queries.op12_personal_data(spark, corpus.SMALL).collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(digest(r.doc_id, r.text) for r in docs)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


def test_redacted_text(spark):
    (row,) = personal.find(corpus.documents(spark, ["call +1 555 555 5555 or c [at] d.org"]), redact=True).collect()
    assert row.text == "call <PHONE> or <EMAIL>"
