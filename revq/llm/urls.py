"""URL filter: host rules, then word segmentation of names and naive Bayes.

The longest rule that fits a url decides. A rule names a host, which stands for all its
subdomains, and the beginning of a path. Where no rule fits, names are split into words
by a unigram model: of all ways to cut a name into words the one with the largest
product of word probabilities wins (Viterbi), where an unknown word costs the more
the longer it is. Multinomial naive Bayes scores the words of host and path.

Word counts come from all urls: words that stand alone between separators of a path or
inside a hyphenated label; a plain label does not count, as it may be several words. All
of them are kept, of any length and however rare, and a fixed list of known words with
them. Naive Bayes is fitted on all different urls, which are marked bad if their host
holds a word of the fixed list of bad words.

Urls are met in bounded blocks. A block sends each piece of its names once to the table of
words and learns which are words; the same goes for the odds of its tokens. So a word that
every url holds is one row per block, and neither words nor tokens are gathered anywhere.

A null url, or one without ://, has an empty host and path; no rule fits and the method
judges it by its class shares alone. Repeated rows are judged alike. If the urls hold
one class only, the method allows everything. Empty tables give empty results; null page
ids are carried along. Columns other than page_id and url are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.llm.blocks import with_answers
from revq.llm.lines import UPPER
from revq.session import materialise

# Bytes of urls in a block, and the least number of blocks.
BLOCK_BYTES = 256 << 10
LEAST_BLOCKS = 64
# Letters of a piece of a name; longer words are found by their first piece.
LONGEST_PIECE = 24

# Host, path and verdict; the longest that fits decides.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Words that mark a host as bad when naive Bayes is fitted.
BAD_WORDS = (
    "ads", "adult", "bets", "betting", "casino", "escort", "gambling", "lottery", "loans", "malware", "pills",
    "poker", "porn", "replica", "sex", "spam", "torrent", "viagra", "warez", "xxx",
)
# Words known to the segmentation beside those counted.
KNOWN_WORDS = (
    "best", "blog", "book", "buy", "cheap", "cloud", "daily", "data", "deal", "farm", "free", "game", "games",
    "home", "live", "mail", "market", "media", "money", "movie", "music", "news", "now", "online", "page", "photo",
    "play", "sale", "shop", "sports", "store", "tech", "track", "travel", "video", "web", "win", "world",
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
    return inside & F.startswith(path, F.lit(rule_path))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path in one string, and its verdict; null if none."""
    rule = verdict = None
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        found = fits(host, path, rule_host, rule_path)
        name = F.lit(rule_host + rule_path)
        rule = F.when(found, name) if rule is None else rule.when(found, name)
        verdict = F.when(found, F.lit(decision)) if verdict is None else verdict.when(found, F.lit(decision))
    return rule, verdict


def _path_words(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "[^a-z]+"), lambda w: F.length(w) > 1)


def _hyphen_words(host: Column) -> Column:
    labels = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    return F.filter(F.split(F.array_join(labels, "-"), "[^a-z]+"), lambda w: F.length(w) > 0)


def _names(text: Column) -> Column:
    """The names of a host or path: its runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


@dataclass
class Model:
    """What is known of some words and tokens; a task builds one for each of its blocks."""

    words: dict[str, float]  # log of a word's share
    unknown: float  # log of the share of an unknown word of one letter
    tokens: dict[str, float]  # log odds of bad over good
    other: float  # the same of a token never seen
    prior: float

    def __post_init__(self):
        # Lengths of the words longer than a piece, by their first piece.
        found: dict[str, set[int]] = {}
        for w in self.words:
            if len(w) > LONGEST_PIECE:
                found.setdefault(w[:LONGEST_PIECE], set()).add(len(w))
        self.longer = {piece: sorted(lengths) for piece, lengths in found.items()}

    def split(self, name: str) -> list[str]:
        """The most probable words whose concatenation is the name; names are of letters only."""
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
        begun = 0
        for start in range(len(name)):
            so_far = best[start][0]
            # The unknown word that ends here begins where that is best. It costs a factor 10 for every letter.
            unknown = [(best[s][0] + self.unknown - (start + 1 - s) * math.log(10), s) for s in (begun, start)]
            p, begun = unknown[unknown[1][0] > unknown[0][0]]
            if p > best[start + 1][0]:
                best[start + 1] = (p, begun)
            known = range(1, min(LONGEST_PIECE, len(name) - start) + 1)
            for n in (*known, *self.longer.get(name[start : start + LONGEST_PIECE], ())):
                p = self.words.get(name[start : start + n]) if start + n <= len(name) else None
                if p is not None and so_far + p > best[start + n][0]:
                    best[start + n] = (so_far + p, start)
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return words[::-1]

    def parts(self, urls: pa.Table) -> Iterator[list[str]]:
        """Per url, words of the names of the host, marked h, and of the path, marked p."""
        split = cache(self.split)
        for host, path in zip(urls["host_names"].to_pylist(), urls["path_names"].to_pylist()):
            found = [f"h:{w}" for name in host for w in split(name)]
            yield found + [f"p:{w}" for name in path for w in split(name)]


@dataclass
class Fitted:
    """A model of any number of words and tokens, as tables."""

    words: DataFrame  # word, p
    unknown: float
    tokens: DataFrame  # token, odds
    other: float
    prior: float

    @classmethod
    def of(cls, spark: SparkSession, model: Model) -> Fitted:
        words = spark.createDataFrame(list(model.words.items()), "word string, p double")
        tokens = spark.createDataFrame(list(model.tokens.items()), "token string, odds double")
        return cls(words, model.unknown, tokens, model.other, model.prior)


def _in_blocks(urls: DataFrame, key: Column) -> DataFrame:
    """Urls written with a block by the hash of a key; rows with names of host and path."""
    letters = urls.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, letters // BLOCK_BYTES + 1)
    rows = materialise(urls.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))))
    return rows.withColumns({"host_names": _names(F.col("host")), "path_names": _names(F.col("path"))})


def _words_of(urls: DataFrame, words: DataFrame) -> DataFrame:
    """block, word, p: the words that occur anywhere in the names of a block, once per block.

    Words up to a piece long are met by all substrings of that length. A longer word is met
    where its first piece occurs: the block asks for the lengths of the words that begin with it.
    """
    names = urls.select("block", F.explode(F.array_union("host_names", "path_names")).alias("name")).distinct()
    starts = names.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("name"))))
    starts = starts.withColumn("piece", F.substring("name", F.col("start"), F.lit(LONGEST_PIECE)))
    heads = F.expr("transform(sequence(1, length(piece)), n -> left(piece, n))")
    sent = starts.select("block", "piece").distinct().select("block", F.explode(heads).alias("word"))

    longer = words.where(F.length("word") > LONGEST_PIECE).select(
        F.left("word", F.lit(LONGEST_PIECE)).alias("piece"), F.length("word").alias("n")
    )
    whole = starts.where(F.col("start") + LONGEST_PIECE <= F.length("name"))
    asked = whole.select("block", "piece").distinct().join(longer.distinct(), "piece")
    asked = asked.select(F.col("block").alias("in_block"), F.col("piece").alias("first"), "n")
    same = (F.col("block") == F.col("in_block")) & (F.col("piece") == F.col("first"))
    fits = F.col("start") + F.col("n") - 1 <= F.length("name")
    long_sent = whole.join(asked, same & fits).select("block", F.substring("name", F.col("start"), F.col("n")).alias("word"))
    sent = sent.unionByName(long_sent).distinct()
    return materialise(sent.join(words, "word").select("block", "word", "p"))


def _odds_of(urls: DataFrame, words: DataFrame, fitted: Fitted) -> DataFrame:
    """block, token, odds: the tokens of a block, once per block."""
    unknown = fitted.unknown

    def used(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(dict(zip(right["word"].to_pylist(), right["p"].to_pylist())), unknown, {}, 0.0, 0.0)
        found = sorted({t for parts in model.parts(left) for t in parts})
        block = left["block"].to_pylist()[:1] * len(found)
        return pa.table({"block": pa.array(block, pa.int64()), "token": pa.array(found, pa.string())})

    return with_answers(urls, words, used, "block long, token string").join(fitted.tokens, "token").select("block", "token", "odds")


def _counted(urls: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """token, bad, good: how often each token is in urls of either class; the null token counts the urls."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(dict(zip(right["word"].to_pylist(), right["p"].to_pylist())), unknown, {}, 0.0, 0.0)
        seen: dict[bool, Counter[str | None]] = {True: Counter(), False: Counter()}
        for parts in model.parts(left):
            bad = any(p.startswith("h:") and p[2:] in BAD_WORDS for p in parts)
            seen[bad].update([None, *parts])
        names = list(seen[True] | seen[False])
        return pa.table({
            "token": pa.array(names, pa.string()),
            "bad": pa.array([seen[True][t] for t in names], pa.int64()),
            "good": pa.array([seen[False][t] for t in names], pa.int64()),
        })

    seen = with_answers(urls, words, count, "token string, bad long, good long")
    return materialise(seen.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def fit(urls: DataFrame) -> Fitted:
    """Word model and naive Bayes from all rows of a table of urls."""
    split = urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counted = materialise(
        split.select(F.explode(F.concat(_hyphen_words(F.col("host")), _path_words(F.col("path")))).alias("word"))
        .groupBy("word").count()
    )
    floor = max(1.0, (counted.agg(F.sum("count")).first()[0] or 0) / 10_000)
    fixed = urls.sparkSession.createDataFrame([(w, floor) for w in {*KNOWN_WORDS, *BAD_WORDS}], "word string, count double")
    counts = counted.union(fixed).groupBy("word").agg(F.max("count").alias("count"))
    total = counts.agg(F.sum("count")).first()[0]
    words = materialise(counts.select("word", F.log(F.col("count") / total).alias("p")))
    unknown = math.log(10 / total)

    known = _in_blocks(split.where("host <> ''").distinct(), F.struct("host", "path"))
    seen = _counted(known, _words_of(known, words), unknown)
    rows = seen.where("token IS NULL").first()
    seen = seen.where("token IS NOT NULL")
    if not rows or not rows["bad"] or not rows["good"]:
        return Fitted(words, unknown, seen.select("token", F.lit(0.0).alias("odds")).limit(0), 0.0, -1.0)
    sums = seen.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    share = lambda name, n: F.log((F.col(name) + 1) / F.lit(float(n + sums[2] + 1)))
    tokens = seen.select("token", (share("bad", sums[0]) - share("good", sums[1])).alias("odds"))
    return Fitted(words, unknown, tokens, 0.0, math.log(rows["bad"] / rows["good"]))


def judge(pages: DataFrame, model: Fitted | Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and log odds of being bad, in the order of the rows."""
    fitted = Fitted.of(pages.sparkSession, model) if isinstance(model, Model) else model
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    # Blocks of rows, so that a url of many rows is in many blocks.
    urls = _in_blocks(split, F.col("row"))
    words = _words_of(urls, fitted.words)
    facts = words.select("block", "word", "p", F.lit(None).cast("string").alias("token")).unionByName(
        _odds_of(urls, words, fitted).select("block", F.lit(None).cast("string").alias("word"), F.col("odds").alias("p"), "token")
    )
    unknown, other, prior = fitted.unknown, fitted.other, fitted.prior

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        known = list(zip(right["word"].to_pylist(), right["token"].to_pylist(), right["p"].to_pylist()))
        odds = {t: p for _, t, p in known if t is not None}
        model = Model({w: p for w, _, p in known if w is not None}, unknown, odds, other, prior)
        values = [prior + sum(odds.get(t, other) for t in parts) for parts in model.parts(left)]
        return left.select(["page_id", "host", "path", "row"]).append_column("log_odds", pa.array(values, pa.float64()))

    schema = T.StructType([*split.schema.fields, T.StructField("log_odds", T.DoubleType())])
    rule, decided = by_rules(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return with_answers(urls, facts, scored, schema).orderBy("row").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "log_odds"
    )
