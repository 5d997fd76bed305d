"""Similarity join on word shingles with a token-group matrix.

Documents are sets of distinct shingles (64-bit hashes). Two documents link when their
Jaccard similarity is at least t = numerator / denominator. A document of n tokens may
miss at most miss(n) = n - ceil(t n) of them in a partner; that bounds every overlap.

1. *The whole corpus as one group.* Each block of documents sends the distinct tokens
   among the first miss(n) + l(n) of every document in hash order, and learns which of
   them other documents hold. A document with fewer than l(n) such tokens has no
   partner. Most documents end here, without their full sets ever being moved.
2. Equal sets become one class. For the remaining classes the same question is asked
   for all tokens, with counts: a class with more than miss(n) tokens of its own has no
   partner. The other classes keep the tokens that they share, rarest first.
3. *Partition.* Classes with an equal minimum hash are similar. Each is compared with
   one leader of its bucket, the class with the fewest tokens of its own, for three hash
   functions. Verified links give components. Groups are the members of a component
   (single classes: of a bucket), at most about 32 each.
4. *Token-group matrix.* A group stores the union of its members' rarest miss(n) + l(n)
   tokens. Queries are asked group by group: the tokens that a group of queries shares
   with another group's union bound the overlap of any two members, and with fewer than
   l of the smallest possible partner there is no link. Sizes and tokens of one's own
   bound it too. Only groups of other components that pass are opened.
5. An opened group stores the union of all its tokens; a query whose overlap with it is
   too small is not compared with the members. All others are, exactly.

Every link between different components is found, so components are exact. Links inside a
component add nothing to it and are not looked for. No step emits pairs within a group:
copies are one class, near copies meet at a leader, and opened groups are small and are
compared inside a task, queries in salted portions.

Null and empty texts have no set, no links and themselves as component. Rows with the
same doc_id are documents of their own; a null doc_id is never a component's id unless
there is no other. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm import blocks as B
from revq.llm.components import components
from revq.llm.tokens import Words, find_words, mixed
from revq.session import materialise

GROUP_ROWS = 32
QUERY_ROWS = 512
_SEEDS = tuple(np.uint64(s) for s in (0x51ED270B0F5A3C11, 0x9D39247E33776D41, 0xC2B2AE3D27D4EB4F))

SETS = "doc_id long, text_hash long, n long, node binary, tokens binary"
MATRIX = "token long, gid long, of binary, low long, high long, own long, least long"
DENSE = "node binary, n long, own long, tokens binary, minima array<long>"
COUNTED = "block long, bucket long, keys binary, counts binary"
LINKS = "a binary, b binary"


class Threshold:
    """Integer bounds for a Jaccard similarity of at least numerator / denominator."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator

    def least(self, n):
        """Tokens a partner shares at least."""
        return (self.numerator * n + self.denominator - 1) // self.denominator

    def miss(self, n):
        return n - self.least(n)

    def probes(self, n):
        """Tokens beyond miss(n) that are looked up; at least one."""
        return np.maximum(1, -(-self.miss(n) // 2))

    def prefix(self, n):
        return np.minimum(n, self.miss(n) + self.probes(n))

    def linked(self, common, a, b):
        return self.denominator * common >= self.numerator * (a + b - common)


class Sets:
    """The shingle sets of a block's documents: tokens by document, in hash order."""

    def __init__(self, words: Words, size: int):
        hashes = words.hashes(fold_case=True)
        keys, at = words.windows(hashes, size)
        docs = words.doc[at]
        for count in range(1, size):  # too short for a shingle: all words as one
            short = np.flatnonzero(words.count == count)
            acc = np.full(len(short), count, np.uint64)
            for k in range(count):
                acc = mixed(acc + hashes[words.first[short] + k])
            keys, docs = np.concatenate([keys, acc]), np.concatenate([docs, short])
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        self.keys, self.docs = keys[fresh], docs[fresh]
        self.first = np.searchsorted(self.docs, np.arange(len(words.count) + 1))
        self.n = np.diff(self.first)
        self.place = np.arange(len(self.keys)) - self.first[self.docs]

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many marked tokens each document has."""
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[self.first])

    def nodes(self) -> list[bytes | None]:
        """128 bits that tell sets apart; null for an empty set."""
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.keys ^ s))]) for s in _SEEDS[:2]]
        both = np.stack([s[self.first[1:]] - s[self.first[:-1]] for s in sums], axis=1)
        return [x.tobytes() if n else None for x, n in zip(both, self.n)]


def _held_twice(keys: np.ndarray) -> np.ndarray:
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[which] > 1


def _candidates(docs: DataFrame, size: int, t: Threshold, block_bytes: int) -> DataFrame:
    """All documents with size and class; those that step 1 leaves carry their tokens."""
    count = B.block_count(docs, block_bytes=block_bytes)
    buckets = B.bucket_count(count)
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("long").alias("block"),
    )

    def prefix(sets: Sets) -> np.ndarray:
        return sets.place < t.prefix(sets.n)[sets.docs]

    def send(docs: pa.Table) -> pa.Table:
        sets = Sets(find_words(docs["text"]), size)
        return B.messages(docs["block"][0].as_py(), sets.keys[prefix(sets)], buckets, bits=32)

    def keep(docs: pa.Table, shared: pa.Table) -> pa.Table:
        sets = Sets(find_words(docs["text"]), size)
        early = prefix(sets)
        keys = sets.keys[early]
        hit = np.zeros(len(sets.keys), bool)
        hit[early] = B.known(keys, shared, buckets, bits=32) | _held_twice(keys)
        alone = sets.per_doc(hit) < t.prefix(sets.n) - t.miss(sets.n)
        tokens = [
            None if no else sets.keys[a:b].tobytes()
            for no, a, b in zip(alone | (sets.n == 0), sets.first, sets.first[1:])
        ]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "text_hash": docs["text_hash"],
                "n": pa.array(sets.n, pa.int64()),
                "node": pa.array(sets.nodes(), pa.binary()),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    shared = B.answers(B.per_block(placed, send, B.MESSAGE), bits=32)
    return B.with_answers(placed, shared, keep, SETS)


class Packed:
    """Token arrays of several rows, laid end to end."""

    def __init__(self, column: pa.ChunkedArray):
        parts = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        self.keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.row = np.repeat(np.arange(len(parts)), np.diff(self.first))


def _dense(classes: DataFrame, t: Threshold, block_bytes: int) -> DataFrame:
    """Classes that can have a partner, with the tokens they share, rarest first."""
    count = B.block_count(classes, "tokens", block_bytes)
    buckets = B.bucket_count(count)
    placed = classes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(count)).cast("long"))

    def send(rows: pa.Table) -> pa.Table:
        keys, counts = np.unique(Packed(rows["tokens"]).keys, return_counts=True)
        out = B.messages(rows["block"][0].as_py(), keys, buckets)
        order = np.argsort(B.bucket_of(keys, buckets), kind="stable")
        lengths = [len(x) // 8 for x in out["keys"].to_pylist()]
        cuts = np.split(counts[order].astype(np.uint32), np.cumsum(lengths)[:-1]) if lengths else []
        return out.append_column("counts", pa.array([c.tobytes() for c in cuts], pa.binary()))

    def count_up(sent: pa.Table) -> pa.Table:
        keys, row = B.unpacked(sent)
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in sent["counts"].to_pylist()])
        _, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=counts).astype(np.uint32)[which]
        many = total > 1
        keys, row, total = keys[many], row[many], total[many]
        used, first = np.unique(row, return_index=True)  # rows are in order already
        out = B.packed(
            sent["block"].to_numpy()[used], sent["bucket"].to_numpy()[used],
            np.split(keys, first[1:]) if len(used) else [],
        )
        totals = np.split(total, first[1:]) if len(used) else []
        return out.append_column("counts", pa.array([x.tobytes() for x in totals], pa.binary()))

    def keep(rows: pa.Table, counted: pa.Table) -> pa.Table:
        packed = Packed(rows["tokens"])
        shared, _ = B.unpacked(counted)
        totals = [np.frombuffer(x, np.uint32) for x in counted["counts"].to_pylist()]
        totals = np.concatenate(totals) if totals else np.empty(0, np.uint32)
        order = np.argsort(shared)
        shared, totals = shared[order], totals[order]
        at = np.searchsorted(shared, packed.keys)
        at[at == len(shared)] = 0
        many = shared[at] == packed.keys if len(shared) else np.zeros(len(packed.keys), bool)
        df = totals[at] if len(shared) else np.zeros(len(packed.keys), np.uint32)
        n = rows["n"].to_numpy()
        own = n - np.bincount(packed.row[many], minlength=len(n))
        stays = many & (own <= t.miss(n))[packed.row]
        keys, row, df = packed.keys[stays], packed.row[stays], df[stays]
        order = np.lexsort((keys, df, row))
        keys, row = keys[order], row[order]
        used, first = np.unique(row, return_index=True)
        minima = [np.minimum.reduceat(mixed(keys ^ s), first).view(np.int64) if len(used) else [] for s in _SEEDS]
        return pa.table(
            {
                "node": rows["node"].take(pa.array(used)),
                "n": pa.array(n[used], pa.int64()),
                "own": pa.array(own[used], pa.int64()),
                "tokens": pa.array([k.tobytes() for k in np.split(keys, first[1:])] if len(used) else [], pa.binary()),
                "minima": pa.array([list(map(int, m)) for m in zip(*minima)], pa.list_(pa.int64())),
            }
        )

    counted = B.per_block(placed, send, COUNTED).groupBy("bucket").applyInArrow(count_up, COUNTED)
    return B.with_answers(placed, counted, keep, DENSE)


def _similar_size(t: Threshold, a: str, b: str):
    low, high = F.least(a, b), F.greatest(a, b)
    return low * t.denominator >= high * t.numerator


def _leader_links(dense: DataFrame, t: Threshold) -> DataFrame:
    """Verified links of classes to the leaders of their buckets."""
    buckets = dense.select("node", "n", "own", F.posexplode("minima").alias("i", "minimum"))
    # Written, so that the join below is free to split a bucket with very many classes.
    leaders = materialise(
        buckets.groupBy("i", "minimum")
        .agg(F.min(F.struct("own", "node", "n")).alias("leader"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("i", "minimum", F.col("leader.node").alias("b"), F.col("leader.n").alias("m"))
    )
    pairs = (
        buckets.join(leaders, ["i", "minimum"])
        .where((F.col("node") != F.col("b")) & _similar_size(t, "n", "m"))
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )
    left = dense.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = dense.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))

    def verify(batches: B.Batches) -> B.Batches:
        for batch in batches:
            common = np.array(
                [
                    len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True))
                    for x, y in zip(batch["tokens_a"].to_pylist(), batch["tokens_b"].to_pylist())
                ],
                np.int64,
            )
            linked = t.linked(common, batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "n_a", "n_b", "tokens_a", "tokens_b"
    ).mapInArrow(verify, LINKS)


def _group_links(members: DataFrame, t: Threshold) -> DataFrame:
    """Links between components, found through the token-group matrix."""
    def unite(group: pa.Table) -> pa.Table:
        """The row of a group in the matrix: its early tokens, and bounds over its members."""
        n, own = group["n"].to_numpy(), group["own"].to_numpy()
        take = t.prefix(n) - own  # tokens of one's own come first and hit nothing
        early = [np.frombuffer(x, np.uint64)[:k] for x, k in zip(group["tokens"].to_pylist(), take)]
        tokens = np.unique(np.concatenate(early)).view(np.int64)
        bounds = {"low": n.min(), "high": n.max(), "own": own.min(), "least": t.probes(t.least(n)).min()}
        same = {name: pa.array(np.full(len(tokens), value), pa.int64()) for name, value in bounds.items()}
        gid, of = (pa.array([group[name][0].as_py()] * len(tokens), kind) for name, kind in (("gid", pa.int64()), ("of", pa.binary())))
        return pa.table({"token": tokens, "gid": gid, "of": of} | same)

    matrix = materialise(
        members.select("n", "own", "tokens", "gid", "of").groupBy("gid").applyInArrow(lambda group: unite(group), MATRIX)
    )
    theirs = matrix.select("token", *[F.col(c).alias(f"{c}2") for c in matrix.columns if c != "token"])
    other = ~F.col("of").eqNullSafe(F.col("of2")) | F.col("of").isNull()
    smaller = F.col("gid") < F.col("gid2")
    near = (F.col("high") * t.denominator >= F.col("low2") * t.numerator) & (
        F.col("high2") * t.denominator >= F.col("low") * t.numerator
    )
    # Tokens of one's own are missing in any partner, on both sides.
    apart = (F.col("own") + F.col("own2")) * (t.numerator + t.denominator)
    near = near & (apart <= (F.col("high") + F.col("high2")) * (t.denominator - t.numerator))
    between = (
        matrix.join(theirs, "token")
        .where(other & smaller & near)
        .groupBy("gid", F.col("gid2").alias("group"))
        .agg(F.count(F.lit(1)).alias("hits"), F.first("least").alias("least"))
        .where(F.col("hits") >= F.col("least"))
        .select("gid", "group")
    )
    # Members of one component need not be compared; classes without a label in one group must be.
    alone = members.where("of IS NULL").groupBy("gid").agg(F.count(F.lit(1)).alias("rows"))
    inside = alone.where("rows > 1").select("gid", F.col("gid").alias("group"))
    opened = materialise(between.unionByName(inside))
    portions = opened.groupBy("group").agg(F.ceil(F.count(F.lit(1)) * GROUP_ROWS / QUERY_ROWS).alias("portions"))
    sides = ["node", "n", "tokens", "root"]
    asking = opened.join(portions, "group").withColumn("portion", F.pmod(F.xxhash64("gid"), F.col("portions")))
    queries = asking.join(members.select(*sides, "gid"), "gid")
    # Aliases make these columns differ from the queries', which come from the same table.
    targets = (
        members.select(*[F.col(c).alias(c) for c in sides], F.col("gid").alias("group"))
        .join(portions, "group")
        .withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
    )

    def compare(queries: pa.Table, group: pa.Table) -> pa.Table:
        tokens = Packed(group["tokens"])
        union, which = np.unique(tokens.keys, return_inverse=True)
        holds = np.zeros((len(union), len(group)), bool)
        holds[which, tokens.row] = True
        sizes = group["n"].to_numpy()
        roots = group["root"].to_pylist()
        found = set()
        for n, root, mine in zip(queries["n"].to_pylist(), queries["root"].to_pylist(), queries["tokens"].to_pylist()):
            mine = np.frombuffer(mine, np.uint64)
            at = np.searchsorted(union, mine)
            at[at == len(union)] = 0
            at = at[union[at] == mine]
            if len(at) < t.least(n):
                continue
            linked = t.linked(holds[at].sum(axis=0), n, sizes)
            found |= {(root, roots[i]) for i in np.flatnonzero(linked) if roots[i] != root}
        return pa.table(
            {
                "a": pa.array([a for a, _ in found], pa.binary()),
                "b": pa.array([b for _, b in found], pa.binary()),
            }
        )

    return (
        queries.select("group", "portion", *sides)
        .groupBy("group", "portion")
        .cogroup(targets.select("group", "portion", *sides).groupBy("group", "portion"))
        .applyInArrow(lambda left, right: compare(left, right), LINKS)
    )


def _in_groups(dense: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with component and group; a group is of one component, or of single classes (`of` is null)."""
    placed = dense.join(roots.select("node", F.col("root").alias("of")), "node", "left").withColumns(
        {"root": F.coalesce("of", "node"), "minimum": F.col("minima")[0]}
    )
    rows = placed.groupBy("minimum", "of").agg(F.count(F.lit(1)).alias("rows")).withColumnsRenamed(
        {"minimum": "_minimum", "of": "_of"}
    )
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / GROUP_ROWS))
    same = (F.col("minimum") == F.col("_minimum")) & F.col("of").eqNullSafe(F.col("_of"))
    return placed.join(rows, same).select(
        "node", "n", "own", "tokens", "root", "of", F.xxhash64("minimum", "of", part).alias("gid")
    )


def _rooted(docs: DataFrame, size: int, numerator: int, denominator: int, block_bytes: int) -> DataFrame:
    """Per document: doc_id, text_hash, n, and `top`, which stands for its component (null: no set)."""
    t = Threshold(numerator, denominator)
    sets = materialise(_candidates(docs, size, t, block_bytes))
    classes = materialise(
        sets.where("tokens IS NOT NULL").select("node", "n", "tokens").dropDuplicates(["node"])
    )
    dense = materialise(_dense(classes, t, block_bytes))
    members = materialise(_in_groups(dense, components(_leader_links(dense, t))))
    merged = components(_group_links(members, t)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = members.select("node", "root").join(merged, "root", "left").select(
        "node", F.coalesce("top", "root").alias("top")
    )
    return sets.select("doc_id", "text_hash", "n", "node").join(final, "node", "left").select(
        "doc_id", "text_hash", "n", F.coalesce("top", "node").alias("top")
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    numerator: int = 4,
    denominator: int = 5,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, and component_id, the smallest doc_id that links reach."""
    rooted = _rooted(docs, size, numerator, denominator, block_bytes)
    # Written, so that the join is free to split a class with very many documents.
    ids = materialise(rooted.where("top IS NOT NULL").groupBy("top").agg(F.min("doc_id").alias("component_id")))
    return rooted.join(ids, "top", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def copies(
    docs: DataFrame,
    size: int = 5,
    numerator: int = 4,
    denominator: int = 5,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """The rows that are not the first of their component, as (doc_id, text_hash, rows, first).

    Of each component one row is first: that with the smallest doc_id (null last), then
    the smallest hash of the text. There is one row here per doc_id and text that is no
    first (`first` false: all its rows are copies), and per first one that is repeated
    (`first` true: all but one of its rows are). Documents without words are no copies.
    """
    rooted = _rooted(docs, size, numerator, denominator, block_bytes)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # Written, so that the join is free to split a class with very many documents.
    firsts = materialise(
        rooted.where("top IS NOT NULL").groupBy("top").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1").select("top", "row")
    )
    return (
        rooted.join(firsts, "top")
        .groupBy("doc_id", "text_hash", (row == F.col("row")).alias("first"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("NOT first OR rows > 1")
        .select("doc_id", "text_hash", "rows", "first")
    )
