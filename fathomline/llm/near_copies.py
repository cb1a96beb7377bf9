"""One document of each group of near copies: texts whose sets of five-word shingles are alike by 0.8 or more.

SimHash fingerprints of such texts differ in 15 of 100 bits or so, so no segment of a 64-bit one would be
useful to find them by. Here a fingerprint is a ring of SEGMENTS segments of WIDTH bits. Candidates are
found by the pigeonring: a segment is equal in both and starts a chain whose cumulative differences stay
within their share of RING_DISTANCE bits, for each length up to CHAIN. Which texts have a segment's value
in common is one shuffle; the chain's bits travel with the value, and what shares one is compared in
numpy. Two texts alike by 0.8 share no such start once in some 35,000 times (simulated, 400,000 rings of independent bits). What has a start in common is
held by the chains and the Hamming distance of the first 64 bits, and then by its exact likeness. Both
distances are over four deviations more than what texts alike by 0.8 have.

Only components matter, so a large group's pairs are never listed. Equal sets are one node. First each
node is held against one other, its hub: of the nodes that share a start with it the one that shares
most starts with most others, as the text that all others are copies of does. Where starts then still
hold several components, pairs across them are candidates, unless what is known of each node alone
rules them out. Two bounds of what two sets have in common are exact: of one's shingles, those that no
other node there has; and with one hub, the hub's shingles but those that either lacks (each lack is
marked in MARKS bits by its hash, so that both nodes' marks count no lack twice), and no more besides
than either has outside of the hub, less those that no other has. An edited copy has many of both. What is left of the candidates is
held by exact likeness, so no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling, simhash
from .common import by_chunks, cut, mix64, released, small_side, texts
from .components import components

SHINGLE, LIKENESS = 5, 0.8
#: The fingerprint's ring; how many segments of a chain are looked at, and the bits of which a chain of so many may have its share.
SEGMENTS, WIDTH = 57, 10
CHAIN, RING_DISTANCE = 13, 127
#: Sets of so few shingles that are alike differ in one at most, which may be half the fingerprint's ties: they are also found by what is left without one.
TINY = 9
#: Of the first 64 bits alone.
RING, DISTANCE = (8,) * 8, 22
MARKS = 1024
_WORD_BASE = 0x9FB21C651E98DF25
WORDS = -(-SEGMENTS * WIDTH // 64)
_SEEDS = mix64(np.arange(1, WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: For each segment, the places of its bits and of the next ones' of its chain, in two words.
_HALF = (CHAIN - 1) // 2 * WIDTH
_PLACES = (np.arange(SEGMENTS)[:, None] * WIDTH + np.arange(CHAIN * WIDTH)) % (SEGMENTS * WIDTH)
_BUDGETS = [n * RING_DISTANCE // SEGMENTS for n in range(1, CHAIN + 1)]
#: Members of a segment's value that are compared as one table; of more, MANY // 32 are tried first, whose groups leave.
MANY = 2048
#: Pairs whose first words are compared at once, so that they stay in cache.
STRIP = 1 << 15
#: Texts' bytes hashed at a time, and shingles whose bits are summed at a time.
BLOCK, SHINGLES = 1 << 20, 4096


def shingle_sets(batch_texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Words are those of simhash.fingerprint; fewer than a shingle's make one, none no shingle."""
    t = rolling.Texts([x.encode().lower() for x in batch_texts])
    words = rolling.Prefix(mix64(t.word_hashes()), _WORD_BASE)
    n = np.bincount(t.word_text, minlength=t.n)
    end = np.cumsum(n)
    out = []
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        at = np.arange(a, max(b - shingle, a) + (b > a))
        out.append(np.unique(mix64(words.hashes(at, np.minimum(at + shingle, b)))))
    return out


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The ring's bits, each set if over half the shingles' hashes have it; the first 64 are those of the hashes themselves."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), SHINGLES):
        part = shingles[at:at + SHINGLES]
        hashes = np.empty((len(part), WORDS), ">u8")
        hashes[:, 0] = part
        hashes[:, 1:] = mix64(part[:, None] ^ _SEEDS)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1)
        for k in range(0, len(part), 255):  # sums of so many fit a byte
            ones += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(shingles)).astype(np.uint8)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of at most 64 bits as numbers, first bit highest."""
    out = np.zeros((len(bits), 8), np.uint8)
    some = np.packbits(bits, axis=1)
    out[:, :some.shape[1]] = some
    return out.view(">i8")[:, 0].astype(np.int64)


def sketch(shingles: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A set's node (a hash of all of it), the first 64 bits of its fingerprint, each segment's key (its number and value), and the next bits of its chain in two words. Sets of at most TINY have keys of themselves and of themselves less one shingle, too."""
    bits = fingerprint(shingles)
    node = np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0]
    chains = bits[_PLACES]
    keys = np.arange(SEGMENTS) << WIDTH | chains[:, :WIDTH] @ (1 << np.arange(WIDTH))
    rest = np.stack([_packed(chains[:, WIDTH:WIDTH + _HALF]), _packed(chains[:, WIDTH + _HALF:])], axis=1)
    if len(shingles) <= TINY:
        less = [shingles, *(np.delete(shingles, k) for k in range(len(shingles)))]
        own = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) | 1 << 63 for x in less if len(x)], np.uint64).view(np.int64)
        keys, rest = np.concatenate([keys, own]), np.concatenate([rest, np.zeros((len(own), 2), np.int64)])
    return int(node), int(_packed(bits[None, :64])[0]), keys, rest


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node, size (distinct shingles), fp, keys, rest (two words a key) of each row of docs; null texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            sets = shingle_sets(texts(batch, "text"))
            node, fp, keys, rest = zip(*map(sketch, sets), strict=True)
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "node": pa.array(node, pa.int64()), "size": pa.array(map(len, sets), pa.int32()), "fp": pa.array(fp, pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys))),
                "rest": pa.ListArray.from_arrays(pa.array(2 * ends, pa.int32()), pa.array(np.concatenate(rest).ravel()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: released(run(x)), f"doc_id {kind}, node long, size int, fp long, keys array<bigint>, rest array<bigint>")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the chains (rows: two words) of each of a and of b keep their budgets, in a table."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    near, first = np.empty((len(a), len(b)), bool), np.ascontiguousarray(b[:, 0])
    strip = max(1, STRIP // max(1, len(b)))
    for k in range(0, len(a), strip):
        np.less_equal(np.bitwise_count(a[k:k + strip, :1] ^ first), _BUDGETS[(CHAIN - 1) // 2], out=near[k:k + strip])
    x, y = np.nonzero(near)  # few, so that all lengths are looked at for them alone
    differ = a[x] ^ b[y]
    good, ones = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n in range(1, CHAIN):
        word, at = divmod((n - 1) * WIDTH, _HALF)
        ones += np.bitwise_count(differ[:, word] >> np.uint64(64 - at - WIDTH) & np.uint64((1 << WIDTH) - 1))
        good &= ones <= _BUDGETS[n]
    near[x[~good], y[~good]] = False
    return near


def chained(rest: np.ndarray) -> np.ndarray:
    """A group number for each of the chains that start in an equal segment (rows: two words), from those that keep their budgets; -1: with no other."""
    group, left, count = np.full(len(rest), -1), np.arange(len(rest)), 0

    def spread(first: int, left: np.ndarray) -> np.ndarray:
        """Numbers all that can be reached from one, at most MANY // 8 of them held against what is left at a time; what is left then."""
        nonlocal count
        at, todo, size = left[left != first], [np.array([first])], 1
        members = todo[:]
        while todo and len(at):
            now = todo.pop()
            if len(now) > MANY // 8:
                todo.append(now[MANY // 8:])
                now = now[:MANY // 8]
            hit = np.zeros(len(at), bool)
            for k in range(0, len(at), 1 << 14):
                hit[k:k + (1 << 14)] = _near(rest[now], rest[at[k:k + (1 << 14)]]).any(axis=0)
            if hit.any():
                todo.append(at[hit])
                members.append(at[hit])
                size += int(hit.sum())
                at = at[~hit]
        if size > 1:
            group[np.concatenate(members)] = count
            count += 1
        return at

    if len(rest) > MANY:  # large groups first: no two of the same are then compared but on the way
        for first in left[:: -(-len(left) * 32 // MANY)].tolist():
            if group[first] < 0:
                left = spread(first, left)
    # of the others, those that have any other
    some = np.zeros(len(left), bool)
    for a in range(0, len(left), MANY):
        for b in range(a, len(left), MANY):
            near = _near(rest[left[a:a + MANY]], rest[left[b:b + MANY]])
            if a == b:
                np.fill_diagonal(near, False)
            some[a:a + MANY] |= near.any(axis=1)
            some[b:b + MANY] |= near.any(axis=0)
    left = left[some]
    while len(left):
        left = spread(int(left[0]), left)
    return group


def starts(own: DataFrame) -> DataFrame:
    """key, node, members: for each start of a chain that nodes of own (node, size, keys, rest) have in common, its number, each of them, and how many they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            held.clear()
            key, node, *rest = (whole.column(c).to_numpy() for c in ("key", "node", "x", "y"))
            rest = np.stack(rest, axis=1)
            edges = [0, *np.flatnonzero(np.diff(key)) + 1, len(key)]
            names, nodes, members = [], [], []
            for a, b in zip(edges, edges[1:], strict=False):
                group = chained(rest[a:b])
                at = np.flatnonzero(group >= 0)
                if len(at):
                    nodes.append(node[a:b][at])
                    members.append(np.bincount(group[at])[group[at]])
                    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                    np.minimum.at(least, group[at], nodes[-1])
                    names.append(mix64(least[group[at]].view(np.uint64) ^ mix64(key[a:a + 1].view(np.uint64))).view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(names), "node": np.concatenate(nodes), "members": np.concatenate(members)})

        for batch in batches:
            key = batch.column("key").to_numpy()
            cut_at = int(np.searchsorted(key, key[-1])) if len(key) else 0  # where its last key begins
            if held and len(key) and (cut_at or key[0] != held[-1].column("key")[-1].as_py()):
                held.append(batch.slice(0, cut_at))
                yield from done()
                batch = batch.slice(cut_at)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from done()

    each = F.posexplode("keys").alias("at", "key")
    rows = own.filter("size > 0").select("node", "rest", each).select("key", "node", F.expr("rest[2 * at]").alias("x"), F.expr("rest[2 * at + 1]").alias("y"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: released(run(x)), "key long, node long, members long")


def _with_node(docs: DataFrame, column: str, shingles: str | None = None) -> DataFrame:
    """docs with a bigint column of each text's node, and, where named, one of its shingle hashes' last 32 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            sets = shingle_sets(texts(batch, "text"))
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            columns, names = [*batch.columns, pa.array(nodes)], [*batch.schema.names, column]
            if shingles:
                ends = np.cumsum([0, *map(len, sets)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32))))
                names.append(shingles)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(column, T.LongType()), *([T.StructField(shingles, T.ArrayType(T.IntegerType()))] if shingles else [])]
    return docs.mapInArrow(lambda x: released(run(x)), T.StructType([*docs.schema.fields, *fields]))


def _viable(a: str, b: str) -> Column:
    """Sizes that allow the likeness, and a chain of segments within its budgets."""
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    differ = F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))
    chains = F.lit(False)
    for i in range(len(RING)):
        chains = chains | simhash.within(differ, RING, DISTANCE, i)
    return (low >= LIKENESS * high) & (F.bit_count(differ) <= DISTANCE) & chains


def _alike(x: str, y: str) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common >= LIKENESS * (F.size(x) + F.size(y) - common)


def _marks(lacks: str) -> list[Column]:
    """MARKS bits in columns of 64, of which each hash in an array sets one."""
    def of(k: int) -> Column:
        mine = F.filter(lacks, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(MARKS // 64 - 1)) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)))))

    return [of(k).alias(f"m{k}") for k in range(MARKS // 64)]


def _across(shared: DataFrame, own: DataFrame, sets: DataFrame, stars: DataFrame, linked: DataFrame) -> DataFrame | None:
    """Links (a, b) between components of linked that a start of shared (key, node) holds together; None if there is no such start."""
    labelled = cut(shared.join(small_side(linked), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels")).filter("labels > 1")
    rest = cut(labelled.join(small_side(cut(mixed.select("key", "largest"))), "key"))
    if rest.isEmpty():
        return None
    nodes = cut(rest.select("node").distinct())
    # hubs are counted too, so that what a node has in common with its hub is never alone
    counted = cut(nodes.unionByName(stars.join(small_side(nodes), "node", "left_semi").select(F.col("hub").alias("node"))).distinct())
    inside = sets.join(small_side(counted), "node", "left_semi").select("node", "shingles")
    alone = inside.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").cast("int").alias("alone"))
    marks = [f"m{k}" for k in range(MARKS // 64)]
    known = nodes.join(own.select("node", "size", "fp"), "node").join(alone, "node", "left").join(stars.select("node", "hub", "hub_size", "more", *marks), "node", "left")
    known = known.withColumn("alone", F.coalesce("alone", F.lit(0))).filter(F.col("size") - F.col("alone") >= LIKENESS * F.col("size"))
    rest = cut(rest.join(small_side(cut(known)), "node"))
    # a member of the largest component is met by those outside of it only
    a, b = rest.filter("label <> largest").alias("a"), rest.alias("b")
    common = F.least(F.col("a.size") - F.col("a.alone"), F.col("b.size") - F.col("b.alone"))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.largest")) | (F.col("a.node") < F.col("b.node")))
    possible = (common >= LIKENESS * (F.col("a.size") + F.col("b.alone"))) & (common >= LIKENESS * (F.col("b.size") + F.col("a.alone")))
    lacks = sum((F.bit_count(F.col(f"a.{m}").bitwiseOR(F.col(f"b.{m}"))) for m in marks), F.lit(0))
    of_hub = F.col("a.hub_size") - lacks + F.least(F.col("a.more") - F.col("a.alone"), F.col("b.more") - F.col("b.alone"))
    possible = possible & ((F.col("a.hub").eqNullSafe(F.col("b.hub")) & F.col("a.hub").isNotNull() & (of_hub < LIKENESS * (F.col("a.size") + F.col("b.size") - of_hub))) == F.lit(False))
    pairs = a.join(b, apart & possible & _viable("a", "b")).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    pairs = cut(pairs.distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    few = cut(sets.join(small_side(wanted), "node", "left_semi").select("node", "shingles"))
    both = pairs.join(few.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(few.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter(_alike("x", "y")).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """A row for each distinct set of shingles in docs (doc_id, text): node, component_id (the smallest doc_id of the group of near copies; null only if all are null), and head, whether node is the one that has it."""
    prints = cut(sketched(docs))
    own = cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("rest").alias("rest")))
    shared = cut(starts(own))
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = cut(shared.join(weight, "node").select("key", "node", "weight"))
    best = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    # a node's hub is the weightiest of those that have a start in common with it; a node that is that itself has none
    hubs = cut(weighed.join(best, "key").groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("hub")))
    # two numbers a row: half a million take some MB
    sets = _with_node(docs.select("text"), "node", "shingles").select("node", "shingles").join(small_side(hubs, 500_000), "node").groupBy("node").agg(F.first("hub").alias("hub"), F.first("shingles").alias("shingles"))
    sets = cut(sets)
    prints = own.select("node", "size", "fp")
    held = hubs.filter("node <> hub").join(prints, "node").alias("a").join(prints.alias("b"), F.col("a.hub") == F.col("b.node")).select("a.node", _viable("a", "b").alias("viable"))
    x, y = sets.join(small_side(cut(held)), "node").alias("x"), sets.alias("y")
    both = x.join(y, F.col("x.hub") == F.col("y.node")).select(
        "x.node", "x.hub", F.size("y.shingles").alias("hub_size"), (F.col("viable") & _alike("x.shingles", "y.shingles")).alias("alike"),
        F.size(F.array_except("x.shingles", "y.shingles")).alias("more"), F.array_except("y.shingles", "x.shingles").alias("lacks"))
    stars = cut(both.select("node", "hub", "hub_size", "alike", "more", *_marks("lacks")))
    links = cut(stars.filter("alike").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    linked = cut(components(links))
    more = _across(shared.select("key", "node"), own, sets, stars, linked)
    if more is not None:
        linked = cut(components(links.unionByName(more)))

    named = cut(own.select("node", "doc").join(small_side(linked), "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label")))
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("h"))
    heads = cut(heads.select("label", F.col("h.doc").alias("component_id"), F.col("h.node").alias("head_node")))
    return cut(named.join(small_side(heads), "label").select("node", "component_id", (F.col("node") == F.col("head_node")).alias("head")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stand for their group of near copies: its smallest doc_id, once.

    Null and empty texts are one group; texts of fewer than five words are alike only if all words are.
    Rows of equal doc_id and equal sets are one; rows of equal doc_id and different texts belong to
    their texts' groups; null ids stand only for groups that have no others. An empty table gives none.
    """
    heads = cut(groups(docs.select("doc_id", "text")).filter("head").select(F.col("node").alias("__head_node"), F.col("component_id").alias("__head")))
    carried = _with_node(docs, "__node")
    stay = carried.join(small_side(heads), (F.col("__node") == F.col("__head_node")) & F.col("doc_id").eqNullSafe(F.col("__head")), "left_semi")
    return stay.dropDuplicates(["__node", "doc_id"]).select(*(f"`{c}`" for c in docs.columns))
