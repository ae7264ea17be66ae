"""Exact n-gram Jaccard self-join with signature trees.

1. Every document's shingles become a set of hashes; documents with equal sets are one.
2. Each set sends its lowest third (a prefix in a fixed global order) to the buckets of its tokens,
   to learn which tokens others have too. Two linked sets share at least ``least_common`` of them,
   so a set with fewer shared tokens is alone; most documents end here.
3. The remaining sets ask again among themselves, with all their tokens: three quarters have to be
   shared. Those left keep a prefix of their shared tokens, rare ones first, so that any two linked
   sets keep a token in common; sets connected by kept tokens form candidate groups.
4. The texts of a group meet in a task (a large group as pairs of bounded tiles), where two
   signature trees are walked together: a node holds the OR of its sets' bitmaps and its range of
   sizes, and a pair of nodes is left when their largest possible overlap is too small, or when
   everything below is linked already. What remains is compared exactly.
5. Links become components.

Token lists move packed and already combined within a task, so a token of a third of all documents
sends a bounded number of entries per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import by_bucket, components, lookup, pack, packed_schema, release, stored, table, text_bytes, unpack
from llm.shingles import shingle_sets
from newscorpus.operators.keyed import broadcast_if_few, first_per_key

#: Similarity as a fraction; 3/4 of the union.
NUMERATOR, DENOMINATOR = 75, 100
#: Tokens of a task combined at a time.
COMBINE = 700_000
#: Tokens of a bucket on average.
BUCKET = 500_000
#: Sets from which on a token counts as frequent; tokens are ranked by their sets up to that.
FREQUENT = 64
#: Sets and shingles of a tile.
TILE_SETS, TILE_SHINGLES = 1024, 1_000_000
FANOUT = 8


def needed(n):
    """Shingles that a set of n has in common with any set it links to, at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


def prefix(n):
    """Length of the prefix in which two linked sets of about n share ``least_common(n)`` tokens."""
    return n - needed(n) + np.maximum(1, n // 12)


def least_common(n):
    """Tokens that the prefixes of a set of n and of any set it links to share, at least: the
    smaller of the two may have as few as three quarters of its shingles."""
    return np.maximum(1, needed(n) // 12)


def linked(common: int, a: int, b: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def set_key(tokens: np.ndarray) -> int:
    """64-bit signed name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


# Entries: a token of a set, with the sets of its task that have it. Up to FREQUENT of them ask one by
# one (count 1). Of a token of more, one entry tells their number, and the rest are KNOWN to be
# shared, so no token sends more than FREQUENT entries per task. SIZE: `token` is the set's size.
KNOWN, SIZE = 0, 0xFFFFFFFF
_ENTRY = {"token": np.uint64, "key": np.int64, "count": np.uint32}


def _combined(tokens: list[np.ndarray], keys: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(t) for t in tokens])
    token, key = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), sizes)
    order = np.argsort(token, kind="stable")
    token, key = token[order], key[order]
    first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
    runs = np.diff(np.append(first, len(token)))
    many = np.repeat(runs > FREQUENT, runs)
    told = first[runs > FREQUENT]
    asks = np.concatenate([np.flatnonzero(~many), told])
    count = np.append(np.ones(len(asks) - len(told), np.uint32), runs[runs > FREQUENT].astype(np.uint32))
    yield from pack(buckets, token[asks], {"token": token[asks], "key": key[asks], "count": count})
    token, key = token[many], key[many]
    yield from pack(buckets, key.view(np.uint64), {"token": token, "key": key, "count": np.full(len(token), KNOWN, np.uint32)})


def _entries(buckets: int, whole: bool):
    """Entries of a prefix of each set, or of the ``whole`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, keys, sizes, total = [], [], [], 0
        for batch in batches:
            for tokens in shingle_sets(text_bytes(batch.column(0))):
                if not len(tokens) or (key := set_key(tokens)) in seen:
                    continue
                seen.add(key)
                held.append(tokens if whole else tokens[: prefix(len(tokens))])
                keys.append(key)
                sizes.append(len(tokens))
                total += len(held[-1])
                if total > COMBINE:
                    yield from _flush(held, keys, sizes, buckets)
                    held, keys, sizes, total = [], [], [], 0
        if held:
            yield from _flush(held, keys, sizes, buckets)
        release()

    return run


def _flush(held, keys, sizes, buckets) -> Iterator[pa.RecordBatch]:
    yield from _combined(held, keys, buckets)
    key = np.array(keys, np.int64)
    size = {"token": np.array(sizes, np.uint64), "key": key, "count": np.full(len(key), SIZE, np.uint32)}
    yield from pack(buckets, key.view(np.uint64), size)


def _shared(buckets: int):
    """Which tokens of a bucket occur in several sets; each of these is told, with the token's rank:
    the number of its sets, FREQUENT at most."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        token, key, count = (unpack(group[n], kind) for n, kind in _ENTRY.items())
        asks = (count != KNOWN) & (count != SIZE)
        passed = {"token": token[~asks], "key": key[~asks], "count": np.where(count[~asks] == SIZE, SIZE, FREQUENT).astype(np.uint32)}
        token, key, count = token[asks], key[asks], count[asks]
        order = np.lexsort((count, key, token))
        token, key, count = token[order], key[order], count[order]
        first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
        runs = np.diff(np.append(first, len(token)))
        # A set that several tasks met asks several times, and counts once.
        new = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(token, prepend=~token[:1]) != 0)
        sets = np.add.reduceat(np.where(count > 1, count.astype(np.int64), new), first) if len(first) else runs
        rank = np.repeat(np.minimum(sets, FREQUENT), runs).astype(np.uint32)
        tell = (rank > 1) & (count == 1) & new
        out = {n: np.concatenate([passed[n], x]) for n, x in (("token", token[tell]), ("key", key[tell]), ("count", rank[tell]))}
        yield from pack(buckets, out["key"].view(np.uint64), out)

    return run


def _by_key(group: pa.Table):
    """(key, n) of a bucket's sets; (key, rank, token) of their distinct shared tokens, in that order."""
    token, key, count = (unpack(group[n], kind) for n, kind in _ENTRY.items())
    sized = count == SIZE
    of, at = np.unique(key[sized], return_index=True)
    n = token[sized][at].astype(np.int64)
    token, key, rank = token[~sized], key[~sized], count[~sized]
    order = np.lexsort((token, rank, key))
    token, key, rank = token[order], key[order], rank[order]
    # A token of one set always has one rank.
    new = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(token, prepend=~token[:1]) != 0)
    return of, n, key[new], token[new]


def _survivors(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sets that share enough tokens of their prefix."""
    of, n, key, _ = _by_key(group)
    shared = np.searchsorted(key, of, side="right") - np.searchsorted(key, of)
    yield pa.RecordBatch.from_pydict({"key": pa.array(of[shared >= least_common(n)], pa.int64())})


def _kept(buckets: int):
    """Of the sets with enough shared tokens, a prefix of these by (rank, token)."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        of, n, key, token = _by_key(group)
        shared = np.searchsorted(key, of, side="right") - np.searchsorted(key, of)
        keep = np.maximum(0, shared - needed(n) + 1)
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        chosen = nth < keep[np.searchsorted(of, key)] if len(key) else np.zeros(0, bool)
        token, key = token[chosen], key[chosen]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
        least = key[first]
        star = np.repeat(least, np.diff(np.append(first, len(token))))
        pairs = np.unique(np.stack([key, star], 1)[key != star], axis=0)
        for batch in pack(buckets, token[first], {"token": token[first], "key": least}):
            for name in ("a", "b"):
                batch = batch.append_column(name, pa.nulls(len(batch), pa.binary()))
            yield batch
        if len(pairs):
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([0], pa.int32()), "token": pa.nulls(1, pa.binary()), "key": pa.nulls(1, pa.binary()),
                "a": [pairs[:, 0].tobytes()], "b": [pairs[:, 1].tobytes()]})

    return run


def _met(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Stars over the sets that kept the same token in different buckets."""
    token, key = unpack(group["token"], np.uint64), unpack(group["key"], np.int64)
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
    star = np.repeat(key[first], np.diff(np.append(first, len(token))))
    pairs = np.unique(np.stack([key, star], 1)[key != star], axis=0)
    yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({n: unpack(batch.column(n), np.int64) for n in ("a", "b")})


class Tree:
    """Sets in an order that keeps like ones together; above them nodes of OR-combined bitmaps."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        row = np.zeros(bits, bool)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            row[at] = True
            maps[i] = np.packbits(row)
            row[at] = False
        size = np.array([len(s) for s in sets])
        # Tokens beyond the first on their bit: by so many may an overlap exceed the common bits.
        spare = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, spare)]
        while len(maps) > 1:
            at = np.arange(0, len(maps), FANOUT)
            low, high, spare = (
                f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.maximum), self.levels[-1][1:])
            )
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            self.levels.append((maps, low, high, spare))

    def span(self, level: int, i: int) -> slice:
        return slice(i * FANOUT**level, min((i + 1) * FANOUT**level, len(self.sets)))


def possible(x: Tree, y: Tree, level_x: int, level_y: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below nodes i of x and j of y may link, for all pairs (i, j)."""
    (a, low_a, high_a, spare_a), (b, low_b, high_b, spare_b) = x.levels[level_x], y.levels[level_y]
    common = np.bitwise_count(a[i][:, None] & b[j][None]).sum(axis=2, dtype=np.int64)
    most = common + np.minimum(spare_a[i][:, None], spare_b[j][None])
    most = np.minimum(most, np.minimum(high_a[i][:, None], high_b[j][None]))
    return DENOMINATOR * most >= NUMERATOR * np.maximum(low_a[i][:, None], low_b[j][None])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def walk(x: Tree, y: Tree, label: np.ndarray, base: int) -> None:
    """Link what links between x and y (the same tree, or y's sets follow from ``base`` on):
    ``label`` holds each set's component and is brought up to date."""

    def one(a: slice, b: slice) -> bool:
        first = label[a.start]
        return (label[a] == first).all() and (label[b] == first).all()

    stack = [(len(x.levels) - 1, len(y.levels) - 1, 0, 0)]
    while stack:
        lx, ly, i, j = stack.pop()
        a, b = x.span(lx, i), y.span(ly, j)
        b_global = slice(b.start + base, b.stop + base)
        same = x is y and lx == ly and i == j
        if lx == ly == 0:
            if not same and label[a.start] != label[b_global.start]:
                s, t = x.sets[i], y.sets[j]
                if linked(overlap(s, t), len(s), len(t)):
                    label[label == label[b_global.start]] = label[a.start]
            continue
        if (a.stop - a.start > 1 or not same) and one(a, b_global):
            continue
        # The higher node is opened; nodes of one height both.
        open_x, open_y = lx >= ly and lx > 0, ly >= lx and ly > 0
        ci = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(x.levels[lx - 1][0]))) if open_x else np.array([i])
        cj = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(y.levels[ly - 1][0]))) if open_y else np.array([j])
        nx, ny = lx - open_x, ly - open_y
        may = possible(x, y, nx, ny, ci, cj)
        if same:
            may &= ci[:, None] <= cj[None]
        for p, q in zip(*np.nonzero(may)):
            stack.append((nx, ny, int(ci[p]), int(cj[q])))


def tile_components(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Component of each set: links within ``left``, or between ``left`` and ``right``."""
    every = left + (right or [])
    bits = 1 << max(6, math.ceil(math.log2(8 * max((len(s) for s in every), default=1))))
    bits = min(bits, 1 << 17)
    label = np.arange(len(every))
    if left and (right is None or right):
        x = Tree(left, bits)
        walk(x, x if right is None else Tree(right, bits), label, 0 if right is None else len(left))
    return label


def _links(group: pa.Table) -> pa.Table:
    """(a, b) links that span the components of each candidate group of a bin."""
    seen: dict[tuple[int, int], bytes] = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
    for g, key, own, text in zip(*(group[n].to_pylist() for n in ("component", "key", "own", "text"))):
        if (g, key) not in seen:
            seen[g, key] = text.encode()
            spans.setdefault(g, []).append((key, own))
    a, b = [], []
    for g, rows in spans.items():
        sets = list(shingle_sets([seen[g, key] for key, _ in rows]))
        sides: list[list[tuple[tuple, int, np.ndarray]]] = [[], []]
        for (key, own), tokens in zip(rows, sets):
            if len(tokens) and set_key(tokens) == key:
                sides[own != lo].append((tuple(tokens[:2]), key, tokens))
        for side in sides:
            side.sort(key=lambda s: s[:2])
        label = tile_components([s for *_, s in sides[0]], [s for *_, s in sides[1]] if lo != hi else None)
        keys = np.array([k for side in sides for _, k, _ in side], np.int64)
        some = keys != keys[label] if len(keys) else np.zeros(0, bool)
        a.append(keys[some])
        b.append(keys[label][some] if len(keys) else keys)
    release()
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def named_sets(docs: DataFrame) -> DataFrame:
    """doc_id, tid (digest of the text), n, key of each row; no key without words."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s) if len(s) else None) for s in shingle_sets(text_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.int64())],
                ["doc_id", "tid", "n", "key"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, f"doc_id {kind}, tid long, n long, key long")


def told(texts: DataFrame, tokens: int, whole: bool) -> tuple[DataFrame, int]:
    """Packed by key: the sizes of the texts' sets, and which of their tokens other sets have."""
    buckets = max(1, math.ceil(tokens / BUCKET))
    schema = packed_schema([*_ENTRY])
    entries = texts.select("text").mapInArrow(_entries(buckets, whole), schema)
    return by_bucket(entries, _shared(buckets), schema), buckets


def candidates(texts: DataFrame, tokens: int) -> DataFrame:
    """(a, b) edges whose components hold every linked pair of the texts' sets."""
    shared, buckets = told(texts, tokens, whole=True)
    kept = stored(by_bucket(shared, _kept(buckets), packed_schema(["token", "key", "a", "b"])), "kept")
    near = kept.where("a is not null").select("a", "b").mapInArrow(_edges, "a long, b long")
    return near.unionAll(by_bucket(kept.where("a is null").select("bucket", "token", "key"), _met, "a long, b long"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, tid (xxhash64 of the text) for every row of (doc_id, text).

    Documents link when their sets of five-word shingles have at least three quarters of their
    union in common; a component is named by its smallest doc_id. Texts that are null, empty or
    without words have no shingles and are components of their own. Repeated rows stay; a null
    doc_id names a component only where all its ids are null. Other columns are ignored. Sets are
    told apart by 64-bit hashes. An empty table gives none.
    """
    sets = stored(named_sets(docs), "sets")
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_tid"), "text")
    by_key = sets.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min(F.struct("doc_id", "tid")).alias("one")
    )
    named = stored(by_key.select(F.col("key").alias("node"), "least", "n", F.col("one.doc_id").alias("_doc"), "one.tid"), "keys")
    lowest = named.agg(F.sum(F.expr("n - ceil(n * 75 / 100) + greatest(1, n div 12)"))).first()[0] or 0

    def of(chosen: DataFrame) -> DataFrame:
        """One text for each row of (_doc, tid, ...)."""
        return texts.join(broadcast_if_few(chosen), (F.col("_tid") == F.col("tid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))

    shared, _ = told(texts, int(lowest), whole=False)
    left = by_bucket(shared, _survivors, "key long").withColumnRenamed("key", "node")
    left = stored(named.join(left, "node").select("n", "_doc", "tid"), "survivors")
    total = left.agg(F.sum("n")).first()[0] or 0
    groups = components(candidates(of(left), int(total))).join(named, "node")
    groups = stored(groups.select(F.col("node").alias("key"), "component", "n", "_doc", "tid"), "members")

    sizes = groups.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("bigint").alias("tiles")
    )
    total = groups.agg(F.count("*"), F.sum("n")).first()
    bins = max(1, math.ceil((total[0] or 0) / TILE_SETS), math.ceil((total[1] or 0) / TILE_SHINGLES))
    # Small groups share bins; a large one has a task for each pair of its tiles.
    dealt = groups.join(sizes, "component").select(
        "key",
        "component",
        "_doc",
        "tid",
        "tiles",
        (F.col("tiles") > 1).alias("large"),
        F.pmod(F.xxhash64("key"), "tiles").alias("own"),
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("bin"),
    )
    met = (
        of(dealt)
        .select("component", "key", "own", "text", "bin", "large", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("other"))
        .select("component", "key", "own", "text", "bin", "large", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    links = stored(met.groupBy("bin", "large", "lo", "hi").applyInArrow(_links, "a long, b long"), "links")

    # A component may hold a third of all sets, and a set may be that of a third of all documents.
    joined = stored(components(links).join(named.select("node", "least"), "node"), "joined")
    roots = joined.groupBy("component").agg(F.min("least").alias("root"))
    rooted = lookup(joined, stored(roots, "roots"), "component").select("node", "root")
    named = named.join(rooted, "node", "left").select(F.col("node").alias("key"), F.coalesce("root", "least").alias("root"))
    found = lookup(sets.where("key is not null"), stored(named, "named"), "key", "left")
    alone = sets.where("key is null").select("doc_id", "n", F.col("doc_id").alias("root"), "tid")
    every = found.select("doc_id", "n", "root", "tid").unionAll(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), "tid")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document of its smallest doc_id.

    Documents without words all stay. Rows without a doc_id count as documents of large ids of their
    own, by their text. Of rows equal in doc_id and text one stays.
    """
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text", F.lit("id")), 2).bitwiseOR(F.lit(1 << 62)))
    found = similar_documents(docs.select(own.alias("doc_id"), "text"))
    marked = found.groupBy(F.col("doc_id").alias("_own"), F.col("tid").alias("_tid")).agg(
        F.min(F.col("doc_id") == F.col("component_id")).alias("_stays"), F.count("*").alias("_n")
    )
    marked = stored(marked.where("not _stays or _n > 1"), "marked")
    same = (own == F.col("_own")) & (F.xxhash64("text") == F.col("_tid"))
    kept = docs.join(broadcast_if_few(marked), same, "left_anti")
    again = marked.where("_stays")
    if again.isEmpty():
        return kept
    repeats = docs.join(broadcast_if_few(again), same)
    return kept.unionAll(first_per_key(repeats, ["_own", "_tid"], []).select(*docs.columns))


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tid")
