"""Removal of long repeated strings, over all documents, with difference-cover suffix ranks.

Windows of 400 bytes are judged, too many to sort them all. A window's anchor is the least hash
among its 64-byte strings, so equal windows have equal anchors, and few positions are anchors.

1. Each text sends its anchors, and for each a hash of its context, the bytes of all windows that
   chose it. Anchors that occur once end here, with all their windows. If whole contexts are equal,
   all their windows are repeats.
2. Only anchors that occur in different contexts (where a repeat begins or ends) are looked into.
   Those contexts are cut out of the texts and dealt to blocks of bounded size by their anchor; in a
   block ``suffix.repeated`` ranks the difference cover's sample and settles every window. The
   contexts of an anchor that has too many are not sent: each of their windows is, by two hashes of
   all its bytes, so equal windows are one entry per task and different ones part.
3. Repeated windows become spans of each text.

Entries move packed and combined within a task, so a string of a third of all documents sends one
entry per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Spans, free_prefix, by_bucket, mix, pack, packed_schema, release, stored, table, unpack
from llm.suffix import repeated

#: Bytes of a window: strings of that length that occur more than once are repeats. Bytes of an anchor.
LENGTH = 400
GRAM = 64
#: Entries combined at a time, entries of a bucket, bytes of a block on average.
COMBINE, BUCKET, BLOCK = 300_000, 150_000, 2_000_000
#: Contexts of one anchor beyond which their windows are dealt out one by one.
HOT = 4_000
#: Rows that go to all executors at once take this many bytes at most; more are joined by shuffle.
BROADCAST = 32_000_000

_ENTRY = {"anchor": np.uint64, "context": np.uint64, "key": np.int64, "at": np.uint32, "lo": np.uint32, "hi": np.uint32, "count": np.uint32}
_SPAN = {"key": np.int64, "start": np.uint32, "end": np.uint32}
_ASK = {"key": np.int64, "anchor": np.uint64, "at": np.uint32, "lo": np.uint32, "hi": np.uint32, "flags": np.uint32}
_WINDOW = {"hash": np.uint64, "check": np.uint64, "key": np.int64, "start": np.uint32, "end": np.uint32, "flags": np.uint32}
WANTED, SPLIT = 1, 2
#: Flags of windows: met again in the task; a span of repeated windows on its way to its text.
AGAIN, TOLD = 4, 8
#: A number for each byte, for a second hash of windows.
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, context, at, lo, hi): windows beginning at lo .. hi chose the string at ``at``."""
    gram = min(gram, length // 2)
    sums = Spans(data)
    here = np.arange(len(data) - gram + 1)
    hashed = sums.of(here, here + gram)
    least = hashed & np.uint64(0xFFFFFFFF00000000) | here.astype(np.uint64)
    span, wide, windows = 1, length - gram + 1, len(data) - length + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[wide - span : wide - span + windows])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.diff(chosen, prepend=-1))
    hi = np.append(lo[1:], windows) - 1
    at = chosen[lo]
    anchor = hashed[at]
    context = mix(sums.of(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x10001) + anchor)
    return anchor, context, at, lo, hi


def _entries(buckets: int, length: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = dict(zip(_ENTRY, (np.concatenate(x) for x in zip(*held))))
        order = np.lexsort((columns["context"], columns["anchor"]))
        columns = {n: c[order] for n, c in columns.items()}
        new = (np.diff(columns["anchor"], prepend=~columns["anchor"][:1]) != 0) | (np.diff(columns["context"], prepend=~columns["context"][:1]) != 0)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(new)))
        yield from pack(buckets, columns["anchor"][first], {n: c[first] for n, c in columns.items()} | {"count": runs.astype(np.uint32)})
        # Contexts met twice in this task are repeats: their spans go straight to their texts.
        again = np.repeat(runs > 1, runs)
        known = {n: c[again] for n, c in columns.items()}
        order = np.lexsort((known["lo"], known["key"]))
        known = {n: c[order] for n, c in known.items()}
        new = (np.diff(known["key"], prepend=~known["key"][:1]) != 0) | (np.diff(known["lo"], prepend=~known["lo"][:1]) != 0)
        known = {n: c[new] for n, c in known.items()}
        yield from pack(buckets, known["key"].view(np.uint64), known | {"count": np.zeros(len(known["key"]), np.uint32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                anchor, context, at, lo, hi = anchors(data, length)
                n = len(at)
                held.append((anchor, context, np.full(n, key), *(x.astype(np.uint32) for x in (at, lo, hi)), np.ones(n, np.uint32)))
                total += n
                if total > COMBINE:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)
        release()

    return run


def _tagged(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Packed rows of spans or of asks with the other's columns empty."""
    names = ["bucket", *dict.fromkeys([*_SPAN, *_ASK])]
    for batch in batches:
        columns = {n: batch.column(n) if n in batch.schema.names else pa.nulls(len(batch), pa.binary()) for n in names}
        yield pa.RecordBatch.from_pydict(columns | {"kind": pa.array([kind] * len(batch))})


def _judged(buckets: int, hot: int, length: int):
    """Which contexts of a bucket occur again; which have to be looked into."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: unpack(group[n], kind) for n, kind in _ENTRY.items()}
        known = c["count"] == 0
        spans = [{n: c[n][known] for n in ("key", "lo", "hi")}]
        c = {n: x[~known] for n, x in c.items()}
        order = np.lexsort((c["key"], c["context"], c["anchor"]))
        c = {n: x[order] for n, x in c.items()}
        if len(order):
            new_anchor = np.diff(c["anchor"], prepend=~c["anchor"][:1]) != 0
            first = np.flatnonzero(new_anchor | (np.diff(c["context"], prepend=~c["context"][:1]) != 0))
            runs = np.diff(np.append(first, len(order)))
            full = np.add.reduceat(c["count"].astype(np.int64), first) > 1
            told = np.repeat(full, runs) & (c["count"] == 1)
            spans.append({n: c[n][told] for n in ("key", "lo", "hi")})
            of_anchor = np.cumsum(new_anchor[first]) - 1
            contexts = np.bincount(of_anchor)[of_anchor]
            mixed = contexts > 1
            rows = first[mixed]
            flags = np.where(full[mixed], 0, WANTED) | np.where(contexts[mixed] > hot, SPLIT, 0)
            ask = {n: c[n][rows] for n in ("key", "anchor", "at", "lo", "hi")} | {"flags": flags.astype(np.uint32)}
            yield from _tagged(pack(buckets, ask["key"].view(np.uint64), ask), "ask")
        key, lo, hi = (np.concatenate([s[n] for s in spans]) for n in ("key", "lo", "hi"))
        yield from _tagged(pack(buckets, key.view(np.uint64), {"key": key, "start": lo, "end": hi + np.uint32(length)}), "span")

    return run


def _per_key(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row of asks for each key, with its arrays in place of those of the bucket, and the number
    of windows that are dealt out one by one."""
    c = {n: unpack(group[n], kind) for n, kind in _ASK.items()}
    order = np.argsort(c["key"], kind="stable")
    c = {n: x[order] for n, x in c.items()}
    first = np.flatnonzero(np.diff(c["key"], prepend=~c["key"][:1]) != 0)
    ends = np.append(first[1:], len(order))
    out = {"key": pa.array(c["key"][first], pa.int64())}
    for n in list(_ASK)[1:]:
        out[n] = pa.array([c[n][a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
    windows = np.where(c["flags"] & SPLIT, c["hi"].astype(np.int64) - c["lo"] + 1, 0)
    out["windows"] = pa.array(np.add.reduceat(windows, first) if len(first) else windows, pa.int64())
    yield pa.RecordBatch.from_pydict(out)


def _merged(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The union of each key's spans: packed starts and ends."""
    key, start, end = (unpack(group[n], kind) for n, kind in _SPAN.items())
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order].astype(np.int64)
    if not len(key):
        return
    # Ends so far, over one axis on which every key has a place of its own.
    place = np.cumsum(np.diff(key, prepend=~key[:1]) != 0) << 33
    reach = np.maximum.accumulate(end + place)
    opens = np.concatenate([[True], start[1:] + place[1:] > reach[:-1]])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(key)) - 1
    key, start, end = key[first], start[first], (reach[last] - place[last]).astype(np.uint32)
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    ends = np.append(first[1:], len(key))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
    yield pa.RecordBatch.from_pydict({"key": pa.array(key[first], pa.int64()), "start": cut(start), "end": cut(end)})


def _asks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(text, key, anchor, at, lo, hi, flags) of each ask of a batch of texts."""
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        data, key = text.as_py(), batch.column("key")[i].as_py()
        for ask in zip(*(np.frombuffer(batch.column(n)[i].as_py(), _ASK[n]).tolist() for n in list(_ASK)[1:])):
            yield data, key, *ask


def _cut_contexts(blocks: int, length: int):
    """Contexts out of their texts, one row each, but for those of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("bucket", "key", "lo", "hi", "wanted", "data")}
            for data, key, anchor, _, lo, hi, flags in _asks(batch):
                if not flags & SPLIT:
                    for n, x in zip(out, (anchor % blocks, key, lo, hi, bool(flags & WANTED), data[lo : hi + length])):
                        out[n].append(x)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(out["bucket"], pa.int32()), "key": pa.array(out["key"], pa.int64()),
                "lo": pa.array(out["lo"], pa.int64()), "hi": pa.array(out["hi"], pa.int64()),
                "wanted": pa.array(out["wanted"], pa.bool_()), "data": pa.array(out["data"], pa.binary())})

    return run


def _twins(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Windows in order, the first of each run of equal ones, and which are also elsewhere.

    A row that repeats as a whole brings the same places again, which are one place.
    """
    order = np.lexsort((c["start"], c["key"], c["check"], c["hash"]))
    c = {n: x[order] for n, x in c.items()}
    changed = lambda n: np.diff(c[n], prepend=~c[n][:1]) != 0
    new = changed("hash") | changed("check")
    place = new | changed("key") | changed("start")
    first = np.flatnonzero(new)
    twice = (np.add.reduceat(place.astype(np.int64), first) > 1) | (np.bitwise_or.reduceat(c["flags"], first) & AGAIN > 0)
    return c, first, np.repeat(twice, np.diff(np.append(first, len(order))))


def _windows(buckets: int, length: int):
    """Windows of hot anchors by hashes of their bytes; equal ones of a task are one entry, and the
    spans of those go straight to their texts."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts, key, lo, hi, wanted = zip(*held)
        data = np.frombuffer(b"".join(parts), np.uint8)
        lo, hi = np.array(lo), np.array(hi)
        size = hi - lo + length
        count = hi - lo + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(size) - size, count) + nth
        start = (np.repeat(lo, count) + nth).astype(np.uint32)
        c = {"hash": Spans(data).of(at, at + length), "check": Spans(LETTER[data]).of(at, at + length),
             "key": np.repeat(np.array(key, np.int64), count), "start": start, "end": start + np.uint32(length),
             "flags": np.repeat(np.array(wanted, np.uint32), count)}
        c, first, again = _twins(c)
        known = again & (c["flags"] & WANTED > 0)
        one = {n: x[first] for n, x in c.items()}
        one["flags"] = np.where(again[first], AGAIN, one["flags"]).astype(np.uint32)
        yield from pack(buckets, one["hash"], one)
        key, start = c["key"][known], c["start"][known].astype(np.int64)
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        opens = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(start, prepend=start[:1]) > 1))
        last = np.append(opens[1:], len(key))[: len(opens)] - 1
        none = np.zeros(len(opens), np.uint64)
        told = {"hash": none, "check": none, "key": key[opens], "start": start[opens].astype(np.uint32),
                "end": (start[last] + length).astype(np.uint32), "flags": np.full(len(opens), TOLD, np.uint32)}
        yield from pack(buckets, told["key"].view(np.uint64), told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, size = [], 0, 0
        for batch in batches:
            for data, key, _, _, lo, hi, flags in _asks(batch):
                if flags & SPLIT:
                    held.append((data[lo : hi + length], key, lo, hi, flags & WANTED))
                    total += hi - lo + 1
                    size += hi - lo + length
                    if total > COMBINE or size > BLOCK:
                        yield from flush(held)
                        held, total, size = [], 0, 0
        if held:
            yield from flush(held)
        release()

    return run


def _counted(buckets: int):
    """Spans of the repeated windows of a bucket."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: unpack(group[n], kind) for n, kind in _WINDOW.items()}
        told = c["flags"] & TOLD > 0
        spans = [{n: c[n][told] for n in _SPAN}]
        c = {n: x[~told] for n, x in c.items()}
        if len(c["key"]):
            c, _, again = _twins(c)
            again &= c["flags"] & WANTED > 0
            spans.append({n: c[n][again] for n in _SPAN})
        span = {n: np.concatenate([s[n] for s in spans]) for n in _SPAN}
        yield from pack(buckets, span["key"].view(np.uint64), span)

    return run


def _settled(buckets: int, length: int):
    """Spans of the repeated windows of a block."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        key, lo, hi = (group[n].to_numpy() for n in ("key", "lo", "hi"))
        # A row that repeats as a whole (same document, same place) is one context.
        _, one = np.unique(np.stack([key, lo], 1), axis=0, return_index=True)
        key, lo, hi = key[one], lo[one], hi[one]
        parts = group["data"].take(pa.array(one)).to_pylist()
        wanted = group["wanted"].to_numpy()[one]
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        count = hi - lo + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(begin, count) + nth
        again = repeated(np.frombuffer(b"".join(parts), np.uint8), starts, length) & np.repeat(wanted, count)
        owner = np.repeat(np.arange(len(key)), count)[again]
        start = lo[owner] + nth[again]
        yield from pack(buckets, key[owner].view(np.uint64), {"key": key[owner], "start": start.astype(np.uint32), "end": (start + length).astype(np.uint32)})

    return run


def _small(df: DataFrame, row_bytes: float) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def repeated_spans(docs: DataFrame, hot: int = HOT, length: int = LENGTH) -> DataFrame:
    """key (xxhash64 of the text), start, end: packed 32-bit offsets in bytes of the spans covered by
    strings of ``length`` bytes (64 or more) that begin anywhere else too. Texts without such spans
    have no row."""
    gram = min(GRAM, length // 2)
    texts = docs.where(F.octet_length("text") >= length).select("doc_id", F.xxhash64("text").alias("key"), "text")
    keyed = texts.select("doc_id", "key", F.octet_length("text").alias("n"))
    one = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_n"), F.sum("n").alias("_bytes")), "texts")
    total = one.agg(F.sum("_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total * 2 / (length - gram) / BUCKET))
    schema = packed_schema(list(_ENTRY))
    entries = texts.select("key", "text").mapInArrow(_entries(buckets, length), schema)
    judged = packed_schema(list(dict.fromkeys([*_SPAN, *_ASK]))) + ", kind string"
    told = stored(by_bucket(entries, _judged(buckets, hot, length), judged), "judged")
    asked = told.where("kind = 'ask'").select("bucket", *_ASK)
    per_key = "key long, " + ", ".join(f"{n} binary" for n in list(_ASK)[1:]) + ", windows long"
    asks = stored(by_bucket(asked, _per_key, per_key), "asks").join(one.select("key", "_doc"), "key")
    asks = asks.withColumnRenamed("key", "_key")
    lines = asks.agg(F.count("*"), F.sum(F.octet_length("at") / 4), F.sum("windows")).first()
    contexts = int(lines[1] or 0)
    wide = 40 + 24 * contexts / max(1, lines[0])
    blocks = max(1, math.ceil(contexts * 1.5 * length / BLOCK))
    cut = texts.join(_small(asks, wide), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select(
        "key", "text", *list(_ASK)[1:]
    )
    pieces = cut.mapInArrow(_cut_contexts(blocks, length), "bucket int, key long, lo long, hi long, wanted boolean, data binary")
    settled = by_bucket(pieces, _settled(buckets, length), packed_schema(list(_SPAN)))
    spans = told.where("kind = 'span'").select("bucket", *_SPAN).unionAll(settled)
    if lines[2]:
        windows = cut.mapInArrow(_windows(math.ceil(lines[2] / BUCKET), length), packed_schema(list(_WINDOW)))
        spans = spans.unionAll(by_bucket(windows, _counted(buckets), packed_schema(list(_SPAN))))
    return by_bucket(spans, _merged, "key long, start binary, end binary")


def with_spans(docs: DataFrame, hot: int = HOT, length: int = LENGTH, among: DataFrame | None = None) -> DataFrame:
    """``docs`` with two more columns, packed byte offsets of starts and ends of what repeats (null: nothing).

    ``among`` has the same rows, where ``docs`` is costlier to make.
    """
    key, start, end = (free_prefix(docs.columns) + n for n in ("key", "start", "end"))
    among = (docs if among is None else among).select("doc_id", "text")
    spans = stored(repeated_spans(among, hot, length), "spans")
    spans = spans.select(F.col("key").alias(key), F.col("start").alias(start), F.col("end").alias(end))
    width = 40 + 8 * (spans.agg(F.avg(F.octet_length(start) / 4)).first()[0] or 0)
    return docs.join(_small(spans, width), F.xxhash64("text") == F.col(key), "left").select(*docs.columns, start, end)


def _keep(text: str | None, start: bytes | None, end: bytes | None, words: int = 0) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the spans that hold ``words`` words or LENGTH bytes, and those spans."""
    data = (text or "").encode()
    spans = list(zip(np.frombuffer(start, np.uint32).tolist(), np.frombuffer(end, np.uint32).tolist())) if start else []
    if words:
        spans = [(a, b) for a, b in spans if b - a >= LENGTH or len(data[a:b].split()) >= words]
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join(parts) + data[at:], spans


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The rows and columns of ``docs`` with each text's repeated bytes taken out.

    Repeated are strings of ``length`` bytes that occur more than once; of the spans they make, those
    of fewer than ``words`` words and LENGTH bytes stay.

    Bytes are judged on the input, so every occurrence of a repeated string goes. Parts of a
    character that remain at a cut are dropped. A null text stays null, and a text shorter than
    ``length`` bytes as it is; an emptied text is the empty string. ``n_chars``, where there is one, is
    counted anew for changed texts.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: batch.column(n) for n in names}
            texts = rows["text"].to_pylist()
            starts, ends = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            new = [t if s is None else _keep(t, s, e, words)[0].decode(errors="ignore") for t, s, e in zip(texts, starts, ends)]
            rows["text"] = pa.array(new, rows["text"].type)
            if "n_chars" in names:
                counts = [c if n == t else len(n) for c, t, n in zip(rows["n_chars"].to_pylist(), texts, new)]
                rows["n_chars"] = pa.array(counts, rows["n_chars"].type)
            yield pa.RecordBatch.from_pydict(rows)

    return with_spans(docs, length=length).mapInArrow(run, docs.schema)


def removals(docs: DataFrame, hot: int = HOT, length: int = LENGTH, passages: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of (doc_id, text); null is empty.

    With ``passages``, (bytes, words), also n_passages and n_passage_bytes: the spans that
    ``without_repeats`` takes out of the text with these, which may be shorter. ``kept`` has them still.
    """
    kind = dict(docs.dtypes)["doc_id"]
    more = ["n_passages", "n_passage_bytes"] if passages else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_keep(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:4]))]
            kept = [r[0] for r in rows]
            gone = [sum(b - a for a, b in r[1]) for r in rows]
            found = {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(k) + g for k, g in zip(kept, gone)], pa.int64()),
                "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(r[1]) for r in rows], pa.int64()),
                "kept": pa.array(kept, pa.binary())}
            if passages:
                spans = [_keep(*x, passages[1])[1] for x in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5)))]
                found["n_passages"] = pa.array([len(x) for x in spans], pa.int64())
                found["n_passage_bytes"] = pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())
            yield pa.RecordBatch.from_pydict(found)

    found = with_spans(docs.select("doc_id", "text"), hot, length)
    if passages:
        found = with_spans(found, hot, passages[0], docs)
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", {n} long" for n in more))


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the passages of 50 words from 200 bytes on, which strings of 400 bytes do not show."""
    found = removals(table(spark, sf_dir, "documents"), passages=(200, 50))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
