"""Conversation prefix trie, built as a burst trie over shards.

A container holds the suffixes of turn ids below one trie head. The first container is the root's,
with every distinct conversation. A container that is too large bursts: the turns that all its
suffixes begin with become a chain of nodes, and the rest is dealt to new containers by the next turn
id. When all are small, tasks sort the suffixes of their containers and sweep them into nodes; what
lies below the burst heads is then added up, the last burst first.

Conversations are cut into windows of ``WINDOW`` turns. What several conversations share beyond a
window's end is a container of its own, named by a hash of all turns before; windows are taken from
the deepest one that is shared. The rest of a conversation that shares no more needs no container.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import lookup, stored, table
from newscorpus.operators.ordering import with_positions

#: Turns of a conversation in one row; suffixes and turns of a container; turns of a task; rows that go to all tasks.
WINDOW, BOX_ROWS, BOX_TURNS, TASK_TURNS, FEW = 1_024, 4_096, 100_000, 300_000, 100_000
#: Members in one row on their way to the digest of a node's conversations.
MEMBERS = 4_096

NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_w long"
_NODE = [c.split()[0] for c in NODE.split(", ")]
_BOX = ["box", "of", "tops", "leaves", "saved"]
SWEPT = f"box binary, of binary, tops long, leaves long, saved long, {NODE}"
_LIMBS = ["s1", "s2", "s3", "s4"]


def turn_id(role: Column, text: Column) -> Column:
    """A 64-bit number for a turn; null role or text is empty. Only turns below one node have to differ."""
    return F.xxhash64(F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def _limbs() -> list[Column]:
    """Four 31-bit hashes of a turn at its depth; sums of them name a sequence of turns."""
    one, two = F.xxhash64("id", "depth"), F.xxhash64("depth", F.lit(1), "id")
    low = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))
    return [low(one), F.shiftrightunsigned(one, 33), low(two), F.shiftrightunsigned(two, 33)]


def _box(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))


def swept(rows: list[tuple]) -> tuple[list[list], list[tuple]]:
    """Nodes (as in NODE) and box summaries of (box, of, base, up, ids, chars, w, rep, ends, below...) rows."""
    rows.sort(key=lambda r: (r[0], r[4]))
    nodes: list[list] = []
    boxes: list[tuple] = []
    stack: list[dict] = []

    def finish(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            node["leaves"] = node["leaves"] or 1
            saved = node["saved"] + (node["n"] - 1) * node["chars"]
            for child in node["made"]:
                nodes[child][2] = node["least"]
            over = stack[-1]
            over["kids"] += 1
            over["leaves"] += node["leaves"]
            over["saved"] += saved
            over["made"].append(len(nodes))
            nodes.append([node["depth"], node["least"], None, node["n"], node["kids"], node["leaves"], saved, node["end"], node["end_w"]])

    def close() -> None:
        if stack:
            finish(1)
            head = stack.pop()
            for child in head["made"]:
                nodes[child][2] = head["up"]
            boxes.append((head["box"], head["of"], head["kids"], head["leaves"], head["saved"]))

    before: list[int] = []
    for box, of, base, up, ids, chars, w, rep, ends, kids, leaves, saved in rows:
        if not stack or stack[0]["box"] != box:
            close()
            stack.append({"box": box, "of": of, "up": up, "kids": 0, "leaves": 0, "saved": 0, "made": []})
            before = []
        same = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            same += 1
        finish(same + 1)
        for node in stack[1:]:
            node["n"] += w
            node["least"] = min(node["least"], rep)
        for at in range(same, len(ids)):
            stack.append({"depth": base + at + 1, "chars": chars[at], "n": w, "least": rep, "kids": 0, "leaves": 0, "saved": 0,
                          "made": [], "end": None, "end_w": None, "below": False})
        last = stack[-1]
        if ends:
            last["end"], last["end_w"] = rep, w
        elif not last["below"]:  # what follows in the next window is the same for all that go on
            last["below"] = True
            last["kids"] += kids
            last["leaves"] += leaves
            last["saved"] += saved
        before = ids
    close()
    return nodes, boxes


_ROW = ["box", "of", "base", "up", "ids", "chars", "w", "rep", "ends", "kids", "leaves", "saved"]


def _sweep(rows: DataFrame) -> DataFrame:
    turns = rows.agg(F.sum(F.size("ids"))).first()[0] or 0
    buckets = max(1, math.ceil(turns / TASK_TURNS))
    names = [*_BOX, *_NODE]

    def run(group: pa.Table) -> pa.Table:
        nodes, boxes = swept(list(zip(*(group[n].to_pylist() for n in _ROW))))
        columns = [*(zip(*boxes)), *([None] * len(boxes) for _ in _NODE)]
        told = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        columns = [*([None] * len(nodes) for _ in _BOX), *zip(*nodes)]
        return pa.concat_tables([told, pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)]) if nodes else told

    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * (len(names) - 2)]
    dealt = rows.select(*_ROW, F.pmod(F.xxhash64("box"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, SWEPT)


def _meet(rows: DataFrame, named: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with one row per key: by broadcast where counting shows few, else with hot keys apart."""
    return rows.join(F.broadcast(named), key, how) if named.count() <= FEW else lookup(rows, named, key, how)


def _burst(rows: DataFrame, box_rows: int, box_turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of containers that are small enough, and the burst ones, level by level."""
    levels: list[DataFrame] = []
    done = None
    active = stored(rows.select(*_ROW), "suffixes")
    while True:
        sizes = active.groupBy("box").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("turns"))
        large = stored(sizes.where((F.col("n") > 1) & ((F.col("n") > box_rows) | (F.col("turns") > box_turns))).select("box", F.lit(True).alias("_large")), "large")
        if large.isEmpty():
            return (active if done is None else done.unionAll(active)), levels
        marked = _meet(active, large, "box")
        small, big = marked.where("_large is null").select(*_ROW), marked.where("_large").select(*_ROW)
        done = small if done is None else done.unionAll(small)
        suffix = F.struct("ids", "chars")
        heads = big.groupBy("box").agg(
            F.first("of").alias("of"), F.first("base").alias("base"), F.first("up").alias("up"),
            F.sum("w").alias("w"), F.min("rep").alias("least"), F.min(suffix).alias("lo"), F.max(suffix).alias("hi"),
        )
        differs = F.array_position(F.zip_with("lo.ids", "hi.ids", lambda a, b: a.eqNullSafe(b)), False)
        heads = heads.withColumn("shared", F.when(differs == 0, F.size("lo.ids")).otherwise(differs - 1).cast("int"))
        heads = stored(heads.select("box", "of", "base", "up", "w", "least", "shared", F.slice("lo.chars", F.lit(1), F.col("shared")).alias("chain")), "heads")
        named = heads.select("box", "shared", "least")
        cut = stored(_meet(big, named, "box", "inner"), "cut")
        # Suffixes that end with the chain: the conversation that ends there, and what the next window holds.
        ended = cut.where(F.size("ids") == F.col("shared")).groupBy("box").agg(
            F.max(F.when(F.col("ends"), F.col("rep"))).alias("end_rep"), F.max(F.when(F.col("ends"), F.col("w"))).alias("end_w"),
            *[F.max(F.when(~F.col("ends"), F.col(c))).alias(f"b_{c}") for c in ("kids", "leaves", "saved")],
        )
        levels.append(stored(heads.join(ended, "box", "left"), "level"))
        rest = F.col("shared") + 1
        longer = cut.where(F.size("ids") > F.col("shared"))
        active = stored(
            longer.select(
                _box(F.hex("box"), F.element_at("ids", rest)).alias("box"), F.col("box").alias("of"),
                (F.col("base") + F.col("shared")).alias("base"), F.when(F.col("shared") > 0, F.col("least")).otherwise(F.col("up")).alias("up"),
                *[F.slice(c, rest, F.size(c)).alias(c) for c in ("ids", "chars")], "w", "rep", "ends", "kids", "leaves", "saved",
            ),
            "suffixes",
        )


def _window_nodes(rows: DataFrame, box_rows: int, box_turns: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes below the containers of ``rows``, and (box, tops, leaves, saved) of each of them."""
    small, levels = _burst(rows, box_rows, box_turns)
    result = stored(_sweep(small), "swept")
    nodes = [result.where("depth is not null").select(*_NODE)]
    told = result.where("depth is null").select(*_BOX)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    for level in reversed(levels):
        sums = told.where("of is not null").groupBy(F.col("of").alias("box")).agg(*[F.sum(c).alias(c) for c in ("tops", "leaves", "saved")])
        met = level.join(sums, "box", "left").select(
            "box", "of", "base", "up", "w", "least", "shared", "chain", "end_rep", "end_w",
            *[(zero(c) + zero(f"b_{b}")).alias(c) for c, b in (("tops", "kids"), ("leaves", "leaves"), ("saved", "saved"))],
        )
        met = stored(met, "heads")
        later = F.aggregate(F.slice("chain", F.col("at") + 1, F.size("chain")), F.lit(0).cast("long"), lambda a, x: a + x)
        last = F.col("at") + 1 == F.col("shared")
        one = F.lit(1).cast("long")
        nodes.append(
            met.where("shared > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shared") - 1))).select(
                (F.col("base") + F.col("at") + 1).alias("depth"), F.col("least").alias("conv_id"),
                F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
                F.when(last, F.col("tops")).otherwise(one).alias("n_children"), F.greatest("leaves", one).alias("n_leaves"),
                (F.col("saved") + (F.col("w") - 1) * later).alias("saved_tokens"),
                F.when(last, F.col("end_rep")).alias("end_rep"), F.when(last, F.col("end_w")).alias("end_w"),
            )
        )
        whole = F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x)
        summary = met.select(
            "box", "of", F.when(F.col("shared") > 0, one).otherwise(F.col("tops")).alias("tops"),
            F.when(F.col("shared") > 0, F.greatest("leaves", one)).otherwise(F.col("leaves")).alias("leaves"),
            (F.col("saved") + (F.col("w") - 1) * whole).alias("saved"),
        )
        told = told.unionAll(summary)
    return nodes, told.where("of is null").select("box", "tops", "leaves", "saved")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, window: int = WINDOW, box_rows: int = BOX_ROWS, box_turns: int = BOX_TURNS
) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the trie of conversations, and which of them are equal.

    ``turns`` has conv_id, depth (1 to n without gaps), id (``turn_id``) and chars, ``convs`` every
    conv_id once, turnless ones too; both are read several times. Nodes have the columns of NODE:
    ``conv_id`` is the smallest member, ``end_rep`` the smallest of the ``end_w`` conversations that
    end at the node (null: none). ``members`` (rep, conv_id) lists conversations that are equal to
    others. A table without conversations has no nodes.
    """
    spark = turns.sparkSession
    limbs = [x.alias(n) for n, x in zip(_LIMBS, _limbs())]
    hashed = turns.select("conv_id", "depth", "id", "chars", *limbs)
    sums = hashed.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in _LIMBS])
    named = convs.join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", *_LIMBS)])
    named = stored(named.select("conv_id", "n", F.struct("n", *_LIMBS).alias("seq")), "named")
    reps = stored(named.groupBy("seq", "n").agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), "reps")
    several = reps.where("w > 1").select("seq", "rep")
    members = lookup(named.select("seq", "conv_id"), several, "seq").select("rep", "conv_id")

    whole = reps.agg(F.min("rep"), F.sum("w"), F.max("n"), F.max(F.when(F.col("n") == 0, F.struct("rep", "w")))).first()
    if whole[1] is None:
        return spark.createDataFrame([], NODE), members
    own = lookup(hashed, reps.where("n > 0").select(F.col("rep").alias("conv_id"), "w", "n"), "conv_id")
    at = F.floor((F.col("depth") - 1) / window).cast("long")
    parts = F.array_sort(F.collect_list(F.struct("depth", "id", "chars")))
    pieces = own.groupBy(F.col("conv_id").alias("rep"), "w", "n", at.alias("win")).agg(
        parts.alias("p"), F.sum("chars").alias("total"), *[F.sum(s).alias(s) for s in _LIMBS]
    )
    pieces = pieces.select(
        "rep", "w", "n", "win", "total", *_LIMBS, F.transform("p", lambda p: p["id"]).alias("ids"), F.transform("p", lambda p: p["chars"]).alias("chars"),
        ((F.col("win") + 1) * window >= F.col("n")).alias("ends"),
    )
    pieces = stored(pieces, "pieces")
    nodes: list[DataFrame] = []
    root = F.unhex(F.lit("00"))
    none = F.lit(None).cast("binary").alias("of")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    first = pieces.where("win = 0")
    short = ["ids", "chars", "w", "rep", "ends"]
    head = [root.alias("box"), none, F.lit(0).cast("long").alias("base"), F.lit(whole[0]).cast("long").alias("up"), *short]
    if whole[2] <= window:
        below = first.select(*head, *zeros)
    else:
        long_ones, told = _long_nodes(pieces.where(F.col("n") > window), window, box_rows, box_turns, nodes)
        goes_on = long_ones.where("win = 0").select("rep", "next")
        after = goes_on.join(told, goes_on["next"] == told["box"], "left").select("rep", *[F.col(c) for c in ("kids", "leaves", "saved")])
        below = first.join(after, "rep", "left").select(*head, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
    made, told = _window_nodes(below, box_rows, box_turns)
    nodes += made
    tops, leaves, saved = (told.agg(*[F.sum(c) for c in ("tops", "leaves", "saved")])).first()
    end = whole[3] or (None, None)
    top = spark.createDataFrame([(0, whole[0], None, whole[1], tops or 0, leaves or 1, saved or 0, *end)], NODE)
    for part in nodes:
        top = top.unionAll(part)
    return top, members


def _long_nodes(pieces: DataFrame, window: int, box_rows: int, box_turns: int, nodes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes beyond the first window are added to ``nodes``. Returns the windows of long conversations
    with ``next``, the container after each, and (box, kids, leaves, saved) of the containers."""
    narrow = pieces.select("rep", "w", "n", "win", "total", *_LIMBS, "ends")
    running = with_positions(narrow, ["rep"], [F.col("win")], running={s: f"b_{s}" for s in _LIMBS} | {"total": "before"})
    name = lambda win, cols: _box(win, *cols)
    placed = running.select(
        "rep", "w", "n", "win", "total", "before", "ends",
        name(F.col("win"), [F.col(f"b_{s}") for s in _LIMBS]).alias("box"),
        F.when(F.col("n") >= (F.col("win") + 1) * window, name(F.col("win") + 1, [F.col(f"b_{s}") + F.col(s) for s in _LIMBS])).alias("next"),
    )
    # The node at a window's end has those as members that end there, too.
    placed = stored(placed, "placed")
    up = placed.where("next is not null").groupBy(F.col("next").alias("box")).agg(F.min("rep").alias("up"))
    boxes = placed.where("win > 0").groupBy("box").agg(F.count("*").alias("reps"), F.max("win").alias("win"))
    boxes = stored(boxes.join(up, "box").select("box", "up", "reps", "win"), "boxes")
    all_chars = placed.groupBy("rep").agg(F.sum("total").alias("all"))
    later = lookup(placed.where("win > 0"), boxes.select("box", "up", "reps"), "box").join(all_chars, "rep")
    later = stored(later.select("rep", "win", "box", "next", "up", "reps", "before", "all"), "later")
    rows = pieces.where("win > 0").join(later, ["rep", "win"])

    # Containers of one conversation: all its nodes have the same member, to the end.
    alone = rows.where("reps = 1").select("*", F.posexplode("chars").alias("at", "_c"))
    done = F.aggregate(F.slice("chars", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    depth = F.col("win") * window + F.col("at") + 1
    is_end = depth == F.col("n")
    nodes.append(alone.select(
        depth.alias("depth"), F.col("rep").alias("conv_id"), F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(is_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("all") - F.col("before") - done)).alias("saved_tokens"),
        F.when(is_end, F.col("rep")).alias("end_rep"), F.when(is_end, F.col("w")).alias("end_w"),
    ))
    told = later.where("reps = 1").join(placed.select("rep", "win", "w"), ["rep", "win"]).select(
        "box", F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * (F.col("all") - F.col("before"))).alias("saved")
    )
    told = stored(told, "told")
    deepest = boxes.where("reps > 1").agg(F.max("win")).first()[0] or 0
    for win in range(deepest, 0, -1):
        here = rows.where((F.col("win") == win) & (F.col("reps") > 1)).select(
            "box", F.lit(None).cast("binary").alias("of"), (F.col("win") * window).alias("base"), "up", "ids", "chars", "w", "rep", "ends", "next"
        )
        after = told.withColumnRenamed("box", "next")
        here = here.join(after, "next", "left").select(*_ROW[:9], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        made, summary = _window_nodes(here, box_rows, box_turns)
        nodes += made
        told = told.unionAll(summary.select("box", F.col("tops").alias("kids"), "leaves", "saved"))
    return placed.select("rep", "win", "next"), told


def member_digests(members: DataFrame, per_row: int = MEMBERS) -> DataFrame:
    """rep, digest: SHA-256 of each rep's conv_ids, ascending, as decimals with commas between them.

    Members are sorted over the cluster and joined to pieces of text where they lie; only pieces meet
    in the task that feeds a rep's digest, one after the other.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, []]

        def flush():
            rep, ids = held
            return pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for rep, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held[1] and (rep != held[0] or len(held[1]) >= per_row):
                    yield flush()
                    held[1] = []
                held[0] = rep
                held[1].append(conv)
        if held[1]:
            yield flush()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or key != rep:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "digest": [state.hexdigest()]})
                    rep, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "digest": [state.hexdigest()]})

    pieces = members.select("rep", "conv_id").orderBy("rep", "conv_id").mapInArrow(joined, "rep long, first long, ids string")
    pieces = stored(pieces, "members")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digested, "rep long, digest string")


def reopened(messages: DataFrame, donor: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that begin with turns of another one.

    ``donor`` and ``shared`` are expressions of conv_id: the first ``shared`` (a few) turns are those
    of ``donor`` (all if fewer, none if absent), followed by the conversation's own ones after its
    first ``shared``. Turns are ordered by turn (null first), then role, then the text's digest. Rows
    with a null conv_id belong to no conversation and are left out; other columns are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    narrow = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_role"), F.md5(text).alias("_digest"),
        turn_id(F.col("role"), F.col("text")).alias("id"), F.char_length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_digest")]
    placed = stored(with_positions(narrow, ["conv_id"], order).select("conv_id", "position", "id", "chars"), "placed")
    convs = stored(placed.select("conv_id").distinct().select("conv_id", donor.cast("long").alias("donor"), shared.cast("long").alias("shared")), "convs")
    most = convs.agg(F.max("shared")).first()[0] or 0
    wanted = convs.select("donor").distinct().withColumnRenamed("donor", "conv_id")
    heads = stored(placed.where(F.col("position") <= most).join(wanted, "conv_id", "left_semi").withColumnRenamed("conv_id", "donor"), "heads")
    opening = convs.join(heads, "donor").where("position <= shared").select("conv_id", F.col("position").cast("long").alias("depth"), "id", "chars")
    sizes = heads.groupBy("donor").agg(F.count("*").alias("has"))
    missing = convs.join(sizes, "donor", "left").select("conv_id", (F.col("shared") - F.coalesce("has", F.lit(0))).alias("missing")).where("missing > 0")
    own = stored(placed.where(F.col("position") > shared), "own")
    own = lookup(own, stored(missing, "missing"), "conv_id", "left").select(
        "conv_id", (F.col("position") - F.coalesce("missing", F.lit(0))).cast("long").alias("depth"), "id", "chars"
    )
    return stored(opening.unionAll(own), "turns"), convs.select("conv_id")


def conversation_nodes(messages: DataFrame, donor: Column, shared: Column, **sizes: int) -> DataFrame:
    """Trie nodes of ``reopened`` conversations, with ``ends_sha256`` in place of the ends."""
    nodes, members = prefix_trie(*reopened(messages, donor, shared), **sizes)
    digests = member_digests(members)
    keep = [c for c in _NODE if not c.startswith("end_")]
    alone = F.when(F.col("end_rep").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("end_rep").cast("string"), 256))
    few = F.coalesce("end_w", F.lit(0)) <= 1
    several = nodes.where(~few).join(digests, F.col("end_rep") == F.col("rep"))
    return nodes.where(few).select(*keep, alone.alias("ends_sha256")).unionAll(several.select(*keep, F.col("digest").alias("ends_sha256")))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt with openings of one in a hundred."""
    c = F.col("conv_id")
    return conversation_nodes(table(spark, sf_dir, "conversations"), c - c % 100, F.crc32(c.cast("string")) % 6)


OP12_SQL = """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT DISTINCT c, c - c % 100 AS donor,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda q, i: xor(q >> 1, 3988292384 * (q & 1)))), 4294967295) % 6 AS h
  FROM o),
r AS (
  SELECT h.c, o.p, role, text FROM h JOIN o ON o.c = h.donor AND o.p <= h.h
  UNION ALL SELECT h.c, o.p, role, text FROM h JOIN o ON o.c = h.c AND o.p > h.h),
t AS (
  SELECT c, row_number() OVER w AS depth, length(text) AS chars,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT c, max(path) AS path FROM t GROUP BY c),
n AS (SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM t GROUP BY path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (
  SELECT DISTINCT a.path, b.path AS under FROM t a JOIN t b ON a.c = b.c AND a.depth <= b.depth),
u AS (
  SELECT s.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM s JOIN m ON m.path = s.under GROUP BY s.path),
x AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM e GROUP BY path)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN u USING (path) LEFT JOIN x USING (path) LEFT JOIN m q ON m.depth > 0 AND q.path = left(m.path, length(m.path) - 64)
"""
