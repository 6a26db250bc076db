"""Repair of conversations: the cheapest edits that make roles alternate, the least audit among equals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import column_of, keep, query, trim
from tabweave.operators.joins import lookup
from tabweave.operators.ordering import row_index

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows of a conversation that are solved together, and their bytes; longer conversations are solved in blocks of so many rows.
ROWS, BYTES = 4_096, 32 << 20
#: States after a prefix: nothing yet, a system turn only, last a user's, last an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = np.array([USER, USER, ASSISTANT, USER])
ENDS = np.array([True, False, False, True])
INF = np.int64(1) << 40
#: Initials of the edits in ASCII order; 0 is the end of an audit.
EDITS = np.frombuffer(b"\0DIKR", np.uint8)
DELETED, INSERTED, KEPT, REROLED = range(1, 5)
_INSERTS = np.array([[0, INF, 3, 6], [INF, 0, 3, 6], [INF, INF, 0, 3], [INF, INF, 3, 0]], np.int64) // 3 * INSERT
_SPACE = r"\x20\x09-\x0D"


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest ways through ``a`` and then ``b``: (min, +) products of matrices, row by row."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return np.minimum(out, INF)


def _through(a: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Cheapest costs from each state through ``a`` and on with ``costs``."""
    return np.minimum((a + costs[:, None, :]).min(axis=2), INF)


def _row_costs(initial: np.ndarray, must: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For every row the cost from each state before it to each state after it, insertions in front included."""
    n = len(initial)
    out = np.full((n, 4, 4), INF)
    for q in range(4):
        out[:, q, q] = DELETE
        stays = np.where(must, INF, CUT * cut)
        out[:, q, FOLLOWS[q]] = np.minimum(out[:, q, FOLLOWS[q]], stays + np.where(initial == FOLLOWS[q], KEEP, REROLE))
    out[:, START, SYSTEM] = np.where((initial == SYSTEM) & ~must, CUT * cut + KEEP, INF)
    return _chained(np.broadcast_to(_INSERTS, out.shape), np.minimum(out, INF))


@dataclass
class Rows:
    """Rows of whole conversations or of blocks of one, end to end.

    ``offsets`` cuts them; ``initial`` is the state their role's initial stands for (START: none);
    ``must`` marks blank rows and duplicates, ``cut`` truncated ones; ``last`` the pieces with which a conversation ends.
    """

    offsets: np.ndarray
    initial: np.ndarray
    must: np.ndarray
    cut: np.ndarray
    last: np.ndarray

    def suffixes(self) -> np.ndarray:
        """For every row the cost matrix from before it to the end of its piece, by doubling."""
        out = _row_costs(self.initial, self.must, self.cut)
        lengths = np.diff(self.offsets)
        ends = np.repeat(self.offsets[1:], lengths)
        at, step = np.arange(len(out)), 1
        while step < lengths.max(initial=0):
            some = at[at + step < ends]
            out[some] = _chained(out[some], out[some + step])
            step *= 2
        return out


class Solved:
    """Costs of all nodes, (place before, between or after the rows of a piece) x state, and the least cheapest path from each.

    ``after``: costs from each state at the end of a piece that is not the last of its conversation.
    """

    def __init__(self, rows: Rows, after: np.ndarray):
        n, pieces = len(rows.initial), len(rows.offsets) - 1
        lengths = np.diff(rows.offsets)
        piece = np.repeat(np.arange(pieces), lengths)
        place = np.arange(n) + piece  # of each row; the place after a piece's last row is its own
        end = rows.offsets[1:] + np.arange(pieces)
        final = np.minimum((_INSERTS + np.where(ENDS, 0, INF)[None, :]).min(axis=1), INF)
        after = np.where(rows.last[:, None], final[None, :], after)
        cost = np.empty((n + pieces, 4), np.int64)
        cost[end] = after
        if n:
            cost[place] = _through(rows.suffixes(), after[piece])
        self.rows, self.cost, self.first = rows, cost, rows.offsets[:-1] + np.arange(pieces)
        self.row = np.full(n + pieces, -1)
        self.row[place] = np.arange(n)
        self.piece = np.empty(n + pieces, np.int64)
        self.piece[place], self.piece[end] = piece, np.arange(pieces)
        self._arcs()
        self._rank()

    def _arcs(self) -> None:
        """The arcs on cheapest paths: target and edit of each, for every node at most one an edit."""
        rows, places = self.rows, len(self.cost)
        node = np.arange(places * 4).reshape(places, 4)
        inner = self.row >= 0
        row = np.maximum(self.row, 0)
        empty = not len(rows.initial)
        take = (lambda a, no: np.full(places, no)) if empty else (lambda a, no: np.where(inner, a[row], no))
        initial, must, cut = take(rows.initial, START), take(rows.must, True), take(rows.cut, False)
        open_ = inner | rows.last[self.piece]  # elsewhere insertions belong to the next piece
        below = np.minimum(node + 4, places * 4 - 1)
        on = np.broadcast_to(FOLLOWS, node.shape)
        step = np.minimum(np.arange(places) * 4 + 4, places * 4 - 4)[:, None]
        stays = np.where(inner & ~must, CUT * cut, INF)[:, None]
        fits = initial[:, None] == on
        system = (initial[:, None] == SYSTEM) & (np.arange(4) == START)
        target = np.stack([node, below, node - np.arange(4) + on, step + np.where(system, SYSTEM, on), step + on])
        weight = np.stack([
            np.full(node.shape, INF), np.broadcast_to(np.where(inner, DELETE, INF)[:, None], node.shape), np.broadcast_to(np.where(open_, INSERT, INF)[:, None], node.shape),
            stays + np.where(fits | system, KEEP, INF), np.broadcast_to(stays + REROLE, node.shape),
        ])
        self.target = target.reshape(5, -1)
        flat = self.cost.reshape(-1)
        self.tight = (weight.reshape(5, -1) < INF) & (weight.reshape(5, -1) + flat[self.target] == flat)
        self.end = ~self.tight.any(axis=0)

    def _rank(self) -> None:
        """Ranks the nodes by their least audits of 1, 2, 4, ... edits, then lets the ranks choose each node's arc.

        An edit and a state determine the next node, so equal audits from one node lead to one node, and the
        doubled pointer after the least audit of 2^k edits is unique.
        """
        nodes = np.arange(self.tight.shape[1])
        edit = np.where(self.end, 0, self.tight.argmax(axis=0))
        rank, pointer = edit.astype(np.int64), self.target[edit, nodes]
        while not self.end[pointer].all():
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
        size = rank.max(initial=0) + 1
        order = np.where(self.tight, np.arange(5)[:, None] * size + rank[self.target], 5 * size)
        self.edit = np.where(self.end, 0, order.argmin(axis=0))
        self.pointers = [self.target[self.edit, nodes]]
        while not self.end[self.pointers[-1]].all():
            self.pointers.append(self.pointers[-1][self.pointers[-1]])

    def paths(self, states: np.ndarray) -> np.ndarray:
        """Nodes of the paths of all pieces, each from its state, end to end, without their ends."""
        seq = self.first * 4 + states
        for pointer in reversed(self.pointers):
            seq = np.stack([seq, pointer[seq]], 1).ravel()
            seq = seq[~self.end[seq]]
        return seq

    def exits(self, states: np.ndarray) -> np.ndarray:
        """The state in which each piece's path from ``states`` ends."""
        return self.pointers[-1][self.first * 4 + states] % 4

    def audits(self, seq: np.ndarray) -> pa.Array:
        """The edits' initials of each piece's path."""
        size = np.bincount(self.piece[seq // 4], minlength=len(self.first))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        letters = EDITS[self.edit[seq]]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).cast(pa.string())

    def repaired(self, seq: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Piece, row (-1: inserted), role, text and edit of each turn of the repaired conversations."""
        seq = seq[self.edit[seq] != DELETED]
        edit, place = self.edit[seq], seq // 4
        row = np.where(edit == INSERTED, -1, self.row[place])
        source = pa.array(np.maximum(row, 0), mask=row < 0)
        named = pa.array(["user", "assistant"], pa.string()).take(pa.array((self.pointers[0][seq] % 4 == ASSISTANT).astype(np.int64)))
        kept = pa.array(edit == KEPT)
        role = pc.if_else(kept, roles.take(source), named) if len(roles) else named
        text = pc.fill_null(texts.take(source), "") if len(texts) else pa.array([""] * len(seq), pa.string())
        return self.piece[place], row, role, text, edit


def _joined_lines(role: pa.Array, text: pa.Array, starts_line: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Lines ``role:text``, a newline before those of ``starts_line``: byte offsets of the lines and all bytes."""
    large = pa.large_string()
    lead = pa.array(np.where(starts_line, "\n", "").astype(object), large)
    named = pc.binary_join_element_wise(lead, role.cast(large), pa.scalar("", large))
    lines = pc.binary_join_element_wise(named, text.cast(large), pa.scalar(":", large))
    _, offsets, data = lines.buffers()
    return np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1], memoryview(data or b"")


def _hashes(owner: np.ndarray, role: pa.Array, text: pa.Array, n: int) -> list[str]:
    follows = np.zeros(len(owner), bool)
    follows[1:] = owner[1:] == owner[:-1]
    offsets, data = _joined_lines(role, text, follows)
    cuts = offsets[np.searchsorted(owner, np.arange(n + 1))] if len(owner) else np.zeros(n + 1, np.int64)
    return [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _pieces(keys: pa.Array) -> np.ndarray:
    """Offsets of runs of equal keys (null equals null)."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def _seen_before(piece: np.ndarray, role: pa.Array, text: pa.Array) -> np.ndarray:
    """Whether an earlier row of the piece has the same role and text."""
    r, t = (c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (role, text))
    order = np.lexsort((t, r, piece))
    same = np.zeros(len(order), bool)
    p, r, t = piece[order], r[order], t[order]
    same[1:] = (p[1:] == p[:-1]) & (r[1:] == r[:-1]) & (t[1:] == t[:-1])
    out = np.empty(len(order), bool)
    out[order] = same
    return out


def _legal(initial: np.ndarray, follows: np.ndarray) -> np.ndarray:
    return ((follows == USER) & ((initial == SYSTEM) | (initial == ASSISTANT))) | ((follows == ASSISTANT) & (initial == USER))


def _gaps(turn: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Turns that are missing between the first and the last of each piece, sorted with nulls first."""
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    value = turn.fill_null(0).to_numpy()
    n = np.diff(offsets)
    piece = np.repeat(np.arange(len(n)), n)
    new = known.copy()
    new[1:] &= ~(known[:-1] & (value[1:] == value[:-1]) & (piece[1:] == piece[:-1]))
    total = np.concatenate([[0], np.cumsum(new)])
    distinct = total[offsets[1:]] - total[offsets[:-1]]
    unknown = np.concatenate([[0], np.cumsum(~known)])
    first = offsets[:-1] + unknown[offsets[1:]] - unknown[offsets[:-1]]
    some = distinct > 0
    out = np.zeros(len(n), np.int64)
    out[some] = value[offsets[1:][some] - 1] - value[first[some]] + 1 - distinct[some]
    return out


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solve_whole(data: pa.Table) -> tuple[dict[str, pa.Array], Solved, np.ndarray]:
    """What is found in whole conversations, sorted, with blank and cut rows marked."""
    offsets = _pieces(column_of(data, "conv_id"))
    n = np.diff(offsets)
    piece = np.repeat(np.arange(len(n)), n)
    role, text = column_of(data, "role"), column_of(data, "text")
    initial = column_of(data, "initial").to_numpy().astype(np.int64)
    blank = column_of(data, "blank").to_numpy(zero_copy_only=False)
    again = _seen_before(piece, role, text) & ~blank
    cut = column_of(data, "cut").to_numpy(zero_copy_only=False) & ~blank & ~again
    solved = Solved(Rows(offsets, initial, blank | again, cut, np.ones(len(n), bool)), np.zeros((len(n), 4), np.int64))
    seq = solved.paths(np.full(len(n), START))
    wrong = np.zeros(len(initial), bool)
    wrong[1:] = (piece[1:] == piece[:-1]) & ~_legal(initial[:-1], initial[1:])
    sums = {name: pa.array(np.add.reduceat(flag.astype(np.int64), offsets[:-1]) if len(n) else n) for name, flag in (("blank", blank), ("duplicate", again), ("truncated", cut), ("illegal", wrong))}
    ids = column_of(data, "conv_id").take(pa.array(offsets[:-1]))
    found = {"conv_id": ids, "gaps": pa.array(_gaps(column_of(data, "turn"), offsets))} | sums
    return found | {"cost": pa.array(solved.cost[solved.first, START]), "audit": solved.audits(seq)}, solved, seq


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a conversation ends; only the rows of one are carried on."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 2_000:
            continue
        data = pa.Table.from_batches(held).combine_chunks()
        last = int(_pieces(column_of(data, "conv_id"))[-2])
        if last:
            yield data.slice(0, last).combine_chunks()
        held = data.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _marked(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their marks and the keys that settle ties."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    first = F.substring("role", 1, 1)
    state = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(START)
    return rows.select(
        "*", state.cast("int").alias("initial"), (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut"),
        F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("hash"),
    )


ORDER = ["turn", "role", "head", "hash"]


def _split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that fit one task, and those of longer ones (None: there are none)."""
    long = keep(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > most) | (F.col("bytes") > BYTES)), "long")
    n_long = long.count()
    if not n_long:
        return rows, None
    flagged = lookup(rows, long.withColumn("_long", F.lit(True)), {"conv_id": F.col("conv_id")}, ["_long"], weight="n", n_table=n_long)
    return flagged.filter("_long is null").drop("_long"), keep(flagged.filter("_long").drop("_long"), "long-rows")


def _streamed(rows: DataFrame, order: list[Column | str], fn, schema: str) -> DataFrame:
    """``fn`` over all rows of each conversation in order, batch by batch: what it holds doesn't grow with them."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(fn, schema)


def _in_blocks(long: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long conversations in blocks of ``most`` rows: their rows, what is found in each conversation, each block's state and audit.

    A block's costs are one matrix, (state before, state after).  The matrices of a conversation are streamed from the
    last to the first, which gives every block the costs behind it; with these each block ranks its own
    nodes and gives the audit and the state after it for each state before it; streamed from the first to the
    last, these give the state before each block.
    """
    placed = row_index(long.withColumn("_same", F.monotonically_increasing_id()), [*ORDER, "_same"], by=["conv_id"], name="place")
    placed = keep(placed.withColumn("digest", F.sha2("text", 256)).drop("_same", "head", "hash"), "placed")
    firsts = keep(placed.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    known = lookup(placed, firsts, {k: F.col(k) for k in ("conv_id", "role", "digest")}, ["first"], weight="n")
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False)) & ~F.col("blank")
    rows = known.select("conv_id", "turn", "role", "text", "initial", "blank", "place", again.alias("again"), (F.col("cut") & ~F.col("blank") & ~again).alias("cut"), F.floor(F.col("place") / most).cast("bigint").alias("block"))
    rows = keep(rows, "blocks")
    slim = rows.select("conv_id", "block", "place", "initial", (F.col("blank") | F.col("again")).alias("must"), "cut")

    def of(group: pa.Table) -> tuple[pa.Table, Rows]:
        group = group.take(pa.array(np.argsort(column_of(group, "place").to_numpy(), kind="stable"))).combine_chunks()
        flags = [column_of(group, c).to_numpy(zero_copy_only=False) for c in ("must", "cut")]
        return group, Rows(np.array([0, group.num_rows]), column_of(group, "initial").to_numpy().astype(np.int64), *flags, np.zeros(1, bool))

    def matrix(group: pa.Table) -> pa.Table:
        group, mine = of(group)
        wrong = int((~_legal(mine.initial[:-1], mine.initial[1:])).sum())
        costs = pa.array([mine.suffixes()[0].ravel().tolist()], pa.list_(pa.int64()))
        edge = [pa.array([int(mine.initial[i])], pa.int32()) for i in (0, -1)]
        return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "block": group.column("block").slice(0, 1), "costs": costs, "wrong": pa.array([wrong]), "head": edge[0], "tail": edge[1]})

    blocks = keep(slim.groupBy("conv_id", "block").applyInArrow(matrix, "conv_id long, block long, costs array<long>, wrong long, head int, tail int"), "matrices")

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs behind each block, whether it is the last, and the costs before it."""
        now, after, head = object(), None, None
        for b in batches:
            out = []
            for r in b.select(["conv_id", "costs", "wrong", "head", "tail"]).to_pylist():
                last = r["conv_id"] != now
                costs = np.array(r["costs"], np.int64).reshape(1, 4, 4)
                if last:
                    after, head = np.minimum((_INSERTS + np.where(ENDS, 0, INF)).min(axis=1), INF), None
                edge = head is not None and not _legal(np.array(r["tail"]), np.array(head))
                before = _through(costs, after[None, :])[0]
                out.append((after.tolist(), last, before.tolist(), r["wrong"] + int(edge)))
                now, after, head = r["conv_id"], before, r["head"]
            columns = [b.column("conv_id"), b.column("block")] + [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "after", "last", "before", "wrong"])

    behind = keep(_streamed(blocks, [F.col("block").desc()], backwards, "conv_id long, block long, after array<long>, last boolean, before array<long>, wrong long"), "behind")

    def solved(group: pa.Table, ends: pa.Table) -> tuple[pa.Table, Solved]:
        group, mine = of(group)
        mine.last = np.array(column_of(ends, "last").to_pylist()[:1])
        return group, Solved(mine, np.array(column_of(ends, "after").to_pylist()[:1], np.int64))

    def choose(group: pa.Table, ends: pa.Table) -> pa.Table:
        group, s = solved(group, ends)
        states = [np.array([q]) for q in range(4)]
        audits = [s.audits(s.paths(q))[0].as_py() for q in states]
        return pa.table({
            "conv_id": group.column("conv_id").slice(0, 1), "block": group.column("block").slice(0, 1),
            "exits": pa.array([[int(s.exits(q)[0]) for q in states]], pa.list_(pa.int32())), "audits": pa.array([audits], pa.list_(pa.string())),
        })

    chosen = keep(slim.groupBy("conv_id", "block").cogroup(behind.groupBy("conv_id", "block")).applyInArrow(choose, "conv_id long, block long, exits array<int>, audits array<string>"), "choices")

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), START
        for b in batches:
            states, audits = [], []
            for r in b.to_pylist():
                state = state if r["conv_id"] == now else START
                now = r["conv_id"]
                states.append(state)
                audits.append(r["audits"][state])
                state = r["exits"][state]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(states, pa.int32()), pa.array(audits, pa.string())], names=["conv_id", "block", "state", "audit"])

    entered = keep(_streamed(chosen, ["block"], forwards, "conv_id long, block long, state int, audit string"), "entered")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *[F.sum(F.col(c).cast("bigint")).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"))]
    )
    costs = behind.groupBy("conv_id").agg(F.sum("wrong").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("before")[START])).alias("cost"))
    audits = entered.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])).alias("audit"))
    same = lambda a, b: a.join(b.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    found = same(same(counts, costs), audits)

    def repair(group: pa.Table, ends: pa.Table) -> pa.Table:
        group, s = solved(group, ends)
        state = np.array(column_of(ends, "state").to_pylist()[:1])
        _, row, role, text, edit = s.repaired(s.paths(state), column_of(group, "role"), column_of(group, "text"))
        n, source = len(row), pa.array(np.maximum(row, 0), mask=row < 0)
        same = lambda c: group.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({
            "conv_id": same("conv_id"), "block": same("block"), "step": pa.array(np.arange(n)), "turn": column_of(group, "turn").take(source), "role": role, "text": text,
            "edit": pa.array(EDITS[edit].tobytes().decode(), pa.string()) if not n else pa.array([chr(EDITS[e]) for e in edit], pa.string()),
        })

    both = behind.select("conv_id", "block", "after", "last").join(entered.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "state"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    whole = rows.withColumn("must", F.col("blank") | F.col("again"))
    turns = whole.groupBy("conv_id", "block").cogroup(both.groupBy("conv_id", "block")).applyInArrow(repair, "conv_id long, block long, step long, turn long, role string, text string, edit string")
    return rows, found, turns


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, taken in as they come."""
    now, digest = None, None
    for b in batches:
        if not b.num_rows:
            continue
        cuts = _pieces(b.column("conv_id"))
        ids = b.column("conv_id").to_pylist()
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if digest is None or ids[a] != now:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])
                now, digest, lead = ids[a], hashlib.sha256(), ""
            else:
                lead = "\n"
            part = b.slice(a, z - a)
            lines = [f"{r}:{t}" for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            digest.update((lead + "\n".join(lines)).encode())
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def audit_conversations(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """What is wrong with each conversation and its cheapest repair, one row a conv_id.

    ``conversations`` has conv_id, turn, role and text; other columns are not read, whatever their names.
    A conversation's rows are taken by turn, nulls first; ties by role, the text's first 64 characters and its hash.
    Null roles and texts are one space; rows with a null conv_id are one conversation.  A row's first fault
    counts: blank, duplicate (role and text seen earlier, so repeated rows are duplicates), truncated (no
    ``.!?`` at its end).  Edits: keep 0, rerole to user or assistant 3, delete 4 (blank rows and duplicates must go),
    insert an empty turn 3; truncated rows that stay cost 3 more.  ``audit`` has the initials of the cheapest
    edits after which the roles read ``(s?(ua)+)?``, the ASCII-least of equal cost; roles with other
    initials are never kept.  ``repaired_sha256`` is over the repaired ``role:text`` lines.  Empty tables give none.

    Conversations of up to ``most`` rows and 32 MB are solved whole, many in one batch; longer ones in blocks
    (see :func:`_in_blocks`), so no task holds a conversation.  Only the hash, which must be taken in sequence, streams
    all lines of a conversation through one task.
    """
    short, long = _split(_marked(conversations), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _whole_conversations(batches):
            found, solved, seq = _solve_whole(data)
            owner, _, role, text, _ = solved.repaired(seq, column_of(data, "role"), column_of(data, "text"))
            found["repaired_sha256"] = pa.array(_hashes(owner, role, text, len(found["conv_id"])), pa.string())
            yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
        trim()

    out = _streamed(short, ORDER, run, f"conv_id long, {FOUND}, repaired_sha256 string")
    if long is None:
        return out
    _, found, turns = _in_blocks(long, most)
    hashes = _streamed(turns.select("conv_id", "block", "step", "role", "text"), ["block", "step"], _streamed_hashes, "_c long, repaired_sha256 string")
    rest = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.unionByName(rest.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty)))


def repair_conversations(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), turn (null: inserted), role, text, edit (K, R or I).

    See :func:`audit_conversations` for the rules; conversations of which nothing is left give no row.
    """
    short, long = _split(_marked(conversations), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _whole_conversations(batches):
            found, solved, seq = _solve_whole(data)
            owner, row, role, text, edit = solved.repaired(seq, column_of(data, "role"), column_of(data, "text"))
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            turn = column_of(data, "turn").take(pa.array(np.maximum(row, 0), mask=row < 0))
            columns = [found["conv_id"].take(pa.array(owner)), pa.array(place), turn, role, text, pa.array([chr(EDITS[e]) for e in edit], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "turn", "role", "text", "edit"])
        trim()

    out = _streamed(short, ORDER, run, "conv_id long, place long, turn long, role string, text string, edit string")
    if long is None:
        return out
    turns = keep(_in_blocks(long, most)[2], "turns")
    return out.unionByName(row_index(turns, ["block", "step"], by=["conv_id"], name="place").drop("block", "step"))


def damage(conversations: DataFrame) -> DataFrame:
    """The same faults in the same rows every time, by the checksum of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(" ")))][1:])
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE
    crc_table AS (
        SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
    ), source AS (
        SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS cid, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations
    ), kinds AS (
        SELECT *, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS k FROM source, crc_table
    ), damaged AS (
        SELECT cid, turn, copy, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM kinds, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY cid) AS m, left(role, 1) AS initial FROM damaged
    ), faults AS (
        SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(initial) OVER (PARTITION BY cid ORDER BY i) || initial AS pair FROM placed
    ), marked AS (SELECT *, blank OR again AS must, CASE WHEN open AND NOT blank AND NOT again THEN 3 ELSE 0 END AS cut FROM faults
    ), walk AS (
        SELECT DISTINCT cid, m + 1 AS i, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM marked
        UNION ALL
        SELECT cid, i, [
            list_min([o[1], {'c': o[3].c + 3, 'a': 'I' || o[3].a}, {'c': o[4].c + 6, 'a': 'II' || o[4].a}]),
            list_min([o[2], {'c': o[3].c + 3, 'a': 'I' || o[3].a}, {'c': o[4].c + 6, 'a': 'II' || o[4].a}]),
            list_min([o[3], {'c': o[4].c + 3, 'a': 'I' || o[4].a}]), list_min([o[4], {'c': o[3].c + 3, 'a': 'I' || o[3].a}])] FROM (
            SELECT w.cid, r.i, [
                list_min([{'c': v[q].c + 4, 'a': 'D' || v[q].a},
                    {'c': CASE WHEN must OR NOT (CASE q WHEN 1 THEN initial IN ('s', 'u') WHEN 3 THEN initial = 'a' ELSE initial = 'u' END) THEN 1000000000 ELSE cut END + v[CASE WHEN q = 1 AND initial = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END].c,
                     'a': 'K' || v[CASE WHEN q = 1 AND initial = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END].a},
                    {'c': CASE WHEN must THEN 1000000000 ELSE cut + 3 END + v[CASE WHEN q = 3 THEN 4 ELSE 3 END].c, 'a': 'R' || v[CASE WHEN q = 3 THEN 4 ELSE 3 END].a}])
                FOR q IN [1, 2, 3, 4]] AS o FROM walk w JOIN marked r ON r.cid = w.cid AND r.i = w.i - 1)
    ), audits AS (SELECT cid, v[1].c::BIGINT AS cost, v[1].a AS audit FROM walk WHERE i = 1
    ), edits AS (
        SELECT cid, j, audit[j] AS e, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) AS o FROM audits, unnest(range(1, length(audit) + 1)) u(j)
    ), kept AS (
        SELECT e.*, r.role, r.text, max(CASE WHEN o = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.cid) AS lead
        FROM edits e LEFT JOIN marked r ON r.cid = e.cid AND r.i = e.i WHERE e <> 'D'
    ), lines AS (
        SELECT cid, string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM kept GROUP BY cid
    ), sums AS (
        SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
               count(*) FILTER (cut > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY cid
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, cid FROM source) c LEFT JOIN sums s USING (cid) LEFT JOIN audits a USING (cid) LEFT JOIN lines l USING (cid)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = audit_conversations(damage(rows)).withColumnRenamed("conv_id", "_c")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in out.columns if c != "conv_id"])
