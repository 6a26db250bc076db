"""Conversation repair against a plain recursion over all edits, whole and in blocks, and on odd rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabweave.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, place string, block string, step string, n string, _copy string"


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash, repaired) of rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserts):
        """Least (cost, audit, turns) from row i on; a detour inserts at most a few turns in a row."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, more, turn=None):
            if more:
                found.append((cost + more[0], edit + more[1], ((turn,) if turn else ()) + more[2]))

        if inserts:
            for role in ("user", "assistant"):
                if role[0] in allowed[state]:
                    add(3, "I", best(i, role[0], inserts - 1), (role, ""))
        if i < len(rows):
            _, role, text = rows[i]
            add(4, "D", best(i + 1, state, 3))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if role[:1] and role[:1] in allowed[state]:
                    add(extra, "K", best(i + 1, role[0], 3), (role, text))
                for other in ("user", "assistant"):
                    if other[0] in allowed[state]:
                        add(3 + extra, "R", best(i + 1, other[0], 3), (other, text))
        return min(found, default=None)

    cost, audit, turns = best(0, "", 3)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = collections.Counter(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest), turns


def in_order(spark, rows):
    """Rows of each conversation, nulls filled, in the order the operator states."""
    df = spark.createDataFrame([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], "conv_id long, turn long, role string, text string")
    out = collections.defaultdict(list)
    for r in df.withColumn("h", F.xxhash64("text")).collect():
        out[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0, r["role"], r["text"][:64], r["h"]), (r["turn"], r["role"], r["text"])))
    return {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    """Random conversations of up to 12 rows, long ones, null keys, equal turns, other roles, blank and equal rows."""
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire", "System"]
    texts = ["a b.", "a b", "what?", "", " \t\n", "no end", "done!", "done! \n", "é…", None, ". . x", " "]
    out = []
    for c in range(220):
        for t in range(rng.randint(1, 12)):
            turn = rng.choice([t, t, t, t, t + 2, None])
            out.append((c, turn, rng.choice(roles[:5] if c % 3 else roles), rng.choice(texts) if c % 2 else f"{t} {rng.choice(texts)}"))
    out += [(None, t, r, x) for t, r, x in [(0, "user", "x."), (1, "user", "y"), (None, "assistant", "z."), (1, "user", "y"), (1, "user", "y")]]
    out += [(900, i // 2, rng.choice(["user", "assistant", "user", "system"]), f"text {rng.randint(0, 40)}{rng.choice(['.', ''])}") for i in range(150)]
    out += [(901, 5, "user", "the same row.")] * 30 + [(902, 0, "user", "long text " * 300_000), (902, 1, "assistant", "ok.")]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def wanted(spark, rows):
    return {c: brute(tuple(v)) for c, v in in_order(spark, rows).items()}


@pytest.mark.parametrize("most", [4_096, 3])
def test_audits_equal_a_plain_recursion(table, wanted, most):
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit_conversations(table, most).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == {c: w for c, (w, _) in wanted.items()}


@pytest.mark.parametrize("most", [4_096, 5])
def test_repaired_turns_are_those_of_the_audit(table, wanted, most):
    got = collections.defaultdict(dict)
    for r in conversations.repair_conversations(table, most).collect():
        got[r["conv_id"]][r["place"]] = (r["role"], r["text"])
        assert (r["edit"] == "I") <= (r["turn"] is None and r["text"] == "")
    assert {c: tuple(v[i] for i in range(len(v))) for c, v in got.items()} == {c: t for c, (_, t) in wanted.items() if t}


def test_damage_follows_the_checksum(spark, rows):
    got = collections.Counter(tuple(r) for r in conversations.damage(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            want[(c, t, "user" if kind == 4 else role, text)] += 2 if kind == 3 else 1
    assert got == want


def test_query_keeps_every_conversation(spark, sf_dir, tmp_path):
    got = {r["conv_id"]: r for r in conversations.op11(spark, sf_dir).collect()}
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert set(got) == {r[0] for r in raw.select("conv_id").distinct().collect()}
    damaged = in_order(spark, [tuple(r) for r in conversations.damage(raw).collect()])
    empty = hashlib.sha256().hexdigest()
    for c, r in got.items():
        want = brute(tuple(damaged[c]))[0] if c in damaged else (0, 0, 0, 0, 0, 0, "", empty)
        assert tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.audit_conversations(none).count() == 0 and conversations.repair_conversations(none).count() == 0
