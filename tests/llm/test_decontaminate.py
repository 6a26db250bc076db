"""Benchmark decontamination against a plain search on odd rows, sliced or not, and what is cut out."""

import collections
import hashlib
import re

import pytest

from tabweave.llm import decontaminate

ITEMS = [
    (1, "Alpha, beta gamma delta; epsilon zeta eta theta iota kappa lambda mu nu!"), (2, "one two three"), (3, "Ünï çödé 42 words"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (5, None), (6, " ... "), (7, "rare"), (8, "one two three"), (7, "twice named"), (10, " ".join(f"shared{i}" for i in range(25))), (11, " ".join(f"shared{i}" for i in range(8, 18))),
]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items=ITEMS, size=10):
    w = words(text)
    hit, names = set(), set()
    for name, t in items:
        x = words(t)
        m = min(size, len(x))
        grams = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                names.add("" if name is None else str(name))
    return w, hit, (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))


@pytest.fixture(scope="module")
def texts():
    passage = "alpha BETA gamma-delta epsilon (zeta) eta theta iota kappa"
    return [
        (1, f"before {passage} after"), (2, passage.replace("kappa", "kapp")), (3, "ONE two, three one TWO three four"), (4, "ünï çödé 42 words; ÜNÏ çödé 42 words"), (5, None), (6, ""), (7, " \n\0"),
        (8, "one\x00two\x7fthree"), (9, "onetwo three"), (None, f"{passage} lambda mu nu and rarely"), (11, "rare"), (11, "rare"), (12, "so Rare it is. " * 3), (13, "twice_named"),
        (14, " ".join(["filler text here"] * 600_000 + [f"shared{i}" for i in range(5, 20)] + ["tail"] * 9)), (15, " ".join(f"shared{i}" for i in range(9))), (16, "日本 語 rare"),
    ]


@pytest.fixture(scope="module")
def tables(spark, texts):
    names = "n_words string, n_hit string, item string, words string, hit string, contaminated string"
    docs = spark.createDataFrame([(i, t, *["x"] * 6, 0 if t is None else len(t)) for i, t in texts], f"doc_id long, text string, {names}, n_chars long").repartition(4).cache()
    items = spark.createDataFrame([(*r, "x", "x") for r in ITEMS], "item_id long, text string, item string, words string").repartition(3).cache()
    return docs, items


@pytest.mark.parametrize("slice_bytes", [8 << 20, 60])
def test_contamination_equals_a_plain_search(tables, texts, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)  # 60: several broadcasts
    got = collections.Counter(tuple(r) for r in decontaminate.contamination(*tables).collect())
    assert got == collections.Counter((i, *brute(t)[2]) for i, t in texts)


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 12)
    item = " ".join(f"w{i}" for i in range(200))
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(191)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r["n_hit"], r["n_items"]) for r in got.collect()} == {(10, 1)} and got.count() == 191


def test_hit_words_or_documents_are_removed(tables, texts):
    docs, items = tables
    cut = {(r["doc_id"], r["text"], r["n_chars"]) for r in decontaminate.decontaminate(docs, items).collect()}
    clean = decontaminate.decontaminate(docs, items, remove="documents")
    assert clean.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(i for i, t in texts if not brute(t)[1])
    assert (1, "before after", 12) in cut and (3, "four", 4) in cut and (2, texts[1][1], len(texts[1][1])) in cut and (5, None, 0) in cut
    for i, t in texts:
        w, hit, _ = brute(t)
        rest = [x for k, x in enumerate(w) if k not in hit]
        mine = [words(x) for d, x, _ in cut if d == i]
        assert (not mine) if hit and not rest else rest in mine


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()
