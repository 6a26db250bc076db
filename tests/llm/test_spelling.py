"""Spelling variants against a comparison of all pairs; odd words, small boxes, folded alphabets, whole query."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from tabweave.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts, ratio=2):
    masks = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)  # replaced
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in counts:
                masks[(w, i)] |= {w, w[:i] + w[i + 1 :]}
    near = collections.defaultdict(set)
    for group in masks.values():
        for a in group:
            near[a] |= group - {a}
    assert all(one_edit(a, b) for a in list(near)[:200] for b in near[a])
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def variants(df, **more):
    return {tuple(r) for r in spelling.spelling_variants(df, **more).collect()}


def vocabulary(rng, letters, n):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n)}
    return {w: rng.choice([1, 1, 2, 3, 7, 20, 20, 500]) for w in sorted(words)}


@pytest.mark.parametrize(("letters", "box", "parts"), [("abcde", 16_384, 4), ("abcéÿ÷", 64, 4), ("abcdefgh日本語", 40, 0.1)])
def test_variants_equal_a_comparison_of_all(spark, monkeypatch, letters, box, parts):
    counts = vocabulary(random.Random(3), letters, 900) | {"x" * 5_000: 9, "x" * 4_999: 4, "aaaaa": 3}
    monkeypatch.setattr(spelling, "box_words", lambda length: max(8, int(box * parts)) if parts < 1 else box)
    df = spark.createDataFrame([(w, n, "x", "x") for w, n in counts.items()] + [(None, 3, "x", "x"), ("", 9, "x", "x")], "word string, n long, form string, box string").repartition(4)
    assert variants(df) == brute(counts)
    assert variants(df, ratio=30) == brute(counts, 30)


def test_boxes_that_no_cut_can_part_are_dealt_to_parts(spark, monkeypatch):
    rng = random.Random(5)
    counts = {"".join(rng.sample("abcdefg", 7)): rng.randint(1, 50) for _ in range(700)} | {"".join(rng.sample("abcdefh", 7)): rng.randint(1, 50) for _ in range(700)}
    monkeypatch.setattr(spelling, "box_words", lambda length: 30)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    boxes = spelling.find_boxes(df)
    assert boxes.parts.max() > 3
    assert variants(df) == brute(counts)


def test_many_letters_are_folded():
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(700)]
    words = sorted({"".join(rng.choice(letters[: 9 if i % 2 else 700]) for _ in range(4)) for i in range(800)})
    n = np.arange(len(words))
    import pyarrow as pa

    count, _ = spelling.near_in_box(pa.array(words), n, np.ones(len(words), bool))
    assert count.tolist() == [sum(one_edit(a, b) for b in words) for a in words] and count.max() > 0


def brute_counts(rows, misspell, letters=5, occurrences=3):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspell and h % misspell == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= occurrences}


@pytest.mark.parametrize("misspell", [0, 3])
def test_words_are_counted_as_stated(spark, docs, misspell):
    from odd_rows import documents

    rows = [(r[0], r[1]) for r in documents()] + [(7, "×÷ßÀÉ straße STRASSE naïve İstanbul ſtraße façade—façade façade" * 4), (8, "verylong" * 700_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.count_words(more, misspell).collect()} == brute_counts(rows, misspell)


def test_the_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.op12(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(brute_counts(rows, 97))


def test_empty_tables(spark, empty):
    assert spelling.count_words(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
