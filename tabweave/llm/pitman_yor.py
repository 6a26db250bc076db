"""Language-model scores by a hierarchical Pitman-Yor model of word pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.chunks import FRAGMENT_ENTRIES, QUESTION, NULL_ID, Chunk, answers, chunk_documents, each_answered, each_chunk, joined, questions, squeeze, stretch
from tabweave.llm.common import keep, mix, query, table, trim

#: Concentrations of the root and of the context restaurants.
THETA_ROOT, THETA_CONTEXT = 1.0, 1.0
BURN_IN, SAMPLES = 2, 4
#: Customers seated one at a time; later ones in runs of a sixteenth of those seated.
SINGLE_STEPS = 32
#: The end of a document, which is also the context of its first word.
END = np.uint64(0xE5D0F0C0FFEE1234)
#: Text of a chunk: larger ones than elsewhere, as each distinct word and pair of a chunk is sent once.
CHUNK_BYTES = 8 << 20
#: Rows that carry a fragment's totals, its pairs, its chunks' entries, its tables or its words' sums instead of a chunk's answers.
TOTALS, STATE, LINKS, TABLES, SUMS = -1, -2, -3, -4, -5


@dataclass
class Tokens:
    """Tokens of a chunk: words, then the end, of each document; codes index ``hashes``, the last of which is the end."""

    hashes: np.ndarray
    code: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, chunk: Chunk) -> Tokens:
        n = np.diff(chunk.offsets)
        end = len(chunk.hashes)
        doc = np.repeat(np.arange(len(n)), n + 1)
        code = np.full(len(doc), end, np.int64)
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(doc), bool)
        inner[last] = False
        code[inner] = chunk.codes
        context = np.empty_like(code)
        context[1:], context[:1] = code[:-1], end
        return cls(np.append(chunk.hashes, END), code, context, doc, chunk.marks[doc] == 0)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the codes by hash, and training counts in that order."""
        order = np.argsort(self.hashes, kind="stable")
        return order, np.bincount(self.code[self.train], minlength=len(self.hashes))[order]

    def pairs(self, counts: np.ndarray, ids: np.ndarray, total: int, n_fragments: int) -> tuple:
        """Distinct pairs in the order they are asked: cuts by fragment, context ids, word ids, whether the context is spread, training counts, word codes, context codes, pair of each token."""
        size = len(self.hashes)
        key, back = np.unique(self.context * size + self.code, return_inverse=True)
        n = np.bincount(back[self.train], minlength=len(key))
        u, w = key // size, key % size
        cu, cw = ids[u], ids[w]
        # a context with more than half a fragment's share of all tokens is spread over all fragments by its words
        hot = counts[u] * 2 * n_fragments > total
        route = mix(np.where(hot, mix(cu) ^ cw, cu)) >> np.uint64(32)
        fragment = (route * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((cw, cu, fragment))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cuts = np.searchsorted(fragment[order], np.arange(n_fragments + 1))
        return cuts, cu[order], cw[order], hot[order], n[order], w[order], u[order], place[back]


def _by_word(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), counts.dtype)
    out[order] = counts
    return out


def _sum_words(numbers: list[int], _: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
    """Corpus counts of the chunks' words and the words' ranks by hash; and the fragment's totals, with its number of words."""
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys))
    yield TOTALS, squeeze(np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum(), len(keys)], np.float64))
    at = 0
    for number, p in zip(numbers, parts, strict=True):
        mine = back[at : at + len(p[0])]
        yield number, squeeze(sums[mine].astype(np.int64), mine.astype(np.uint32))
        at += len(p[0])


def discount(n1: float, n2: float) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 > 0 else 0.5


def draw(key: np.ndarray, step: int, size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Binomial numbers that depend on a pair's ``key`` and the ``step`` alone, so no partition of the pairs changes them."""
    seeds = mix(key + mix(np.array([step], np.uint64)))
    u = (seeds >> np.uint64(11)) * 2.0**-53
    if size.max(initial=1) == 1:
        return (u < chance).astype(np.int64)
    p = np.clip(chance, 0, 1 - 1e-9)
    out = np.zeros(len(u), np.int64)
    many = np.flatnonzero(size * p > 30)
    for i in many.tolist():
        out[i] = np.random.Generator(np.random.Philox(key=int(seeds[i]))).binomial(size[i], p[i])
    on = np.flatnonzero(size * p <= 30)
    mass = np.exp(size[on] * np.log1p(-p[on]))
    below = mass.copy()
    odds = p[on] / (1 - p[on])
    while len(on):  # inversion: count up to the first number whose cumulative mass exceeds u
        more = (u[on] >= below) & (out[on] < size[on])
        on, mass, below, odds = on[more], mass[more], below[more], odds[more]
        mass = mass * odds * (size[on] - out[on]) / (out[on] + 1)
        below = below + mass
        out[on] += 1
    return out


def seat(c: np.ndarray, key: np.ndarray, open_: np.ndarray, parent: np.ndarray, d: float, sweep: int) -> np.ndarray:
    """Tables of pairs with ``c`` > 1 customers after one sweep of Gibbs sampling.

    Every pair's customers leave and are seated again, given the tables of all other pairs (``open_``: what the
    pair's context offers to a new table; ``parent``: the root's probability of the word): one at a time at first, then in runs.
    """
    order = np.argsort(-c, kind="stable")
    c, key, pull = c[order].astype(np.int64), key[order], (open_ * parent)[order]
    t, seated = np.ones(len(c)), 1
    most = int(c.max(initial=0))
    while seated < most:
        run = 1 if seated < SINGLE_STEPS else max(1, seated // 16)
        n = int(np.searchsorted(-c, -seated, side="left"))  # pairs with more customers than are seated
        new = pull[:n] / (pull[:n] + np.maximum(seated - d * t[:n], 1e-9))
        t[:n] += draw(key[:n], (sweep << 40) + seated, np.minimum(c[:n] - seated, run), new)
        seated += run
    out = np.empty(len(c), np.uint32)
    out[order] = t
    return out


def _merge_pairs(numbers: list[int], _: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
    """A fragment's totals; its state for the sweeps (pairs seen more than once, table counts of the others); which pair each chunk's entries are."""
    u, w, n, level = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((w, u))
    new = np.ones(len(u), bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    c = np.add.reduceat(n[order].astype(np.int64), starts)
    yield TOTALS, squeeze(np.array([c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()], np.float64))
    pair = np.empty(len(u), np.int64)
    pair[order] = group
    mine = np.zeros(len(u), np.uint8)
    mine[np.minimum.reduceat(order, starts)] = 1  # one chunk reports a pair's tables to the root
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    steps = np.concatenate([np.diff(pair[z - k : z], prepend=0) for z, k in zip(ends, sizes, strict=True)])
    yield LINKS, squeeze(np.array(numbers, np.int64), sizes, steps.astype(np.uint32), mine, c.astype(np.uint32))
    known = order[starts][c > 0]
    c = c[c > 0]
    words, at, wi = np.unique(w[known], return_index=True, return_inverse=True)
    contexts, first, ci = np.unique(u[known], return_index=True, return_inverse=True)
    several = c > 1
    once = [np.bincount(x[~several], minlength=k).astype(np.uint32) for x, k in ((wi, len(words)), (ci, len(contexts)))]
    levels, spread = (level[known][at] >> 1).astype(np.uint8), (level[known][first] & 1).astype(np.uint8)
    gaps = [np.diff(x, prepend=x[:1] * 0) for x in (words, contexts)]
    yield STATE, squeeze(gaps[0], levels, once[0], gaps[1], once[1], spread, np.diff(ci[several], prepend=0).astype(np.uint32), wi[several].astype(np.uint32), c[several].astype(np.uint32))


def _sum_tables(numbers: list[int], tags: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
    """Corpus sums of the fragments' tables for each word (tag 0) and spread context (1), answered to 2 * fragment + tag; and the root's totals."""
    for tag in (0, 1):
        on = [i for i, t in enumerate(tags) if t == tag]
        if not on:
            continue
        keys, back = np.unique(np.concatenate([parts[i][0] for i in on]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([parts[i][1] for i in on]), minlength=len(keys))
        if tag == 0:
            yield TOTALS, squeeze(np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum()], np.float64))
        at = 0
        for i in on:
            yield 2 * numbers[i] + tag, squeeze(sums[back[at : at + len(parts[i][0])]].astype(np.uint64))
            at += len(parts[i][0])


def _sum_last(_: list[int], tags: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
    """Average tables of a word fragment's words, as words (tag 0) and as contexts (1), by id; and the root's totals."""
    out = []
    for tag in (0, 1):
        on = [i for i, t in enumerate(tags) if t == tag]
        keys, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(parts[i][0] for i in on)]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([np.zeros(0), *(parts[i][1] for i in on)]), minlength=len(keys)) / SAMPLES
        if tag == 0:
            yield TOTALS, squeeze(np.array([sums.sum(), (sums > 0).sum(), ((sums > 0) & (sums < 1.5)).sum(), ((sums >= 1.5) & (sums < 2.5)).sum()], np.float64))
        out += [np.diff(keys, prepend=np.uint64(0)), sums.astype(np.float32)]
    yield SUMS, squeeze(*out)


def _by_fragment(state: DataFrame, more: list[DataFrame], fn: Callable[[int, dict], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``fn(fragment, {kind: replies in order})`` makes of the rows (fragment, kind, place, reply) of each fragment; ``state`` in buckets stays where it is."""

    def run(*groups: pa.Table) -> pa.Table:
        group = pa.concat_tables(groups)
        rows = sorted(zip(group.column("kind").to_pylist(), group.column("place").to_pylist(), range(group.num_rows), strict=True))
        held: dict[int, list[bytes]] = {}
        for kind, _place, i in rows:
            held.setdefault(kind, []).append(group.column("reply")[i].as_py())
        out = [pa.table(d) for d in fn(group.column("fragment")[0].as_py(), held)]
        trim()
        return pa.concat_tables(out)

    own = state.groupBy("fragment")
    if not more:
        return own.applyInArrow(lambda group: run(group), schema)
    return own.cogroup(reduce(DataFrame.unionByName, more).groupBy("fragment")).applyInArrow(lambda group, told: run(group, told), schema)


def seat_pairs(asked: DataFrame, n_words: int, n_ids: int, n_pairs: int, first_id: np.ndarray) -> tuple[DataFrame, tuple[float, DataFrame]]:
    """Answers (chunk, fragment, reply) to chunks about their pairs: corpus count, average tables, and whether the chunk reports them.

    With them, the contexts' discount and the words' sums of average tables by word fragment (``_sum_last``),
    whose ids begin at ``first_id``.

    Fragments are partitions of one model.  Before a sweep each sends its tables a word, and a spread context, to the
    fragments that own these; the sums, the root's totals and the corpus-wide discounts come back.  Counts of
    tables are whole numbers and draws depend on the pair alone, so the seating is the same with any number of fragments.
    """
    merged = answers(asked, _merge_pairs, buckets=n_pairs)
    d = discount(*_totals(merged)[2:])
    rows = lambda df, kind, place: df.select("fragment", F.lit(kind).alias("kind"), place.cast("int").alias("place"), "reply")
    state = rows(merged.filter(F.col("chunk") == STATE), STATE, F.lit(0))

    def sweep_round(sweep: int, root_totals: np.ndarray) -> Callable[[int, dict], Iterator[dict]]:
        def fn(fragment: int, held: dict) -> Iterator[dict]:
            words, levels, once_w, contexts, once_c, spread, steps, wi, c = stretch(held[STATE][0])
            words, contexts = np.cumsum(words, dtype=np.uint64), np.cumsum(contexts, dtype=np.uint64)
            ci = np.cumsum(steps, dtype=np.int64)
            t, total = stretch(held[TABLES][0]) if TABLES in held else (np.ones(len(c), np.uint32), np.zeros(len(c), np.uint32))
            shared = np.flatnonzero(spread)
            by_context = lambda: once_c + np.bincount(ci, weights=t, minlength=len(contexts))
            if sweep >= 0:
                customers, kinds, n1, n2 = root_totals
                d0 = discount(n1, n2)
                root, inside = joined(held.get(0), np.float64)[0], by_context()
                inside[shared] = joined(held.get(1), np.float64)[0]
                base = 2.0 ** (-levels.astype(np.float64) / 4)
                parent = (np.maximum(root - d0, 0) + (THETA_ROOT + d0 * kinds) * base) / (THETA_ROOT + customers)
                key = mix(mix(contexts)[ci] + words[wi] * np.uint64(0x9E3779B97F4A7C15))
                t = seat(c, key, THETA_CONTEXT + d * inside[ci], parent[wi], d, sweep)
                total = total + t if sweep >= BURN_IN else total
            head = {"chunk": pa.array([fragment], pa.int64()), "tag": pa.array([TABLES], pa.int32())}
            yield {"fragment": pa.array([fragment], pa.int32()), **head, "part": pa.array([squeeze(t, total.astype(np.uint32))], pa.binary())}
            if sweep < last:
                by_word = once_w + np.bincount(wi, weights=t, minlength=len(words))
                owner = lambda ids: ids * np.uint64(n_words) // np.uint64(n_ids)
                yield from questions(fragment, words, [by_word.astype(np.uint32)], n_words, top=owner(words))
                yield from questions(fragment, contexts[shared], [by_context()[shared].astype(np.uint32)], n_words, tag=1, top=owner(contexts[shared]))
            else:
                home = lambda ids: (np.searchsorted(first_id, ids, side="right") - 1).astype(np.uint64)
                for tag, ids, once, at in ((0, words, once_w, wi), (1, contexts, once_c, ci)):
                    sums = once.astype(np.int64) * SAMPLES + np.bincount(at, weights=total, minlength=len(ids)).astype(np.int64)
                    yield from questions(fragment, ids, [sums.astype(np.uint64)], n_words, tag=tag, top=home(ids))

        return fn

    told, root_totals, last = [], np.zeros(4), BURN_IN + SAMPLES - 1
    for sweep in range(-1, last + 1):
        done = keep(_by_fragment(state, told, sweep_round(sweep, root_totals), QUESTION), "sweep")
        tables = done.filter(F.col("tag") == TABLES).select("fragment", F.lit(TABLES).alias("kind"), F.lit(0).alias("place"), F.col("part").alias("reply"))
        sums = answers(done.filter(F.col("tag") != TABLES), _sum_tables if sweep < last else _sum_last)
        if sweep < last:
            root_totals = _totals(sums)
            back = sums.filter(F.col("chunk") != TOTALS)
            told = [tables, back.select(F.expr("cast(chunk div 2 as int)").alias("fragment"), F.expr("cast(chunk % 2 as int)").alias("kind"), F.col("fragment").alias("place"), "reply")]

    def reply(fragment: int, held: dict) -> Iterator[dict]:
        numbers, sizes, steps, mine, c = stretch(held[LINKS][0])
        t = (c > 0).astype(np.float32)
        t[c > 1] = stretch(held[TABLES][0])[1] / np.float32(SAMPLES)
        ends, out = np.cumsum(sizes), []
        for z, k in zip(ends, sizes, strict=True):
            pair = np.cumsum(steps[z - k : z], dtype=np.int64)
            out.append(squeeze(c[pair], t[pair], mine[z - k : z]))
        yield {"chunk": pa.array(numbers), "fragment": pa.array(np.full(len(numbers), fragment, np.int32)), "reply": pa.array(out, pa.binary())}

    links = rows(merged.filter(F.col("chunk") == LINKS), LINKS, F.lit(0))
    return _by_fragment(links, [tables], reply, "chunk long, fragment int, reply binary"), (d, sums)


def _totals(replies: DataFrame) -> np.ndarray:
    """Sums of the fragments' totals; one short row a fragment."""
    return sum((stretch(r["reply"])[0][:4] for r in replies.filter(F.col("chunk") == TOTALS).select("reply").collect()), np.zeros(4))


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Scores of whole documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents where ``held_out`` (a condition on doc_id) is false.  A
    document is its words with A-Z lower-cased, then an end; null texts are the end
    alone, null ids are learnt from.  One row each, repeated rows too; other columns are ignored.
    ``base_score`` is the sum of log10((count + 1) / (N + V + 1)).  ``score`` is the model's: the
    root restaurant has one table a word, so its discounted mass is that of words not seen; each
    previous word is a restaurant whose tables are the root's customers, seated by Gibbs sampling, and
    predictive probabilities are those of the averaged seatings.  Nothing learnt: unseen words have probability one.

    Words and pairs of a chunk are counted in the chunk, summed in the fragments that own them
    and answered to each chunk; no table of the model is held whole anywhere.  Chunks, pairs and answers
    about words lie in buckets, so only questions and answers are shuffled.
    """
    chunks = chunk_documents(docs, F.when(held_out, 1).otherwise(0), CHUNK_BYTES, buckets=True)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    n_words, n_pairs = max(1, -(-tokens // (4 * FRAGMENT_ENTRIES))), max(1, -(-tokens // (2 * FRAGMENT_ENTRIES)))

    def ask_words(chunk: Chunk, _: dict) -> Iterator[dict]:
        t = Tokens.of(chunk)
        order, counts = t.words()
        yield from questions(chunk.number, t.hashes[order], [counts.astype(np.uint32)], n_words)

    counted = answers(each_chunk(chunks, ask_words, QUESTION), _sum_words, buckets=n_words)
    total, kinds = (int(x) for x in _totals(counted)[:2])
    replies = counted.filter(F.col("chunk") != TOTALS)
    # words are numbered by hash over all fragments: the fragment's first number (one a fragment) and the rank in it
    sizes = np.zeros(n_words, np.int64)
    for r in counted.filter(F.col("chunk") == TOTALS).select("fragment", "reply").collect():
        sizes[r["fragment"]] = stretch(r["reply"])[0][4]
    n_ids, first_id = int(sizes.sum()), np.cumsum(sizes) - sizes

    def counts_of(t: Tokens, extra: dict) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts and ids of the codes."""
        order = t.words()[0]
        count, rank = joined(extra["words"], np.int64)[:2]
        owner = ((t.hashes[order] >> np.uint64(32)) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64)
        return _by_word(count, order), _by_word((first_id[owner] + rank).astype(np.uint64), order)

    word_type = np.uint32 if n_ids < 1 << 32 else np.uint64

    def ask_pairs(chunk: Chunk, extra: dict) -> Iterator[dict]:
        t = Tokens.of(chunk)
        counts, ids = counts_of(t, extra)
        cuts, cu, cw, hot, n, w, _u, _p = t.pairs(counts, ids, total, n_pairs)
        level = np.round(-4 * np.log2((counts[w] + 0.5) / (total + 0.5 * kinds + 1))).clip(0, 255).astype(np.uint16) * 2 + hot
        some = np.flatnonzero(np.diff(cuts))
        parts = [squeeze(np.diff(cu[a:z], prepend=np.uint64(0)), cw[a:z].astype(word_type), n[a:z].astype(np.uint32), level[a:z].astype(np.uint16)) for a, z in zip(cuts[some], cuts[some + 1], strict=True)]
        yield {"fragment": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk.number)), "tag": pa.array(np.zeros(len(some), np.int32)), "part": pa.array(parts, pa.binary())}

    pairs, (d1, gathered) = seat_pairs(each_answered(chunks, {"words": replies}, ask_pairs, QUESTION), n_words, n_ids, n_pairs, first_id)
    customers, served, once, twice = _totals(gathered)
    d0 = discount(once, twice)

    def add_tables(fragment: int, held: dict) -> Iterator[dict]:
        """Answers about words, with each word's sums of tables as a word and as a context."""
        sums = np.zeros((2, int(sizes[fragment])), np.float32)
        for g in held.get(SUMS, []):
            for own, gaps, found in zip(sums, *(iter(stretch(g)),) * 2, strict=True):
                own[np.cumsum(gaps, dtype=np.uint64).astype(np.int64) - first_id[fragment]] = found
        for number, got in held.items():
            if number != SUMS:
                count, rank = stretch(got[0])
                yield {"chunk": pa.array([number], pa.int64()), "fragment": pa.array([fragment], pa.int32()), "reply": pa.array([squeeze(count, rank, *(x[rank] for x in sums))], pa.binary())}

    rows = lambda df: df.select("fragment", F.col("chunk").alias("kind"), F.lit(0).alias("place"), "reply")
    words = _by_fragment(rows(replies), [rows(gathered.filter(F.col("chunk") == SUMS))], add_tables, "chunk long, fragment int, reply binary")

    def score(chunk: Chunk, extra: dict) -> Iterator[dict]:
        t = Tokens.of(chunk)
        counts, ids = counts_of(t, extra)
        *_rest, place = t.pairs(counts, ids, total, n_pairs)
        count, tables, _mine = (a[place] for a in joined(extra["pairs"], np.float32))
        root, inside = (_by_word(a, t.words()[0]).astype(np.float64) for a in joined(extra["words"], np.float32)[2:])
        c, u = counts[t.code], counts[t.context]
        seen = np.where(c > 0, np.maximum(root[t.code] - d0, 1e-9), THETA_ROOT + d0 * served) / (THETA_ROOT + customers)
        p = (np.maximum(count - d1 * tables, 0) + (THETA_CONTEXT + d1 * inside[t.context]) * seen) / (THETA_CONTEXT + u)
        p = np.where(u > 0, p, seen)
        n = len(chunk.ids)
        sums = lambda x: np.bincount(t.doc, weights=x, minlength=n)
        yield {
            "doc_id": pa.array(chunk.ids, mask=chunk.ids == NULL_ID), "held_out": pa.array(chunk.marks == 1), "n_tokens": pa.array(np.diff(chunk.offsets) + 1),
            "n_known": pa.array(sums(c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(sums(np.log10((c + 1) / (total + kinds + 1)))), "score": pa.array(sums(np.log10(p))),
        }

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return each_answered(chunks, {"words": words, "pairs": pairs}, score, schema)


@query("op5_pitman_yor_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), held_out)
