"""Document operators against brute force, on rows with every odd case and on empty tables."""

import collections
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_rows import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabweave.llm import mixing, ngram_join, packing, pitman_yor, quality, rans, sharding, suffix_dedup
from tabweave.session import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_shards_hold_all_rows_in_gapless_slots(docs):
    got = collected(sharding.shard_documents(docs, n_shards=6))
    want = collections.Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in documents())
    assert collections.Counter(r[:3] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r[3]].append(r[4])
    assert set(by) <= set(range(6)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_near_equal_and_keep_small_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(50, 400)) + str(i if i % 10 else i // 40), "en", f"s{i % 7}") for i in range(3_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), n_shards=24).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() / size.mean() < 1.03 and size.min() / size.mean() > 0.97
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    again = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), target_bytes=int(size.mean())).toPandas()
    assert again.shard.nunique() in (24, 25)


def test_one_hot_text_is_spread_over_shards(spark):
    df = spark.createDataFrame([(i, "same text", "en", "s") for i in range(1_000)], "doc_id long, text string, lang string, source string")
    size = sharding.shard_documents(df, n_shards=8).toPandas().groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() <= 1.1 * size.mean()


@pytest.mark.parametrize("name,low", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_field_encoder_equals_the_library(name, low):
    import pyarrow as pa

    from tabweave.llm.tokens import FieldEncoder

    texts = [t for _, t, *_ in documents()] + ["a.", "x" + "." * 30, "b1!!", "s\nb.", "end.\n", " lead", "trail ", "a  b", "...", "\n\n x", "Ḱ."]
    library, mine = Tokenizer.from_file(public_tokenizers.path(name)), FieldEncoder(public_tokenizers.path(name), low)
    for _ in range(2):
        ends, ids = mine.texts(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_blocks_decode_from_any_checkpoint_and_notice_damage():
    ids = np.minimum((np.random.default_rng(0).pareto(0.7, 300_000) * 5).astype(np.int64), 50_256).astype(np.uint16)
    tab = rans.Table.of_counts(np.bincount(ids, minlength=50_257))
    block = rans.encode_block(ids, tab)
    assert tab.freq.sum() == 1 << rans.SCALE_BITS and len(block) < 2 * len(ids)
    assert (rans.decode_block(block, tab) == ids).all()
    for first in (1, 2):
        tail = rans.decode_block(block, tab, first)
        assert 0 < len(tail) < len(ids) and (tail == ids[-len(tail) :]).all()
    for n in (1, 2, 2_047, 2_049):
        assert (rans.decode_block(rans.encode_block(ids[:n], tab), tab) == ids[:n]).all()
    bad = bytearray(block)
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(bad), tab)
    with pytest.raises(ValueError):
        rans.decode_block(block, rans.Table.of_counts(np.ones(50_257, np.int64)))


def test_ids_come_back_from_the_files(spark, docs):
    folder = new_path(spark, "rans-test")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rans.write_ids(docs, path, folder, n_parts=4)
    got = sorted(rans.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(path), 0
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in documents())
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_packing_holds_all_ids_and_fills_the_fewest_sequences(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 256).toPandas()
    want = collections.Counter()
    for i, t, *_ in documents():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(-(-len(ids) // 256)):
            part = ids[256 * p : 256 * p + 256]
            want[(i, p, 256 * p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    keys = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy(float)]
    assert collections.Counter(keys) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1


def test_fullest_bin_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.choice(np.arange(1, 25), 6, replace=False)}
        items = [x for x, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        free = int(rng.integers(1, 40))
        found = packing.fullest(free, sorted(counts, reverse=True), counts)
        assert sum(found) == max(s for s in sums if s <= free)
        assert all(found.count(x) <= counts[x] for x in found)


def test_mix_meets_its_targets(spark, docs):
    out, parts = mixing.mix_documents(docs, block_words=16)
    got = out.toPandas()
    assert len(got) == len(documents()) and (got.taken <= 3 * got["size"]).all()
    sizes = collections.Counter()
    for i, t, _l, s, _n in documents():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s, part in got.assign(source=got.source.astype(object).where(got.source.notna(), None)).groupby("source", dropna=False):
        s = None if s != s else s
        assert part.source_size.iloc[0] == sizes[s] and abs(part.taken.sum() - want[s]) <= 1
    p = parts.toPandas()
    assert p.words.sum() == got.taken.sum()
    assert (got.n_slots > 0).equals(got.taken > 0) and got.n_slots.sum() == len(p) and got.first_slot.isna().equals(got.taken == 0)
    assert got.set_index("row").first_slot.dropna().astype(int).to_dict() == p.groupby("row").slot.min().to_dict()
    again = mixing.mix_documents(docs.repartition(2), block_words=16)[0].toPandas()
    key = ["doc_id", "size", "taken"]
    assert collections.Counter(map(str, got[key].to_numpy().tolist())) == collections.Counter(map(str, again[key].to_numpy().tolist()))


def test_slots_follow_the_sequence_through_the_needs(spark):
    """A plain loop over golden-ratio points: which source has each slot, and which block of it."""
    rows = [(i, "w " * (20 + i % 7), "abc"[i % 3] if i % 5 else "a") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, parts = mixing.mix_documents(df, block_words=16)
    plan = mixing.source_plan(df.select("source", F.size(F.split(F.trim("text"), " ")).alias("size")), (5, 2, 1), 3)
    frame = {r["number"]: r for r in mixing._plan_frame(spark, plan, 16).collect()}
    need = {n: frame[n]["need"] for n in frame}
    total, rank, want = sum(need.values()), collections.Counter(), {}
    for t in range(total):
        point, run = (t + 1) * mixing.GOLDEN % 1.0, 0
        for n in sorted(need):
            run += need[n]
            if point < run / total or n == max(need):
                break
        if rank[n] < need[n]:
            want[t] = (n, rank[n])
        rank[n] += 1
    got = {r["slot"]: r["number"] for r in parts.filter(f"slot < {total}").select("slot", "number").distinct().collect()}
    assert set(got) <= set(want) and all(got[t] == want[t][0] for t in got)
    assert len(got) > 0.95 * total


def test_targets_reshare_what_full_sources_leave():
    assert mixing.targets([10, 1000], [5, 2], 3) == [30.0, 980.0]
    assert mixing.targets([0, 0], [5, 2], 3) == [0.0, 0.0]


def test_schedule_has_low_discrepancy(spark, docs):
    _, parts = mixing.mix_documents(docs, block_words=16)
    p = parts.select("slot", "number").distinct().orderBy("slot").toPandas()
    for _, ranks in p.reset_index().groupby("number"):
        if len(ranks) > 30:
            at = ranks["index"].to_numpy() / len(p)
            assert np.abs(at - (np.arange(len(at)) + 0.5) / len(at)).max() < 0.1


def brute_groups(rows, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else []))
    lab = list(range(len(rows)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                lab[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = lambda i: min((x for x in ids[find(i)] if x is not None), default=None)
    return collections.Counter((r[0], len(sets[i]), least(i) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_groups_equal_brute_force(docs):
    got = ngram_join.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(collected(got)) == brute_groups(documents())


def test_jaccard_groups_of_random_edits_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(25):
        base = [f"v{rng.integers(60)}" for _ in range(int(rng.integers(8, 70)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(1000)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ngram_join.jaccard_groups(df).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(collected(got)) == brute_groups(rows)


def test_one_document_of_each_group_stays(docs):
    kept = ngram_join.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    # 11, 12 and 13 are mostly one passage
    assert [i for i in ids if i is not None and i < 20] == [1, 5, 6, 7, 8, 9, 11, 14, 15]
    assert ids.count(None) == 2 and sum(i is not None and i >= 200 for i in ids) == 1


def brute_repeats(rows, size):
    seen = collections.defaultdict(list)
    for i, (d, t, *_) in enumerate(rows):
        w = words(t)
        for p in range(len(w) - size + 1):
            seen[tuple(w[p : p + size])].append((d is None, d or 0, p, i))
    cover = {}
    for hits in seen.values():
        if len({h[:2] for h in hits}) > 1:
            first = min(h[:3] for h in hits)
            for h in hits:
                for p in range(h[2], h[2] + size):
                    cover[h[3], p] = cover.get((h[3], p), True) and h[:3] == first
    out, at = collections.Counter(), sorted(cover)
    k = 0
    while k < len(at):
        z = k
        while z + 1 < len(at) and at[z + 1] == (at[z][0], at[z][1] + 1) and cover[at[z + 1]] == cover[at[k]]:
            z += 1
        out[(rows[at[k][0]][0], at[k][1], at[z][1] + 1, cover[at[k]])] += 1
        k = z + 1
    return out


@pytest.mark.parametrize("size", [30, 50])
def test_repeats_equal_brute_force(docs, size):
    got = suffix_dedup.repeated_passages(docs, size).select("doc_id", "begin", "end", "kept")
    assert collections.Counter(collected(got)) == brute_repeats(documents(), size)


def test_removal_keeps_first_occurrences_and_clean_documents(docs):
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect() if r["doc_id"] is not None}
    old = {r[0]: r[1] for r in documents()}
    assert out[1] == old[1] and out[11] == old[11] and out[8] == old[8] and out[6] == ""
    assert out[12] == "delta" and out[13] == "zeta" and 2 not in out


def test_classifier_learns_and_scores_every_row(spark, docs):
    rng = np.random.default_rng(2)
    good = [" ".join(f"good{rng.integers(50)}" for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(f"bad{rng.integers(50)}%%%" for _ in range(60)) for _ in range(150)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.fit_on_labels(df, df)
    got = quality.score(df.select("doc_id", "text", "quality"), m).withColumn("h", quality.held_out()).toPandas()
    held = got[got.h]
    assert len(held) > 50 and ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.97
    every = quality.score(docs, m).toPandas()
    assert len(every) == len(documents()) and every.score.between(0, 1).all()


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = quality.Machine.new()
    m.w[:] = rng.normal(size=quality.WIDTH)
    number, value = np.array([3, 70, 500, 8_000]), np.array([0.5, 1.0, -2.0, 0.25], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(number, value)) for b, y in list(zip(number, value))[:i])
    got = m.margins(np.array([0, 4]), number, value)[0][0]
    assert abs(got - (float(m.w[number] @ value) + pairs)) < 1e-4


def test_language_model_counts_equal_brute_force_and_beat_the_base(spark, docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = collected(pitman_yor.score_documents(docs, held))
    tokens = [(i, words(t) + [""], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in documents()]
    counts = collections.Counter(w for _, ws, h in tokens if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws, h in tokens)
    assert collections.Counter((*r[:5], round(r[5], 4)) for r in got) == want
    assert all(np.isfinite(r[6]) and r[6] <= 1e-9 for r in got)
    assert sum(r[6] for r in got) > sum(r[5] for r in got)


def test_predictive_probabilities_sum_to_one(spark):
    corpus = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b a a", "b", ""] * 4)]
    vocabulary = ["a", "b", "c", "zzz"]  # the last stands for all words not seen
    probe = [(100 + i, w) for i, w in enumerate(vocabulary)] + [(200, None)]
    df = spark.createDataFrame(corpus + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(df, F.col("doc_id") >= 100).collect()}
    two = spark.createDataFrame(corpus + probe + [(300 + 10 * i + j, f"{w} {x}") for i, w in enumerate(vocabulary) for j, x in enumerate(vocabulary)], "doc_id long, text string")
    more = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(two, F.col("doc_id") >= 100).collect()}
    assert abs(got[200] - more[200]) < 1e-9
    # P(end | start) + sum over w of P(w | start) = 1; P(w | start) = P(w end) + sum over x of P(w x end) + ... is bounded by it
    once = 10 ** got[200] + sum(10 ** got[100 + i] for i in range(4))
    twice = sum(10 ** more[300 + 10 * i + j] for i in range(4) for j in range(4))
    assert 0.3 < once < 1 and once + twice < 1 + 1e-9


def test_seating_is_one_model_over_any_number_of_fragments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"the w{int(x)}" if x % 2 else f"w{int(x)} w{int(x) % 7}" for x in rng.zipf(1.4, 60) % 300)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()

    def run():
        tables = []
        seat_pairs = pitman_yor.seat_pairs

        def kept(asked, *sizes):
            pairs, d = seat_pairs(asked, *sizes)
            fragments = set()
            for r in pairs.collect():
                fragments.add(r["fragment"])
                count, t, mine = pitman_yor.stretch(r["reply"])
                tables.extend(zip(count[mine == 1].tolist(), t[mine == 1].tolist()))
            tables.append(len(fragments))
            return pairs, d

        with monkeypatch.context() as m:
            m.setattr(pitman_yor, "seat_pairs", kept)
            got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(df, F.col("doc_id") % 7 == 2).collect()}
        return got, tables.pop(), sorted(tables)

    one, n_one, tables_one = run()
    monkeypatch.setattr(pitman_yor, "FRAGMENT_ENTRIES", 1_500)
    many, n_many, tables_many = run()  # "the" is the context of a quarter of all tokens, so it is spread
    assert n_one == 1 and n_many > 5
    assert tables_one == tables_many and any(1 < t < c for c, t in tables_one)
    np.testing.assert_allclose([many[i] for i in sorted(many)], [one[i] for i in sorted(one)], rtol=1e-6)


def test_scores_shuffle_questions_and_answers_but_no_chunks(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FRAGMENT_ENTRIES", 400)
    rows = [(i, " ".join(f"w{(i * 37 + j * j) % 211}" for j in range(60))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with chunks of any real size
    try:
        got = pitman_yor.score_documents(df, F.col("doc_id") >= 3)  # three documents teach the words of several fragments
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = [re.search("[A-Za-z]", line).start() if re.search("[A-Za-z]", line) else 0 for line in lines]
    assert any("body" in line for line in lines)
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
            assert not any("body" in lines[j] for j in below)
    scored = got.collect()
    assert len(scored) == 100 and all(r["held_out"] == (r["doc_id"] >= 3) and r["score"] < 0 for r in scored)
    unlearnt = pitman_yor.score_documents(df, F.lit(True)).collect()
    assert len(unlearnt) == 100 and all(r["score"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 61 for r in unlearnt)


def test_keyed_draws_are_binomial():
    key = np.arange(200_000, dtype=np.uint64)
    for size, p in ((1, 0.3), (6, 0.7), (40, 0.05), (200, 0.5)):
        x = pitman_yor.draw(key[: 200_000 if size * p <= 30 else 20_000], 33, np.full(200_000 if size * p <= 30 else 20_000, size), np.full(200_000 if size * p <= 30 else 20_000, p))
        assert abs(x.mean() - size * p) < 5 * np.sqrt(size * p * (1 - p) / len(x)) and abs(x.var() / (size * p * (1 - p)) - 1) < 0.05


def test_empty_tables_give_empty_results(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sharding.shard_documents(empty, n_shards=4).count() == 0
    assert packing.pack_documents(empty, path).count() == 0
    assert mixing.mix_documents(empty)[0].count() == 0 and mixing.mixed_texts(empty).count() == 0
    assert ngram_join.jaccard_groups(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert pitman_yor.score_documents(empty, F.lit(False)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(empty, quality.fit_on_labels(empty, labels)).count() == 0
    folder = new_path(spark, "rans-empty")
    rans.write_ids(empty, public_tokenizers.path("byte_bpe_50k.json"), folder, n_parts=2)
    assert rans.read_ids(spark, folder).count() == 0
