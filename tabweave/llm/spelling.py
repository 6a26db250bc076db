"""Spelling variants of a vocabulary: k-d trees over letter counts, box-pruned range searches, letter order verified."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import batches_by_bytes, column_of, keep, pieces, query, table, trim, words_of

LETTERS, OCCURRENCES, RATIO = 5, 3, 2
#: Words of a box, about, and letters of them; boxes are cut at the medians of a sample of at most so many words and letters.
BOX_WORDS, BOX_LETTERS = 16_384, 4 << 20
SAMPLE_WORDS, SAMPLE_LETTERS = 262_144, 8 << 20
#: Letters are folded to so many counts, up to so much each, to choose boxes: folding only makes distances smaller.
FOLD, MOST = 64, 4
#: Different letter counts of a leaf inside a box, and the most letters that are told apart there.
LEAF, ALPHABET = 24, 192
#: Pairs (or compared letters of pairs) that are held at once.
PAIRS = 1 << 21


# ---- words of texts


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text and all maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; null texts have none."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, offsets, data = texts.buffers()
    if data is not None and data.size:
        b = np.frombuffer(data, np.uint8)
        pair = b == 0xC3  # U+00C0 to U+00FF are the pairs that begin so in UTF-8
        letter = ((b >= 97) & (b <= 122)) | pair
        letter[1:] |= pair[:-1]
        data = pa.py_buffer(np.where(letter, b, np.uint8(32)))
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset))


def count_words(docs: DataFrame, misspell: int = 0, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """Written vocabulary (word, n) of ``docs`` (doc_id, text): runs of at least ``letters`` code points seen ``occurrences`` times.

    With ``misspell``, the code point at h % length goes from a run whose h = crc32(``doc_id:run``) it divides
    (a null doc_id is empty).  Null and empty texts have no words.  Counts are made in the task that reads a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches_by_bytes(batches, "text"):
            offsets, words = letter_runs(column_of(data, "text"))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
            n = np.bincount(codes, minlength=len(lengths)).astype(np.int64)
            changed: dict[str, int] = {}
            if misspell and len(codes):
                some = np.flatnonzero(lengths[codes] >= letters)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[some]
                pairs, times = np.unique(doc * len(lengths) + codes[some], return_counts=True)
                doc, code = pairs // len(lengths), pairs % len(lengths)
                starts = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in column_of(data, "doc_id").to_pylist()], np.int64)
                raw = np.array(coded.dictionary.cast(pa.large_binary()).to_pylist(), object)
                h = np.fromiter(map(zlib.crc32, raw[code].tolist(), starts[doc].tolist()), np.int64, len(code))
                for i in np.flatnonzero(h % misspell == 0).tolist():
                    word, k = raw[code[i]].decode(), int(h[i] % lengths[code[i]])
                    n[code[i]] -= times[i]
                    word = word[:k] + word[k + 1 :]
                    if len(word) >= letters:
                        changed[word] = changed.get(word, 0) + int(times[i])
            mine = np.flatnonzero((lengths >= letters) & (n > 0))
            found = pa.concat_arrays([coded.dictionary.take(pa.array(mine)).cast(pa.string()), pa.array(list(changed), pa.string())])
            yield pa.RecordBatch.from_arrays([found, pa.array(np.concatenate([n[mine], np.fromiter(changed.values(), np.int64, len(changed))]))], names=["word", "n"])
            trim()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return keep(counted.filter(F.col("n") >= occurrences), "vocabulary")


# ---- letter counts and boxes


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per word and all code points in a row."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), points


def unary(offsets: np.ndarray, letters: np.ndarray, n_letters: int, most: int) -> np.ndarray:
    """Letter counts as bits: bit ``t`` of a letter is set if it occurs more than ``t`` times.

    So the L1 distance of two counts is the number of bits in which they differ, and a box is the bits that all
    its words have and those that any has.
    """
    n = len(offsets) - 1
    width = -(-n_letters * most // 64)
    out = np.zeros((n, width * 64), bool)
    step = max(1, (1 << 24) // max(1, n_letters))
    for a in range(0, n, step):
        z = min(n, a + step)
        mine = letters[offsets[a] : offsets[z]]
        word = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
        count = np.bincount(word * n_letters + mine, minlength=(z - a) * n_letters).reshape(z - a, n_letters)
        out[a:z, : n_letters * most] = (count[:, :, None] > np.arange(most)).reshape(z - a, -1)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).reshape(n, width)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


@dataclass
class Tree:
    """Nodes of k-d trees: the box of each, its children (-1: a leaf), the bit that parts them, and a leaf's members."""

    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    child: list = field(default_factory=list)
    bit: list = field(default_factory=list)
    members: list = field(default_factory=list)

    def add(self, low: np.ndarray, high: np.ndarray, members: np.ndarray | None = None) -> int:
        for held, x in zip((self.low, self.high, self.child, self.bit, self.members), (low, high, (-1, -1), -1, members), strict=True):
            held.append(x)
        return len(self.bit) - 1

    def packed(self) -> Tree:
        return Tree(np.array(self.low), np.array(self.high), np.array(self.child, np.int64).reshape(-1, 2), np.array(self.bit), self.members)


def _best_bit(bits: np.ndarray) -> int:
    """The letter and its median that part the words most evenly; -1 if all are equal."""
    share = bits.mean(axis=0)
    bit = int(np.abs(share - 0.5).argmin())
    return bit if 0 < share[bit] < 1 else -1


def within(tree: Tree, codes: np.ndarray, start: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) for every leaf whose box is within ``radius`` of a query; ``start``: root for each query (-1: none)."""
    who, node = np.flatnonzero(start >= 0), start[start >= 0]
    found_who, found_leaf = [], []
    while len(who):
        q = codes[who]
        gap = np.bitwise_count(tree.low[node] & ~q).sum(axis=1, dtype=np.int64) + np.bitwise_count(q & ~tree.high[node]).sum(axis=1, dtype=np.int64)
        near = gap <= radius[who]
        who, node = who[near], node[near]
        leaf = tree.bit[node] < 0
        found_who.append(who[leaf])
        found_leaf.append(node[leaf])
        who, node = np.repeat(who[~leaf], 2), tree.child[node[~leaf]].ravel()
    return (np.concatenate(found_who), np.concatenate(found_leaf)) if found_who else (who, node)


def local_tree(codes: np.ndarray) -> Tree:
    """A k-d tree over distinct letter counts, boxes drawn tight around their members."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    tree = Tree()
    waiting = [(np.arange(len(codes)), -1, 0)]
    while waiting:
        members, parent, side = waiting.pop()
        at = tree.add(np.bitwise_and.reduce(codes[members]), np.bitwise_or.reduce(codes[members]), members)
        if parent >= 0:
            tree.child[parent] = (at, tree.child[parent][1]) if side == 0 else (tree.child[parent][0], at)
        bit = _best_bit(bits[members]) if len(members) > LEAF else -1
        if bit >= 0:
            tree.bit[at], tree.members[at] = bit, None
            up = bits[members, bit].astype(bool)
            waiting += [(members[~up], at, 0), (members[up], at, 1)]
    return tree.packed()


@dataclass
class Boxes:
    """The boxes that words are dealt to: one tree a word length, whose leaves may be dealt to several parts by a hash."""

    tree: Tree
    roots: dict[int, int]
    number: np.ndarray
    parts: np.ndarray

    def codes(self, offsets: np.ndarray, points: np.ndarray) -> np.ndarray:
        return unary(offsets, points % FOLD, FOLD, MOST)

    def root_of(self, lengths: np.ndarray) -> np.ndarray:
        known, which = np.unique(lengths, return_inverse=True)
        return np.array([self.roots.get(int(x), -1) for x in known], np.int64)[which] if len(known) else np.zeros(0, np.int64)

    def home(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The leaf of each word, a node."""
        node = self.root_of(lengths)
        while True:
            inner = np.flatnonzero(self.tree.bit[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            bit = self.tree.bit[at]
            up = (codes[inner, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)
            node[inner] = self.tree.child[at, up.astype(np.int64)]


def draw_boxes(sample: pa.Array, counts: dict[int, int], share: float) -> Boxes:
    """Boxes of about ``BOX_WORDS`` words for each length, cut at the medians of ``sample``, a ``share`` of all words."""
    offsets, points = code_points(sample)
    lengths = np.diff(offsets)
    empty = Boxes(Tree(), {}, np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes = empty.codes(offsets, points)
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little") if len(codes) else np.zeros((0, FOLD * MOST), np.uint8)
    tree, roots, width = Tree(), {}, FOLD * MOST // 64
    for length in counts:
        most = box_words(length)
        waiting = [(np.flatnonzero(lengths == length), np.zeros(width, np.uint64), np.full(width, ~np.uint64(0)), -1, 0)]
        while waiting:
            members, low, high, parent, side = waiting.pop()
            at = tree.add(low, high)
            if parent < 0:
                roots[length] = at
            else:
                tree.child[parent] = (at, tree.child[parent][1]) if side == 0 else (tree.child[parent][0], at)
            bit = _best_bit(bits[members]) if len(members) / share > most and len(members) > 8 else -1
            if bit < 0:
                continue
            tree.bit[at] = bit
            first = bit // MOST * MOST  # the bits of one letter, all in one number
            below, above = (np.uint64(sum(1 << (x % 64) for x in range(a, z))) for a, z in ((first, bit + 1), (bit, first + MOST)))
            up_low, down_high = low.copy(), high.copy()
            up_low[bit // 64] |= below
            down_high[bit // 64] &= ~above
            up = bits[members, bit].astype(bool)
            waiting += [(members[~up], low, down_high, at, 0), (members[up], up_low, high, at, 1)]
    packed = tree.packed()
    number = np.cumsum(packed.bit < 0) - 1 if len(packed.bit) else np.zeros(0, np.int64)
    return Boxes(packed, roots, number, np.ones(len(packed.bit), np.int64))


def box_words(length: int) -> int:
    return max(64, min(BOX_WORDS, BOX_LETTERS // length))


def _parts_of(words: pa.Array, n: np.ndarray) -> np.ndarray:
    """The part of its box that each word is dealt to."""
    if (n == 1).all():
        return np.zeros(len(n), np.int64)
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words.to_pylist()], np.int64) % n


def _words_in(data: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    words = data.column("word").cast(pa.string())
    offsets, points = code_points(words)
    return words, offsets, points, np.diff(offsets)


def find_boxes(words: DataFrame) -> Boxes:
    """Boxes for a written vocabulary (word, n); the driver gets counts by length and box, and the bounded sample."""
    by_length = {r[0]: r[1] for r in words.groupBy(F.char_length("word")).count().collect()}
    total, letters = sum(by_length.values()), sum(k * v for k, v in by_length.items())
    share = min(1.0, SAMPLE_WORDS / max(1, total), SAMPLE_LETTERS / max(1, letters))
    few = words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    boxes = draw_boxes(few.toArrow().column("word").combine_chunks().cast(pa.string()), by_length, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, offsets, points, lengths = _words_in(b)
                leaf, n = np.unique(boxes.home(boxes.codes(offsets, points), lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    size = {r[0]: r[1] for r in words.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect()}
    of = {leaf: length for length, root in boxes.roots.items() for leaf in _leaves(boxes.tree, root)}
    for leaf, n in size.items():
        boxes.parts[leaf] = -(-n // (4 * box_words(of[leaf])))
    return boxes


def _leaves(tree: Tree, root: int) -> list[int]:
    out, waiting = [], [root]
    while waiting:
        at = waiting.pop()
        if tree.bit[at] < 0:
            out.append(at)
        else:
            waiting += tree.child[at].tolist()
    return out


def deal(words: DataFrame, boxes: Boxes) -> DataFrame:
    """Every word in its own box, and as a visitor in each other box that may hold a near word: box, part, word, n, home.

    A pair of equal length meets in the box with the greater number (or part); a shorter word visits the longer ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, offsets, points, lengths = _words_in(b)
            codes = boxes.codes(offsets, points)
            home = boxes.home(codes, lengths)
            mine = _parts_of(words, boxes.parts[home])
            out = [(np.arange(len(home)), home, mine, np.ones(len(home), bool))]
            for more, radius in ((0, 2), (1, 1)):
                who, leaf = within(boxes.tree, codes, boxes.root_of(lengths + more), np.full(len(home), radius))
                if not more:
                    later = leaf >= home[who]
                    who, leaf = who[later], leaf[later]
                times = boxes.parts[leaf]
                part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                who, leaf = np.repeat(who, times), np.repeat(leaf, times)
                if not more:
                    other = (leaf > home[who]) | (part > mine[who])
                    who, leaf, part = who[other], leaf[other], part[other]
                out.append((who, leaf, part, np.zeros(len(who), bool)))
            who, leaf, part, at_home = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(boxes.number[leaf]), pa.array(part), words.take(pa.array(who)), b.column("n").take(pa.array(who)), pa.array(at_home)],
                names=["box", "part", "word", "n", "home"],
            )

    return words.mapInArrow(run, "box long, part long, word string, n long, home boolean")


# ---- near words inside a box


def _class_pairs(codes: np.ndarray, at_home: np.ndarray, length: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (any, home) of distinct letter counts that one edit may join; two at home in one order only."""
    homes = np.flatnonzero(at_home)
    if not len(homes):
        return
    own = codes[homes]
    tree = local_tree(own)
    radius = np.where(length == length[homes[0]], 2, 1)
    size = np.array([0 if m is None else len(m) for m in tree.members])
    start = np.cumsum(size) - size
    member = homes[np.concatenate([m for m in tree.members if m is not None])]
    for a in range(0, len(codes), 4_096):
        z = min(len(codes), a + 4_096)
        who, leaf = within(tree, codes[a:z], np.zeros(z - a, np.int64), radius[a:z])
        cuts = np.searchsorted(np.cumsum(size[leaf]), np.arange(PAIRS, int(size[leaf].sum()) + PAIRS, PAIRS), side="right")
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
            if i == j:
                continue
            x = np.repeat(who[i:j] + a, size[leaf[i:j]])
            y = member[pieces(start[leaf[i:j]], size[leaf[i:j]])]
            gap = _differ(codes[x], codes[y])
            fits = (gap <= radius[x]) & (~at_home[x] | (x < y if exact else x <= y)) & ((gap > 0) | (not exact))
            yield x[fits], y[fits]


def _one_edit(matrix: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words ``x`` and ``y``, as long or one code point longer, differ by exactly one edit."""
    a, b = matrix[x], matrix[y]
    width = matrix.shape[1]
    shorter = length[x] < length[y]
    out = (a != b).sum(axis=1) == 1
    if shorter.any():
        s, t, n = a[shorter], b[shorter], length[x[shorter]]
        front = (s[:, : width - 1] == t[:, : width - 1]) | (np.arange(width - 1) >= n[:, None])
        back = (s[:, : width - 1] == t[:, 1:]) | (np.arange(width - 1) >= n[:, None])
        prefix = np.where(front.all(axis=1), n, front.argmin(axis=1))
        suffix = np.where(back.all(axis=1), n, n - (width - 1) + back[:, ::-1].argmin(axis=1))
        out[shorter] = prefix + suffix >= n
    return out


def near_in_box(words: pa.Array, n: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many near words it meets in this box, and the best of them (largest n, then smallest; -1: none)."""
    offsets, points = code_points(words)
    length = np.diff(offsets)
    alphabet, letters = np.unique(points, return_inverse=True)
    exact = len(alphabet) <= ALPHABET
    letters = letters if exact else letters % ALPHABET
    n_letters = min(len(alphabet), ALPHABET)
    word = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((letters, word))
    runs = np.flatnonzero(np.diff(letters[order], prepend=-1) | np.diff(word[order], prepend=-1))
    most = int(np.diff(np.append(runs, len(letters))).max())
    codes, which = np.unique(unary(offsets, letters, n_letters, most), axis=0, return_inverse=True)
    which = which.ravel()
    # a class has words at home or visitors; with several parts a box may have both: two classes then
    tag = which * 2 + home
    kinds, which = np.unique(tag, return_inverse=True)
    codes, at_home = codes[kinds // 2], (kinds % 2).astype(bool)
    by_class = np.argsort(which, kind="stable")
    size = np.bincount(which, minlength=len(kinds))
    start = np.cumsum(size) - size
    matrix = np.full((len(length), int(length.max())), -1, np.int32)
    matrix[word, np.arange(len(points)) - np.repeat(offsets[:-1], length)] = points
    best_first = pc.sort_indices(pa.table({"n": n, "word": words}), [("n", "descending"), ("word", "ascending")]).to_numpy()
    place = np.empty(len(n), np.int64)
    place[best_first] = np.arange(len(n))
    count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n), np.int64)
    most_pairs = max(1, PAIRS // matrix.shape[1])
    for x, y in _class_pairs(codes, at_home, length[by_class[start]], exact):
        one = by_class[pieces(start[x], size[x])]  # each word of x with all of class y
        other = np.repeat(y, size[x])
        ends = np.cumsum(size[other])
        cuts = np.searchsorted(ends, np.arange(most_pairs, (int(ends[-1]) if len(ends) else 0) + most_pairs, most_pairs), side="right")
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(other)], strict=True):
            if i == j:
                continue
            a = np.repeat(one[i:j], size[other[i:j]])
            b = by_class[pieces(start[other[i:j]], size[other[i:j]])]
            if not exact:  # words of one class at home meet twice
                once = (which[a] != which[b]) | (a < b)
                a, b = a[once], b[once]
            near = _one_edit(matrix, length, a, b)
            a, b = a[near], b[near]
            count += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
            np.minimum.at(best, a, place[b])
            np.minimum.at(best, b, place[a])
    return count, np.where(best < len(n), best_first[np.minimum(best, len(n) - 1)], -1)


def near_words(words: DataFrame) -> DataFrame:
    """For every word of a written vocabulary (word, n): n_near, and its near word of largest n (ties: the smallest) with that n."""
    boxes = find_boxes(words)

    def run(group: pa.Table) -> pa.Table:
        mine = column_of(group, "word").cast(pa.string())
        n = column_of(group, "n").to_numpy()
        count, best = near_in_box(mine, n, column_of(group, "home").to_numpy(zero_copy_only=False))
        some = np.flatnonzero(count)
        out = pa.table({"word": mine.take(pa.array(some)), "n_near": pa.array(count[some]), "best": mine.take(pa.array(best[some])), "best_n": pa.array(n[best[some]])})
        trim()
        return out

    found = deal(words, boxes).groupBy("box", "part").applyInArrow(run, "word string, n_near long, best string, best_n long")
    none = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("bigint").alias("best_n"))
    top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))).alias("top")
    both = none.unionByName(found.withColumn("n", F.lit(None).cast("bigint"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), top)
    return both.select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word's more usual spelling: word, form, root, n, n_near, form_n.

    ``words`` (word, n) has one row a word; other columns are not read, rows with a null or empty word are left out.
    Words are near if one inserted, deleted or replaced code point makes them equal.  ``form`` is the near word of
    largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the word's, else null; ``root``
    is where the forms lead, the word itself if it has none.  An empty table gives none.

    One edit changes the letter counts by two at most in L1 distance (one, if the length changes).  So words are dealt to boxes
    of k-d trees over these counts, one tree a length; a word visits the boxes of its own and of the next length within that
    distance.  In a box a second tree over the distinct counts finds the candidates, whose letter order is compared.
    The boxes follow a bounded sample, all words are searched; a box that stays too large is dealt to parts.
    """
    known = words.select("word", "n").filter("word <> ''")
    found = near_words(keep(known, "words"))
    table = keep(found.withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))), "forms")
    return follow(table).select("word", "form", "root", "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """Adds ``root`` to (word, form, ..) by doubled pointers: the last word that the forms lead to."""
    links = keep(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        links, before = keep(links.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots"), links
        if links.filter("moved").isEmpty():
            break
        links = links.select("word", "root")
    ends = before.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
    return forms.join(ends, F.col("word") == F.col("_w"), "left").withColumn("root", F.coalesce("_r", "word")).drop("_w", "_r")


@query(
    "op12_spelling_forms",
    r"""
    WITH RECURSIVE
    crc_table AS (
        SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
    ), runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents
    ), pairs AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL
    ), bytes AS (
        SELECT doc_id, w, n, list_transform(string_split(regexp_replace(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT) AS b FROM pairs
    ), hashed AS (
        SELECT doc_id, w, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
    ), words AS (
        SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed
    ), counted AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ), masks AS (
        SELECT word, n, i, word[:i] || chr(1) || word[i + 2:] AS replaced, word[:i] || word[i + 2:] AS less FROM counted, unnest(range(0, length(word))) u(i)
    ), near AS (
        SELECT a.word, b.word AS other, b.n FROM masks a JOIN masks b ON a.replaced = b.replaced AND a.word <> b.word
        UNION SELECT m.word, c.word, c.n FROM masks m JOIN counted c ON c.word = m.less
        UNION SELECT c.word, m.word, m.n FROM masks m JOIN counted c ON c.word = m.less
    ), best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word
    ), forms AS (
        SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * c.n THEN top END AS form_n,
               CASE WHEN top >= 2 * c.n THEN (SELECT min(x.other) FROM near x WHERE x.word = c.word AND x.n = top) END AS form
        FROM counted c LEFT JOIN best b ON b.word = c.word
    ), walk AS (
        SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
    ), ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
    SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return spelling_variants(count_words(docs, misspell=97))
