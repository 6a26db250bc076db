"""Token ids of whole texts by the tokenizers library, with a cache of words in each worker process.

Both vocabularies cut texts at spaces, so the ids of a text are those of its fields one after
the other.  Corpora repeat their words; each worker therefore encodes a field once and
looks it up later.  The cache is keyed by a 64-bit hash and emptied when it is full, which
costs time and changes nothing else.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabweave.llm.common import hash_strings, pieces

CACHE_FIELDS = 1_500_000
#: New fields are encoded in lists of this many, so that their encodings don't pile up.
ENCODE_AT_ONCE = 20_000
#: Marks that are cut off a field's end, behind what they are cut, and how many at most.
_TAIL, _SOLID, _LONGEST_TAIL = ".,;:!?*$%#&", "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$", 8
#: A space between two characters that are no white space of any kind: no token crosses it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")

#: White space of any kind, and fields that are empty or begin or end with it.
_WHITE = "".join(re.escape(c) for c in map(chr, range(0x3001)) if c.isspace())
_ODD = rf"^$|^[{_WHITE}]|[{_WHITE}]$"


class FieldEncoder:
    """Ids of fields; ``lowered`` vocabularies drop white space and case, others keep the space before a field."""

    def __init__(self, path: str, lowered: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lowered = Tokenizer.from_file(path), lowered
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode(self, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = [], []
        for at in range(0, len(fields), ENCODE_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(fields[at : at + ENCODE_AT_ONCE], add_special_tokens=False):
                got = e.ids
                lengths.append(len(got))
                ids.extend(got)
        return np.array(lengths, np.int64), np.array(ids, np.uint16)

    def fields(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each (distinct) field stand in ``self.ids``: starts and lengths."""
        if len(self.keys) + len(values) > CACHE_FIELDS:
            self.clear()
        keys = hash_strings(values)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            lengths, ids = self._encode(values[new].tolist())
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint16)])
            self.ids[self.used : self.used + len(ids)] = ids
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(ids)
            order = np.argsort(keys[new], kind="stable")
            place = np.searchsorted(self.keys, keys[new][order])
            self.keys = np.insert(self.keys, place, keys[new][order])
            self.slots = np.insert(self.slots, place, first + order)
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at]
        return self.starts[slot], self.lengths[slot]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and all ids in a row; null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.lowered:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.lowered:
            distinct, codes, offsets = self._spaced(texts, distinct, codes, offsets)
        counts = np.diff(offsets)
        starts, lengths, tail = self._with_tails(distinct)
        # one or two lookups a field, in order
        twice = tail[codes] >= 0
        at = np.arange(len(codes)) + np.concatenate([[0], np.cumsum(twice)])[:-1]
        unit = np.empty(len(codes) + int(twice.sum()), np.int64)
        unit[at] = codes
        unit[at[twice] + 1] = tail[codes[twice]]
        per_unit = lengths[unit]
        out = self.ids[pieces(starts[unit], per_unit)]
        ends = np.concatenate([[0], np.cumsum(per_unit)])
        first = np.concatenate([at, [len(unit)]])
        return ends[first[np.concatenate([[0], np.cumsum(counts)])]], out

    def _with_tails(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of each distinct field without the marks at its end, then of those marks; which marks follow it (-1: none).

        A run of marks behind a letter or digit is a token boundary in both vocabularies, so fields that only differ in it are encoded once.
        """
        core = pc.utf8_rtrim(distinct, characters=_TAIL)
        cut = pc.and_(pc.less(pc.binary_length(core), pc.binary_length(distinct)), pc.match_substring_regex(core, _SOLID))
        core = pc.if_else(cut, core, distinct)
        marks = pc.utf8_slice_codeunits(distinct.filter(cut), -_LONGEST_TAIL)
        marks = pc.replace_substring_regex(marks, pattern="^.*[^" + re.escape(_TAIL) + "]", replacement="")
        short = pc.equal(pc.add(pc.binary_length(core.filter(cut)), pc.binary_length(marks)), pc.binary_length(distinct.filter(cut)))
        on = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        fine = short.to_numpy(zero_copy_only=False)
        if not fine.all():  # longer runs of marks stay with their field
            core = pc.if_else(pa.array(np.isin(np.arange(len(distinct)), on[~fine])), distinct, core)
            on, marks = on[fine], marks.filter(short)
        cores, tails = core.dictionary_encode(), marks.dictionary_encode()
        every = np.concatenate([cores.dictionary.to_numpy(zero_copy_only=False), tails.dictionary.to_numpy(zero_copy_only=False)])
        starts, lengths = self.fields(every)
        n = len(cores.dictionary)
        core_at = cores.indices.to_numpy(zero_copy_only=False)
        tail = np.full(len(distinct), -1, np.int64)
        tail[on] = len(distinct) + tails.indices.to_numpy(zero_copy_only=False)
        return np.concatenate([starts[core_at], starts[n:]]), np.concatenate([lengths[core_at], lengths[n:]]), tail

    def _spaced(self, texts: pa.Array, distinct: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Fields with the space before them, where that space surely starts a token; else the field is joined to the one before.

        Distinct fields, codes of all fields, offsets per text.  A field is spelled out once with a space and once
        without, if it occurs so, whatever the number of its occurrences.
        """
        first = np.zeros(len(codes), np.int64)
        first[offsets[:-1]] = 1
        unit = codes * 2 + first
        used = np.zeros(2 * len(distinct), bool)
        used[unit] = True
        some = np.flatnonzero(used)
        lead = pc.if_else(pa.array(some % 2 == 1), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        spaced = pc.binary_join_element_wise(lead, distinct.take(pa.array(some // 2)), pa.scalar("", pa.large_string()))
        new = (np.cumsum(used) - 1)[unit]
        odd = pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return spaced, new, offsets
        per_text = np.add.reduceat(odd[codes].astype(np.int64), offsets[:-1])
        wrong = np.flatnonzero(per_text)
        split = []
        for i in wrong.tolist():
            units = [u if not j else " " + u for j, u in enumerate(_SAFE.split(texts[i].as_py()))]
            split.append([u for u in units if u])
        extra = pa.array([u for units in split for u in units], pa.large_string()).dictionary_encode()
        more = extra.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(spaced)
        counts, at, end, parts = np.diff(offsets), 0, 0, []
        for i, units in zip(wrong.tolist(), split, strict=True):
            parts += [new[at : offsets[i]], more[end : end + len(units)]]
            at, end = offsets[i + 1], end + len(units)
            counts[i] = len(units)
        parts.append(new[at:])
        return pa.concat_arrays([spaced, extra.dictionary]), np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


_ENCODERS: dict[tuple[str, bool], FieldEncoder] = {}


def encoder(path: str, lowered: bool) -> FieldEncoder:
    """The worker process's own encoder, made once."""
    if (path, lowered) not in _ENCODERS:
        _ENCODERS[path, lowered] = FieldEncoder(path, lowered)
    return _ENCODERS[path, lowered]
