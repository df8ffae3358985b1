"""Removal of 50-byte strings that also start in a document with a smaller id, by blockwise suffix sorting.

Suffixes are dealt to buckets by the minimizer of their first 50 bytes (of the hashes of their 24-byte strings the least), so
equal strings meet. Neighbouring suffixes with one minimizer travel as one string. Blocks first learn which minimizers are of
several documents; only those strings are sent, each once a block. A bucket folds equal strings and sorts the suffixes of
those that differ, a range of first bytes at a time: up to the period of a difference cover by their bytes, longer ties by the
ranks of the cover's sample suffixes, which were sorted before. Neighbours with 50 bytes in common are one string, and its
least document keeps it.

A null text counts as empty; texts under 50 bytes are kept; a null doc_id is the least; copies under one id are kept; very long
texts are blocks of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import COUNTED, EXACT, NULL_ID, Blocks, count_keys, deltas, expand, mix64, narrow, rest_of, rows_of, shard_slices, span_hashes, squeeze, undeltas, unpack, widen
from .common import lean, written

LENGTH, GRAM = 50, 24
_WIDE = LENGTH - GRAM + 1
_CHUNK = 1 << 20
#: A minimizer of more documents deals its suffixes out one by one, by their own bytes.
HOT = 20_000
#: A perfect difference cover: every difference modulo 31 is one of two of its elements.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of strings that form a bucket, about, and suffixes of it that are sorted at once.
PART, RANGE = 1 << 20, 1 << 17


def _shifts() -> np.ndarray:
    """[r, s]: the least d for which r + d and s + d are both in the cover."""
    out = np.full((PERIOD, PERIOD), PERIOD)
    for d in reversed(range(PERIOD)):
        at = np.array([(c - d) % PERIOD for c in COVER])
        out[np.ix_(at, at)] = d
    return out


SHIFTS = _shifts()
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()


def runs(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings with one minimizer, and its hash."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - LENGTH + 1
    firsts, lasts, hashes = [], [], []
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, np.maximum(starts[:-1], starts[1:] - LENGTH + 1), 1)
    np.add.at(edge, starts[1:], -1)
    outside = np.cumsum(edge, dtype=np.int32)[:n] > 0
    low = np.uint64((1 << 26) - 1)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        v = _words(raw[lo : hi + LENGTH - 1])
        h = mix64(v[:-16] * np.uint64(0x9E3779B97F4A7C15) + v[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + v[16:] * np.uint64(0x165667B19E3779F9))
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, _WIDE - 16):
            least = np.minimum(least[:-step], least[step:])
        at = (least & low).astype(np.int64)
        out = outside[lo:hi]
        new = np.ones(hi - lo, bool)
        new[1:] = (at[1:] != at[:-1]) | out[:-1]
        end = np.ones(hi - lo, bool)
        end[:-1] = new[1:] | out[1:]
        first = np.flatnonzero(new & ~out)
        firsts.append(first + lo)
        lasts.append(np.flatnonzero(end & ~out) + lo)
        hashes.append(h[at[first]])
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _requests(blocks: Blocks) -> DataFrame:
    bits, shards = blocks.key_bits, blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            _, starts, data = unpack(row)
            first, _, h = runs(data, starts)
            doc = np.searchsorted(starts, first, side="right") - 1
            key = h >> np.uint64(64 - bits)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            keys, counts = np.unique(key[keep], return_counts=True)
            out = [(s, row["block"], deltas(keys[a:b]), narrow(counts[a:b] - 1)) for s, a, b in shard_slices(keys, bits, shards)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "keys", "more"])

    return blocks.table.mapInArrow(run, "shard int, block long, keys binary, more binary")


class _Repeats:
    """A block's runs whose minimizer is of several documents, each different string once."""

    def __init__(self, row: dict, bits: int, shards: int) -> None:
        self.ids, self.starts, self.data = unpack(row)
        first, last, h = runs(self.data, self.starts)
        key = h >> np.uint64(64 - bits)
        keys, place = np.unique(key, return_inverse=True)
        more = np.zeros(len(keys), np.int64)
        said = {a["shard"]: a["more"] for a in row["answers"] or []}
        for s, a, b in shard_slices(keys, bits, shards):
            more[a:b] = widen(expand(said[s]))
        more = more[place]
        use = np.flatnonzero((more > 0) & (more < HOT))
        hot = np.flatnonzero(more >= HOT)
        count = last[hot] - first[hot] + 1
        alone = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[hot], count)
        begin = np.concatenate([first[use], alone])
        order = np.argsort(begin, kind="stable")
        self.first = begin[order]
        self.last = np.concatenate([last[use], alone])[order]
        single = (np.arange(len(begin)) >= len(use))[order]
        raw = np.frombuffer(self.data, np.uint8)
        text = mix64(span_hashes(raw, self.first, self.last + LENGTH, EXACT) + (self.last - self.first).astype(np.uint64))
        key = np.concatenate([key[use], np.zeros(len(alone), np.uint64)])[order]
        key[single] = text[single] >> np.uint64(64 - bits)
        self.doc = self.ids[np.searchsorted(self.starts, self.first, side="right") - 1]
        order = np.lexsort((self.doc, text, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])
        self.sent = order[new]  # the least document's run of each string, by key
        self.owner = np.empty(len(order), np.int64)
        self.owner[order] = np.cumsum(new) - 1
        self.keys = key[self.sent]

    def strings(self, a: int, b: int) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        at = self.sent[a:b]
        first, size = self.first[at], self.last[at] - self.first[at] + LENGTH
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        docs = self.doc[at]
        base = int(docs.min())
        text = np.frombuffer(self.data, np.uint8)[place].tobytes()
        return deltas(self.keys[a:b]), narrow(size - LENGTH), base.to_bytes(8, "little", signed=True) + narrow(docs.astype(np.uint64) - np.uint64(base % (1 << 64))), squeeze(text, 3)


def _sent(blocks: Blocks, counted: DataFrame) -> DataFrame:
    bits, shards = blocks.key_bits, blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            r = _Repeats(row, bits, shards)
            out = [(s, row["block"], *r.strings(a, b)) for s, a, b in shard_slices(r.keys, bits, shards)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["shard", "block", "keys", "sizes", "docs", "texts"])

    return blocks.with_answers(counted).mapInArrow(run, "shard int, block long, keys binary, sizes binary, docs binary, texts binary")


def _columns(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n numbers of eight bytes each, from the places at, that compare as the bytes do."""
    return np.lib.stride_tricks.sliding_window_view(raw, 8 * n)[at].view(">u8")


def sample_ranks(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes, to their string's end, at the cover's places (elsewhere 0). raw is padded by zeros."""
    n = int(ends[-1]) if len(ends) else 0
    at = np.flatnonzero(IN_COVER[np.arange(n) % PERIOD])
    rank = np.zeros(n, np.int64)
    if not len(at):
        return rank
    size = int(np.diff(ends, prepend=0).max())
    left = ends[np.searchsorted(ends, at, side="right")] - at
    group = np.zeros(len(at), np.int64)
    for k in range(0, size, 8):  # eight bytes more at a time, of those whose ranks are still shared
        counts = np.bincount(group, minlength=1)
        open_ = np.flatnonzero((counts[group] > 1) & (left > k)) if k else np.arange(len(at))
        if not len(open_):
            break
        word = np.zeros(len(at), np.uint64)
        w = _columns(raw, at[open_] + k, 1)[:, 0].astype(np.uint64)
        over = np.clip(8 - (left[open_] - k), 0, 7).astype(np.uint64) * np.uint64(8)
        word[open_] = w >> over << over
        order = np.lexsort((word, group))
        new = np.zeros(len(at), np.int64)
        new[1:] = (group[order][1:] != group[order][:-1]) | (word[order][1:] != word[order][:-1])
        group[order] = np.cumsum(new)
    rank[at] = group
    return rank


def sorted_range(raw: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The places at, in the order of their suffixes: by 32 bytes, then by the ranks of sample suffixes."""
    cols = _columns(raw, at, 4)
    order = np.lexsort(cols.T[::-1])
    at, cols = at[order], cols[order]
    group = np.zeros(len(at), np.int64)
    group[1:] = np.cumsum((cols[1:] != cols[:-1]).any(axis=1))
    done = np.zeros(len(at), bool)
    while True:
        sizes = np.bincount(group)
        done |= sizes[group] == 1
        todo = np.flatnonzero(~done)
        if not len(todo):
            return at
        first = np.cumsum(sizes) - sizes
        pivot = at[(first + sizes // 2)[group[todo]]]
        shift = SHIFTS[at[todo] % PERIOD, pivot % PERIOD]
        sign = np.zeros(len(at), np.int64)
        sign[todo] = np.sign(rank[at[todo] + shift] - rank[pivot + shift])
        done[todo] |= sign[todo] == 0
        key = group * 3 + sign
        order = np.argsort(key, kind="stable")
        at, done, key = at[order], done[order], key[order]
        group = np.zeros(len(at), np.int64)
        group[1:] = np.cumsum(key[1:] != key[:-1])


def least_documents(text: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes within a string of text (place by place; elsewhere the string's own document): the
    least document in whose strings the same bytes start."""
    own = np.repeat(docs, np.diff(ends, prepend=0))
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))
    raw = np.concatenate([text, np.zeros(96, np.uint8)])
    rank = sample_ranks(raw, ends)
    at = np.flatnonzero(left >= LENGTH)
    out = own.copy()
    head = _columns(raw, at, 1)[:, 0].astype(np.uint64)
    by = np.argsort(head, kind="stable")
    head = head[by]
    cuts = [0]
    while cuts[-1] < len(by):  # ranges of first bytes
        to = min(cuts[-1] + RANGE, len(by))
        cuts.append(int(np.searchsorted(head, head[to - 1], side="right")))
    for a, b in zip(cuts, cuts[1:], strict=False):
        place = sorted_range(raw, at[by[a:b]], rank)
        rows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[place]
        new = np.ones(len(place), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        least = np.minimum.reduceat(own[place], np.flatnonzero(new))
        out[place] = least[np.cumsum(new) - 1]
    return out


def _gone(text: np.ndarray, end: np.ndarray, size: np.ndarray, doc: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """For each picked string a bit for each of its starts whose bytes start in a smaller document."""
    s = size[pick].astype(np.int32)
    first = np.cumsum(s, dtype=np.int32) - s
    bit = np.arange(s.sum(), dtype=np.int32) - np.repeat(first, s)
    least = least_documents(text[np.repeat(end[pick] - s, s) + bit], np.cumsum(s), doc[pick])
    gone = (least < np.repeat(doc[pick], s)) & (bit <= np.repeat(s, s) - LENGTH)
    return np.bitwise_or.reduceat(np.where(gone, np.uint64(1) << np.minimum(bit, 63).astype(np.uint64), np.uint64(0)), first)


def _sort_shard(table: pa.Table) -> pa.Table:
    """For each string of each block of a shard: which of its starts have their bytes in a document of a smaller id."""
    lean()  # of what the shard before this one took
    parts = [undeltas(k) for k in table.column("keys").to_pylist()]
    key = np.concatenate(parts)
    size = np.concatenate([widen(x) for x in table.column("sizes").to_pylist()]).astype(np.int64) + LENGTH
    doc = np.concatenate([(widen(x[8:]) + np.uint64(int.from_bytes(x[:8], "little"))).view(np.int64) for x in table.column("docs").to_pylist()])
    text = np.frombuffer(b"".join(expand(x) for x in table.column("texts").to_pylist()), np.uint8)
    end = np.cumsum(size)
    content = mix64(span_hashes(text, end - size, end, EXACT) + size.astype(np.uint64))
    order = np.lexsort((doc, content, key))
    new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    new[1:] = new_key[1:] | (content[order][1:] != content[order][:-1])
    firsts = order[new]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    kinds = np.bincount(np.cumsum(new_key)[new] - 1)  # different strings of each key
    several = kinds[np.cumsum(new_key)[new] - 1] > 1
    marks = np.zeros(len(firsts), np.uint64)
    pick = firsts[several]
    if len(pick):
        # one bucket of suffixes after the other: some keys' strings, about PART bytes
        ends = np.flatnonzero(np.append(key[pick][1:] != key[pick][:-1], True)) + 1
        total = np.concatenate([[0], np.cumsum(size[pick])])
        got, lo = [], 0
        while lo < len(pick):
            to = np.searchsorted(total[ends], total[lo] + PART, side="right") - 1
            hi = int(ends[max(to, np.searchsorted(ends, lo, side="right"))])
            got.append(_gone(text, end, size, doc, pick[lo:hi]))
            lo = hi
        marks[several] = np.concatenate(got)
    out = np.where(doc > doc[firsts][place], (np.uint64(1) << (size - LENGTH + 1).astype(np.uint64)) - np.uint64(1), marks[place])
    split = np.split(out, np.cumsum([len(k) for k in parts])[:-1])
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "marks": pa.array([squeeze(x.astype("<u4").tobytes()) for x in split], pa.binary())})


def _removed(row: dict, bits: int, shards: int) -> tuple[_Repeats, np.ndarray]:
    """A block's repeats, and which of its bytes go."""
    r = _Repeats(row, bits, shards)
    marks = np.zeros(len(r.keys), np.uint64)
    said = {a["shard"]: a["marks"] for a in row["marks"] or []}
    for s, a, b in shard_slices(r.keys, bits, shards):
        marks[a:b] = np.frombuffer(expand(said[s]), "<u4")
    count = r.last - r.first + 1
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    later = r.doc > r.doc[r.sent][r.owner] if len(r.doc) else np.zeros(0, bool)
    own = np.where(later, full, marks[r.owner] if len(r.doc) else full)
    some = np.flatnonzero(own)
    c = count[some]
    bit = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    at = (np.repeat(r.first[some], c) + bit)[(np.repeat(own[some], c) >> bit.astype(np.uint64)) & np.uint64(1) == 1]
    edge = np.zeros(len(r.data) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    return r, np.cumsum(edge[:-1], dtype=np.int32) > 0


def _planned(blocks: Blocks) -> DataFrame:
    counted = written(_requests(blocks).groupBy("shard").applyInArrow(count_keys, COUNTED)).select("block", "shard", "more")
    marks = _sent(blocks, counted).groupBy("shard").applyInArrow(_sort_shard, "block long, shard int, marks binary")
    per = marks.groupBy("block").agg(F.collect_list(F.struct("shard", "marks")).alias("marks"))
    return blocks.with_answers(counted).join(per, "block", "left")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256 of each document."""
    blocks = Blocks(docs)
    bits, shards = blocks.key_bits, blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            r, gone = _removed(row, bits, shards)
            raw, at = np.frombuffer(r.data, np.uint8), r.starts
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cut = at[:-1][at[:-1] < len(gone)]
            begins[cut] = gone[cut]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            sha = [hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            cols = [pa.array(r.ids, pa.int64(), mask=r.ids == NULL_ID), pa.array(np.diff(at), pa.int64()), pa.array(total(gone), pa.int64()), pa.array(total(begins), pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _planned(blocks).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with what is kept of each text; bytes of a character that was cut are dropped with it."""
    blocks = Blocks(docs, keep=True)
    bits, shards = blocks.key_bits, blocks.shard_bits
    names = docs.columns

    def run(batches):
        for row in rows_of(batches):
            r, gone = _removed(row, bits, shards)
            raw, at = np.frombuffer(r.data, np.uint8), r.starts
            texts = [raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(at, at[1:], strict=False)]
            table = rest_of(row).append_column("text", pa.array(texts, pa.string())).select(names)
            yield from table.combine_chunks().to_batches()

    return _planned(blocks).mapInArrow(run, docs.schema)
