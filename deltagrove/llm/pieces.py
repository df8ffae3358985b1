"""SentencePiece segmentations: Gumbel top-k sampling without replacement over the lattice of pieces, and decoding.

A text's lattice is that of its words (pieces never cross a blank's left side or a line end), so a word's own lattice is
solved once and kept for the texts after: the summed weight of all ways to its end is the exact heuristic of the search. A piece's weight is that
of its rank (Zipf: 1 / (rank + 2)) to the power ALPHA; characters without a piece fall back to byte tokens. The search is a
perturbed A* from the start of the text: the best path keeps its parent's Gumbel value, and all branches beside it wait as one
entry with the value of their best, drawn below the parent's; the branch is drawn when the entry is taken, and what is left of
it waits again. Taking the largest entry again and again gives the k
segmentations with the largest perturbed log-probabilities, all different, as the sampling demands. The value of the best
entry left over is the threshold of the inclusion scores. All draws are hashes of the seed, the row key and the place.

A null or empty text has one segmentation, without pieces. A text with fewer than k segmentations gives them all. Repeated
rows give equal samples. Decoding gives the text back byte for byte.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, mix64
from .common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TOP, ALPHA, SEED = 3, 0.5, 1
#: Characters to a batch (a longer text has its own), and of words whose lattices are held for the batches after.
BATCH_CHARS, MOST_KNOWN = 1 << 17, 3 << 18
_WORDS = re.compile(r"\n| *[^ \n]+| +")
_BLANK, _LITERAL = 0x2581, 0x110000


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes, alpha: float) -> Vocabulary:
    """One for all tasks of a worker process."""
    return Vocabulary(model, alpha)


class Vocabulary:
    """Pieces, a trie of them, their weights, and the tokens of single bytes, of a SentencePiece model."""

    def __init__(self, model: bytes, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bytes_of = np.zeros(256, np.int64)
        kept, texts = [], [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(p[3:5], 16)] = i
                texts[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "▁" in p.lstrip("▁") or "\n" in p:
                    raise ValueError("pieces cross words")
                kept.append((i, p))
                texts[i] = p.replace("▁", " ").encode()
        first = min(i for i, _ in kept)
        self.longest = max(len(p) for _, p in kept)
        self.ids = np.array([i for i, _ in kept], np.int32)
        self.weight = -alpha * np.log(self.ids - first + 2.0)
        self.byte_weight = -alpha * np.log(n - first + 2.0)
        self._plant([p for _, p in kept])
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def _plant(self, pieces: list[str]) -> None:
        """A trie of the pieces as a double array: from the node at slot s, character c leads to slot base[s] + code[c] if
        owner[] names s there; piece[] is the piece that a slot ends, or -1."""
        frequent = Counter(c for p in pieces for c in p).most_common()
        code = {c: i for i, (c, _) in enumerate(frequent, 1)}
        points = np.array([ord(c) for c in code])
        self.code = np.zeros(_LITERAL + 1, np.int32)  # 0: in no piece
        self.code[points] = np.arange(1, len(points) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                to = children[node].setdefault(code[c], len(ends))
                if to == len(ends):
                    children.append({})
                    ends.append(-1)
                node = to
            if ends[node] >= 0:
                raise ValueError("two pieces are the same")
            ends[node] = i
        free = np.ones(2 * len(ends) + 4 * len(code), bool)
        free[0] = False
        slot_of, base_of = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        at, width = 1, 0
        for node in sorted((i for i, c in enumerate(children) if len(c) > 1), key=lambda i: -len(children[i])):  # the widest first
            own = np.array(sorted(children[node]))
            if len(own) != width:
                at, width = 1, len(own)
            at = max(at, int(own[0]))
            while True:
                if at + 512 + own[-1] - own[0] >= len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                tries = at + np.flatnonzero(free[at : at + 512])
                for step in (own - own[0])[1:].tolist():
                    tries = tries[free[tries + step]]
                if len(tries):
                    at = int(tries[0])
                    break
                at += 512
            base_of[node] = at - own[0]
            slots = base_of[node] + own
            free[slots] = False
            slot_of[[children[node][c] for c in own.tolist()]] = slots
        # nodes with one child fill the gaps from where no base gets negative
        single = [(i, *next(iter(c.items()))) for i, c in enumerate(children) if len(c) == 1]
        if single:
            node, own, child = np.array(single).T
            gaps = len(code) + np.flatnonzero(np.concatenate([free[len(code) :], np.ones(len(single), bool)]))[: len(single)]
            base_of[node], slot_of[child] = gaps - own, gaps
        room = int(slot_of.max()) + len(code) + 2
        self.base, self.owner, self.piece = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        self.base[slot_of] = base_of
        self.piece[slot_of] = ends
        for node, own in enumerate(children):
            if own:
                self.owner[slot_of[list(own.values())]] = slot_of[node]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids, without the blank before the text."""
        size = self.sizes[ids]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[ids], size)
        return self.text[at].tobytes()[1:]


def _ranked(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the earlier and over the later edges of each edge's character, free of what other characters hold."""
    size = np.diff(first)
    before, after = np.zeros(len(values)), np.zeros(len(values))
    open_ = np.flatnonzero(size > 1)
    for r in range(1, int(size.max(initial=0))):
        open_ = open_[size[open_] > r]
        up, down = first[open_] + r, first[open_ + 1] - 1 - r
        before[up] = before[up - 1] + values[up - 1]
        after[down] = after[down + 1] + values[down + 1]
    return before, after


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.empty(max(n, len(self.room) * 5 // 4), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = values
        self.n = n

    def __call__(self) -> np.ndarray:
        return self.room[: self.n]


class Lattices:
    """The pieces that start at each character of words, and their conditional probabilities. Words stay known, since most
    come again, until MOST_KNOWN characters are held; what a word's lattice holds doesn't depend on other words."""

    #: By character: where its word ends, its first edge.
    CHARS = {"end": np.int32, "first": np.int32}
    #: By edge: its character, characters, tokens, first token, log-probability, that of all other edges of the character,
    #: and the summed probability up to it.
    EDGES = {"start": np.int32, "size": np.int8, "tokens": np.int8, "first_id": np.int32, "log_p": np.float64, "other": np.float64, "ladder": np.float64}

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.columns = {name: _Column(t) for name, t in {**self.CHARS, **self.EDGES, "starts": np.int32, "ids": np.int32}.items()}
        self.clear()

    def clear(self) -> None:
        # a counter, not the index's own length: a cycle would keep each cleared index until the garbage collector happens on it
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        for column in self.columns.values():
            column.n = 0
        self.columns["first"].add(np.zeros(1, np.int32))
        self._show()

    def _show(self) -> None:
        for name, column in self.columns.items():
            setattr(self, name, column())

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, and where each text's begin (one more than texts)."""
        if self.columns["end"].n > MOST_KNOWN:
            self.clear()
        index = self.index
        known, out, counts = len(index), [], []
        for t in texts:
            own = _WORDS.findall(f" {t}") if t else []
            out += map(index.__getitem__, own)
            counts.append(len(own))
        if len(index) > known:
            self._learn(list(itertools.islice(index, known, None)))
        return np.array(out, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        v = self.v
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(raw == 32, _BLANK, np.where(raw == _BLANK, _LITERAL, raw))
        n = len(points)
        lens = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lens) - lens
        left = np.repeat(starts + lens, lens) - np.arange(n)
        code = v.code[points]
        found = []
        i, slot = np.arange(n), np.zeros(n, np.int32)
        for k in range(1, v.longest + 1):  # only from where the last k - 1 characters begin a piece
            to = v.base[slot] + code[i + (k - 1)]
            on = np.flatnonzero(v.owner[to] == slot)
            i, slot = i[on], to[on]
            whole = v.piece[slot]
            hit = np.flatnonzero(whole >= 0)
            found.append((k, i[hit], whole[hit]))
            longer = np.flatnonzero(left[i] > k)
            i, slot = i[longer], slot[longer]
            if not len(i):
                break
        single = np.zeros(n, bool)
        single[found[0][1]] = True
        rest = np.flatnonzero(~single)
        count = np.bincount(rest, minlength=n)
        for _, i, _ in found:
            count[i] += 1
        # by start, a start's longer pieces first: they are the likelier ones, and so drawn after fewer steps
        first = np.concatenate([[0], np.cumsum(count)])
        start, free = np.repeat(np.arange(n), count), first[:-1].copy()
        size, place = np.ones(len(start), np.int8), np.full(len(start), -1, np.int32)
        for k, i, whole in reversed(found):
            at = free[i]
            size[at], place[at] = k, whole
            free[i] += 1
        tokens = np.ones(len(start), np.int8)
        tokens[free[rest]] = 1 + (raw[rest] >= 0x80) + (raw[rest] >= 0x800) + (raw[rest] >= 0x10000)
        weight = np.where(place >= 0, v.weight[place], tokens * v.byte_weight)
        first_id = np.cumsum(tokens, dtype=np.int64) - tokens
        ids = np.empty(int(tokens.sum()), np.int32)
        known = place >= 0
        ids[first_id[known]] = v.ids[place[known]]
        bare = np.flatnonzero(~known)
        for j in range(4):
            more = bare[tokens[bare] > j]
            ids[first_id[more] + j] = v.bytes_of[_utf8_byte(raw[start[more]], tokens[more], j)]
        # summed weight of all ways from each character to its word's end, from the end backwards; a word's end has none
        to = start + size
        ahead = np.zeros(n + 1)
        away = left[start]
        last = size == away
        by = np.argsort(away.astype(np.int16) if away.max() < 1 << 15 else away, kind="stable")  # 16 bits: by radix
        cuts = np.searchsorted(away[by], np.arange(1, int(away.max()) + 2))
        ordered, goal, cost = start[by], np.where(last, n, to)[by], weight[by]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                begins = np.flatnonzero(new[a:b])
                ahead[ordered[a:b][begins]] = np.logaddexp.reduceat(cost[a:b] + ahead[goal[a:b]], begins)
        log_p = np.minimum(weight + np.where(last, 0.0, ahead[to]) - ahead[start], 0.0)
        p = np.exp(log_p)
        before, after = _ranked(first, p)
        ladder = before + p
        ladder[first[1:] - 1] = 1.0
        beside = before + after
        other = np.log(beside, where=beside > 0, out=np.full(len(p), -np.inf))
        chars, edges, held = self.columns["end"].n, self.columns["start"].n, self.columns["ids"].n
        made = {"end": left + np.arange(chars, chars + n), "first": first[1:] + edges, "start": start + chars, "size": size, "tokens": tokens, "first_id": first_id + held, "log_p": log_p, "other": other, "ladder": ladder, "starts": starts + chars, "ids": ids}
        for name, values in made.items():
            self.columns[name].add(values)
        self._show()

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[node].astype(np.int64)
        wait = np.flatnonzero(u > self.ladder[e])
        while len(wait):
            e[wait] += 1
            wait = wait[u[wait] > self.ladder[e[wait]]]
        return e


def _utf8_byte(c: np.ndarray, size: np.ndarray, j: int) -> np.ndarray:
    c = c.astype(np.int64)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    tail = 6 * (size - 1 - j)
    return np.where(j == 0, lead | (c >> tail), 0x80 | ((c >> tail) & 0x3F))


def _place(key: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    return mix64(key + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from the high bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(key: np.ndarray, what: int, place: int = 0) -> np.ndarray:
    return _unit(_place(mix64(key ^ np.uint64(what)), place))


class _Walk:
    """Paths through the words of several texts, sampled onwards from given places."""

    def __init__(self, lat: Lattices, words: np.ndarray, begin: np.ndarray, keys: np.ndarray) -> None:
        self.lat, self.words, self.begin, self.keys = lat, words, begin, keys
        self.text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))

    def onwards(self, occ: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """The edges from node to the end of each occurrence's word, in order, and their occurrence's place in occ."""
        lat, end = self.lat, self.lat.end
        text = self.text[occ]
        key = _place(mix64(self.keys ^ np.uint64(sample + 1))[text], occ - self.begin[text])
        at, live, step = node.copy(), np.arange(len(occ)), 0
        edges, owners, steps = [], [], []
        while len(live):
            u = _unit(_place(key[live], step))
            e = lat.draw(at[live], u)
            edges.append(e)
            owners.append(live)
            steps.append(np.full(len(e), step))
            to = at[live] + lat.size[e]
            more = to < end[at[live]]
            at[live] = to
            live = live[more]
            step += 1
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e, o, s = np.concatenate(edges), np.concatenate(owners), np.concatenate(steps)
        count = np.bincount(o, minlength=len(occ))
        place = (np.cumsum(count) - count)[o] + s
        out, own = np.empty(len(e), np.int64), np.empty(len(e), np.int64)
        out[place], own[place] = e, o
        return out, own


def _beside(lat: Lattices, edges: np.ndarray, at: int) -> np.ndarray:
    """The probability, of all ways that share the first `at` edges, of leaving the path at each place from there on. It ends
    where all that is left is too small to change the sum."""
    size = 128
    while True:
        part = edges[at : at + size]
        own = lat.log_p[part]
        total = np.cumsum(own)
        mass = np.exp(total - own + lat.other[part])
        if at + size >= len(edges) or total[-1] < -40 and np.exp(total[-1]) < 1e-17 * mass.sum():
            return mass
        size *= 8


def top_k(texts: list[str], keys: list[int], lat: Lattices, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k different segmentations: ids, log-probability, perturbed value, log inclusion score."""
    words, begin = lat.numbers(texts)
    n = len(texts)
    key = mix64(np.array(keys, np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    walk = _Walk(lat, words, begin, key)
    root = -np.log(-np.log(_uniform(key, 1 << 20)))
    edges, own = walk.onwards(np.arange(len(words)), lat.starts[words].astype(np.int64), 0)
    bounds = np.searchsorted(own, begin)
    # ways[d][j]: edges and words (within the text) of the j-th sample of text d
    ways = [[(edges[a:b], own[a:b] - o)] for a, b, o in zip(bounds, bounds[1:], begin, strict=False)]
    values = [[float(g)] for g in root]
    # what waits: value, path, place, log-probability up to it, masses beside the path from there on, (place, edge) taken
    queue: list[list[tuple]] = [[] for _ in range(n)]

    def wait(d: int, noise: float, bound: float, parent: int, at: int, before: float, mass: np.ndarray, out: tuple) -> None:
        total = float(mass.sum())
        if total > 0:  # the largest value below the bound; the bound keeps the order of unbounded values
            queue[d].append((float(-np.logaddexp(-bound, math.log(-math.log(noise)) - before - math.log(total))), parent, at, before, mass, out))

    for d, u in enumerate(_uniform(key, 1 << 21).tolist()):
        wait(d, u, values[d][0], 0, 0, 0.0, _beside(lat, ways[d][0][0], 0), ())
    for j in range(1, k):
        u_place, u_edge, u_rest, u_own = (_uniform(key, (1 << 22) + q, j).tolist() for q in range(4))
        going, heads, o_all, node_all, o_bounds = [], [], [], [], [0]
        for d in range(n):
            if not queue[d]:
                continue
            g, parent, at, before, mass, out = queue[d].pop(max(range(len(queue[d])), key=lambda i: queue[d][i][0]))
            e, o = ways[d][parent]
            total = np.cumsum(mass)
            place = int(np.searchsorted(total, u_place[d] * total[-1], side="right"))
            if place == len(total):
                place = int(np.flatnonzero(mass)[-1])
            t = at + place
            node = int(lat.start[e[t]])
            taken = {e[t], *(x for q, x in out if q == t)}
            options = [x for x in range(int(lat.first[node]), int(lat.first[node + 1])) if x not in taken]
            p = np.exp(lat.log_p[options])
            chosen = min(int(np.searchsorted(np.cumsum(p), u_edge[d] * p.sum())), len(options) - 1)
            pick = options[chosen]
            inner = float(lat.log_p[e[at:t]].sum())
            mass = mass.copy()
            mass[place] = math.exp(inner) * np.delete(p, chosen).sum()
            wait(d, u_rest[d], g, parent, at, before, mass, (*out, (t, pick)))
            values[d].append(g)
            going.append(d)
            heads.append((e[:t], o[:t], pick, int(o[t]), before + inner + float(lat.log_p[pick])))
            first = begin[d] + int(o[t])
            to = node + int(lat.size[pick])
            inside = to < int(lat.end[node])
            later = np.arange(first + 1, begin[d + 1])
            o_all.append(np.concatenate([[first], later]) if inside else later)
            node_all.append(np.concatenate([[to], lat.starts[words[later]]]) if inside else lat.starts[words[later]])
            o_bounds.append(o_bounds[-1] + len(o_all[-1]))
        if not going:
            break
        occs = np.concatenate(o_all)
        edges, own = walk.onwards(occs, np.concatenate(node_all).astype(np.int64), j)
        marks = np.searchsorted(own, o_bounds)
        local = occs[own] if len(own) else own
        for d, (he, ho, pick, po, before), a, b in zip(going, heads, marks, marks[1:], strict=False):
            e = np.concatenate([he, [pick], edges[a:b]])
            ways[d].append((e, np.concatenate([ho, [po], local[a:b] - begin[d]])))
            wait(d, u_own[d], values[d][-1], j, len(he) + 1, before, _beside(lat, e, len(he) + 1), ())
    every = np.concatenate([e for w in ways for e, _ in w] or [np.zeros(0, np.int64)])
    size = lat.tokens[every].astype(np.int64)
    ends = np.cumsum(size)
    ids = lat.ids[np.arange(int(size.sum())) + np.repeat(lat.first_id[every] - (ends - size), size)]
    log_p = lat.log_p[every]
    out, a, b = [], 0, 0
    for d in range(n):
        kappa = max((q[0] for q in queue[d]), default=-np.inf)
        rows = []
        for (e, _), g in zip(ways[d], values[d], strict=True):
            phi = float(log_p[a : a + len(e)].sum())
            a += len(e)
            to = int(ends[a - 1]) if a else 0
            inclusion = 0.0 if kappa == -np.inf else float(np.log(-np.expm1(-np.exp(min(phi - kappa, 30.0))))) if phi - kappa > -30 else phi - kappa
            rows.append((ids[b:to], phi, g, inclusion))
            b = to
        out.append(rows)
    return out


COLUMNS = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double"


def sample_segmentations(docs: DataFrame, model: str | bytes = MODEL, k: int = TOP, alpha: float = ALPHA, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Rows (doc_id, sample from 0, ...) with the token ids; with digest, the SHA-256 of the ids as 32-bit numbers and of the
    text decoded from them, in their place."""
    proto = model if isinstance(model, bytes) else open(model, "rb").read()  # half a MB, read once on the driver
    names = [c.split()[0] for c in COLUMNS.split(", ")] + (["ids_sha256", "decoded_sha256"] if digest else ["ids"])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()] + ([pa.string()] * 2 if digest else [pa.list_(pa.int32())])

    def run(batches):
        v = vocabulary(proto, alpha)
        lat = Lattices(v)
        for b in batches:
            lens = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(lens, (lens[lo - 1] if lo else 0) + BATCH_CHARS, side="right")))
                part = b.slice(lo, hi - lo)
                ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for i, got in zip(ids, top_k(texts, [NULL_ID if i is None else i for i in ids], lat, k, seed), strict=True):
                    for j, (token, phi, g, inclusion) in enumerate(got):
                        last = [hashlib.sha256(token.tobytes()).hexdigest(), hashlib.sha256(v.decode(token)).hexdigest()] if digest else [token]
                        rows.append([i, j, len(token), phi, g, inclusion, *last])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                lo = hi
        del lat
        lean()

    tail = ", ids_sha256 string, decoded_sha256 string" if digest else ", ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS + tail)


def decode(encoded: DataFrame, model: str | bytes = MODEL, name: str = "text") -> DataFrame:
    """encoded with the text of its ids, in the column called name; a column that already has this name is replaced."""
    proto = model if isinstance(model, bytes) else open(model, "rb").read()
    kept = [c for c in encoded.columns if c != name]

    def run(batches):
        v = vocabulary(proto, ALPHA)
        for b in batches:
            texts = [v.decode(np.array(x or [], np.int64)).decode("utf-8") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, name])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.select(*kept).mapInArrow(run, f"{fields}, `{name}` string")
