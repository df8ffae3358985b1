"""Exact Jaccard self-join on sets of word shingles, as a size-aware heavy-light join, and its connected classes.

Words are what `[^\\x20\\x09-\\x0D]+` matches after A-Z are lower-cased; a set holds the distinct 5-word shingles; with fewer
words, the whole sequence; without words it is empty and links with nothing. Two sets link at 100 * overlap >= 80 * union.
A set stands for all documents that have it. A null text counts as empty, a null doc_id is kept, repeated rows are copies.

1. Blocks send their elements to shards and learn of how many documents each is. In the order from rare to frequent, two sets
   that link share one of the first n - ceil(0.8 n) + 1 elements of each (the prefix); elements of one document alone are on
   no list, so a document in which they fill the prefix has no partner.
2. Small sets send their subsets of the fixed size that any two linked small sets share; larger ones send the elements of
   their prefix, to be scanned as inverted lists. The boundary is where the number of subsets passes what scanning costs.
3. In each list the members are held against one pivot, and linked sets become one class; lists that still hold several
   classes get new pivots, and at last all pairs between different classes of a list are held against each other.
4. The links of a set lie within its class, where parts of bounded size are held against each other to count them.

Shingles are compared as 64-bit hashes (overlaps by their high 48 bits), sets of equal texts as 128 bits, without a look at the
words: a false link takes a chance collision. Texts of any length go whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import COUNTED, NULL_ID, Blocks, count_keys, deltas, expand, mix64, narrow, powers, rows_of, shard_slices, span_hashes, unpack, widen
from .common import bucketed, written

SHINGLE = 5
#: 64-bit words of a set's parities.
CELLS = 8
#: Rounds of pivots before all that is left is compared.
ROUNDS = 3
#: Small sets have at most so many elements, whatever the costs.
MOST_SMALL = 14
#: So many of a set's lists show whether a pair was met before; elements of sets to a part of a class. Neither changes results.
FIRST_LISTS, PART_ELEMENTS = 8, 1 << 18
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


_STEP = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def word_hashes(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie end to end, and its text's place."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = starts[:-1][starts[:-1] < len(raw)]
    begins[first] = word[first]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = starts[1:] - 1
    last = last[last >= 0]
    ends[last] = word[last]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return mix64(span_hashes(raw, b, e) + (e - b).astype(np.uint64)), np.searchsorted(starts, b, side="right") - 1


def shingle_sets(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more than texts)."""
    words, doc = word_hashes(data, starts)
    n = len(starts) - 1
    counts = np.bincount(doc, minlength=n)
    ends = np.cumsum(counts)
    m = len(words) - SHINGLE + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for j in range(SHINGLE):
            h += words[j : j + m] * _STEP[j]
        whole = doc[:m] == doc[SHINGLE - 1 :]
        h, d = mix64(h[whole]), doc[:m][whole]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(SHINGLE - 1):
            has = counts[few] > j
            short[has] += words[ends[few[has]] - counts[few[has]] + j] * _STEP[j]
        h, d = np.concatenate([h, mix64(short + counts[few].astype(np.uint64))]), np.concatenate([d, few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Elements that a set of n shares with any partner: 80 of 100 of the larger set, at least of its own."""
    return (4 * n + 4) // 5


def _requests(blocks: Blocks) -> DataFrame:
    bits, shards = blocks.key_bits, blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            _, starts, data = unpack(row)
            h, bounds = shingle_sets(data, starts)
            keys, counts = np.unique(h >> np.uint64(64 - bits), return_counts=True)
            out = [(s, row["block"], deltas(keys[a:b]), narrow(counts[a:b] - 1)) for s, a, b in shard_slices(keys, bits, shards)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "keys", "more"])

    return blocks.table.mapInArrow(run, "shard int, block long, keys binary, more binary")


def subset_sizes(n: int, small: int) -> list[int]:
    """Sizes of the common subsets of a small set of n and any small partner."""
    return sorted({c for m in range(n, min(small, n * 5 // 4) + 1) if (c := -(-4 * m // 5)) <= n})


def boundary(mean_list: float) -> int:
    """The largest set for which sending subsets costs no more than scanning the lists of a prefix."""
    small = 0
    for n in range(1, MOST_SMALL + 1):
        if sum(math.comb(n, c) for c in subset_sizes(n, n * 5 // 4)) > (n - -(-4 * n // 5) + 1) * max(1.0, mean_list):
            break
        small = n
    return small


def parities(h: np.ndarray) -> list[int]:
    """For each of 512 cells whether an odd number of elements falls in it, as eight numbers. Two sets differ in as many
    elements at least as their cells differ in number."""
    odd = np.bincount((mix64(h) & np.uint64(64 * CELLS - 1)).astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _may_link(a: str, b: str, n: str, m: str):
    """Whether the cells allow 100 * overlap >= 80 * union: linked sets differ in at most a ninth of their summed sizes."""
    x, y = F.col(a), F.col(b)
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, CELLS)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return differ * 9 <= F.col(n) + F.col(m)


def _lists(h: np.ndarray, more: np.ndarray, small: int) -> np.ndarray:
    """The lists that a set is on. more: of how many other documents each element is."""
    n = len(h)
    first = np.lexsort((h, more))[: n - int(least_overlap(np.array([n]))[0]) + 1]
    first = first[more[first] > 0]
    if not len(first):
        return h[first]
    out = []
    if n <= small:
        for c in subset_sizes(n, small):
            salt = np.uint64(0xA24BAED4963EE407 * c % (1 << 64))
            picks = np.array(list(itertools.combinations(range(n), c)))
            out.append(mix64(mix64(h)[picks].sum(axis=1, dtype=np.uint64) + salt))
    if n >= least_overlap(np.array([small + 1]))[0]:
        out.append(h[first])
    return np.unique(np.concatenate(out))


_SETS = "doc_id long, n_shingles long, sid string, set binary, lists array<long>, sketch array<long>"


def _documents(blocks: Blocks, answers: DataFrame, small: int) -> DataFrame:
    """A row for each document; set and lists only for the block's first of those that may have a partner."""
    bits, shards = blocks.key_bits, blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            ids, starts, data = unpack(row)
            h, bounds = shingle_sets(data, starts)
            keys, place = np.unique(h >> np.uint64(64 - bits), return_inverse=True)
            got = np.zeros(len(keys), np.int64)
            said = {a["shard"]: a["more"] for a in row["answers"] or []}
            for s, a, b in shard_slices(keys, bits, shards):
                got[a:b] = widen(expand(said[s]))
            more = got[place]
            n = np.diff(bounds)
            alone = np.diff(np.concatenate([[0], np.cumsum(more == 0)])[bounds])
            sids, sets, lists, sketches, seen = [None] * len(n), [None] * len(n), [None] * len(n), [None] * len(n), set()
            for i in np.flatnonzero((n > 0) & (alone <= n - least_overlap(n))):
                own = h[bounds[i] : bounds[i + 1]]
                weight = powers(0x2545F4914F6CDD1D, len(own))
                sid = f"{int((own * weight).sum(dtype=np.uint64)):016x}{int((mix64(own) * weight).sum(dtype=np.uint64)):016x}"
                sids[i] = sid
                if sid not in seen:
                    seen.add(sid)
                    on = _lists(own, more[bounds[i] : bounds[i + 1]], small)
                    sets[i], lists[i] = np.ascontiguousarray((own >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), on.view(np.int64).tolist()
                    sketches[i] = parities(own)
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sids, pa.string()), pa.array(sets, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "sid", "set", "lists", "sketch"])

    return blocks.with_answers(answers.select("block", "shard", "more")).mapInArrow(run, _SETS)


def _elements(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. sets is bucketed by id, so it isn't dealt again. Pairs of one a are dealt over several
    tasks, each with its own copy of a's set."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("_a").to_pylist(), batch.column("_b").to_pylist()
            keep, known = [], {}
            for x, y in zip(a, b, strict=True):
                if x not in known:
                    known = {x: _elements(x)}
                u, v = known[x], _elements(y)
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    of = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"_{c}"))
    firsts = dealt.select("a", "_salt").distinct().join(of("a").hint("merge"), "a")
    return dealt.join(firsts.hint("merge"), ["a", "_salt"]).join(of("b").hint("merge"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def classes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, root) of the connected classes of edges (a, b). names: id, least. A label is a set's least doc_id and its id; the
    least label spreads, and labels' labels shorten the way, so a class's least doc_id comes without a join by class."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    own = both.select(F.col("a").alias("id")).distinct().join(names, "id")
    label = written(own.select(F.col("id").alias("node"), F.struct("least", "id").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near.select(F.col("a").alias("node"), "m"), "node", "left").select("node", "root", F.least("root", "m").alias("m"))
        step = step.withColumn("_m", F.col("m.id"))
        hop = step.join(label.select(F.col("node").alias("_m"), F.col("root").alias("r")), "_m", "left")
        new = written(hop.select("node", F.least("m", "r").alias("new"), "root"))
        if new.where("new <> root").isEmpty():
            return new.select("node", "root")
        label = new.select("node", F.col("new").alias("root"))


def _near_size(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def _linked_sets(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(node, root) of all sets that link with another. sets: id, n, set, lists, sketch; names: id, least."""
    posts = sets.select("id", "n", F.explode("lists").alias("list"))
    shared = posts.groupBy("list").agg(F.count("*").alias("_m")).where("_m > 1").select("list")
    posts = written(posts.join(shared, "list"))
    edges, root = None, None
    for r in range(ROUNDS + 1):
        known = None if root is None else root.select(F.col("node").alias("id"), F.col("root.id").alias("root"))
        at = posts.withColumn("root", F.col("id")) if known is None else posts.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        if r < ROUNDS:
            pivot = F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), F.col("id").alias("p"), F.col("n").alias("pn"), F.col("root").alias("proot")))
            lists = at.groupBy("list").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), pivot.alias("_p")).where("_lo <> _hi")
            pairs = at.join(lists.select("list", "_p.p", "_p.pn", "_p.proot"), "list").where((F.col("root") != F.col("proot")) & _near_size("n", "pn"))
            pairs = pairs.select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
        else:
            pairs = _rest(at, sets)
        pairs = written(pairs)
        if pairs.isEmpty():  # another pivot, or the last round, may still offer some
            continue
        found = written(_verified(pairs, sets))
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        root = classes(edges, names)
    return root if root is not None else sets.sparkSession.createDataFrame([], "node long, root struct<least:long,id:long>")


def _rest(at: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different classes that share a list. In each list the members outside its largest class meet all others;
    their parities rule out, exactly, most pairs that don't link. A pair that shares many lists leaves few of them: none
    where the two sets' first lists that are left show a lesser one in common, so that the least is never passed over."""
    sizes = at.groupBy("list", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("list").agg(F.max(F.struct("m", "root")).alias("_main"), F.count("*").alias("k")).where("k > 1").select("list", F.col("_main.root").alias("main"))
    left = written(at.join(main, "list"))
    firsts = left.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("list")), 1, FIRST_LISTS).alias("firsts"))
    rows = written(left.join(firsts, "id").join(sets.select("id", "sketch"), "id"))
    other = rows.select("list", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("root").alias("proot"), F.col("sketch").alias("psketch"), F.col("firsts").alias("pfirsts"))
    once = (F.col("proot") == F.col("main")) | (F.col("id") < F.col("p"))
    least = F.array_min(F.array_intersect("firsts", "pfirsts"))
    pairs = rows.where("root <> main").join(other, "list").where(once & (F.col("root") != F.col("proot")) & _near_size("n", "pn") & _may_link("sketch", "psketch", "n", "pn") & F.coalesce(least >= F.col("list"), F.lit(True)))
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _count_part(table: pa.Table) -> pa.Table:
    """Of how many documents, in the other part, each set of two parts of a class links with (within one part: all others)."""
    sets = [_elements(x) for x in table.column("set").to_pylist()]
    n = np.array([len(s) for s in sets])
    weight, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
    every = np.concatenate(sets)
    names, place, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # an element of one set alone is in no overlap
    where = np.full(len(names), -1)
    where[shared] = np.arange(len(shared))
    bits = np.zeros((len(sets), -(-max(len(shared), 1) // 64) * 64 // 8), np.uint8)
    owner, cell = np.repeat(np.arange(len(sets)), n), where[place]
    owner, cell = owner[cell >= 0], cell[cell >= 0]
    np.bitwise_or.at(bits, (owner, cell >> 3), (1 << (cell & 7)).astype(np.uint8))
    rows = bits.view(np.uint64)
    halves = table.column("first").to_numpy() != table.column("second").to_numpy()
    links = np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        against = np.flatnonzero((side != side[i]) if halves[0] else np.arange(len(sets)) != i)
        against = against[(n[against] * 5 >= n[i] * 4) & (n[i] * 5 >= n[against] * 4)]
        both = np.bitwise_count(rows[against] & rows[i]).sum(axis=1, dtype=np.int64)
        links[i] = weight[against[100 * both >= 80 * (n[against] + n[i] - both)]].sum()
    return pa.table({"id": table.column("id"), "links": pa.array(links, pa.int64())})


def _count_links(sets: DataFrame, names: DataFrame, root: DataFrame) -> DataFrame:
    """(id, links): with how many documents of other sets each set links. All links of a set lie within its class, so a class
    is dealt in parts of about PART_ELEMENTS elements, and two parts at a time are held against each other as rows of bits; no
    pair is written. A class of one part is sent once, one of c parts c times."""
    of = root.select(F.col("node").alias("id"), F.col("root.id").alias("root"))
    parts = sets.select("id", "n").join(of, "id").groupBy("root").agg(F.ceil(F.sum("n") / PART_ELEMENTS).alias("parts")).where("parts > 1")
    rows = sets.select("id", "set").join(of, "id").join(names.select("id", "copies"), "id").join(parts, "root", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_other"))
    rows = rows.select("id", "set", "copies", "root", F.least("_own", "_other").alias("first"), F.greatest("_own", "_other").alias("second"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))
    return rows.groupBy("root", "first", "second").applyInArrow(_count_part, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; with count_links, n_links too: how many other documents it links
    with."""
    blocks = Blocks(docs)
    answers = written(_requests(blocks).groupBy("shard").applyInArrow(count_keys, COUNTED))
    cost = answers.agg(F.sum("square"), F.sum("sum")).first()
    rows = written(_documents(blocks, answers, boundary(cost[0] / cost[1] if cost[1] else 1.0)))
    some = lambda c, name: F.first(c, ignorenulls=True).alias(name)
    sets = rows.where("sid is not null").groupBy("sid").agg(some("n_shingles", "n"), some("set", "set"), some("lists", "lists"), some("sketch", "sketch"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = bucketed(sets.withColumn("id", F.monotonically_increasing_id()), "id")
    names = sets.select("id", "least", "copies")
    root = _linked_sets(sets, names)
    named = sets.select("sid", "id", "least", "copies").join(root.withColumnRenamed("node", "id"), "id", "left")
    if count_links:
        named = named.join(_count_links(sets, names, root), "id", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    copies = written(named.select("sid", F.coalesce("root.least", "least").alias("component"), *(["n_links"] if count_links else [])))
    out = rows.select("doc_id", "n_shingles", "sid").join(copies, "sid", "left")
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), "n_shingles", null(F.coalesce("component", "doc_id")).alias("component_id"), *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []))
