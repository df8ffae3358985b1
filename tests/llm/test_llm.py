"""The operators of deltagrove.llm: edge cases, and plain-Python versions of what they compute."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltagrove.llm import blocks, chat, fingerprints, jaccard, media, mixing, pieces, quality, queries, suffixes, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size string, block int, _score double, root string"


def document_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    passage = text(80)
    texts = [None, "", " \t\n", "one", "One two  three", "one two three", "a b c d e", "a b c d e f", base, base, " ".join(near), base.upper(), text(30) + " " + passage + " " + text(30), passage, text(20) + " " + passage, "é" * 300, text(20_000), "x" * 5_000, "<b> \\### é ü", "Ａｂｃ ﬁ", "abc fi"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], None, "clash", 1, 0.5, "r") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, base, "en", "s1", 1, None, None, None, None), (100, base, "en", "s1", 1, None, None, None, None), (200, text(50), None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


# -- 1 fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_report(docs.select("doc_id", "text")).collect()
    rows = sorted(((r[0], r[1] or "") for r in document_rows()), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert len(got) == len(rows)
    edited = {}
    for i, (d, t) in enumerate(rows):
        n, nxt = len(t), rows[(i + 1) % len(rows)][1]
        edited.setdefault(d, []).append(hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest())
    for r in got:
        assert r.edited_sha256 in edited[r.doc_id]
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint)
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[5].fingerprint == fp_of(got, 5) and by[8].fingerprint == by[9].fingerprint == by[11].fingerprint
    assert by[19].fingerprint == by[20].fingerprint and by[0].fingerprint == by[1].fingerprint == by[2].fingerprint
    assert by[8].fingerprint != by[10].fingerprint and by[8].near_next == 1.0
    assert fingerprints.fingerprint_report(empty.select("doc_id", "text")).count() == 0
    assert fingerprints.fingerprint(docs).count() == len(rows)


def fp_of(rows, doc):
    return next(r.fingerprint for r in rows if r.doc_id == doc)


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.substring(c, 1, 1))
    rows = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")], "doc_id long, text string")
    got = {r.row.doc_id: r.fingerprint for r in fingerprints.fingerprint(rows).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


# -- 2 quality -------------------------------------------------------------------------------------------------------------


def _kneser_ney(good: list[bytes]):
    gram = lambda t: [(b"\0" * 4 + t)[i : i + 5] for i in range(len(t))]
    counts = {5: Counter(g for t in good for g in gram(t))}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    offs, total = {}, {n: defaultdict(lambda: [0, 0.0]) for n in counts}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0.0
        offs[n] = [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.0), i) if k[i] else 0.0 for i in (1, 2, 3)]
        for g, m in c.items():
            total[n][g[:-1]][0] += m
            total[n][g[:-1]][1] += offs[n][min(m, 3) - 1]

    def p(g):
        n = len(g)
        low = 1 / 256 if n == 1 else p(g[1:])
        if g[:-1] not in total[n]:
            return low
        m, off = total[n][g[:-1]]
        c = counts[n].get(g, 0)
        return (max(c - (offs[n][min(c, 3) - 1] if c else 0), 0) + off * low) / m

    return lambda t: math.exp(-sum(math.log(p(g)) for g in gram(t)) / len(t)) if t else None


def test_quality(docs, empty, labels):
    good = {i for i in range(15) if i % 2}
    model = _kneser_ney([(r[1] or "").encode() for r in document_rows() if r[0] in good])
    got = quality.quality_report(docs, labels).collect()
    texts = defaultdict(list)
    for r in document_rows():
        texts[r[0]].append((r[1] or "").encode())
    assert len(got) == len(document_rows())
    for r in got:
        t = texts[r.doc_id][0]
        if len(t) < 5_000:
            want = model(t)
            assert (r.perplexity is None and not r.good) if want is None else r.perplexity == pytest.approx(want, rel=3e-3)
        assert r.perplexity is None or r.good == (r.perplexity <= r.threshold)
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(docs, labels.limit(0)).where("perplexity is not null").agg(F.min("perplexity")).first()[0] == pytest.approx(256, rel=1e-3)


@pytest.mark.parametrize("accuracy", [12, 10_000])
def test_quantiles_are_exact(spark, accuracy, monkeypatch):
    monkeypatch.setattr(quality, "ACCURACY", accuracy)
    rng = random.Random(4)
    rows = [(f"k{i % 3}", rng.choice([1.0, 2.0, rng.random() * 5, None])) for i in range(900)] + [("one", 7.0), ("none", None)]
    got = {r.k: r.threshold for r in quality.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", 0.9).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = own[max(1, math.ceil(len(own) * 0.9)) - 1] if own else None
    assert got == want


# -- 3 mixing --------------------------------------------------------------------------------------------------------------


def test_mixing(docs, empty, spark):
    rows = mixing.plan_mix(docs).select("doc_id", "_size", "_source_size", "_target", "_taken").collect()
    assert len(rows) == len(document_rows())
    again = mixing.plan_mix(docs.repartition(5)).select("doc_id", "_size", "_source_size", "_target", "_taken").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    total = sum(r._size for r in rows)
    targets = {r._source_size: r._target for r in rows}
    assert sum(targets.values()) == pytest.approx(total)
    for size, target in targets.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r._taken for r in rows if r._source_size == size) - target) <= 1
    assert all(r._taken <= 3 * r._size for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r._taken for r in rows)
    assert {r._size for r in mixed.select("_size").collect()} <= {"clash", None}
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r._taken for r in mixing.plan_mix(blank).collect()] == [0, 0]


# -- 4 chat ----------------------------------------------------------------------------------------------------------------


def test_reply_tree(spark):
    nodes = [("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "c", 1.0), ("t", 5, 3, "user", "d", 1.0), ("t", 6, 5, "assistant", "e", 1.0), ("t", 7, 5, "assistant", "f", 2.0), ("u", 9, 77, "user", None, 1.0)]
    t = spark.createDataFrame(nodes, "conv_id string, node long, parent long, role string, text string, score double").fillna("", ["text"])
    _, ways = chat.paths(t)
    got = {(r.conv_id, r["rank"]): (r.leaf, r.score) for r in ways.collect()}
    assert got == {("t", 1): (7, 9.0), ("t", 2): (6, 8.0), ("t", 3): (4, 3.0), ("u", 1): (9, 1.0)}
    best = chat.read_back(chat.format_paths(t)).collect()
    turns = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in best}
    assert turns == {"t": [("user", "hi"), ("assistant", "b"), ("user", "d"), ("assistant", "f")], "u": [("user", "")]}
    assert {r.conv_id: r.loss_text for r in best} == {"t": "bf", "u": ""}


def test_reply_tree_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_ROUNDS", 2, raising=False)
    rows = [(1, 1, None, "user", "t", 1.0)] + [(1, n, n - 1 - n % 2, "user", "t", 1.0) for n in range(2, 10)]
    rows = [(c, n, None if p is None else max(1, p), r, t, s) for c, n, p, r, t, s in rows]
    _, ways = chat.paths(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"))
    kids = {p for _, _, p, *_ in rows}
    up = {n: p for _, n, p, *_ in rows}
    depth = lambda n: 0 if n is None else 1 + depth(up[n])
    assert sorted(r.score for r in ways.collect()) == sorted(float(depth(n)) for n in up if n not in kids)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "<", "</turn>", "\n", "### assistant:\n", ":", "é", "x", "$1"]
    rows = [(i % 7 or None, j if i else None, rng.choice(["user", "assistant", "a:b\\", None]), rng.choice([None, "", *("".join(rng.choices(bits, k=12)) for _ in range(3))])) for i in range(14) for j in range(4)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    want = defaultdict(list)
    for c, n, r, x in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((r or "", x or ""))
    got = chat.read_back(chat.format_paths(chat.turns_to_nodes(t))).collect()
    for r in got:
        assert [(x.role, x.text) for x in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    assert len(got) == 7 and any(r.conv_id is None for r in got)
    long = spark.createDataFrame([(None, 1, "user", "<#" * 300_000), (None, 1, "user", "<#" * 300_000)], "conv_id long, turn long, role string, text string")
    assert [[x.text for x in r.turns] for r in chat.read_back(chat.format_paths(chat.turns_to_nodes(long))).collect()] == [["<#" * 300_000] * 2]
    assert chat.format_paths(chat.turns_to_nodes(t.limit(0))).count() == 0


# -- 5 urls ----------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "anet", "org", "x.org", "example.net", "w.example.net", "", ".net", "EXAMPLE.com"]
    paths = ["", "/", "/en/", "/en", "/en/x?y", "/de/#t", "/fr/1", "?q=/en/"]
    given = [None, "", "no scheme", "http://"] + [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.net", "/en", "block"), ("net", "/en/x", "allow"), ("b.a.net", "", "block"), ("a.net", "/en", "allow"), ("x.org", "/en/", "block"), ("x.org", "/en/", "allow")]
    t = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)], "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    swept = sorted(map(tuple, urls.filter_urls(t, r).collect()))
    assert len(swept) == len(given)
    for parts in (1, 5, 300):  # one range; ranges that begin inside a rule's interval; more ranges than hosts
        assert sorted(map(tuple, urls.filter_urls(t, r, parts=parts).collect())) == swept
    assert {x[3:] for x in map(tuple, urls.filter_urls(t, r.limit(0)).collect())} == {(None, "allow")}
    for i, host, path, rule, verdict in swept:
        u = given[i]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest)[0]
        assert host == h.translate(LOWER) and path == re.match(r"[^?#]*", rest[len(h) :])[0]
        fit = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)]
        assert (rule, verdict) == (max(fit)[2:] if fit else (None, "allow"))
    assert urls.filter_urls(t.limit(0), r).count() == 0
    with pytest.raises(ValueError, match="clash"):
        urls.filter_urls(t.withColumnRenamed("page_id", "rule"), r, id_col="rule")


# -- 6 pieces --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read(), 1.0)


@pytest.fixture()
def lattices(vocabulary):
    return pieces.Lattices(vocabulary)


def all_segmentations(text, v, alpha):
    """Every way to write a text in pieces, with its probability, by plain recursion over the model's own pieces."""
    import sentencepiece

    with open(pieces.MODEL, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    known = {sp.id_to_piece(i): i for i in plain}
    cost = lambda i: (i - min(plain) + 2.0) ** -alpha
    tokens = {i: [sp.piece_to_id(f"<0x{i:02X}>")] for i in range(256)}

    def ways(word):
        if not word:
            return [((), 1.0)]
        out = []
        for k in range(1, len(word) + 1):
            piece = known.get(word[:k])
            if piece is not None:
                out += [((piece, *ids), cost(piece) * w) for ids, w in ways(word[k:])]
        if word[0] not in known:
            raw = word[0].replace("▁", " ").encode()
            own = tuple(t for b in raw for t in tokens[b])
            out += [((*own, *ids), (n - min(plain) + 2.0) ** (-alpha * len(raw)) * w) for ids, w in ways(word[1:])]
        total = sum(w for _, w in out)
        return [(ids, w) for ids, w in out] if total else []

    every = {(): 1.0}
    for word in re.findall(r"\n| *[^ \n]+| +", f" {text}"):
        own = ways(word.replace(" ", "▁"))
        total = sum(w for _, w in own)
        every = {a + ids: p * w / total for a, p in every.items() for ids, w in own}
    return every


@pytest.mark.parametrize("text", ["a", "of", "the", "ab c", "é\n1", "zz 9"])
def test_pieces_against_every_segmentation(text, lattices, vocabulary):
    """All segmentations come, with their probabilities, where k reaches their number; with fewer, the k come in the order of
    sampling without replacement, and their inclusion scores weigh what they stand for."""
    want = all_segmentations(text, vocabulary, 1.0)
    got = pieces.top_k([text], [3], lattices, len(want) + 2, 5)[0]
    assert {tuple(map(int, ids)): phi for ids, phi, _, _ in got} == {k: pytest.approx(math.log(p), abs=1e-9) for k, p in want.items()}
    assert all(inc == 0.0 for *_, inc in got) and [g for _, _, g, _ in got] == sorted((g for _, _, g, _ in got), reverse=True)
    if len(want) > 2:
        n = 3_000
        two = pieces.top_k([text] * n, list(range(n)), lattices, 2, 9)
        first, pairs = Counter(tuple(map(int, r[0][0])) for r in two), Counter(tuple(tuple(map(int, x[0])) for x in r) for r in two)
        for s, p in want.items():
            assert first[s] / n == pytest.approx(p, abs=4.5 * math.sqrt(p * (1 - p) / n) + 1e-9)
            for t, q in want.items():
                if s != t:
                    both = p * q / (1 - p)
                    assert pairs[s, t] / n == pytest.approx(both, abs=4.5 * math.sqrt(both * (1 - both) / n) + 1e-3)
        weights = {s: np.mean([sum(math.exp(phi - inc) for ids, phi, _, inc in r if tuple(map(int, ids)) == s) for r in two]) for s in want}
        for s, p in want.items():
            assert weights[s] == pytest.approx(p, abs=0.08)


def test_pieces_do_not_depend_on_their_batch(lattices, vocabulary, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeéß.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    flat = lambda rows: [[(tuple(map(int, ids)), *rest) for ids, *rest in r] for r in rows]
    whole = flat(pieces.top_k(texts, list(range(40)), lattices, 3, 1))
    monkeypatch.setattr(pieces, "MOST_KNOWN", 300)
    small = pieces.Lattices(vocabulary)
    assert whole == [flat(pieces.top_k([t], [i], small, 3, 1))[0] for i, t in enumerate(texts)]
    assert all(vocabulary.decode(np.array(ids)) == t.encode() for t, r in zip(texts, whole, strict=True) for ids, *_ in r)


def test_pieces_sample_as_they_should(lattices):
    n = 4_000
    got = pieces.top_k(["ab cde"] * n, list(range(n)), lattices, 3, 7)
    p = {tuple(ids): math.exp(phi) for r in got for ids, phi, _, _ in r}
    first = Counter(tuple(r[0][0]) for r in got)
    second = Counter(tuple(r[1][0]) for r in got)
    for s, c in first.most_common(2):
        assert c / n == pytest.approx(p[s], abs=4 * math.sqrt(p[s] * (1 - p[s]) / n) + 1e-3)
    want = {s: sum(p[f] * p[s] / (1 - p[f]) for f in p if f != s) for s in p}
    for s, c in second.most_common(2):
        assert c / n == pytest.approx(want[s], abs=0.03)
    assert np.mean([sum(math.exp(phi - inc) for _, phi, _, inc in r) for r in got]) == pytest.approx(1, abs=0.05)
    assert all(len({tuple(x[0]) for x in r}) == 3 and r[0][2] > r[1][2] > r[2][2] for r in got)


def test_pieces_round_trip(docs, empty, lattices, vocabulary):
    e = pieces.sample_segmentations(docs, k=2)
    back = pieces.decode(e).collect()
    texts = defaultdict(set)
    for r in document_rows():
        texts[r[0]].add(r[1] or "")
    assert {r.doc_id for r in back} == set(texts)
    assert all(r.text in texts[r.doc_id] and len(r.ids) == r.n_pieces for r in back)
    odd = ["▁ x", "\x00", "😀é\n\n  a", "   ", "a▁▁b"]
    for t, r in zip(odd, pieces.top_k(odd, list(range(5)), lattices, 3, 1), strict=True):
        assert all(vocabulary.decode(x[0]) == t.encode() for x in r)
    again = {(r.doc_id, r.sample, tuple(r.ids)) for r in pieces.sample_segmentations(docs.repartition(7), k=2).collect()}
    assert again == {(r.doc_id, r.sample, tuple(r.ids)) for r in back}
    assert pieces.sample_segmentations(empty).count() == 0
    clash = pieces.decode(e.withColumn("text", F.lit("old")).withColumn("more", F.lit(1)))
    assert sorted(clash.columns) == sorted([*e.columns, "more", "text"]) and {r.text for r in clash.collect()} == {r.text for r in back}


# -- 7 toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty, labels):
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(document_rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert toxicity.toxicity_report(empty, labels).count() == 0
    assert toxicity.toxicity_report(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    bad = ["vileterm", "grossword", "nastything"]
    rows = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            t[rng.randrange(60)], t[rng.randrange(60)], t[rng.randrange(60)] = rng.choices(bad, k=3)
        rows.append((i, " ".join(t), int(i % 5 == 0)))
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity_report(t.select("doc_id", "text"), t.select("doc_id", "toxic")).where("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in got) / len(got) > 0.9


# -- 8 Jaccard join --------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    key = lambda d: -math.inf if d is None else d
    return sorted(((d, len(sets[i]), min(least[root(i)], key=key), links[i]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("seed", "rounds", "firsts", "part"), [(1, 0, 8, 200), (2, 1, 1, 1 << 18), (3, jaccard.ROUNDS, 2, 60)])
def test_jaccard(spark, seed, rounds, firsts, part, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FIRST_LISTS", firsts)
    monkeypatch.setattr(jaccard, "PART_ELEMENTS", part)
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (5, 6, 7, 9, 12, 15, 18, 30, 80)]
    rows = []
    for i in range(140):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)]
        rows.append((i * 3, " ".join(t)))
    got = sorted(map(tuple, jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_edges(docs, empty):
    rows = [(r[0], r[1]) for r in document_rows()]
    assert sorted(map(tuple, jaccard.components(docs).collect()), key=str) == brute_components(rows)
    assert jaccard.components(empty).count() == 0


def test_classes(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(50, 51), (52, 51)]
    names = spark.createDataFrame([(i, 3 if i in (7, 9) else 100 - i) for i in range(60)], "id long, least long")
    got = {r.node: tuple(r.root) for r in jaccard.classes(spark.createDataFrame(edges, "a long, b long"), names).collect()}
    assert set(got[i] for i in range(21)) == {(3, 7)} and got[50] == got[51] == got[52] == (48, 52)


def test_jaccard_joins_what_a_long_passage_hides(spark):
    """Two sets that link, a third larger one that shares much with both, and three that share the rest of the third."""
    rng = random.Random(0)
    for _ in range(3):
        w = [f"q{rng.random()}" for _ in range(200)]
        texts = [w[:40] + w[40:44], w[:40] + w[50:54], w[:40] + w[60:130], *(w[60:130] + w[130 + 9 * i : 139 + 9 * i] for i in range(3))]
        rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
        got = sorted(map(tuple, jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert got == brute_components(rows) and got[1][2] == 1


@pytest.mark.parametrize("rounds", [1, 3])
def test_jaccard_goes_on_after_a_pivot_without_pairs(spark, rounds, monkeypatch):
    """The pivot of the one list is too large for the two sets that link."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    a, b, c = (r.id for r in spark.range(3).orderBy(F.xxhash64("id", F.lit(0))).collect())
    row = lambda i, e: (i, len(e), np.array(e, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), [7], jaccard.parities(np.array(e, np.uint64)))
    rows = [row(a, list(range(1, 101))), row(b, list(range(1, 2)) + list(range(200, 249))), row(c, list(range(1, 2)) + list(range(201, 250)))]
    sets = spark.createDataFrame([(i, n, bytearray(x), on, s) for i, n, x, on, s in rows], "id long, n long, set binary, lists array<long>, sketch array<long>")
    names = spark.range(3).select("id", F.col("id").alias("least"))
    assert {r.node: r.root.id for r in jaccard._linked_sets(sets, names).collect()} == {b: min(b, c), c: min(b, c)}


# -- 9 suffix dedup --------------------------------------------------------------------------------------------------------


def brute_removed(rows):
    data = [(-math.inf if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in data:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], math.inf), d)
    out = []
    for (doc, _), (d, t) in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_difference_cover():
    assert (suffixes.SHIFTS < suffixes.PERIOD).all()
    for r in range(suffixes.PERIOD):
        for s in range(suffixes.PERIOD):
            d = suffixes.SHIFTS[r, s]
            assert (r + d) % suffixes.PERIOD in suffixes.COVER and (s + d) % suffixes.PERIOD in suffixes.COVER


@pytest.mark.parametrize("hot", [2, 20_000])
def test_suffixes(spark, hot, monkeypatch):
    for name, value in (("PART", 2_000), ("RANGE", 64), ("HOT", hot)):
        monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3_000)
    rng = random.Random(6)
    line = "".join(rng.choices("abc ", k=140))
    rows = []
    for i in range(60):
        t = "".join(rng.choices("abé\n ", k=rng.randrange(0, 160)))
        for _ in range(rng.choice([0, 1, 2])):
            a = rng.randrange(0, 90)
            at = rng.randrange(0, len(t) + 1)
            t = t[:at] + line[a : a + rng.randrange(40, 140)] + t[at:]
        rows.append((i, t + ("ab" * 60 if i % 9 == 0 else "")))
    got = suffixes.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows)


def test_suffix_edges(docs, empty):
    rows = [(r[0], r[1]) for r in document_rows()]
    assert sorted(map(tuple, suffixes.dedup_report(docs).collect()), key=str) == brute_removed(rows)
    kept = suffixes.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert kept.where("doc_id = 3").first()._size == "clash"
    assert suffixes.dedup_report(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0


# -- 10 media --------------------------------------------------------------------------------------------------------------


def test_media(docs, empty):
    texts = defaultdict(set)
    for r in document_rows():
        texts[r[0]].add((r[1] or "").encode())
    for r in media.media_columns(docs, keep_media=True).collect():
        text = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
        payload = media.pad(text)
        assert r.payload_bytes == len(payload) and len(payload) % 576 == 0 and len(payload) >= 576
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    clips = media.media_clips(docs).where("doc_id = 16").orderBy("clip").collect()
    assert clips[0].first_frame == 0 and all(a.end_frame == b.first_frame for a, b in zip(clips, clips[1:], strict=False))
    assert media.media_columns(empty).count() == 0


def test_media_bytes():
    for data in (os.urandom(3_000), b"\xff" * 1_152, b"\0" * 576):
        payload = media.pad(data)
        stored = media.encode(payload)
        frames, fps = media.parse_riff(stored)
        assert fps == media.FPS and len(frames) == len(payload) // 576
        coef = media.coefficients(stored, frames)
        assert media.payload_of(coef) == payload
        at, size = frames[0]
        assert (media.decode_jpeg(stored[at : at + size]) == coef[0]).all()


# -- queries against SQL, and the pipeline -----------------------------------------------------------------------------------


def test_queries_match_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(str, df.select(*columns).collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, r, strict=True)) + ")" for r in want.fetchall()), name


def test_pipeline_stages(spark, docs, empty, tmp_path, labels):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near copies", "suffix dedup", "mixing", "pieces"]
    for name, stage in list(steps.items())[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, empty, sf).count() == 0, name
    near = [(r.doc_id, r.text) for r in steps["near copies"](spark, docs, sf).collect()]
    parts = defaultdict(list)
    for d, _, c, _ in brute_components([(r[0], r[1]) for r in document_rows()]):
        parts[c].append(d)
    assert sorted((d for d, _ in near), key=str) == sorted(parts, key=str)
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_copies_keep_texts_that_share_an_id(spark, tmp_path):
    import corpus_pipeline

    text = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    a, b = text("a"), text("b")
    near_b = b + " end"
    rows = [(3, b), (7, a), (7, near_b), (None, text("c")), (None, text("d")), (None, text("e")), (9, text("c")), (7, a)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter([(3, b), (7, a), (None, text("c")), (None, text("d")), (None, text("e"))])
