"""License scans, the prefix trie and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

from repotide.llm import licenses, negatives, oracles, prefixes, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    _, problems = compare(connect(SF), queries.QUERIES[name](spark, SF), queries.ORACLES[name])
    assert not problems


# License scans

def scanned(text, templates=licenses.TEMPLATES, block=licenses.BLOCK, step=licenses.STEP):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute._UPPER))
    starts, places, base, labels, best = [0], [], set(), set(), 0.0
    while starts[-1] + block < len(words):
        starts.append(starts[-1] + step)
    for t in templates:
        own = t.text.split()
        if t.phrase:
            at = [i for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own]
            if at:
                labels.add(t.label)
                best = 1.0
                if t.text in licenses.BASE:
                    places += at
                    base.add(t.label)
            continue
        for s in starts:
            share = len(set(own) & set(words[s:s + block])) / len(set(own))
            if share == 1 or (len(set(own)) >= licenses.SHORT and round(100 * share, 6) >= licenses.PERCENT):
                labels.add(t.label)
                best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)


def license_texts():
    rng, out = random.Random(5), []
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.text.split()})
    for i in range(60):
        words = brute.prose(i, rng.randrange(200)).split() + rng.choices(vocabulary, k=rng.randrange(60))
        for t in rng.sample(licenses.TEMPLATES, 2):
            kept = [w if rng.random() > 0.1 else "zzz" for w in t.text.split()]
            at = rng.randrange(len(words) + 1)
            words[at:at] = kept if rng.random() > 0.3 else rng.sample(kept, len(kept))
        out.append((i, " ".join(words)))
    return out + [(100, None), (101, ""), (102, " \n"), (103, "CC BY"), (104, "cc-by cc by by cc"), (105, "All Rights\nReserved! all rights reserved"),
                  (106, brute.prose(3, 70_000) + " general public license"), (None, "all rights reserved"), (103, "CC BY"), (107, "ALL RİGHTS reserved"),
                  (108, "x " * 62 + "general public license"), (109, "the MIT\x00 License")]


@pytest.mark.parametrize("per_pass", [licenses.PASS, 4])
def test_licenses(spark, per_pass):
    rows = license_texts()
    got = licenses.license_report(licenses.scan_licenses(spark, brute.frame(spark, rows), per_pass=per_pass)).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *scanned(t)) for d, t in rows)
    assert sum(bool(r["labels"]) for r in got) > 30


def test_license_hits_are_blocks(spark):
    text = brute.prose(1, 100) + " " + licenses.TEMPLATES[16].text
    hit, = licenses.scan_licenses(spark, brute.frame(spark, [(1, text)])).first()["hits"][-1:]
    words = licenses.words_of(text)[hit["start"]:hit["stop"]]
    assert len(set(words) & set(licenses.TEMPLATES[16].text.split())) == hit["overlap"]


def test_licenses_empty_and_refused(spark):
    assert licenses.license_report(licenses.scan_licenses(spark, brute.frame(spark, []))).collect() == []
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark, brute.frame(spark, []), block=10, step=10)
    assert licenses.scan_licenses(spark, brute.frame(spark, [(1, "a b")]), templates=()).first()["n_words"] == 2


def test_rarest_tokens_come_first():
    index = licenses.TemplateIndex([(0, licenses.Template("x", " ".join(f"t{i}" for i in range(20))))], {f"t{i}": i for i in range(20)}, 80, 10)
    assert index.rank["t0"] == 0 and index.rank["t19"] == 19 and sorted(index.postings) == [0, 1, 2, 3, 4]
    assert index.search([f"t{i}" for i in range(4, 20)], 64, 32) == [(0, 0, 16, 16, [])]
    assert index.search([f"t{i}" for i in range(5, 20)], 64, 32) == []


# Prefix trie

def trie(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, children, sums = defaultdict(list), defaultdict(list), {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [sums[x] for x in children[node]]
        sums[node] = (sum(x for x, _ in below) or 1, (len(members[node]) - 1) * words + sum(x for _, x in below))
    out = Counter()
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(node))
        out[min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), *sums[node],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string, node string, at string, chunk string, rn string, slice string, words string"


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [0, 1, 2, 3, 5, 7, 20, 21, 22, -5, -20, -21, 40, 45, 46, 60, *range(80, 130)]:
        first = rng.choice([0, 1, 7])
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, first + 2 * turn if turn or first != 1 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "é  x\ty z"])))
    for c, n in ((300, 70), (301, 64), (302, 33), (303, 64)):  # longer than a chunk, some ending where one does
        rows += [(c, t, "u", "same text") for t in range(n)]
    return rows + [(None, 0, "u", "x"), (304, 5, "u", "tie"), (304, 5, "u", "tie"), (304, 6, "u", "long " * 50_000)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "run": 3, "per_slice": 5}, {"chunk": 1, "run": 7, "per_slice": 1000}])
def test_prefix_trie(spark, sizes):
    rows = conversations(len(sizes) and sizes["chunk"])
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], TURNS)
    got = prefixes.prefix_trie(*prefixes.rebuilt_turns(prefixes.placed_turns(frame)), **sizes).collect()
    assert Counter(tuple(r) for r in got) == trie(rows)


def test_small_tries(spark):
    frame = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert prefixes.conversation_trie(frame([])).collect() == []
    for rows in ([(5, 0, "u", "x")], [(c, 0, None, None) for c in range(1, 40)]):  # the second has turnless conversations
        assert Counter(tuple(r) for r in prefixes.conversation_trie(frame(rows)).collect()) == trie(rows)


def test_member_lists_in_pieces(spark):
    ends = spark.createDataFrame([(i % 3, 0, i) for i in range(100)], "ka long, kb long, conv_id long")
    got = {r["ka"]: r["ends_sha256"] for r in prefixes._member_digests(ends, piece=7).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(100) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_extents_equal_a_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 33):
        lcp = rng.integers(-1, 4, n)
        at, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        left, right = prefixes._extents(prefixes._levels(lcp), at, depth)
        for i, d, a, b in zip(at, depth, left, right, strict=True):
            x = y = i
            while x > 0 and lcp[x] >= d:
                x -= 1
            while y + 1 < n and lcp[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)


# Hard negatives

def mined(rows, divisor=50, positives=5, count=3):
    live = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, lab, q) in enumerate(live):
        if i % divisor:
            continue
        score = [sum(x * y for x, y in zip(q, v[2], strict=False)) for v in live]
        order = sorted(range(len(live)), key=lambda j: (-score[j], live[j][0]))
        for p in [j for j in order if live[j][1] == lab and j != a][:positives]:
            fit = [j for j in order if live[j][1] != lab and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            for rank, j in enumerate(fit[:count], 1):
                out[i, live[p][0], rank, live[j][0], score[p], score[j]] += 1
    return out


def vectors(n=400, size=8, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    flat = np.round(rng.normal(0.3, 0.3, (n, size)), 1).astype(np.float32)  # coarse, so that scores tie
    return [(i, int(rng.integers(labels)), [float(x) for x in v]) for i, v in enumerate(flat)]


EMBEDDINGS = "vec_id long, label int, embedding array<float>, uid string, anchor string, slot string, score string, rank string"


def mine(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], EMBEDDINGS)
    return Counter(tuple(r) for r in negatives.hard_negatives(frame.repartition(5), "vec_id % 50 = 0", **kw).collect())


def test_hard_negatives(spark):
    odd = [(None, 1, [0.5] * 8), (1000, None, [0.5] * 8), (1050, 1, None), (1100, 0, [0.5] * 7 + [None]), (1150, 2, [math.nan] * 8),
           (1200, 1, [math.inf] * 8), (1250, 1, []), (1300, 2, [0.5, 0.5]), (1301, 0, [0.5] * 12), (50, 1, [0.4] * 8), (1350, 9, [0.3] * 8)]
    rows = vectors() + odd + vectors()[:3]
    want = mined(rows)
    assert len(want) > 60 and mine(spark, rows) == want


def test_passes_and_counts(spark):
    rows = vectors(300, 4, 2, 1)
    assert mine(spark, rows, per_pass=2) == mined(rows)
    assert mine(spark, rows, positives=9, negatives=1) == mined(rows, positives=9, count=1)
    assert mine(spark, []) == Counter() and mine(spark, [(50, 1, [0.5])]) == Counter()


def test_few_rows_and_large_components(spark):
    rows = [(0, 1, [3000.0] * 4), (1, 1, [3000.0] * 4), (2, 2, [2000.0] * 4), (3, 2, [1800.0] * 4), (4, 1, [-1.0] * 4), (50, 2, [2e5] * 4), (51, 2, [2.1e5] * 4), (52, 1, [1.5e5] * 4), (53, 0, [1e30, -1e30, 0.0, 0.0])]
    assert mine(spark, rows) == mined(rows) != Counter()


def test_products_are_whole_numbers():
    a = np.array([[2.0 ** 26 + 1, 1.0], [3.0, -5.0]])
    assert negatives._products(a, a).tolist() == [[int(x @ y) for y in a.astype(object)] for x in a.astype(object)]
    assert negatives._products(np.array([[1e30], [1.0]]), np.array([[1e30], [-1e300]])).tolist() == [[negatives.MOST, -negatives.MOST]] * 2


def test_best_keeps_ties_by_id():
    best = negatives._Best(1, 1, 2)
    for ids, scores in (([4, 9], [7, 7]), ([1, 3], [7, 2])):
        best.add(slice(0, 1), 0, np.array([scores]), np.ones((1, 2), bool), np.array(ids), np.array(ids))
    out = pa.Table.from_batches([best.batch(np.array([0]))]).to_pydict()
    assert out["vec_id"] == [1, 4] and out["score"] == [7, 7]
