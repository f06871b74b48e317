"""Token files, sharding, the Jaccard join, packing and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from repotide.llm import coder, common, components, jaccard, packing, sharding, tokenfile, tokens
from repotide.session import cut


@pytest.fixture(scope="module")
def docs(spark):
    return cut(brute.frame(spark, [*brute.edge_rows(), (None, "no id at all"), (15, "a")]))


@pytest.fixture(scope="module")
def empty(spark):
    return brute.frame(spark, [])


# Tokens

def test_chunked_encoding_equals_the_library():
    rng, encoder = random.Random(3), tokens.ChunkEncoder()
    bits = [" ", "  ", "\n", " \n", "\t", "a", "b", "é", "'s", "1", "23", "!", "<|endoftext|>", "the", " the", "\x00", "日本", "\x1c", "​", "\x85", " ", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(5000)] + [None, "", " ", "  ", " a", "a ", "\x00abc", "abc"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == brute.token_ids(text, 0).tolist()[:-1], repr(text)


def test_cache_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    encoder, texts = tokens.ChunkEncoder(), [brute.prose(i, 50) for i in range(5)]
    assert [encoder.encode([t])[0] for t in texts] == tokens.ChunkEncoder().encode(texts)


def test_words_are_learnt_once_whatever_mark_follows():
    encoder = tokens.ChunkEncoder()
    first = "x Alpha été beta 12"
    encoder.encode([first])
    known = set(encoder.known)
    texts = ["x Alpha, été. beta! 12: Alpha", 'x beta" Alpha) été; beta?\nx Alpha\nx été,\nx', "x (beta) 12.5 http://été...\n\nx 'tis Alpha's"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == brute.token_ids(text, 0).tolist()[:-1]
    new = set(encoder.known) - known
    assert not [k for k in new if k.strip("\0,.!:;?)\"\n") in first.split() and k[0] != "\0"]
    ids, ends = encoder.encode_flat([*texts, None, "", first])
    assert [ids[b:e].tobytes() for b, e in zip([0, *ends], ends, strict=False)] == encoder.encode([*texts, None, "", first])


def test_marks_and_line_ends_between_words():
    rng, encoder = random.Random(5), tokens.ChunkEncoder()
    bits = [" ", " ", "a", "The", "été", "ß", "Ж", "ª", "7", ".", ",", "!", ")", "(", '"', "'s", "-", "<", "|>", "<|endoftext|>", "\n", "\n\n", "\r\n", "\xa0", "\0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 20))) for _ in range(5000)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == brute.token_ids(text, 0).tolist()[:-1], repr(text)


# Coder and token files

def coder_blocks():
    rng = np.random.default_rng(0)
    return [rng.integers(0, 50257, n) for n in (1, 2, 3, 100, coder.BLOCK, coder.BLOCK, 777)] + [
        np.zeros(coder.BLOCK, np.int64), np.full(500, coder.MOST_ID - 1), np.arange(coder.BLOCK) % 3, np.array([0, coder.MOST_ID - 1] * 50),
        rng.integers(0, 40, coder.BLOCK), (rng.pareto(0.5, coder.BLOCK) * 3).astype(np.int64) % 50257]


def test_coder_round_trip():
    blocks = coder_blocks()
    coded = coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, coder.decode_blocks(coded), strict=True))
    assert coder.decode_blocks(coder.encode_blocks([])) == []
    for one, data in zip(blocks, coded, strict=True):  # blocks do not depend on their neighbours
        assert coder.encode_blocks([one]) == [data]
    assert len(coded[7]) < 100 and len(coded[9]) < 100 and len(coded[11]) < 0.5 * 2 * coder.BLOCK


def test_coded_bytes_stay():
    coded = coder.encode_blocks(coder_blocks())
    assert zlib.crc32(b"".join(coded)) == 2073432186


def test_coder_refuses_what_it_cannot_hold():
    with pytest.raises(ValueError):
        coder.encode_blocks([np.array([coder.MOST_ID])])
    data = coder.encode_blocks([np.arange(300)])[0]
    for at in range(0, len(data), 7):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode_blocks([bytes(broken)])


@pytest.mark.parametrize("file_rows", [7, 8000])
def test_token_files(spark, docs, empty, file_rows, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_ROWS", file_rows)
    got = tokenfile.read_token_digests(spark, tokenfile.write_tokens(spark, docs)).collect()
    own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in docs.select("doc_id", "text").collect())
    want, start = [], 0
    for known, d, _, t in own:
        ids = brute.token_ids(t, tokenfile.END_ID)
        want.append((d if known else None, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert max(n for _, _, n, _ in want) > 10 * coder.BLOCK
    assert tokenfile.read_token_digests(spark, tokenfile.write_tokens(spark, empty)).collect() == []


def test_writer_codes_a_bounded_number_of_blocks_at_once(monkeypatch):
    monkeypatch.setattr(tokenfile, "ABREAST", 3)
    most, code = [], tokenfile.encode_blocks
    monkeypatch.setattr(tokenfile, "encode_blocks", lambda blocks: most.append(len(blocks)) or code(blocks))
    writer, ids = tokenfile._Writer(4), np.random.default_rng(2).integers(0, 50257, 10 * coder.BLOCK + 5).astype("<u4")
    counts = [1, 0, 9 * coder.BLOCK, coder.BLOCK + 4]
    writer.add([None, 1, 2, 3], ids, counts)
    rows = [r for batch in (*writer.flush(False), *writer.flush(True)) for r in batch.to_pylist()]
    assert most == [3, 3, 3, 2] and [r["block"] for r in rows] == list(range(11))
    opened = [tokenfile._open(r["record"]) for r in rows]
    assert (np.concatenate(coder.decode_blocks([o[-1] for o in opened])) == ids).all()
    assert [o[0] for o in opened] == [i * coder.BLOCK for i in range(11)]
    assert list(writer.flush(True)) == []


def test_crc_of_joined_parts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(5000))
        a, b = np.frombuffer(a[:len(a) // 4 * 4], "<u4"), np.frombuffer(b[:len(b) // 4 * 4], "<u4")
        assert tokenfile.join_crc(brute.crc(a), brute.crc(b), 4 * len(b)) == brute.crc(np.concatenate([a, b]))


# Sharding

def test_shards(spark, docs, empty):
    got = sharding.shard_documents(docs, sharding.even_tree(16)).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {(r["doc_id"], r["size"]) for r in got}
    assert (12, 1) in sizes and (13, 1) in sizes and (17, 1 + len(dict(brute.edge_rows())[17].encode())) in sizes
    assert sharding.shard_documents(empty, sharding.even_tree(16)).collect() == []
    assert len({r["shard"] for r in got if r["doc_id"] == 15}) == 1


def test_movement_stays_in_changed_subtrees(spark):
    tree = sharding.even_tree(16)
    heavier = [(a, b, s, 3.0 if s == 5 else w) for a, b, s, w in tree]
    ids = spark.range(20_000)
    col = [F.col("id")]
    got = ids.select(*[sharding.tree_shard(col, t).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", sharding.grown(tree)))]).collect()
    loads = Counter(r["a"] for r in got)
    assert len(loads) == 16 and max(loads.values()) < 1.2 * 20_000 / 16
    moved = [(r["a"], r["b"]) for r in got if r["a"] != r["b"]]
    # The weight of shard 5, its rack (4 to 7) and its region (0 to 7) grew: rows move inside that region or into it.
    assert moved and all(b < 8 for _, b in moved)
    assert all(b == 5 for a, b in moved if 4 <= a < 8)
    assert all(4 <= b < 8 for a, b in moved if a < 4)
    assert {r["c"] for r in got if r["a"] != r["c"]} == {16}
    share = Counter(r["b"] for r in got)[5] / 20_000
    assert 0.13 < share < 0.2  # 3 of 18


# Jaccard join

def group_rows(seed=0):
    """Groups of near copies around bases, chains of edits, exact copies, shared passages."""
    rng, rows, passage = random.Random(seed), [], brute.prose(77, 60)
    for b in range(6):
        base = brute.prose(200 + b, 120 + 20 * b, 10**6).split()
        for c in range(9):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
            rows.append(" ".join(words))
        chain = list(base)
        for c in range(6):
            at = 18 * c
            chain[at:at + 3] = [f"c{b}{c}{i}" for i in range(3)]
            rows.append(" ".join(chain))
    rows += [passage + " " + brute.prose(900 + i, rng.choice((4, 20, 60, 200)), 10**6) for i in range(25)]
    rows += [passage] * 5 + [passage.upper()]
    rng.shuffle(rows)
    return [(7 + 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("group,limit", [(512, 500_000), (512, -1), (4, 500_000)])
def test_jaccard_components(spark, group, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(jaccard, "LEADERS", (2, 3, 8))
    data = group_rows()
    got = jaccard.jaccard_components(spark, brute.frame(spark, data).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(data)


def near_rows(groups=3, members=14):
    """Sets that are all 60 to 80 % alike but not linked, some with a linked copy or a chain between two of them."""
    rows = []
    for g in range(groups):
        core = brute.prose(600 + g, 60, 10**6).split()
        tails = [brute.prose(700 + 100 * g + m, 13, 10**6).split() for m in range(members)]
        rows += [core + t for t in tails]
        rows += [core + tails[0] + ["more"], core + tails[1] + tails[2][:6], core + tails[2][:6] + tails[1], core + tails[2]]
    return [(3 * i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("near", [1, 32])
def test_groups_that_are_near_but_not_linked(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "LEADERS", (3, 8))
    monkeypatch.setattr(jaccard, "NEAR", near)
    data = near_rows()
    got = jaccard.jaccard_components(spark, brute.frame(spark, data).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(data)


def test_rows_of_a_near_group_follow_its_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NEAR", 4)
    data = near_rows(1, 40)
    rows = [(1, 0, leads, i, t) for i, t in data for leads in (False, True)]
    frame = spark.createDataFrame(rows, "comp long, chunk int, leads boolean, node long, text string")
    met = jaccard._join_leaders(frame, 5, 80).collect()
    each = Counter(r["u"] for r in met if r["kind"] != "link")
    assert max(each.values()) <= 4 and len(met) <= 5 * len(data)
    assert {r["u"] for r in met if r["kind"] == "many"} == {i for i, _ in data}


def test_blocks_of_queries_keep_within_their_cells(monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 100)
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(30)] + [np.arange(500, dtype=np.uint64)]
    blocks = list(jaccard._blocks(sets))
    assert [b for b, _ in blocks] + [31] == [0] + [e for _, e in blocks]
    assert all(e - b == 1 or sum(map(len, sets[b:e])) * (e - b) <= 100 for b, e in blocks)
    found = {(i, int(j)) for i, js, _ in jaccard.trie_links(sets) for j in js if i != j}
    assert found == {(i, j) for i in range(30) for j in range(30) if i != j and abs(i - j) <= 2}


def test_jaccard_edges(spark, docs, empty):
    got = jaccard.jaccard_components(spark, docs).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in own)
    want = brute.components([(d, t) for d, t in own if d is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.jaccard_components(spark, empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = []
    for _ in range(30):
        core = rng.integers(0, 400, rng.integers(1, 60))
        for _ in range(rng.integers(1, 5)):
            base.append(np.unique(np.concatenate([core[rng.random(len(core)) < 0.93], rng.integers(0, 400, rng.integers(0, 4))])).astype(np.uint64))
    base = [b for b in base if len(b)]
    for queries in (base, base[::3]):
        found = [(i, int(j), bool(s)) for i, js, sure in jaccard.trie_links(base, queries, 60, 80) for j, s in zip(js, sure, strict=True)]
        near = {(i, j) for i, a in enumerate(base) for j, b in enumerate(queries) if 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))}
        assert {(i, j) for i, j, _ in found} == near
        got = {(i, j) for i, j, s in found if s}
        want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(queries)
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert got == want


def test_prefix_sizes_lose_no_partner():
    """Random sets at the edge of the threshold, ordered by hash and then by any other order."""
    rng = random.Random(8)
    for _ in range(3000):
        a = rng.randint(1, 60)
        union = rng.randint(a, -(-a * 100 // 80))
        common = -(-80 * union // 100)
        if common > a:
            continue
        b = union - a + common
        universe = rng.sample(range(10**6), union)
        x, y = set(universe[:a]), set(universe[a - common:])
        assert len(y) == b and len(x & y) == common
        second = {t: rng.random() for t in universe}

        def part(s):
            prefix, rare = jaccard.prefix_sizes(len(s))
            return set(sorted(sorted(s)[:prefix], key=second.get)[:rare])

        assert part(x) & part(y)


def test_linked_sets_meet_as_whole_ones_or_by_prefixes():
    rng, mark = random.Random(9), 1 << jaccard._WHOLE_BIT
    for _ in range(600):
        a = rng.randint(150, 400)
        union = rng.randint(a, -(-a * 100 // 80))
        common = -(-80 * union // 100)
        if common > a:
            continue
        universe = rng.sample(range(1 << 40), union)
        x, y = (np.array(sorted(u), np.uint64) for u in (universe[:a], universe[a - common:]))
        small, large = sorted((len(x), len(y)))
        one, other = ({int(t) for t in jaccard.candidate_tokens(s)} for s in (x, y))
        whole = {t for t in one & other if t & mark}
        if large <= jaccard.WHOLE:
            assert len(whole) == common
        else:
            assert not whole and len(one & other) >= max(1, small // jaccard.PART)


def line_rows(count=400, lines=30):
    """Texts of three common lines each, some with a word more: any two may share lines, few are linked."""
    rng = random.Random(17)
    common = [brute.prose(800 + i, 6, 10**6) for i in range(lines)]
    texts = [" ".join(rng.sample(common, 3)) for _ in range(count)]
    return [(2 * i, t) for i, t in enumerate(texts + [f"{t} more" for t in texts[::10]])]


def test_common_lines_do_not_chain_sets_into_one_group(spark):
    data = line_rows()
    sets = cut(jaccard._sets(brute.frame(spark, data).repartition(4), 5, 80))
    edges, _ = jaccard._candidates(sets, 80)
    groups = components.connected(edges).groupBy("root").count().collect()
    assert 20 <= len(groups) and max(r["count"] for r in groups) <= 40  # before: one group of nearly all
    got = jaccard.jaccard_components(spark, brute.frame(spark, data).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(data)


@pytest.mark.parametrize("light", [1, 16])
def test_sets_of_about_the_size_taken_whole(spark, light, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    rows = []
    for c in range(24):
        words = brute.prose(1000 + c, 200 + 6 * c, 10**6).split()
        rows += [" ".join(words), " ".join(words[:len(words) * 9 // 10]), " ".join(words[len(words) // 5:]), " ".join(words + words[:c])]
    data = [(5 + i, t) for i, t in enumerate(rows)]
    got = jaccard.jaccard_components(spark, brute.frame(spark, data).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(data)


@pytest.mark.parametrize("parts", [1, 5])
def test_an_id_with_several_texts_links_their_copies(spark, parts):
    a, b = brute.prose(41, 60), brute.prose(42, 60)
    rows = [(7, a), (5, a), (5, b), (3, b + " x"), (2, a + " x"), (9, b), (11, brute.prose(43, 60))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark, brute.frame(spark, rows).repartition(parts)).collect()}
    assert got == {**dict.fromkeys((2, 3, 5, 7, 9), 2), 11: 11}


def test_components_by_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["u"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
    assert got == {u: root(u) for u in list(parent)}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# Packing

def check_plan(histogram, capacity):
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, low, high, first, offset in packing.plan_packing(histogram, capacity):
        ranks[length] += range(low, high)
        for r in range(high - low):
            filled[first + r].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("seed", range(8))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice((16, 100, 1024))
    histogram = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 120))}
    used, least = check_plan(histogram, capacity), -(-sum(n * c for n, c in histogram.items()) // capacity)
    rooms, fit = [], 0
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):  # best fit decreasing
        at = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    fit = len(rooms)
    assert least <= used <= fit * 1.02 + 1


def test_plan_of_nothing_and_of_whole_pieces():
    assert packing.plan_packing({}) == []
    assert check_plan({1024: 7}, 1024) == 7 and check_plan({1: 3}, 1024) == 1 and check_plan({512: 3, 1: 1}, 1024) == 2


def test_packing(spark, docs, empty):
    got = packing.pack_documents(spark, docs).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for d, t in own:
        ids = brute.token_ids(t, packing.END_ID)
        begin, head = 0, len(ids) - (len(ids) - 1) // 1024 * 1024
        for piece, stop in enumerate(range(head, len(ids) + 1, 1024)):
            want[(d, piece, begin, stop - begin, brute.crc(ids[begin:stop]))] += 1
            begin = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(spark, empty).collect() == []


@pytest.mark.parametrize("group", [1, 512])
def test_ids_with_several_texts_keep_their_links(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    a, b = brute.prose(31, 60), brute.prose(32, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, a + " x y"), (5, b + " x y"), (1, a), (9, brute.prose(33, 60))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark, brute.frame(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 9: 9}


def test_workers_drop_what_other_operators_kept():
    jaccard.shingle_set("some words that are kept")
    tokens.encoder()
    common.begin_task("tokens")
    assert not jaccard._HASHES and tokens._ENCODERS
    common.begin_task("jaccard")
    assert not tokens._ENCODERS
