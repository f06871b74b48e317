"""Columns that the registered queries derive, over whole tables, against plain Python."""

from collections import Counter, defaultdict

import brute
import pyarrow.parquet as pq
import pytest

from repotide.llm import chat, packing, queries, tokenfile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def test_op1(spark, own):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    by_id = brute.contamination(own, items)
    want = {d: (n, hit, len(found), brute.sha(",".join(found)), hit > 0) for d, (n, hit, found) in by_id.items()}
    got = queries.op1_decontamination(spark, SF).collect()
    assert len(got) == len(own) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert any(r["contaminated"] for r in got)


def test_op2(spark):
    turns = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    turns[chat.PROBE_ID] += [(0, "user", chat.PROBE_TEXT), (1, "assistant", chat.PROBE_TEXT)]
    want = {}
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        want[c] = (len(rows), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), brute.sha(loss))
    assert {r["conv_id"]: tuple(r)[1:5] for r in queries.op2_chat_format(spark, SF).collect()} == want


def test_op3(spark, own):
    got = queries.op3_secret_scan(spark, SF).collect()
    want = Counter()
    for d, t in own:
        found = brute.base_secrets(t)
        kinds = Counter(kind for *_, kind in found)
        want[(d, kinds["assign"], kinds["access"], kinds["hex"], brute.sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found)))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        spans = [x.split(":")[0] for x in r["spans"].split(",") if x]
        assert all(spans.count(k) >= r[f"n_{k}"] for k in ("assign", "access", "hex"))


def test_op4(spark, own):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = queries.op4_language_id(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in own)
    known = [r for r in got if langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in known) / len(known) > 0.95


def test_op5(spark, own):
    want = Counter((d, len(ids), brute.crc(ids)) for d, t in own for ids in [brute.token_ids(t, tokenfile.END_ID)])
    got = [tuple(r) for r in queries.op5_token_file(spark, SF).collect()]
    assert Counter((r[0], r[2], r[3]) for r in got) == want


def test_op7(spark, own):
    got = queries.op7_sharding(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in own)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < queries.SHARDS
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, own):
    got = queries.op8_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(own)


def test_op9(spark, own):
    rows, want = sorted((d, t or "") for d, t in own), {}
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        want[d] = (len(t), brute.sha(t[:len(t) - half] + rows[(i + 1) % len(rows)][1][:half]))
    got = queries.op9_fingerprints(spark, SF).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    same = defaultdict(set)
    for r in got:
        same[dict(rows)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in same.values())


def test_op10(spark, own):
    got = queries.op10_packing(spark, SF).collect()
    want = Counter()
    for d, t in own:
        ids = brute.token_ids(t, packing.END_ID)
        begin, head = 0, len(ids) - (len(ids) - 1) // 1024 * 1024
        for piece, stop in enumerate(range(head, len(ids) + 1, 1024)):
            want[(d, piece, begin, stop - begin, brute.crc(ids[begin:stop]))] += 1
            begin = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
