"""Decontamination, chat formatting, secrets, language, fingerprints and pages against brute force."""

import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from repotide.llm import chat, decontaminate, language, pages, queries, secrets, sketches
from repotide.session import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return cut(brute.frame(spark, [*brute.edge_rows(), (None, "no id at all"), (15, "a")]))


@pytest.fixture(scope="module")
def empty(spark):
    return brute.frame(spark, [])


def rows(df):
    return [tuple(r) for r in df.collect()]


# Decontamination

def item_rows():
    base, long = brute.prose(1, 300).split(), brute.prose(3, 60_000).split()
    return [(1, " ".join(base[20:45])), (10, " ".join(base[290:])), (2, "ONE, two. three"), (3, None), (4, "..."), (5, " ".join(long[-30:])),
            (None, " ".join(base[:30])), (6, "tie tie tie tie tie tie tie tie tie tie"), (7, " ".join(base[100:109])), (8, "a"), (8, "a"), (9, "é cödé text")]


@pytest.mark.parametrize("limit", [10**6, -1])
def test_contamination(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", limit)
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in item_rows()], "item_id long, text string, key string, pos int")
    got = decontaminate.decontaminate(docs, items).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute.contamination(own, item_rows())
    assert len(got) == len(own)
    for r in got:
        assert (r["n_words"], r["n_hit"], list(r["hit_items"])) == want[r["doc_id"]]
    assert sum(r["n_hit"] > 0 for r in got) > 8


def test_contamination_without_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert rows(decontaminate.decontaminate(empty, items)) == []
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_winnowing_keeps_a_mark_in_every_window(spark):
    """Random texts over few words, so that hashes tie: any shared span of ten words shares a mark."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = decontaminate.words_of(F.col("t"))
    got = df.select("i", decontaminate.winnow(decontaminate._hashes(words)).alias("m")).collect()
    for r in got:
        kept = {m["pos"] for m in r["m"]}
        for s in range(31):
            assert any(s <= p and p + decontaminate.GRAM <= s + 10 for p in kept)


# Chat

def test_chat_round_trip(spark):
    hostile = ["", r"\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\", r"\e\h\c", "a:b", "###", "### ", "tab\tnew\nline", "é😀", "<\\/turn>", None]
    data = [(c, t, role, x, "clash") for c in range(4) for t, (role, x) in enumerate(
        (r, x) for r in ("user", "assistant", "a: b\\", None) for x in random.Random(c).sample(hostile, len(hostile)))]
    data += [(9, None, "user", "null turn", ""), (9, 0, "assistant", "x", ""), (9, 0, "assistant", "x", ""), (None, 1, "user", "no id", "")]
    data += [(20, t, "assistant", f"turn {t} ###", "") for t in range(3 * chat.CHUNK + 5)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, line string").repartition(5)
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_conversations(df)).collect()}
    assert len(got) == 7
    for c in got:
        own = sorted(((-1 if t is None else t), r is not None, r or "", x or "") for cc, t, r, x, _ in data if cc == c)
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), brute.sha(text))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), brute.sha(loss))
    assert rows(chat.chat_digests(chat.format_conversations(df.limit(0)))) == []


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"}]}', [("human", "a")]),
        ('{"output":"o","instruction":"i"}', [("user", "i"), ("assistant", "o")]),
        ('{"instruction":"i","input":null,"output":"o"}', [("system", "i"), ("user", ""), ("assistant", "o")]),
        ('{"prompt":"p","completion":"c"}', [("user", "p"), ("assistant", "c")]),
        ('{"other":1}', []), ("not json", []), (None, [])]
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r, _ in records], "record string")).collect()
    assert [[tuple(t) for t in r["turns"]] for r in got] == [want for _, want in records]
    assert [r["layout"] is None for r in got] == [False] * 5 + [True] * 3


def test_turns_longer_than_the_json_reader_takes(spark):
    df = spark.range(2).selectExpr(
        "1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "if(id = 0, 'short', repeat('x', cast(20000000 + id as int))) text")
    got = chat.chat_digests(chat.format_conversations(df)).first()
    long = "x" * 20_000_001
    assert (got["n_turns"], got["turns_sha256"]) == (2, brute.sha(f"user\nshort\nassistant\n{long}\n"))
    assert (got["loss_chars"], got["loss_sha256"]) == (len(long), brute.sha(long))
    record = df.selectExpr("to_json(struct('user' role, text content)) record")
    with pytest.raises(Exception, match="refused a record"):
        chat.canonical_turns(record).select(F.size("turns")).collect()


def test_chat_query(spark):
    got = queries.op2_chat_format(spark, SF).filter("conv_id = -7").first()
    probe = chat.PROBE_TEXT
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(probe), brute.sha(probe))


# Secrets

SECRET_TEXTS = [
    None, "", "password=hunter2", 'my "api_key": "abcdefghijkl"', "token = short token=abcdefghijklmn", "PASSWORD:ABCDEFGHIJKL", "ſecret=abcdefghijklmn",
    "AKIA" + "A" * 14, "AKIA" + "B" * 13, "0123456789abcdef", "0123456789ABCDEF", "passwd=token=abcdefghijklmnop", "é😀 secret='0123456789abcdef01'",
    "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT", "https://me:passw0rd@host/x", "x" * 200_000 + " apikey=zzzzzzzzzzzzzz"]


def test_secrets(spark):
    data = [(i, t) for i, t in enumerate(SECRET_TEXTS)] + [(3, SECRET_TEXTS[3])] * 2 + [(None, SECRET_TEXTS[3])]
    got = secrets.scan_secrets(spark, brute.frame(spark, data)).collect()
    assert len(got) == len(data)
    by_id = dict(data)
    for r in got:
        base = [(f["start"], f["end"], f["kind"]) for f in r["findings"] if f["base"]]
        assert base == [(s, e, k) for s, _, e, k in brute.base_secrets(by_id[r["doc_id"]])]
        assert [f["start"] for f in r["findings"]] == sorted(f["start"] for f in r["findings"])
    kinds = {f["kind"] for r in got for f in r["findings"]}
    assert {"assign", "access", "hex", "jwt", "url_password"} <= kinds
    assert rows(secrets.scan_secrets(spark, brute.frame(spark, []))) == []


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.BlobLedger(spark)
    one, two = brute.frame(spark, [(1, "a"), (2, "a"), (3, "token=abcdefghijklmn")]), brute.frame(spark, [(1, "a"), (4, "b"), (3, "token=abcdefghijklmn")])

    def seen(df, version="1"):
        return spark.read.parquet(ledger.scan(secrets.versions(df), rule_version=version)).count()

    assert [seen(one), seen(two), seen(two), seen(one, "2")] == [2, 1, 0, 2]
    paths = ledger.findings(secrets.versions(one.unionByName(two))).filter(F.size("findings") > 0).select("path").collect()
    assert [r[0] for r in paths] == [3, 3]


def test_ledger_is_reopened_by_its_path(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = brute.frame(spark, [(1, "a"), (3, "token=abcdefghijklmn")])
    two = brute.frame(spark, [(1, "a"), (4, "b"), (3, "token=abcdefghijklmn")])

    def seen(df, rules=secrets.RULES):
        return spark.read.parquet(secrets.BlobLedger(spark, path).scan(secrets.versions(df), rules)).count()

    broken = [type("Rule", (), {"needles": (), "pattern": "(", "flags": 0})()]
    with pytest.raises(Exception):
        seen(one, broken)
    (tmp_path / "ledger" / "batch=000000").mkdir(parents=True, exist_ok=True)  # left by a batch that failed midway
    assert [seen(one), seen(one), seen(two)] == [2, 0, 1]
    for _ in range(2):
        got = secrets.scan_secrets(spark, two, ledger=secrets.BlobLedger(spark, path)).collect()
        assert sorted((r["doc_id"], len(r["findings"])) for r in got) == [(1, 0), (3, 1), (4, 0)]


def test_redaction(spark):
    data = [(i, t) for i, t in enumerate(SECRET_TEXTS)]
    df = brute.frame(spark, data)
    found = secrets.scan_secrets(spark, df).join(df.select("doc_id", "text"), "doc_id")
    for r in found.select("doc_id", "text", "findings", secrets.redact(F.col("text"), F.col("findings")).alias("clean")).collect():
        want, at = "", 0
        for f in r["findings"]:
            if f["start"] >= at:
                want += r["text"][at:f["start"]] + "[REDACTED]"
            at = max(at, f["end"])
        assert r["clean"] == (want + r["text"][at:] if r["findings"] else r["text"])


def test_bad_texts_take_linear_time():
    import time

    for text in ("eyJ" * 330_000, "eyJ" * 100_000 + "." + "eyJ" * 100_000, "-----BEGIN " * 90_000, "AKIA" * 250_000, "password " * 110_000,
                 "http://" * 140_000, "token" + " " * 1_000_000, "a+" * 500_000 + "://"):
        start = time.perf_counter()
        secrets.scan_text(text)
        assert time.perf_counter() - start < 5, text[:20]
    start = time.perf_counter()
    text = "token=abcdefghijklmnop " * 43_000
    clean = secrets.redact_text(text, [f[1:3] for f in secrets.scan_text(text)])
    assert clean == "[REDACTED] " * 43_000 and time.perf_counter() - start < 5


def test_jwt_is_found_as_by_the_plain_pattern():
    import random
    import re

    plain = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    rng, parts, hits = random.Random(5), ["eyJ", "a", "bcdefghijk", ".", "_", " ", "ABCDEFGHIJKLM", "e", "y"], 0
    for _ in range(50_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 18)))
        want = [m.span() for m in plain.finditer(text)]
        assert [f[1:3] for f in secrets.scan_text(text) if f[0] == "jwt"] == want
        hits += len(want)
    assert hits > 50


def test_redaction_of_nulls_and_overlaps(spark):
    found = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    data = [(0, None, [("a", 0, 1, True)]), (1, "", []), (2, "é secret x", [("a", 4, 8, True), ("b", 2, 6, True)]), (3, "kept", None)]
    df = spark.createDataFrame(data, f"doc_id int, text string, findings {found}")
    got = {r[0]: r[1] for r in df.select("doc_id", secrets.redact(F.col("text"), F.col("findings"))).collect()}
    assert got == {0: None, 1: "", 2: "é [REDACTED] x", 3: "kept"}


# Language

def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(docs).join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").filter("held_out").collect()
    assert 150 < len(got) < 350 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_language_edges(spark, docs, empty):
    got = language.identify_language(docs).collect()
    assert len(got) == docs.count()
    kinds = {r["doc_id"]: r["lang_pred"] for r in got}
    assert kinds[12] == kinds[13] == kinds[14] == "und" and kinds[3] == "en"
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert rows(language.identify_language(empty)) == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_language(unlabelled).collect()} == {"und"}


def many_letters(size, seed=1):
    """Letters of a script with many, by Zipf's law over 3500 of them."""
    import numpy as np

    share = 1 / np.arange(1, 3501)
    return "".join(map(chr, 0x4E00 + np.random.default_rng(seed).choice(3500, size, p=share / share.sum())))


def test_language_memory_does_not_follow_the_letters(monkeypatch):
    import tracemalloc

    text = many_letters(120_000)
    assert len({text[i:i + 3] for i in range(len(text) - 2)}) > 80_000
    monkeypatch.setattr(language, "_STATE", {})
    language.bundle(["warm"])
    tracemalloc.start()
    whole = language.bundle([text, *(text[i:i + 2000] for i in range(0, 120_000, 2000))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * 2**20
    assert abs(whole[1] - language.bundle([text[:2000]])[0]).max() < 1e-6


def test_language_slices_and_parts_change_nothing(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    texts = ["".join(rng.choices("aÀ ς.Σ\n漢字 b", k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "  ", "a", " a ", "..", many_letters(400)]
    monkeypatch.setattr(language, "_STATE", {})
    grams, want = language.GramVectors(), []
    for text in texts:  # brute force
        letters = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
        letters = " " + letters.lstrip(" ") + " " if letters.strip() else ""
        total = 0 * grams._letter(97).astype(float)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            total = total + np.roll(grams._letter(ord(a)), 2) * np.roll(grams._letter(ord(b)), 1) * grams._letter(ord(c))
        want.append(total / (sum(total * total)**0.5 or 1))
    for part, size, kept in ((1 << 20, 16_384, 40_000), (1, 5, 3), (7, 16, 20), (2, 1, 0)):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "SLICE", size)
        monkeypatch.setattr(language, "GRAMS_KEPT", kept)
        got = language.bundle(texts)
        assert max(abs(g - w).max() for g, w in zip(got, want, strict=True)) < 1e-5


def test_next_rows_with_many_ranges(spark):
    """Some thousand ranges: the lookup of a range must follow the number of bits, not a power of it."""
    ids = [*range(-50, 20_000, 3), *range(100, 400, 3), None, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    got = Counter((r["doc_id"], r["next_doc_id"]) for r in sketches.with_next(df, "doc_id", ["doc_id"], 3).collect())
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert got == Counter(zip(order, order[1:] + order[:1], strict=True))


# Fingerprints

@pytest.mark.parametrize("size", [5, 2000])
def test_fingerprints(spark, docs, empty, size, monkeypatch):
    monkeypatch.setattr(sketches.with_next, "__defaults__", (size,))
    got = sketches.fingerprint_documents(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("e"), "sketch", "next_sketch", "near_edited", "near_next").collect()
    own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.select("doc_id", "text").collect()))
    want = Counter()
    for i, (known, d, t) in enumerate(own):
        follow, half = own[(i + 1) % len(own)][2], len(t) // 2
        want[(d if known else None, len(t), brute.sha(t[:len(t) - half] + follow[:half]))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["e"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[15]["sketch"] == by_id[16]["sketch"] and by_id[13]["sketch"] == []
    assert rows(sketches.fingerprint_documents(empty)) == []


def test_likeness_estimates(spark):
    a, b = brute.prose(1, 4000, 10**6).split(), brute.prose(2, 4000, 10**6).split()
    pairs = [(" ".join(a), " ".join(a[:k] + b[k:])) for k in (0, 1000, 2000, 3000, 4000)]
    df = spark.createDataFrame(pairs, "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"), F.col("a").alias("s"), F.col("b").alias("t"))
    for r in df.select(sketches.likeness(F.col("a"), F.col("b")).alias("j"), sketches.containment(F.col("a"), F.col("b")).alias("c"), "s", "t").collect():
        x, y = brute.shingles(r["s"]), brute.shingles(r["t"])
        assert abs(r["j"] - len(x & y) / len(x | y)) < 0.06 and abs(r["c"] - len(x & y) / len(x)) < 0.06


# Pages

def test_pages_of_the_tables(spark):
    import html

    got = {r["page_id"]: r for r in queries.op6_html_text(spark, SF).collect()}
    own = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(own)
    for r in own:
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?p>|</?h1>", re.sub(r"</?b>|<br>", " ", inside))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


@pytest.fixture(scope="module")
def labeller():
    return pages.train([f"word{i}" for i in range(3000)])


def test_labeller_on_other_layouts(labeller):
    right = total = 0
    for page, labels in pages.training_pages([f"other{i}" for i in range(3000)], 150, seed=1234):
        found = pages.blocks(page)
        if found:
            got = labeller.predict(*pages.padded([pages.features(found)]))[:, 0] >= 0.5
            right, total = right + sum(g == bool(w) for g, w in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.99


def test_gradients_are_those_of_the_loss():
    import numpy as np

    model, rng = pages.BiLstm(5, 3, seed=2), np.random.default_rng(1)
    x, mask, y = rng.normal(size=(4, 2, 5)).astype(np.float32), np.ones((4, 2), np.float32), rng.integers(0, 2, (4, 2)).astype(np.float32)
    mask[3, 1] = 0
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        p = model.predict(x, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for name, value in model.p.items():
        flat, g = value.reshape(-1), grads[name].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 2e-3


def test_page_edges(spark, labeller):
    odd = [None, "", "no tags at all", "<p>unclosed", "<article><p>a &lt;b&gt; &amp;amp; c&#39;s", "<script>var x='<p>';</script><article><p>x</p></article>",
           "<article><p>" + "long " * 50_000 + "</p></article>", "<!-- only -->", "<article><p>a<b>b</b>\n c</p>"]
    df = spark.createDataFrame([(i, "u", t, "clash") for i, t in enumerate(odd)] + [(None, None, "", "c"), (4, "u", odd[4], "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(df, labeller).collect()}
    assert got[0] == got[1] == got[7] == got[None] == ""
    assert got[4] == "a <b> &amp; c's" and got[5] == "x" and got[8] == "ab c" and len(got[6]) == 249_999
    assert rows(pages.extract_pages(df.limit(0))) == []


def test_blocks_are_broken_where_blocks_start():
    found = pages.blocks("<div class='Main-content'>a<p>b <i>c</i><br>d<p>e</div><li>f<li>g<title>t</title><style>p{}</style>h</b></x>")
    assert [b.text for b in found] == ["a", "b c d", "e", "f", "g", "h"]
    assert tuple(found[1].path) == ("div", "main", "content", "p") == tuple(found[2].path)


def test_long_page_beside_short_ones(labeller):
    """Memory follows neither the longest page times the pages of a batch nor, but for its blocks, the page."""
    import tracemalloc

    short = "<nav><li>menu</li></nav><article>" + "<p>some words of the article</p>" * 12 + "</article><footer>end</footer>"
    long = "<nav><li>menu</li></nav><article>" + "<p>some words of the article</p>" * 20_000 + "</article><footer>end</footer>"
    pages.main_text([short], labeller)
    tracemalloc.start()
    got = pages.main_text([short] * 100 + [long], labeller)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * 2**20
    assert got[:100] == pages.main_text([short], labeller) * 100
    assert got[100].count("some words of the article") > 19_000


def test_slices_of_a_page_change_nothing(labeller, monkeypatch):
    made = [pages.blocks(p) for p, _ in pages.training_pages([f"w{i}" for i in range(500)], 40, seed=5)]
    made = [b for b in made if b]
    want = labeller.predict(*pages.padded([pages.features(b) for b in made]))
    texts = [p for p, _ in pages.training_pages([f"w{i}" for i in range(500)], 40, seed=5)]
    whole = pages.main_text(texts, labeller)
    for cells in (1, 7, 3 * len(made), 400):
        monkeypatch.setattr(pages, "CELLS", cells)
        got = labeller.predict_pages(made)
        assert all(abs(got[:len(b), j] - want[:len(b), j]).max() < 1e-4 for j, b in enumerate(made))
        assert pages.main_text(texts, labeller) == whole


def test_raw_elements_end_in_either_case():
    page = "<HTML><HEAD><TITLE>İstanbul</TITLE><STYLE>p{}</STYLE><SCRIPT>x='<p>'</ſcript></SCRIPT></HEAD><BODY><P>İyi günler<title>t</Title><p>son"
    assert [b.text for b in pages.blocks(page)] == ["İyi günler", "son"]


def test_bad_pages_take_linear_time():
    import time

    for page in ("<a " * 330_000, "<div>x" * 100_000, "<!" * 500_000, '<a x="' * 160_000 + ">", "<a x=\"'" * 140_000 + ">", "<" + "a" * 1_000_000,
                 "<div>" * 80_000 + "</p>" * 120_000, "<!--" * 250_000, "<" * 1_000_000 + ">", '<div class="a b c d">' * 48_000):
        start = time.perf_counter()
        pages.features(pages.blocks(page)[:1000])
        assert time.perf_counter() - start < 15, page[:20]


def test_broken_tags():
    def texts(page):
        return [b.text for b in pages.blocks(page)]

    assert texts("a<p title='it's>b<p>c") == ["a", "b", "c"]  # an open quote: the tag ends at the next >
    assert texts('<p title="x > y">b') == ["b"]
    assert texts("<p>1 < 2 <b") == ["1 < 2 <b"] and texts("<p>x<!-- no end") == ["x"] and texts("<p>x < y<!-- no end") == ["x < y"]
    deep = pages.blocks("<div class='one'>" * 3 + "x</div></p>y</div></div>z")
    assert [list(b.path) for b in deep] == [["div", "one"] * 3, ["div", "one"] * 2, []]
