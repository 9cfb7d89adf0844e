"""Tokenizers, fingerprints, licences, toxicity and language model on small rows."""

import functools
import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, common, cuts, exchange, licenses, pitman_yor, syncmers, token_counts, toxicity, windows


def by_row(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBPE(common.tokenizer_file(bpe.VOCABULARY), leaf=16, window=2)


@pytest.fixture(scope="module")
def counter():
    return token_counts.ChunkedCounter(common.tokenizer_file(token_counts.VOCABULARY), chunk=20, overlap=2)


words = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["'s", " ", "  ", "\n\n", "123", "don't", "<|endoftext|>", "é", "日本", "..."])), max_size=25).map("".join)


@settings(max_examples=150, deadline=None)
@given(words)
def test_tree_equals_library(tree, text):
    ids = tree.encode(text)
    assert ids == tree.base.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(words)
def test_chunked_counts_equal_library(counter, text):
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False))


@settings(max_examples=100, deadline=None)
@given(words)
def test_cuts_separate_tokens(tree, text):
    at = cuts.first_cut(text, 0, len(text))
    if at > 0:
        both = tree.base.encode_ordinary(text[:at]) + tree.base.encode_ordinary(text[at:])
        assert both == tree.base.encode_ordinary(text)


@pytest.mark.parametrize("text", ["한국어 문장 하나", "جملة عربية هنا", "हिन्दी का वाक्य", "ไทย ภาษา", "משפט בעברית", "ελληνική πρόταση", "日本 語", "a\u00a0b c", "x\u180e y z"])
def test_cuts_in_all_scripts(tree, counter, text):
    whole = text * 30
    places, p = [], cuts.first_cut(whole, 0, len(whole))
    while p >= 0:
        places.append(p)
        p = cuts.first_cut(whole, p, len(whole))
    assert len(places) >= 30
    for p in places[:40]:
        assert tree.base.encode_ordinary(whole[:p]) + tree.base.encode_ordinary(whole[p:]) == tree.base.encode_ordinary(whole)
    assert tree.encode(whole) == tree.base.encode_ordinary(whole)
    assert counter.count(whole) == len(counter.tokenizer.encode(whole, add_special_tokens=False))


def test_round_trip_rows(spark, docs, nothing, tree):
    found = by_row(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    wanted = Counter()
    for r in docs.collect():
        ids = tree.base.encode_ordinary(r.text or "")
        wanted[(r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert found == wanted
    assert bpe.round_trip(nothing).count() == 0
    again = bpe.decode(bpe.encode(docs))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())


def test_token_counts(docs, nothing, counter):
    for r in token_counts.count_tokens(docs.select("doc_id", "text"), chunk=300, overlap=20).collect():
        assert r.over_limit == (r.n_tokens > 512)
    found = by_row(token_counts.count_tokens(docs, chunk=300, overlap=20), "doc_id", "n_bytes", "n_tokens")
    wanted = Counter((r.doc_id, len((r.text or "").encode()), len(counter.tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    assert found == wanted and token_counts.count_tokens(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(words, st.sampled_from(["a\u00a0b c", "x\u180e y", "\x1c z", "\t\r\n", " \x0b q"])), max_size=6))
def test_pieces_equal_library(counter, texts):
    c = token_counts.ChunkedCounter(common.tokenizer_file(token_counts.VOCABULARY))
    assert c.in_pieces
    wanted = [c.tokenizer.encode(t, add_special_tokens=False) for t in texts]
    assert c.count_all(texts) == c.count_all(texts) == [len(e) for e in wanted]
    assert [c._starts(t, 0, len(t)) for t in texts] == [[a for a, _ in e.offsets] for e in wanted]
    assert counter.count_all(texts) == [len(e) for e in wanted]


def test_pieces_go_to_the_library_once(monkeypatch):
    c = token_counts.ChunkedCounter(common.tokenizer_file(token_counts.VOCABULARY))
    text = " ".join(f"word{i % 40}" for i in range(3000))
    seen = []

    class Spied:
        def encode_batch(self, texts, **options):
            seen.append(sum(map(len, texts)))
            return tokenizer.encode_batch(texts, **options)

    tokenizer, c.tokenizer = c.tokenizer, Spied()
    n = len(tokenizer.encode(text, add_special_tokens=False))
    assert c.count_all([text[:9000], text, text * 2])[1] == n
    assert 0 < sum(seen) < 1000
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 10)
    assert c.count_all([text + " more"]) == [len(tokenizer.encode(text + " more", add_special_tokens=False))]


def test_other_tokenizers_get_texts_whole(tmp_path):
    import json

    with open(common.tokenizer_file(token_counts.VOCABULARY), encoding="utf-8") as f:
        made = json.load(f)
    made["added_tokens"][0]["rstrip"] = True
    (tmp_path / "other.json").write_text(json.dumps(made), encoding="utf-8")
    c = token_counts.ChunkedCounter(str(tmp_path / "other.json"))
    text = "a <|endoftext|>  b"
    assert not c.in_pieces and c.count_all([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False))]


def test_syncmers(spark, docs, nothing):
    assert syncmers.report(nothing).count() == 0
    rows = syncmers.report(docs).collect()
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in order]
    wanted = Counter()
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        half = len(t) // 2
        wanted[(r.doc_id, len(t), hashlib.sha256((t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == wanted
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def brute_fingerprint(text, k=syncmers.K, s=syncmers.S):
    """Links of a text by plain loops, with Spark's hash."""
    fold = lambda h, v: xxhash.xxh64_intdigest(v, seed=h)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda values: functools.reduce(fold, (struct.pack("<Q", x) for x in values), 42)
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(syncmers.WORD_BREAK, text) if w]
    if not hashes:
        return []
    if len(hashes) < k:
        found = [(1, fold(42, " ".join(str(signed(h)) for h in hashes).encode()))]
    else:
        small = [signed(of(hashes[i : i + s])) for i in range(len(hashes) - s + 1)]
        found = []
        for i in range(len(hashes) - k + 1):
            inner = small[i : i + k - s + 1]
            if min(inner) in (inner[0], inner[-1]):
                found.append((i + 1, of(hashes[i : i + k])))
    if len(found) < 2:
        return [h & 0xFFFFFFFF for _, h in found]
    pairs = [fold(of([a[1], b[1]]), struct.pack("<i", b[0] - a[0])) & 0xFFFFFFFF for a, b in zip(found, found[1:])]
    return list(dict.fromkeys(pairs))


def test_syncmers_equal_brute_force(spark):
    r = random.Random(8)
    texts = ["", "one", "a b c", "a b c d e f", "日本語 テスト。" * 3] + [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(7, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    likeness = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    for row in syncmers.report(df).collect():
        t, after = texts[row.doc_id], texts[(row.doc_id + 1) % len(texts)]
        half = len(t) // 2
        own, changed = brute_fingerprint(t), brute_fingerprint(t[: len(t) - half] + after[:half])
        assert row.fingerprint == "".join(f"{x:08x}" for x in own)
        assert row.edited_fingerprint == "".join(f"{x:08x}" for x in changed)
        assert math.isclose(row.near_edited, likeness(own, changed))
        assert math.isclose(row.near_next, likeness(own, brute_fingerprint(after)))


def edited_hashes(rows):
    texts = [t for _, t in rows]
    out = Counter()
    for i, (k, t) in enumerate(rows):
        half = len(t) // 2
        out[(k, hashlib.sha256((t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_syncmers_across_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(syncmers, "BUCKET", 3)
    monkeypatch.setattr(syncmers, "SUPER", 2)
    ids = sorted({*range(0, 60, 2), 10**12, -5, -(1 << 63), (1 << 63) - 1})
    ids = [str(i) for i in ids] if kind == "string" else ids
    ids = sorted({float(i) for i in ids}) if kind == "double" else sorted(ids)
    df = spark.createDataFrame([(i, f"text number {i} with some more words") for i in ids], f"doc_id {kind}, text string")
    found = Counter((r.doc_id, r.edited_sha256) for r in syncmers.report(df).collect())
    assert found == edited_hashes([(i, f"text number {i} with some more words") for i in ids])


def test_syncmers_null_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET", 3)
    rows = [(None, f"no id {i}, some words") for i in range(20)] + [(i, f"text {i} of some words") for i in range(10)]
    h = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), seed=42)))[0]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h(x[1]) % (1 << 64) if x[0] is None else 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.edited_sha256) for r in syncmers.report(df).collect())
    assert found == edited_hashes(order)


def test_syncmers_context_free(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(shared,), ("before it " + shared + " after it",)], "text string")
    a, b = ({x["hash"] for x in r[0]} for r in df.select(syncmers.anchors(df.text)).collect())
    assert a <= b and len(a) > 10
    a, b = ({*r[0]} for r in df.select(syncmers.fingerprint(df.text)).collect())
    assert a <= b and len(a) > 10


def test_licenses(spark, docs, nothing):
    notice = "intro\nReleased  under the MIT LICENCE!\nmore"
    whole = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")
    df = spark.createDataFrame([(1, notice), (2, whole), (3, None), (4, "nothing"), (2, whole)], "doc_id long, text string")
    rows = sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text_licence, r.line_licences, r.n_license_lines) for r in rows] == [(1, None, "MIT", 1), (2, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "", 0), (4, None, "", 0)]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_every_known_licence(spark, monkeypatch):
    """Known texts, reflowed and with another holder, are found as whole documents; so are lines of any wording."""
    texts = [(n, "(c) 1999 Someone\nAll rights reserved.\n\n" + t.replace(", ", ",\n")) for n, t in licenses.KNOWN]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for small in (licenses.SMALL, 0):
        monkeypatch.setattr(licenses, "SMALL", small)
        assert {r.doc_id: r.text_licence for r in licenses.scan(df).collect()} == {i: n for i, (n, _) in enumerate(texts)}
    plain = spark.createDataFrame([(1, "Something.\nThis is in the PUBLIC domain\n\nThis is in the public domain.")], "doc_id long, text string")
    found = licenses.scan(plain, texts=[("PD", "This is in the public domain.")]).collect()
    assert [(r.line_licences, r.n_license_lines) for r in found] == [("PD", 2)]


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"])
def test_long_licences(spark, name):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no such text on this machine")
    with open(path, encoding="utf-8") as text:
        df = spark.createDataFrame([(1, text.read())], "doc_id long, text string")
    assert licenses.scan(df).first().text_licence.startswith(name)


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_labels_of_unknown_ids(spark, data):
    """Any number of labels without a document changes nothing; so does a bound on bytes that is not reached."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    of = lambda more, **k: {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, more, **k)).collect()}
    scores = of(labels)
    unknown = spark.range(10**9, 10**9 + 50_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS int) AS toxic")
    assert of(labels.unionByName(unknown)) == scores
    assert of(labels, size=16 << 20) == scores and of(labels, size=40_000) != scores
    assert set(of(labels, size=8).values()) == {0.0}


def test_toxicity_held_out(spark):
    """Held-out accuracy on whole tables: toxic rows found, others left alone."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_accuracy():
    r = random.Random(5)
    plain = ["".join(r.choice(["th", "er", "on", "an", "re", "ing", "at"]) for _ in range(r.randint(1, 4))) for _ in range(800)]
    bad = ["idiot", "worthless", "moron", "stupid", "disgusting"]

    def text(toxic):
        out = [r.choice(plain) for _ in range(r.randint(20, 200))]
        if toxic:
            for _ in range(r.randint(2, 6)):
                out.insert(r.randrange(len(out)), r.choice(bad))
        return " ".join(out)

    y = np.array([r.random() < 0.25 for _ in range(1200)])
    texts = pa.array([text(t) for t in y])
    model = toxicity.fit(texts.slice(0, 800), y[:800])
    right = (model.scores(texts.slice(800)) >= 0.5) == y[800:]
    assert right.mean() > 0.97


@pytest.mark.parametrize(("chunk", "bucket"), [(1_000_000, 1_000_000), (4000, 6000)])
def test_pitman_yor(spark, docs, nothing, monkeypatch, chunk, bucket):
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(pitman_yor, "BUCKET_KEYS", bucket)
    rows = pitman_yor.score(docs).collect()
    source = docs.select("doc_id", "text").collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = Counter(w for r in source if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r.text)), 5)) for r in source)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == wanted
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in rows)
    assert pitman_yor.score(nothing).count() == 0
    one = docs.where("doc_id = 0").limit(1)
    assert [r.doc_id for r in pitman_yor.score(one).collect()] == [0]


def test_hashes_of_words_without_strings():
    import time

    import xxhash

    texts = ["", "a", "é日本", "x" * 300, "a"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["q", *texts, "r"]).slice(1, 5), pa.array([], pa.string()), pa.array(["", ""])):
        assert common.hash_strings(column).tolist() == [xxhash.xxh3_64_intdigest(x) for x in column.to_pylist()]
    words = pa.array([f"word{i}" for i in range(300_000)], pa.large_string())
    times = []
    for f in (common.hash_strings, lambda c: np.fromiter((xxhash.xxh3_64_intdigest(x) for x in c.to_pylist()), dtype=np.uint64)):
        times.append([])
        for _ in range(3):
            begin = time.process_time()
            f(words)
            times[-1].append(time.process_time() - begin)
    assert min(times[0]) < 0.7 * min(times[1])


def test_distinct_keys_of_any_width():
    rng = np.random.default_rng(5)
    for top in (1, 5, 1 << 20, 1 << 58, (1 << 64) - 1):
        keys = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        keys[:2] = 0, top
        found, times, number = exchange.distinct(keys)
        wanted = np.unique(keys, return_inverse=True, return_counts=True)
        assert (found == wanted[0]).all() and (number == wanted[1]).all() and (times == wanted[2]).all()
    assert [len(x) for x in exchange.distinct(np.empty(0, dtype=np.uint64))] == [0, 0, 0]


def test_packed_structures():
    x = np.zeros(1000, dtype=pitman_yor._SEEN)
    x["customers"], x["tables"], x["parent"] = np.arange(1000) << 33, np.arange(1000), 7
    assert (exchange.unpacked(exchange.packed(x), x.dtype) == x).all()
    assert len(exchange.unpacked(exchange.packed(x[:0]), x.dtype)) == 0
    for top in (200, 1 << 30, 1 << 62):
        keys = np.unique(np.random.default_rng(1).integers(0, top, 500, dtype=np.uint64))
        assert (exchange.decoded(exchange.coded(keys)) == keys).all()


def test_workers_do_not_look_over_modules_after_each_task(spark):
    def run(batches):
        import gc

        for batch in batches:
            common.trim()
            yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * batch.num_rows, pa.int64())], names=["n"])

    assert spark.range(1).mapInArrow(run, "n long").first().n > 10_000


def brute_model(spark, docs):
    """Probabilities from the sampled seating by plain loops over words, with dictionaries."""
    model = pitman_yor.fit(docs.selectExpr("doc_id AS key", "text", "false AS held_out"))
    texts = [(r.text or "").lower().split() for r in docs.collect()]
    pairs, words = Counter(), sorted({w for t in texts for w in t} | {None}, key=str)
    for t in texts:
        pairs.update(zip(["<"] + t, [*t, None]))
    hashes = {w: pitman_yor.END if w is None else common.hash_strings(pa.array([w]))[0] for w in words}
    number = {w: i + 1 for i, w in enumerate(sorted(words, key=lambda w: hashes[w]))} | {"<": len(words) + 1}
    key = lambda v, w: np.array([number[v] << 32 | number[w]], dtype=np.uint64)
    tables, sweeps = None, []
    first, level = None, None
    for s in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        before = None if s == 0 else history[-1]
        if s == 0:
            history, tables = [], {p: 1 for p in pairs}
        else:
            sweep, t_v, t_w, m_w = before
            prob = lambda w: float(sweep.probability(np.array([t_w[w]]), np.array([m_w[w]]))[0])
            weight = {p: (sweep.pairs.strength + sweep.pairs.discount * t_v[p[0]]) * prob(p[1]) for p in pairs}
            tables = {p: int(pitman_yor.seat(common.mix64(key(*p)), np.array([c]), np.array([weight[p]]), sweep.pairs.discount, s)[0]) for p, c in pairs.items()}
        t_v, t_w = Counter(), Counter()
        for (v, w), t in tables.items():
            t_v[v] += t
            t_w[w] += t
        history.append([None, t_v, t_w, None])
        if s == 0:
            m_w = {w: 1 for w in t_w}
        else:
            m = sum(before[3].values())
            a = (before[0].parent.strength + before[0].parent.discount * m) / (len(words) + 1)
            m_w = {w: int(pitman_yor.seat(np.array([number[w]], dtype=np.uint64), np.array([c]), np.array([a]), before[0].parent.discount, s + 1000)[0]) for w, c in t_w.items()}
        history[-1][3] = m_w
        drawn = model.sweeps[s - pitman_yor.BURN_IN + 1] if s >= pitman_yor.BURN_IN - 1 else None
        history[-1][0] = drawn or SWEEPS[s + 1]
        if drawn:
            assert (drawn.customers, drawn.tables) == (sum(t_w.values()), sum(m_w.values()))
        sweeps.append((history[-1], tables))

    totals = Counter()
    for (v, _), c in pairs.items():
        totals[v] += c

    def p(v, w):
        out = 0.0
        for s in range(pitman_yor.BURN_IN, len(sweeps)):
            (now, t_v, t_w, m_w), tables = sweeps[s]
            of = sweeps[s - 1][0][0].pairs
            base = float(now.probability(np.array([t_w.get(w, 0)]), np.array([m_w.get(w, 0)]))[0])
            own = max(pairs[v, w] - of.discount * tables.get((v, w), 0), 0)
            out += (own + (of.strength + of.discount * t_v[v]) * base) / (of.strength + totals[v]) if totals[v] else base
        return out / pitman_yor.SAMPLES

    return p, words, texts


SWEEPS = []


def test_pitman_yor_equals_brute_force(spark, monkeypatch):
    """Scores of a small corpus against seating, sums and predictions by plain loops; probabilities sum to 1."""
    kept = pitman_yor.Sweep.__init__
    SWEEPS.clear()
    monkeypatch.setattr(pitman_yor.Sweep, "__init__", lambda self, *a: (kept(self, *a), SWEEPS.append(self))[0])
    r = random.Random(31)
    texts = [" ".join(r.choice("abcdefgh") * r.choice([1, 1, 2]) for _ in range(r.randrange(0, 40))) for _ in range(60)] + ["a b " * 120]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10], "doc_id long, text string")
    p, words, _ = brute_model(spark, df)
    for v in ("<", "a", "bb", "zz"):
        assert math.isclose(sum(p(v, w) for w in [*words, "unknown"]), 1, rel_tol=1e-9)
    again = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10**6 + i, f"a zz {i} b") for i in range(40)], "doc_id long, text string")
    again = again.where("doc_id < 1000 OR crc32(CAST(doc_id AS string)) % 10 = 0")
    held = {t.doc_id: t for t in pitman_yor.score(again).collect()}
    assert any(t.held_out and t.doc_id > 1000 for t in held.values())
    for row in again.collect():
        t = row.text.lower().split()
        assert math.isclose(held[row.doc_id].score, sum(math.log10(p(v, w)) for v, w in zip(["<"] + t, [*t, None])), rel_tol=1e-9)


def partitions(n):
    """All seatings of n customers, as lists of table sizes by order of arrival."""
    out = [[]]
    for _ in range(n):
        out = [[*s[:i], s[i] + 1, *s[i + 1 :]] for s in out for i in range(len(s))] + [[*s, 1] for s in out]
    return out


@pytest.mark.parametrize("d", [0.2, 0.75])
def test_tables_of_the_restaurant_process(d):
    """Stirling numbers, draws and restaurant weights against all seatings of few customers."""
    for c in (2, 3, 5, 7):
        weight = Counter()
        for s in partitions(c):
            weight[len(s)] += math.prod(math.prod(k - d for k in range(1, n)) for n in s)
        found = np.exp(pitman_yor.stirling(d)[c, 1 : c + 1])
        assert np.allclose(found, [weight[t] for t in range(1, c + 1)])
        a = 0.8
        p = np.array([weight[t] * a**t for t in range(1, c + 1)])
        drawn = pitman_yor.seat(np.arange(40_000, dtype=np.uint64), np.full(40_000, c), np.full(40_000, a), d, 3)
        assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / 40_000, p / p.sum(), atol=0.01)
    strength = 1.7
    for c, t in ((4, 2), (9, 5)):
        rising = sum(math.log(strength + k * d) for k in range(t)) - sum(math.log(strength + k) for k in range(c))
        assert math.isclose(pitman_yor.log_restaurants(np.array([c]), np.array([t]), strength, d), rising, rel_tol=1e-8)
    # Beyond EXACT customers: near the process itself.
    r = np.random.default_rng(1)
    a, n = 3.0, 400
    wanted = []
    for _ in range(300):
        t = 1
        for k in range(1, n):
            t += r.random() < a / (a + k - d * t)
        wanted.append(t)
    drawn = pitman_yor._grown(np.arange(3000, dtype=np.uint64), np.full(3000, n), np.full(3000, round(np.mean([min(t, 64) for t in wanted]) * 0 + _tables_at(a, d, 64))), np.full(3000, a), d, 2)
    assert abs(drawn.mean() / np.mean(wanted) - 1) < 0.1


def _tables_at(a, d, n):
    t = 1.0
    for k in range(1, n):
        t += a / (a + k - d * t)
    return t


def test_mix_and_its_inverse():
    x = np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64)
    assert (pitman_yor.unmix64(common.mix64(x)) == x).all()


def test_model_beats_base(spark):
    """Held-out texts of real size: better than the base, by words of any rank."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in pitman_yor.score(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.93 * sum(r.base_score for r in rows)


def test_sweeps_have_settled(spark):
    """Averaged are sweeps after the seating has left its start of one table for each dish."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pitman_yor.fit(df.selectExpr("doc_id AS key", "text", "crc32(CAST(doc_id AS string)) % 10 = 0 AS held_out"))
    kept = [s.customers for s in model.sweeps[1:]]
    assert len(kept) >= 4 and max(kept) - min(kept) < 0.005 * max(kept)


@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(2, 12))
@settings(max_examples=60, deadline=None)
def test_anchors_cover_windows(texts, size):
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    a = windows.anchors(data, bounds, size, max(1, size // 3))
    covered = sorted(p for f, last in zip(a["first"], a["last"], strict=True) for p in range(f, last + 1))
    assert covered == [p for i in range(len(texts)) for p in range(bounds[i], bounds[i + 1] - size + 1)]


def test_anchors_of_long_pieces(monkeypatch):
    """Places beyond PLACE, and ties across it, in random and in periodic bytes."""
    monkeypatch.setattr(windows, "PLACE", np.uint64(63))
    r = random.Random(9)
    size, gram = 20, 5
    for data in (bytes(r.choice(b"ab") for _ in range(1000)), b"abcdefg" * 150, b"a" * 700):
        a = windows.anchors(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), size, gram)
        code = windows.Hashes(np.frombuffer(data, dtype=np.uint8)).all_of(gram)
        order = code & ~np.uint64(63)
        wanted = [p + int(np.argmin(order[p : p + size - gram + 1])) for p in range(len(data) - size + 1)]
        found = [place for place, first, last in zip(a["place"], a["first"], a["last"], strict=True) for _ in range(first, last + 1)]
        assert found == wanted
        assert a["gram"].tolist() == code[a["place"]].tolist()
