"""Archives, near-duplicates, repeats, leaks and the pipeline on small rows."""

import base64
import hashlib
import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import common, dart_minhash, decontaminate, exchange, suffix_dedup, warc_zip


def test_warc_round_trip(spark):
    rows = [(3, "http://a b\n", "same"), (1, None, "same"), (1, "u", "same"), (None, "u", "same"), (4, "u", None), (5, "u", ""), (6, "é", "yé" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    for zip64 in (False, True):
        manifest = warc_zip.write(df, zip64=zip64)
        found = warc_zip.read(manifest).collect()
        assert Counter((r.key, r.payload_bytes, r.payload_digest) for r in found) == Counter((k, len((h or "").encode()), digest(h)) for k, _, h in rows)
        same = [r for r in found if r.payload_digest == digest("same")]
        assert [(r.key, r.refers_to) for r in same if r.record_type == "response"] == [(1, None)]
        assert sorted(str(r.key) for r in same if r.refers_to == 1) == ["1", "3", "None"]
        for r in manifest.collect():
            with zipfile.ZipFile(warc_zip.filesystem(r.archive)[1]) as z:
                assert z.testzip() is None and len(z.namelist()) == 2
    kept = warc_zip.read(warc_zip.write(df, min_bytes=5)).collect()
    assert sum(r.record_type == "revisit" for r in kept) == 0
    assert warc_zip.round_trip(df.limit(0)).count() == 0


def test_warc_rows_and_tasks(spark, monkeypatch):
    """Records have names of their own, and reading tasks grow with the archives."""
    rows = [(None if i % 3 == 0 else i % 5, "u", f"{random.Random(i).random()}" * 200 if i % 2 else "common") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc_zip, "TASK_BYTES", 2000)
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 1500)
    for small in (warc_zip.SMALL, 0):
        monkeypatch.setattr(warc_zip, "SMALL", small)
        manifest = warc_zip.write(df)
        back = warc_zip.read(manifest)
        assert back.rdd.getNumPartitions() >= 3
        found = back.collect()
        assert Counter(r.record_type for r in found) == {"response": 31, "revisit": 29}
        assert {r.refers_to for r in found if r.record_type == "revisit"} == {0}
    assert warc_zip._record_id(1, 5) != warc_zip._record_id(1, 6) and warc_zip._key_of(warc_zip._record_id(None, 3)) is None


def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, nothing):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(50)] + [None, "", "a" * 70, "a" * 70, "é" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (9, 20):
        found = [tuple(x)[1:] for x in sorted(suffix_dedup.report(df, size=size).collect())]
        assert found == brute_repeats(texts, size)
    rows = docs.select("doc_id", "text").collect()
    found = Counter(tuple(x)[1:] for x in suffix_dedup.report(docs).collect())
    assert found == Counter(brute_repeats([x.text for x in rows], suffix_dedup.SIZE))
    assert suffix_dedup.report(nothing).count() == 0
    kept = suffix_dedup.rewrite(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.where("doc_id = 0").first().text is None
    assert suffix_dedup.remove(docs).where("doc_id = 5").first().n_removed == len(rows[5].text)


def test_suffix_dedup_passes(spark, monkeypatch):
    """Digits, chunks, parts and buckets of any size; passages cut at every place."""
    for name, value in {"DIGITS": (12, 9, 9), "CHUNK": 400, "PART": 150, "BUCKET_KEYS": 400}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(17)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    texts = []
    for _ in range(40):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if texts and r.random() < 0.7:
            other = r.choice(texts)
            at = r.randrange(len(other) + 1)
            t = t[: len(t) // 2] + other[at : at + r.randint(20, 120)] + t[len(t) // 2 :]
        texts.append(t)
    texts += ["x" * 700, texts[0] * 3, "common passage that is in many of them " * 2] + [f"{i} common passage that is in many of them {i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [tuple(x)[1:] for x in sorted(suffix_dedup.report(df, size=30, gram=7).collect())]
    assert found == brute_repeats(texts, 30)


def test_suffix_dedup_of_long_texts(spark):
    """Repeats beyond 8 MiB of a text, across its parts and to other texts."""
    r = random.Random(23)
    long = "".join(f"{r.getrandbits(64):016x}" for _ in range(600_000))
    passage = "".join(f"{r.getrandbits(64):016x}" for _ in range(20))
    cut = suffix_dedup.PART
    a = long[:9_000_000] + passage + long[9_000_000:]
    b = "short one " + passage + " and " + long[cut - 130 : cut + 150]
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    found = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.report(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found[1] == (320 + 280, 2, sha(long[: cut - 130] + long[cut + 150 :]))
    assert found[2] == (320 + 280, 2, sha("short one  and "))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50).map(sorted))
def test_coded_keys(keys):
    assert exchange.decoded(exchange.coded(np.array(keys, dtype=np.uint64))).tolist() == keys


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_near_duplicates(spark, docs, nothing, monkeypatch, small):
    for name in ("SMALL_PAIRS", "SMALL_CLASSES", "SMALL_KINDS"):
        monkeypatch.setattr(dart_minhash, name, small)
    r = random.Random(7)
    texts = []
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([12, 60, 300]))]
        texts += [" ".join(edited(r, base, k)) for k in (0, 0, 1, 2, 4, 8)]
        texts.append(" ".join(base[: len(base) // 2] + [f"x{r.randrange(10**6)}" for _ in base]))
    texts += ["", None, "A b", "a  B", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.class_id for x in dart_minhash.report(df).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows, hashes = dart_minhash.cells(pa.array(texts))
    sets = [set(hashes[rows == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if (not either) or len(sets[i] & sets[j]) / either >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in range(len(texts))}
    assert dart_minhash.report(nothing).count() == 0
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2  # two repeats of row 4


@pytest.mark.parametrize("place", [0, 15, 30])
def test_near_duplicates_hub(spark, monkeypatch, place):
    """Copies that only their hub links are one class, wherever the hub stands."""
    monkeypatch.setattr(dart_minhash, "BLOCK", 4)
    r = random.Random(11)
    hub = [f"w{i}" for i in range(300)]
    texts = []
    for c in range(30):
        copy = list(hub)
        for k, at in enumerate(r.sample(range(10, 290, 10), 6)):
            copy[at] = f"c{c}x{k}"
        texts.append(" ".join(copy))
    texts.insert(place, " ".join(hub))
    pairs = dart_minhash.similarity(pa.array([" ".join(hub)] * 30), pa.array([t for t in texts if t != " ".join(hub)]))
    assert (pairs >= 0.8).all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.class_id for x in dart_minhash.report(df).collect()} == {0}


def test_near_duplicates_recall(spark):
    """Of 400 separate pairs just above the threshold, 0.9 at least are found (0.999 by formula)."""
    r = random.Random(21)
    texts, pairs = [], []
    while len(pairs) < 400:
        base = [f"g{len(pairs)}w{i}" for i in range(r.choice([40, 90, 250]))]
        a, b = " ".join(base), " ".join(edited(r, base, max(1, len(base) // 60)))
        if 0.8 <= dart_minhash.similarity(pa.array([a]), pa.array([b]))[0] <= 0.9:
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.class_id for x in dart_minhash.report(df).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(found[a] in (a, b) and found[b] in (a, b) for a, b in pairs)


@pytest.mark.parametrize("few", [1, 256])
def test_shared_cells(monkeypatch, few):
    monkeypatch.setattr(dart_minhash, "FEW", few)
    monkeypatch.setattr(dart_minhash, "PAIRS", 1000)
    monkeypatch.setattr(dart_minhash, "CELLS", 7)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))) for _ in range(25)]
    row, cell = np.repeat(np.arange(25), [len(x) for x in sets]), np.concatenate(sets).astype(np.uint64)
    x, y = np.arange(0, 25, 2), np.arange(5, 25)
    found = dart_minhash._shared_cells(row, cell, x, y, 25)
    assert found.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]


def test_signatures_estimate_similarity():
    r = random.Random(2)
    errors = []
    for _ in range(60):
        a = [str(r.randrange(50)) for _ in range(r.choice([8, 80, 500]))]
        pair = pa.array([" ".join(a), " ".join(edited(r, a, len(a) // 40 + 1))])
        rows, hashes = dart_minhash.cells(pair)
        s = dart_minhash.signatures(rows, hashes, 2)
        errors.append((s[0] == s[1]).mean() - dart_minhash.similarity(pair.slice(0, 1), pair.slice(1))[0])
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21)] + [(i, i + 1) for i in range(100, 140)]
    found = dict(dart_minhash.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert found[4] == 1 and found[9] == 7 and found[21] == 20 and {found[i] for i in range(100, 141)} == {100}


def test_leaks(spark, docs, nothing):
    question = "Every morning Anna buys 5 apples and 3 pears for Bob, and Anna pays 5 dollars in the shop."
    bench = spark.createDataFrame([(1, question), (2, "short one here"), (3, None), (4, ""), (1, question)], "item_id long, text string")
    swapped = "so. Every morning Carla buys 7 apples and 4 pears for Dan, and Carla pays 7 dollars in the shop. ok"
    mixed = "Every morning Carla buys 7 apples and 4 pears for Dan, and Eve pays 9 dollars"
    df = spark.createDataFrame([(1, swapped), (2, mixed), (3, "a SHORT one, here"), (4, None), (5, ""), (6, "clean words only")], "doc_id long, text string")
    rows, items = common.with_row(df), common.with_row(bench)
    for limit in (decontaminate.FILTER_WINDOWS, 0):  # with and without the filter
        pairs = decontaminate.leaks(rows, items, filter_windows=limit)
        named = pairs.join(rows, "__row").select("doc_id").distinct()
        assert sorted(r.doc_id for r in named.collect()) == [1, 3]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.report(df, bench).collect()) == [(1, 1), (1, 1), (3, 2)]
    exact = spark.createDataFrame([(1, "Before. short one here"), (2, "short one")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.report(exact, bench).collect()] == [(1, 2)]
    assert decontaminate.report(docs, bench.limit(0)).count() == 0 and decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.remove(docs, bench).count() == docs.count()


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "short one"), (3, "42"), (4, "she went to Paris")], "item_id long, text string")
    docs = ["We saw Paris.", "a short, ONE", "one short", "about 42 of them", "nothing of it", "she went to Rome", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.report(df, bench).collect()) == [(0, 1), (1, 2), (3, 3), (5, 4)]


def brute_leaks(docs, items):
    """Pairs by plain loops over tokens, as the docstring has them."""
    trim, numbers, units = decontaminate.TRIM, decontaminate.NUMBERS, decontaminate.UNITS
    width_most, short = decontaminate.WINDOW, decontaminate.SHORT

    def tokens(text):
        out, start = [], True
        for raw in (text or "").split():
            bare = raw.strip(trim)
            if not bare:
                continue
            low = bare.lower()
            kind = "#" if any(c in "0123456789" for c in bare) or low in numbers else "unit" if low in units else "name" if not start and len(bare) > 1 and bare[0].isupper() and bare[1].islower() else ""
            out.append((kind or low, low, bool(kind)))
            start = raw.rstrip("\"'”’)]")[-1:] in (".", "!", "?")
        return out

    def windows(t, width, by_value):
        for p in range(len(t) - width + 1):
            part = t[p : p + width]
            template = width >= short and 2 * sum(not x[2] for x in part) >= width
            if template != by_value:
                yield p, tuple(x[1 if by_value else 0] for x in part), tuple(x[:2] for x in part if x[2])

    out = set()
    for i, item in enumerate(items):
        t = tokens(item)
        width = min(width_most, len(t))
        if not width:
            continue
        known = [(p, v, key, slots) for v in (False, True) for p, key, slots in windows(t, width, v)]
        templates = sum(not v for _, v, _, _ in known)
        for d, doc in enumerate(docs):
            aligned = {}
            for v in (False, True):
                for p, key, slots in windows(tokens(doc), width, v):
                    for q, w, other, own in known:
                        if w == v and other == key:
                            aligned.setdefault(p - q, []).append((q, v, own, slots))
            places, long = set(), False
            for found in aligned.values():
                same = {(q, v) for q, v, own, slots in found if own == slots}
                pairs = {x for _, _, own, slots in found for x in zip(own, slots)}
                consistent = len({a for a, _ in pairs}) == len(pairs)
                places |= {(q, v) for q, v, _, _ in found} if consistent else same
                run = sorted({q for q, _ in same}) if width == width_most else []
                step = decontaminate.VERBATIM - width_most
                long |= any(q + step in run and all(q + k in run for k in range(step)) for q in run)
            n = sum(not v for _, v in places)
            part = n >= decontaminate.COVERAGE * templates if templates else len(places) >= decontaminate.COVERAGE * len(known)
            if places and (long or part):
                out.add((d, i, len(places), len(known)))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(12)
    pool = ["red", "box", "the", "of", "sells", "Anna", "Bob", "Carla", "5", "7", "12", "km", "dollars", "hour", "shop.", "and", "(two)", "…"]
    items = [" ".join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(25)] + ["", None, "and"]
    docs = [None, ""]
    for _ in range(60):
        part = items[r.randrange(25)].split()
        at = r.randrange(len(part))
        exchange = dict(zip(("Anna", "5", "km", "Bob"), r.sample(["Bob", "Anna", "7", "12", "hour", "Carla"], 4)))
        part = [exchange.get(w, w) if r.random() < 0.9 else w for w in part[at:]]
        docs.append(" ".join([*(r.choice(pool) for _ in range(r.randrange(8))), *part, *(r.choice(pool) for _ in range(r.randrange(8)))]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {tuple(x) for x in decontaminate.report(df, bench).collect()}
    assert found == brute_leaks(docs, items) and len(found) > 30


def test_leaks_of_part(spark):
    r = random.Random(4)
    long_item = [f"word{r.randrange(10**6)}" for _ in range(200)]
    numbers = "we counted 5 red boxes and 3 blue boxes on the shelf"
    heavy = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 are all"
    names = "the letter that Anna wrote was read by all of the neighbours while the rain fell on the old roof of Anna last night"
    bench = spark.createDataFrame([(1, " ".join(long_item)), (2, numbers), (3, heavy), (4, names)], "item_id long, text string")
    docs = [
        "so " + " ".join(long_item[80:130]) + " end",  # a quarter of the item is not reached
        "so " + " ".join(long_item[80:92]) + " end",  # 12 tokens
        numbers.replace("5", "4").replace("3", "4"),  # two values exchanged for equal ones
        "so 1 2 3 4 5 6 7 8 9 10 11 12 13 14 end",  # nearly all placeholders
        names.replace("of Anna", "of Bob").replace("that Anna", "that Eve"),  # one inconsistent slot
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.report(df, bench).collect()) == [(0, 1), (2, 2), (3, 3), (4, 4)]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out) and kept <= {r.doc_id for r in docs.collect()}
    classes = {}
    for r in dart_minhash.report(docs).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert all(len(kept & c) <= 1 for c in classes.values())
    leaked = {r.doc_id for r in decontaminate.report(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert not leaked & kept
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.token_ids) for r in out)
