import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colsieve.llm import ann, bpe, common, components, langid, neardup, packing, quality, queries, rules, sharding, suffix_dedup, warc
from colsieve.session import shared_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(n, seed=0, size=400):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(size) for _ in range(n))


def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns whose names clash with our own."""
    long = words(60_000, 5, 50_000)
    rows = [(1, None, None), (2, "", "en"), (3, "  \n\t ", None), (None, "no id at all", "en"), (4, long, "en"), (4, long, "en"), (5, "é" * 900, "fr"), (6, "one two", None), (7, "\x00 <|endoftext|> ½ 日本", "de"), (8, words(200, 1), "en"), (9, words(200, 1), "en"), (10, "a" * 1000, "en"), (None, None, None)]
    df = spark.createDataFrame([(*r, "src", 0) for r in rows], SCHEMA)
    return df.select("*", *(F.lit(1).alias(c) for c in ("id", "row", "tag", "n_words", "kept", "score", "shard", "ranges", "core", "mark", "length", "part")))


def one_row_each(df, out):
    assert out.count() == df.count()


# --- 1 ------------------------------------------------------------------------------------------


def removed_by_force(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(x[p : p + length] for x in data.values() for p in range(len(x) - length + 1))
    out = {}
    for i, x in data.items():
        covered = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                covered[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out[i] = (len(x), int(covered.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(x, covered, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("group_rows", [suffix_dedup.GROUP_ROWS, 2])
def test_suffix_dedup_equals_brute_force(spark, docs, texts, group_rows):
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs, group_rows=group_rows).collect()}
    assert got == removed_by_force(texts, 400)


def test_suffix_dedup_on_repetitive_text(spark):
    r = random.Random(3)
    base = "".join(r.choice("ab") for _ in range(300))
    texts = {0: "a" * 200, 1: "ab" * 150, 2: base, 3: base[50:200] + "c" + base[:90], 4: base, 5: None, 6: "", 7: "x" + base[10:80] + base[10:80], 8: "é" * 60, 9: "zé" * 31}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    for window, group_rows in ((12, 512), (20, 2)):
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, length=40, window=window, group_rows=group_rows).collect()}
        assert got == removed_by_force(texts, 40)
    full = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, length=40, window=12, with_spans=True).collect()}
    assert full[2]["kept_text"] == "" and full[2]["spans"][0]["end"] == 300 and full[8]["kept_text"] == ""


def test_suffix_dedup_of_a_hot_core(spark):
    """A line that many texts share is in one core with as many contexts: the group is parsed deeper, not gathered."""
    line = words(60, 8)
    texts = {i: words(30 + i % 7, i + 100) + " " + line[i % 5 :] + " " + words(25, 1000 + i // 2) for i in range(300)}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    for group_rows in (512, 20):
        assert {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, length=60, window=24, group_rows=group_rows).collect()} == removed_by_force(texts, 60)


def test_phrases_of_slices_are_those_of_the_whole():
    r = np.random.default_rng(4)
    for raw in (r.integers(97, 105, 5000, dtype=np.uint8).tobytes(), b"ab" * 2500, bytes(399), bytes(400)):
        whole = suffix_dedup.phrases(raw)
        for slice_ in (1, 97, 1000):
            assert all((a == b).all() for a, b in zip(whole, suffix_dedup.phrases(raw, slice_=slice_), strict=True))


def test_short_runs_stay(spark):
    line, passage = words(30, 1), words(51, 2)
    texts = [words(80, 10 + i) + "\n" + (line if i < 3 else passage) + "\n" + words(80, 20 + i) for i in range(6)]
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.stripped(df, length=100, window=40, min_words=51, length_col="n_chars").collect()}
    assert all(got[i]["text"] == texts[i] for i in range(3)) and all(passage not in got[i]["text"] and len(got[i]["text"]) < len(texts[i]) - 200 for i in range(3, 6))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# --- 2 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (9, None, "y" * 200), (3, "http://c\r\nd e", "y" * 200), (5, "u", "y" * 200), (5, "u", "y" * 200), (6, "u", None), (None, "u", "y" * 200), (3, "http://c\r\nd e", "y" * 200), (7, "u", "é\r\n\r\n" * 50)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = 3 if len(raw) == 200 and i not in (None, 3) else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=str)
    uri = shared_dir(spark, "warc-test")
    manifest = warc.write_archives(df.filter("page_id IS NOT NULL"), uri, bundle_bytes=500)
    assert manifest.count() > 1
    full = {(r["record_id"], r["record_type"]): bytes(r["payload"]) for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert full["7", "response"] == ("é\r\n\r\n" * 50).encode() and full["5", "revisit"] == b""
    reader = next(b for b in (warc.open_bundle(r["bundle"]) for r in manifest.collect()) if "7" in [e[0] for e in b.index])
    assert warc.parse_record(reader.get("7"))[1] == ("é\r\n\r\n" * 50).encode()
    assert warc.round_trip(df.limit(0)).count() == 0
    again = warc.write_archives(df.filter("page_id IS NOT NULL"), uri, bundle_bytes=500)  # into the same folder: no file is replaced, each manifest names its own
    assert not {r["bundle"] for r in again.collect()} & {r["bundle"] for r in manifest.collect()}
    assert sorted(map(tuple, warc.read_archives(again).collect()), key=str) == sorted(map(tuple, warc.read_archives(manifest).collect()), key=str)


def test_warc_of_an_id_on_several_payloads(spark):
    a, b, own, short = "a" * 200, "b" * 200, "c" * 200, "d" * 9
    pages = [(1, "u", a), (2, "u", b), (7, "u", a), (7, "u", b), (7, "u", own), (7, "u", short)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    manifest = warc.write_archives(df, shared_dir(spark, "warc-test"))
    got = [(r["record_id"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in warc.read_archives(manifest, with_payload=True).collect()]
    refers = {(7, a): "1", (7, b): "2"}
    want = [(str(i), hashlib.sha256(h.encode()).hexdigest(), "revisit" if (i, h) in refers else "response", refers.get((i, h)), "" if (i, h) in refers else h) for i, _, h in pages]
    assert sorted(got, key=str) == sorted(want, key=str)


# --- 3 ------------------------------------------------------------------------------------------


def test_packing(spark, docs, texts):
    path = bpe.vocabulary()
    rows = packing.pack(docs, path, with_ids=True).collect()
    own = bpe.ForcedBoundaryBPE(path)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = own.tokenizer.encode(t, add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["ids"]] == ids and [p["start"] for p in parts] == [4096 * k for k in range(len(parts))]
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = sorted((r["length"] for r in rows), reverse=True)
    free: list[int] = []  # plain best-fit decreasing
    for n in lengths:
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda k: free[k])
            free[i] -= n
        else:
            free.append(4096 - n)
    assert len(by_bin) == len(free)


def test_plan_equals_plain_best_fit():
    r = random.Random(1)
    for _ in range(30):
        lengths = Counter(r.choice([r.randrange(1, 65), 7, 33]) for _ in range(r.randrange(0, 200)))
        plan = packing.plan_best_fit(dict(lengths), 64)
        free: list[int] = []
        for n in sorted(lengths.elements(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= n
            else:
                free.append(64 - n)
        used = Counter()
        for n, _, count, first, _ in plan:
            for b in range(first, first + count):
                used[b] += n
        assert sorted(64 - v for v in used.values()) == sorted(free)
        assert sum(plan[:, 2]) == sum(lengths.values()) if len(plan) else not lengths


# --- 4 ------------------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    out = {r["doc_id"]: r for r in langid.identify(odd(spark), langid.train(docs)).collect()}
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (1, 2, 3)) and out[8]["lang_pred"] != "und"
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def gram_share(raw, bucket_of):
    """Relative frequencies by a plain walk over the grams."""
    padded = " " + raw + " "
    seen = Counter(bucket_of(padded[i : i + w]) for w in (1, 2, 3) for i in range(len(padded) - w + 1))
    return {b: n / seen.total() for b, n in seen.items()}


def gram_bucket(gram):
    h = 0
    for c, (k, add) in zip(gram.lower().encode(), ((2654435761, 0), (2246822519, 1), (668265263, 7)), strict=False):
        h = c * k if add == 0 else ((h ^ (c + add) * k) * (3266489917 if add == 1 else 374761393))
        h &= 0xFFFFFFFF
    return h >> 32 - langid.BUCKETS.bit_length() + 1


def test_gram_frequencies_equal_a_plain_count_in_any_slices():
    text = words(300, 6) + " The QUICK brown"
    want = gram_share(text, gram_bucket)
    for chunk in (1, 2, 3, 10, 1000, 1 << 20):
        got = langid.frequencies(text.encode(), chunk)
        assert {int(b): round(float(got[b]), 12) for b in np.flatnonzero(got)} == {b: round(v, 12) for b, v in want.items()}


def test_language_scores_equal_a_plain_evaluation(spark):
    """Family, then votes and margins of the pairs, from given weights on plain dictionaries."""
    r = np.random.default_rng(2)
    weights = lambda: r.normal(size=langid.BUCKETS + 1)
    families = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "xx": ["xx"]}
    pairs = {p: weights() for p in (("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr"))}
    model = langid.LanguageModel(families, np.ones(langid.BUCKETS), {f: weights() for f in families}, pairs)
    texts = {i: words(40, i) for i in range(30)} | {50: "", 51: "12 34", 52: None, 53: "A", 54: words(40, 3)}
    df = spark.createDataFrame([(i, t, i, "x") for i, t in texts.items()], "doc_id bigint, text string, id int, held_out string")
    got = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    for i, t in texts.items():
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        share = gram_share(t, gram_bucket)
        margin = lambda w: sum(v**0.5 * w[b] for b, v in share.items()) + w[-1]  # noqa: E731, B023
        sigmoid = lambda m: 1 / (1 + np.exp(-m))
        family = max(families, key=lambda f: margin(model.family[f]))  # noqa: B023
        votes, total = Counter(), Counter()
        for (a, b), w in pairs.items():
            if a in families[family]:
                m = margin(w)
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        best = max(families[family], key=lambda c: (votes[c], total[c]))  # noqa: B023
        score = sigmoid(2 * margin(model.family[family])) * (sigmoid(2 * total[best] / (len(families[family]) - 1)) if len(families[family]) > 1 else 1)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - score) < 1e-9
    assert got[54]["lang_pred"] == got[3]["lang_pred"] and got[54]["score"] == got[3]["score"]


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda x, langs: Counter(langs))
    rows = [(i, f"text {i}", f"x{i % 230:03d}") for i in range(230 * 30)] + [(i, "rare", "zz") for i in range(10_000, 10_010)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names = {r[2] for r in rows}
    assert set(langid.train(df)) == names
    monkeypatch.setattr(langid, "MAX_TEXTS", 500)
    few = langid.train(df)
    assert set(few) == names and sum(few.values()) <= 500
    monkeypatch.setattr(langid, "MAX_TEXTS", 100)
    with pytest.raises(ValueError):
        langid.train(df)


# --- 5 ------------------------------------------------------------------------------------------


def measured_by_force(text):
    ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_ledger(spark, docs, texts):
    extra = odd(spark)
    for df in (docs, extra):
        rows = rules.ledger(df).collect()
        want = Counter((r["doc_id"], *measured_by_force(r["text"])) for r in df.collect())
        assert Counter(tuple(r)[:6] for r in rows) == want
        for r in rows:
            assert bool(r["failed_bits"] & 1) == (r["n_words"] < 50) and bool(r["failed_bits"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert rules.passing(extra, rules.FULL).columns == extra.columns and rules.passing(extra, rules.BASE).count() == 4
    ledger = rules.stored_ledger(docs)
    measured = ledger.collect()
    assert Counter(map(tuple, measured)) == Counter(map(tuple, rules.ledger(docs).collect()))
    versions = [rules.policy("base", 1), rules.policy("base"), rules.policy("full")]
    assert [p.version for p in versions] == [1, 2, 1]
    for r in rules.verdicts(ledger, versions).collect():
        base = r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]
        assert (r["base_v1"], r["base_v2"], r["full_v1"]) == (base, base and 100 * r["n_dup_lines"] <= 50 * r["n_lines"], r["failed_bits"] == 0)
    with pytest.raises(ValueError):
        rules.policy("base", 9)
    assert rules.stored_ledger(docs.limit(0)).count() == 0
    for r in rules.ablation(ledger, rules.FULL).collect():
        without = rules.Policy("t", 1, tuple(n for n in rules.FULL.rules if n != r["rule"]))
        assert r["kept_without"] == ledger.filter(~rules.fails(without)).count()
    assert rules.measure(b"a\x1cb c\xc2\xa0d")[:2] == (2, 6)


# --- 6 ------------------------------------------------------------------------------------------


def components_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    common = Counter((a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(docs).collect()}
    assert got == components_by_force(texts)


def test_near_duplicates_in_large_regions(spark, monkeypatch):
    """A region in many blocks: chains of edits, copies, and texts that resemble without being linked."""
    monkeypatch.setattr(neardup, "REGION_ROWS", 8)
    r = random.Random(9)
    base, texts = words(120, 2).split(), {}
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        texts[i] = " ".join(w)
    other = words(120, 77).split()
    for i in range(90, 120):
        other[r.randrange(120)] = "f%d" % i  # each links with its neighbours in time only
        texts[i] = " ".join(other)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = {x["doc_id"]: tuple(x)[1:] for x in neardup.near_duplicates(df).collect()}
    assert got == components_by_force(texts)


def test_near_duplicates_odd_rows(spark):
    df = odd(spark)
    got = {}
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        got[r["doc_id"]] = tuple(r)[1:]
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[9][1:] == (8, False) and got[8][1:] == (8, True) and got[6] == (1, 6, True) and got[None][1:] == (None, True)
    kept = neardup.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [0, 5, components.FINISH_EDGES])
def test_components(spark, finish):
    edges = [(i, i + 1) for i in range(12)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), finish_edges=finish).collect()}
    assert got == {i: 0 for i in range(13)} | {100: 90, 90: 90, 95: 90}
    assert components.connected_components(spark.createDataFrame([(7, 7)], "a bigint, b bigint"), finish_edges=finish).count() == 0


def test_forest_links_are_neighbours_with_their_common_prefix(spark):
    sets = [np.unique(np.random.default_rng(i // 4).integers(0, 1 << 62, 200, dtype=np.uint64)[: 200 - 9 * (i % 4)]) for i in range(80)]
    signatures = [np.frombuffer(neardup.signature(s), np.uint16) for s in sets]
    want = {}
    for tree in range(neardup.TREES):
        keys = sorted((np.take(g, range(tree * neardup.OWN, tree * neardup.OWN + neardup.DEPTH), mode="wrap").tobytes(), i) for i, g in enumerate(signatures))
        for (x, i), (y, j) in zip(keys, keys[1:], strict=False):
            depth = next((d for d in range(neardup.DEPTH) if x[2 * d : 2 * d + 2] != y[2 * d : 2 * d + 2]), neardup.DEPTH)
            if depth >= neardup.MIN_DEPTH:
                want[i, j] = max(want.get((i, j), 0), depth)
    reps = spark.createDataFrame([(i, neardup.signature(s)) for i, s in enumerate(sets)], "id bigint, sig binary")
    assert {(r["a"], r["b"]): r["depth"] for r in neardup.forest_links(reps).collect()} == want and len(set(want.values())) > 2


# --- 7 ------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary())
    r = random.Random(2)
    strange = ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(1, 0x2FFF), r.randrange(0x1F300, 0x1F650), 32, 39])) for _ in range(50)) for _ in range(400)]
    fixed = ["", "  ", "it's ÉTÉ don'T <|endoftext|>x<|startoftext|>", "ΣΑΣ İstanbul\x1cab é x", "<|endoftex 12345 ½ ² ñ'll ..'s \x00\x01", "a" * 3000]
    for t in strange + fixed + [x["text"] for x in docs.limit(60).collect()]:
        want = own.tokenizer.encode(t, add_special_tokens=False).ids
        ids = own.encode(t.encode())
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == own.tokenizer.decode(want, skip_special_tokens=False)
    vocab = own.tokenizer.get_vocab(with_added_tokens=False)
    inner = {a + b for t in vocab for a, b in zip(t.removesuffix("</w>"), t.removesuffix("</w>")[1:], strict=False)}
    assert own.cuts(b"qzx") == [i for i in (1, 2) if "qzx"[i - 1 : i + 1] not in inner]
    df = odd(spark)
    out = bpe.encode_decode(df, bpe.vocabulary(), with_ids=True)
    one_row_each(df, out)
    assert {r["n_tokens"] for r in out.filter("doc_id IN (1, 2, 3)").collect()} == {0}


def test_pieces_share_the_memo_of_words():
    """A word's letters are encoded once, in whatever case and beside whatever signs they stand; ids are the library's."""
    encoder, made = bpe.ForcedBoundaryBPE(bpe.vocabulary()), Counter()
    cuts = encoder.cuts
    encoder.cuts = lambda piece: made.update([piece]) or cuts(piece)
    for w in ("unsaidly", "unsaidly,", "Unsaidly", "(unsaidly)", "UNSAIDLY's", "étéréou", "étéréou!", "ÉTÉRÉOU", "x1,y2", "ŸŠſ", "İx", "日本,unsaidly"):
        assert np.frombuffer(encoder.encode(w.encode()), "<u4").tolist() == encoder.tokenizer.encode(w, add_special_tokens=False).ids, w
    assert made[b"unsaidly"] <= 2 and made["étéréou".encode()] == 1  # once more for what takes the library's pre-tokenizer


def test_texts_encoded_together(monkeypatch):
    """Ids are the library's for each text; plain words go to native code thousands a call, each once, and not one by one."""
    encoder, r = bpe.ForcedBoundaryBPE(bpe.vocabulary()), random.Random(9)
    alphabet = "".join(chr(c) for c in [*range(33, 127), *range(0xC0, 0x180)] if c not in (0xD7, 0xF7, 0x130))
    words = ["".join(r.choices(r.choice([alphabet, "aeinrst", "it'sdvm.,", "09"]), k=r.randrange(1, 12))) for _ in range(3000)]
    plain = [" ".join(r.choices(words, k=300)) for _ in range(60)]
    one_by_one, calls, core = [], [], encoder._core
    monkeypatch.setattr(encoder._words, "_compute", lambda w, f=encoder._words._compute: one_by_one.append(w) or f(w))
    monkeypatch.setattr(encoder, "_core", type("Counted", (), {"encode_ordinary": lambda self, text: calls.append(text) or core.encode_ordinary(text)})())
    want = lambda t: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
    got = lambda texts, kind="string": [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(pa.array(texts, kind))]
    assert got(plain) == [want(t) for t in plain]
    assert not one_by_one and len(calls) == 1
    strange = [None, "", " \n\t ", "İx ΣΑΣ 日本,word \x1cab", "a\nb\r\nc\x00d e\u0301 ½²", "<|endoftext|>x y<|startoftext|>", "<|endoftex", "it's'll ''s 'S", "x" * 65 + " " + "é" * 33, "a" * 3000, "\u00a0\u0131\u017f ŉ", "Ġ Ċ Ċ</w> </w>"]
    texts = [t for pair in zip(strange * 5, plain, strict=True) for t in pair]
    assert got(texts) == [want(t) for t in texts]
    for name, value in (("GROUP_BYTES", 3000), ("SLICE_WORDS", 7), ("CALL_WORDS", 5)):  # texts above the size of a group, in several slices and calls
        monkeypatch.setattr(bpe, name, value)
        assert got(texts[:40]) == [want(t) for t in texts[:40]]
    assert got([]) == [] and got([""]) == got([None]) == got([" \t"]) == [[]] and got(texts[:40], "large_string") == got(texts[:40])
    other = bpe.ForcedBoundaryBPE(bpe.vocabulary("byte_bpe_50k.json"))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in other.encode_all(pa.array(["it's 42", None]))] == [other.tokenizer.encode("it's 42").ids, []]


def test_memos_are_bounded_in_bytes():
    memo = bpe._Memo(lambda w: w * 2, 10_000)
    for n in (10, 300, 20_000):
        for i in range(100):
            assert memo[b"%06d" % i * n] == b"%06d" % i * 2 * n
            assert sum(len(k) + len(v) for k, v in memo.items()) <= 10_000
    assert len(memo) == 0 or max(map(len, memo)) < 10_000


def test_workers_drop_what_other_operators_keep(spark):
    """Each worker of one process pool serves every operator; after a task it holds that one's memos alone."""
    path = bpe.vocabulary()

    def held(batches):
        import gc

        for batch in batches:
            memos = sum(type(x).__name__ in ("_Memo", "ForcedBoundaryBPE") for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([memos])], ["memos"])

    def memos():
        return {r["memos"] for r in spark.range(0, 4, 1, 4).mapInArrow(held, "memos bigint").collect()}

    df = spark.createDataFrame([(i, words(60, i), "en", "src", 0) for i in range(200)], SCHEMA).repartition(4)
    bpe.encode_decode(df, path).collect()
    quality.score(df, quality.OrdinalModel(np.zeros(quality.BUCKETS), np.zeros(2))).collect()
    neardup.sketches(df, "doc_id", "text").collect()
    rules.ledger(df.repartition(24)).collect()  # more tasks than workers, which are served in turn
    assert memos() == {0}


def test_a_task_keeps_what_it_asks_for():
    common.begin_task()
    first = common.held_over("a", list)
    assert common.held_over("a", list) is first
    common.end_task()
    common.begin_task()
    assert common.held_over("a", list) is first  # the next task of the same operator goes on with it
    common.end_task()
    common.begin_task()
    common.held_over("b", list)
    common.end_task()
    assert "a" not in common._KEPT and "b" in common._KEPT


def test_memos_keep_what_is_asked_again():
    made = Counter()
    memo = bpe._Memo(lambda w: made.update([w]) or w * 2, 100_000)
    for i in range(5000):
        assert memo[b"often"] == b"oftenoften" and memo[b"%06d" % i] == b"%06d" % i * 2
    assert made[b"often"] == 1 and made[b"000001"] == 1


def test_memos_hold_values_of_every_kind():
    """Numbers as near-duplicates keep them, tuples as the encoder and the classifier do."""
    for compute in (xxhash.xxh3_64_intdigest, lambda w: tuple(w), lambda w: 0):
        memo, keys = bpe._Memo(compute, 20_000), [b"%06d" % i for i in range(1000)]
        assert [memo[k] for k in keys] == [compute(k) for k in keys] and 0 < len(memo) <= 10_000 // 100
    assert neardup.word_hashes(keys).tolist() == [xxhash.xxh3_64_intdigest(k) for k in keys]


# --- 8 ------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grades = quality.grades_of(labels)
    even = grades.filter("doc_id % 3 <> 0")
    rows = quality.score(docs, quality.train(docs, even)).join(grades.filter("doc_id % 3 = 0"), "doc_id").collect()
    rate = lambda g: np.mean([r["kept"] for r in rows if r["grade"] == g])
    assert rate(2) > 0.9 and rate(0) < 0.2
    assert all(0 <= r["tail_prob"] <= r["expected_grade"] <= 2 for r in rows)
    df = odd(spark)
    model = quality.train(df, grades.limit(0))
    assert quality.accepted(df, model).columns == df.columns and quality.accepted(df, model).count() == df.count()
    assert quality.grades_of(spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 0), (3, None, 1)], labels.schema)).count() == 2


def test_quality_scores_equal_a_plain_evaluation(spark):
    """Sums of given weights over word features, then the cumulative link, on plain dictionaries; long and repeated texts, clashing names."""
    r = random.Random(4)
    fold = lambda kind, w: xxhash.xxh3_64_intdigest(kind + w.encode()) % quality.BUCKETS
    texts = {i: " ".join(r.choice(["Good,", "bad", "UGLY!!", "wordy-words", "x1y2", "été", "#tag", "a"]) for _ in range(r.randrange(1, 60))) for i in range(40)} | {90: None, 91: "", 92: words(40_000, 5), 93: "Good, bad"}
    texts[94] = texts[93]

    def buckets(text):
        ws = (text or "").split()
        out = set()
        for w in ws:
            for part in re.findall(r"[^\W\d_]+", w.lower()):
                out |= {fold(b"w", part)} | {fold(b"s", part[:k]) for k in (4, 5) if len(part) > k}
            out |= {fold(b"x", sign[:3]) for sign in re.findall(r"[^\w\s.,;:'\"()-]+", w)}
            if len(w) > 2 and w.isupper():
                out.add(fold(b"", "caps"))
        if len(ws) >= 20:
            out |= {fold(b"repeat", str(k)) for k in range(10 * len(set(ws)) // len(ws), 5)}
        return out

    weights = np.zeros(quality.BUCKETS)
    for b in set().union(*map(buckets, texts.values())):
        weights[b] = r.uniform(-1, 1)
    model = quality.OrdinalModel(weights, np.array([-0.3, 0.8]))
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts.items()], "doc_id bigint, text string, kept string, score double")
    got = {x["doc_id"]: x for x in quality.score(df, model).collect()}
    for i, t in texts.items():
        s = sum(weights[b] for b in buckets(t))
        tails = [1 / (1 + np.exp(-(s - c))) for c in (-0.3, 0.8)]
        assert abs(got[i]["score"] - s) < 1e-9 and abs(got[i]["expected_grade"] - sum(tails)) < 1e-9 and abs(got[i]["tail_prob"] - tails[1]) < 1e-9
        assert got[i]["kept"] == (got[i]["tail_prob"] >= quality.KEEP_TAIL)
    assert {x["doc_id"] for x in quality.accepted(df, model).collect()} == {i for i in texts if got[i]["kept"]}


def test_sample_reaches_the_driver_in_parts(spark, monkeypatch):
    """Features come in the order of ids, about a part's bytes at a time, and the sort by range takes no sample of them."""
    r = random.Random(6)
    texts = {i: " ".join("".join(r.choices("abcdefghij", k=8)) for _ in range(1500)) for i in range(64)} | {64: None, 65: ""}
    frame, taken, fitted = type(spark.range(0)), [], []
    local = frame.toLocalIterator
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a, **b: taken.append(self) or local(self, *a, **b))
    monkeypatch.setattr(quality, "fit_ordinal", lambda held, grades, n: fitted.append(([c.tolist() for _, _, c in held.chunks()], held.lengths.tolist(), grades.tolist())))
    monkeypatch.setattr(quality, "PART_BYTES", 1 << 16, raising=False)
    quality.train(spark.createDataFrame(list(texts.items())[::-1], "doc_id bigint, text string"), spark.createDataFrame([(i, i % 3) for i in texts], "doc_id bigint, grade int"))
    rows = [np.sort(quality.features(t and t.encode())) for t in texts.values()]
    assert fitted == [([np.concatenate(rows).tolist()], list(map(len, rows)), [i % 3 for i in texts])]
    sizes = [x[1] for x in taken[0].groupBy(F.spark_partition_id()).agg(F.sum(F.length("buckets"))).collect()]
    assert sum(sizes) > 16 << 16 and max(sizes) < 4 << 16
    ranges = re.findall(r"rangepartitioning\(.*", taken[0]._jdf.queryExecution().executedPlan().toString())
    assert ranges and not any("buckets" in re.sub(r"xxhash64\(.*?\)", "", x) for x in ranges)


def test_ordinal_fit_orders_grades():
    x = [np.array([g, 10 + i % 5], np.int32) for g in range(3) for i in range(40)]
    y = np.repeat(np.arange(3), 40)
    m = quality.fit_ordinal(x, y, 3, buckets=32)
    assert (np.diff(m.thresholds) >= 0).all() and (np.diff(m.weights[:3]) > 0).all()
    assert ((m.tails(np.array([m.score(r) for r in x])) > 0.5).sum(1) == y).all()


# --- 9 ------------------------------------------------------------------------------------------


def test_fit_holds_features_in_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 240)
    x = [np.unique(np.append(rng.integers(0, 60_000, 30_000), 70_000 + g)).astype(np.int32) for g in y]
    tracemalloc.start()
    monkeypatch.setattr(quality, "CHUNK_FEATURES", 1 << 17)
    chunked = quality.fit_ordinal(x, y, 3, buckets=1 << 17, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(map(len, x))  # owners, columns and weights of all features at once take 24 bytes for each
    monkeypatch.setattr(quality, "CHUNK_FEATURES", 1 << 30)
    whole = quality.fit_ordinal(x, y, 3, buckets=1 << 17, rounds=3)
    assert np.allclose(chunked.weights, whole.weights, atol=1e-12) and np.allclose(chunked.thresholds, whole.thresholds, atol=1e-12)


def test_sharding(spark, docs):
    for df in (docs, odd(spark), docs.limit(0), docs.withColumn("doc_id", F.lit(None).cast("bigint"))):
        rows = sharding.shard_by_bytes(df, 7).collect()
        assert len(rows) == df.count()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter(tuple(r)[:3] for r in rows) == want
        shards = defaultdict(list)
        for r in rows:
            shards[r["shard"]].append(r)
            assert (r["law"], r["grown_shard"]) == ("bytes", None)
        total, largest = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
        for s in shards.values():
            assert sorted(r["slot"] for r in s) == list(range(len(s))) and abs(sum(r["size"] for r in s) - total / 7) <= largest + 1
        order = [r["doc_id"] for k in sorted(shards) for r in sorted(shards[k], key=lambda r: r["slot"])]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_shards_equal_plain_prefix_sums(spark, texts):
    """Rows in id order; a row is in the shard that the middle of its bytes falls into."""
    sizes = {i: len((t or "").encode()) + 16 for i, t in texts.items()} | {10_000 + i: 16 + 2 * i for i in range(20)}
    df = spark.createDataFrame([(i, texts.get(i, "é" * (i % 100)), 1, 2) for i in sizes], "doc_id bigint, text string, row int, size int")
    total, at, slots, want = sum(sizes.values()), 0, Counter(), {}
    for i in sorted(sizes):
        shard = min(39, (at + sizes[i] // 2) * 40 // total)
        want[i] = (sizes[i], shard, slots[shard])
        slots[shard] += 1
        at += sizes[i]
    for parts in (1, 7, 60):
        assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df, 40, partitions=parts).collect()} == want


# --- 10 -----------------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2050, [0.0] * 64), (2100, [float("nan")] * 64), (2150, [1.0] * 3), (2200, [None] * 64), (None, rows[3][1]), rows[50], rows[51]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1))
    got = defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)}
    queries = [i for i in x if i % 50 == 0]
    assert set(got) == set(queries)
    found = total = 0
    for q in queries:
        s = {i: float(v @ x[q] / (np.linalg.norm(v) * np.linalg.norm(x[q]))) for i, v in x.items() if i != q}
        want = sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - v) < 1e-12 for i, v in got[q].values())
        found += len(set(want) & {i for i, _ in got[q].values()})
        total += 5
    assert found / total >= 0.9
    few = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 51), (2, 52)]
    assert ann.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_radius_is_not_learned_from_copies_at_low_ids(spark):
    x = np.random.default_rng(3).normal(size=(9000, 64))
    x[:3000] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(df, (F.col("vec_id") >= 3000) & (F.col("vec_id") % 50 == 0)).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = 0
    for q in range(3000, 9000, 50):
        s = unit @ unit[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()))
    assert found / (5 * 120) >= 0.97


def test_copies_are_indexed_once_and_queries_go_in_rounds(spark, monkeypatch):
    rng, k, made = np.random.default_rng(11), 5, {}
    kinds = rng.normal(size=(6, 8)).astype("f4")
    rows = [(i if i % 31 else 7, [float(x) for x in kinds[i % 6]]) for i in range(240)]  # 7 stands on several vectors
    keep = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df, what: made.setdefault(what, []).append(x := keep(df, what)) or x)
    monkeypatch.setattr(ann, "ROUND_BYTES", 1)
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 10 == 7, k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    size, want = np.sqrt((v * v).sum(axis=1)), {}
    for q in {i for i, _ in rows if i % 10 == 7}:
        score = np.max([(v * v[a]).sum(axis=1) / (size * size[a]) for a in np.flatnonzero(ids == q)], axis=0)  # a vector's cosine with itself is 1 but for rounding
        best = {}
        for i, s in zip(ids.tolist(), score.tolist(), strict=True):
            best[i] = max(s, best.get(i, -2))
        want[q] = sorted((i for i in best if i != q), key=lambda i: (-best[i], i))[:k]
    assert got == want
    assert sum(len(r["vectors"]) for r in made["index"][0].collect()) == 6 * 8 * 4
    assert len(made["near"]) == made["asked"][0].count()


def test_radius_search_is_exact():
    codes = np.random.default_rng(0).integers(0, 1 << 16, (300, 4), dtype=np.uint16)
    index = ann.BlockIndex(codes)
    want = np.array([[sum(int(a ^ b).bit_count() for a, b in zip(p, q, strict=True)) for q in codes] for p in codes[:20]])
    for radius in (0, 3, 21, 26, 31):
        assert (index.within(codes[:20], radius) == (want <= radius)).all()


def test_only_codes_of_probed_buckets_are_compared(monkeypatch):
    codes = np.random.default_rng(1).integers(0, 1 << 16, (500, 6), dtype=np.uint16)
    index = ann.BlockIndex(codes)
    index = ann.BlockIndex.unpack(codes.tobytes(), index.pack(), 500)
    seen = []
    own = index.distances
    monkeypatch.setattr(index, "distances", lambda queries, q, c: seen.append(len(c)) or own(queries, q, c))
    want = np.array([[sum(int(a ^ b).bit_count() for a, b in zip(p, q, strict=True)) for q in codes] for p in codes[:20]])
    for radius in (0, 10, 17, 40):
        assert (index.within(codes[:20], radius) == (want <= radius)).all()
    assert seen[0] == 20 and seen[1] < 2000 and seen == sorted(seen)


# --- pipeline -----------------------------------------------------------------------------------


def without_passages(texts):
    """Each text without the runs of 51 words or more that repeated strings of 200 bytes cover."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    n = corpus_pipeline.PASSAGE_BYTES
    seen = Counter(x[p : p + n] for x in data.values() for p in range(len(x) - n + 1))
    out = {}
    for i, x in data.items():
        keep, at = bytearray(), 0
        covered = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - n + 1):
            if seen[x[p : p + n]] > 1:
                covered[p : p + n] = True
        edges = np.flatnonzero(np.diff(covered.astype(int), prepend=0))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if len(x[a:b].split()) >= 51:
                while a < b and x[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(x) and x[b] & 0xC0 == 0x80:
                    b -= 1
                keep += x[at:a]
                at = b
        out[i] = (keep + x[at:]).decode()
    return out


def test_passages_of_51_to_70_words_go(spark):
    stage, r = dict(corpus_pipeline.STAGES)["suffix_array_dedup"], random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 10))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [prose(n) for n in range(51, 71)]
    shared = {i: prose(90) + " " + passages[i // 3] + " " + prose(90) for i in range(60)}
    clean = {100 + i: prose(150) + (" " + shared[3][-150:] if i == 0 else "") for i in range(30)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in (shared | clean).items()], SCHEMA)
    got = {x["doc_id"]: x["text"] for x in stage(spark, df, SF).collect()}
    assert all(got[i] == t for i, t in clean.items())
    assert all(passages[i // 3] not in got[i] and len(got[i].split()) >= 175 for i in shared)


def test_pipeline_stages(spark, docs):
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == docs.columns, name
        before, after = frame.count(), out.cache().count()
        if name == "quality_rules":
            want = {r["doc_id"] for r in rules.ledger(frame).filter("failed_bits = 0").collect()}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "near_duplicates":
            want = {i for i, (_, _, kept) in components_by_force({r["doc_id"]: r["text"] for r in frame.collect()}).items() if kept}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "suffix_array_dedup":
            want = without_passages({r["doc_id"]: r["text"] for r in frame.collect()})
            assert after == before and {r["doc_id"]: r["text"] for r in out.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in out.collect())
        frame = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in frame.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)


def test_pipeline_on_odd_and_empty_tables(spark):
    plain = [name for name, _ in corpus_pipeline.STAGES]
    for df in (odd(spark), odd(spark).limit(0)):
        frame, rows = df, {}
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            rows[name] = frame.collect()
        base = [r for r in df.collect() if measured_by_force(r["text"])[0] >= 50]
        assert Counter(r["doc_id"] for r in rows[plain[0]]) == Counter(r["doc_id"] for r in base if r["text"] != "a" * 1000)
        left = {r["doc_id"]: r["text"] for r in rows[plain[1]]}
        best = {}
        for i in sorted(left):
            best.setdefault(left[i], i)
        assert sorted(r["doc_id"] for r in rows[plain[2]]) == sorted(best.values()) and len(rows[plain[3]]) == len(best)
        assert {r["doc_id"]: r["text"] for r in rows[plain[3]]} == without_passages({i: t for t, i in best.items()})
        assert {r["doc_id"] for r in rows[plain[4]]} == set(best.values())
    assert sharding.shard_by_bytes(odd(spark)).count() == 13
    assert suffix_dedup.remove_repeats(odd(spark)).count() == 13 and suffix_dedup.stripped(odd(spark)).count() == 13
    assert packing.pack(odd(spark), bpe.vocabulary()).filter("doc_id = 1").first()["length"] == 1


# --- SQL ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
