"""Each operator against a plain computation, with awkward rows."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from marketweave.llm import byte_bpe, lm_scoring, mixing, pii, simhash, suffix_dedup, token_counts, toxicity, winnowing
from marketweave.llm import queries as op_queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# -- byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, rows, reference_bpe):
    got = by_id(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN))
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        ids = reference_bpe.encode_ordinary(text or "")
        for r in got[i]:
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(text or "")


def test_bpe_round_trip(docs, rows):
    decoded = by_id(byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS))
    assert all(bytes(r["text"]).decode() == (text or "") for i, text, *_ in rows for r in decoded[i])


def test_bpe_long_pieces_agree_with_matrices(reference_bpe):
    ranks = byte_bpe.load(RANKS)
    rng = np.random.default_rng(1)
    for n in (2, 5, 30, 63):
        piece = bytes(rng.choice(list(b"abetnois"), n))
        assert ranks.encode_long(piece) == ranks.encode([piece])[0] or piece in ranks.of
    piece = ("ab" * 2000 + "the" * 500).encode()
    assert ranks.encode([piece])[0] == reference_bpe.encode_ordinary(piece.decode())


# -- token counts


def test_token_counts_equal_the_library(docs, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(token_counts.count(docs, PIECES))
    for i, text, *_ in rows:
        for r in got[i]:
            assert (r["n_tokens"], r["n_bytes"]) == (len(model.encode(text or "")), len((text or "").encode()))


@pytest.mark.parametrize("text", [" a", "a ", "  ", "\n", "\n\n a", "a\n b  c\n", "a\tb", "▁", "a▁b ", "<s> x </s>", "\r\n x"])
def test_token_counts_white_space(spark, text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES).first()
    assert got["n_tokens"] == len(model.encode(text))


# -- mixing


def test_mixing_shares_and_caps(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for _, t, _, s, *_ in rows:
        per[s] += size(t)
    names = sorted([s for s in per if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(per.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if 2 * per[s] < level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * per[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    got = {r["source"]: r for r in mixing.rates(docs).collect()}
    assert {s: r["source_size"] for s, r in got.items()} == dict(per)
    assert all(math.isclose(got[s]["target"], target[s], rel_tol=1e-9) for s in names)
    taken = mixing.copies(docs, mixing.rates(docs)).collect()
    assert len(taken) == len(rows)
    assert all(math.floor(r["copies"]) in (math.floor(got[r["source"]]["rate"]), math.floor(got[r["source"]]["rate"]) + 1) and r["copies"] <= 2 for r in taken)
    again = mixing.copies(docs.repartition(5), mixing.rates(docs)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in taken) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mix_repeats_rows_and_keeps_columns(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.copies(docs, mixing.rates(docs)).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert {r["copies"] for r in mixed.collect()} == {1}  # the documents' own column


def test_mixing_rows_without_ids_draw_apart(spark):
    rows = [(None, f"some words of text number {i}", s) for i in range(900) for s in "abc"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    per = {r["source"]: r for r in mixing.rates(frame).collect()}
    got = mixing.mix(frame).groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()
    for r in got:
        part = per[r["source"]]["rate"] % 1
        spread = math.sqrt(900 * 36 * part * (1 - part))
        assert abs(r["n"] - per[r["source"]]["target"]) <= 4 * spread + 1e-6


# -- winnowing


def test_winnowing_fingerprints(spark, rows):
    k, w = 5, 4
    frame = spark.createDataFrame([(i, t or "") for i, t, *_ in rows[:60]], "i long, t string")
    got = {r["i"]: r["f"] for r in frame.select("i", winnowing.fingerprint(F.col("t"), k, w).alias("f")).collect()}
    for i, text, *_ in rows[:60]:
        points = (text or "").encode("utf-32-be")
        n = len(points) // 4
        grams = [points[4 * a : 4 * (a + k)] for a in range(n - k + 1)] or ([points] if n else [])
        # signed view of XXH64 with seed 42, its upper 31 bits as the hash
        values = [(xxhash.xxh64_intdigest(g, 42) >> 33 << 32) | (4294967295 - a) for a, g in enumerate(grams)]
        spans = [values[a : a + w] for a in range(max(1, len(values) - w + 1))] if values else []
        assert got[i] == list(dict.fromkeys(map(min, spans)))


def test_winnowing_edits(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    got = by_id(winnowing.compare(docs))
    assert sum(map(len, got.values())) == len(rows)
    for (i, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert sha(edited) in {r["edited_sha256"] for r in got[i]} and {r["n_chars"] for r in got[i]} == {len(text)}
        if edited == text:
            assert 1.0 in {r["near_edited"] for r in got[i]}
        elif third > 60:
            assert all(0.3 < r["near_edited"] < 1 for r in got[i])


@pytest.mark.parametrize("kind", ["sparse", "clustered", "null", "one id"])
def test_winnowing_order_of_any_ids(spark, kind):
    rng = random.Random(12)
    said = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(12))
    ids = {"sparse": [rng.randint(-(1 << 62), 1 << 62) for _ in range(1500)], "clustered": [*range(1200), 10**15, *range(10**17, 10**17 + 300)], "null": [None] * 1000 + list(range(500)), "one id": [7] * 900 + [-3, 1 << 60]}[kind]
    rows = [(i, said()) for i in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = [r["count"] for r in winnowing._buckets(frame).groupBy("top", "low").count().collect()]
    assert kind == "one id" or max(sizes) < 1200 and len(sizes) > 3
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = Counter()
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(text) // 3
        want[i, sha(text[: len(text) - third] + after[:third])] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in winnowing.compare(frame).collect()) == want


def test_winnowing_finds_shared_passages(spark):
    passage = "a passage of at least twenty-seven characters"
    frame = spark.createDataFrame([("left words before " + passage, "other text " * 9 + passage + " and after")], "a string, b string")
    assert frame.select(winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b"))).alias("x")).first()["x"] > 0


# -- SimHash


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def _components(names, links):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_simhash_components(docs, rows):
    prints = {i: _fingerprint(t) for i, t, *_ in rows}
    names = sorted(prints)
    links = [(a, b) for a in names for b in names if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = _components(names, links)
    for i, found in by_id(simhash.clusters(docs)).items():
        assert all(r["fp"] % (1 << 64) == prints[i] and r["component_id"] == want[i] for r in found)
    kept = sorted({r["doc_id"] for r in simhash.representatives(docs).collect()})
    assert kept == sorted(set(want.values()))


def test_simhash_keeps_one_row_of_each_component(spark):
    text = "one text of which there are many rows, with and without ids"
    other, lone = "quite another text which has rows without ids only", "a third text that stands alone"
    rows = [(3, text, "a")] * 4 + [(3, text, "b"), (5, text, "a"), (None, text, "a"), (None, text, "a")]
    rows += [(None, other, "a")] * 3 + [(None, other, "b"), (3, lone, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = simhash.representatives(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(3, text), (0, other), (3, lone)])
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, simhash.representatives(frame.repartition(2)).collect()))


def test_simhash_links_across_hot_buckets(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (700, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    names = sorted(values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in names], "fp long")).collect()
    want = _components(names, [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3])
    assert _components(names, [(r["u"], r["v"]) for r in edges]) == want


# -- suffix arrays


def _repeated(raw, length, places):
    """Bytes covered by strings of so many bytes that start more than once."""
    cover = bytearray(len(raw))
    for a in range(len(raw) - length + 1):
        if places[raw[a : a + length]] > 1:
            cover[a : a + length] = b"\1" * length
    return cover


def _repeats_by_counting(texts, got, length, least):
    places = {n: Counter(raw[a : a + n] for _, raw in texts for a in range(len(raw) - n + 1)) for n in (length, least)}
    for i, raw in texts:
        cover = _repeated(raw, length, places[length])
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        runs = len(re.findall(rb"\x01+", bytes(cover)))
        seen = sum(_repeated(raw, least, places[least]))
        for r in got[i]:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"]) == (len(raw), sum(cover), runs, sha(kept), seen)


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_suffix_dedup_removes_exactly_the_repeated(docs, rows, bucket):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    _repeats_by_counting(texts, by_id(suffix_dedup.remove(docs, length=60, least_=45, gram=12, bucket=bucket)), 60, 45)


@pytest.mark.parametrize("bucket", [2, 16])
def test_suffix_dedup_splits_hot_grams(spark, bucket):
    # one passage stands in many texts, between different words and with a changed letter here and there
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(90):
        middle = list(passage)
        for _ in range(rng.randint(0, 2)):
            middle[rng.randrange(len(middle))] = "z"
        texts.append((i, " ".join(word() for _ in range(rng.randint(0, 30))) + "".join(middle) + " ".join(word() for _ in range(rng.randint(0, 30)))))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    _repeats_by_counting([(i, t.encode()) for i, t in texts], by_id(suffix_dedup.remove(frame, length=80, least_=50, gram=8, bucket=bucket)), 80, 50)


def test_suffix_dedup_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    line = " ".join(word() for _ in range(900))
    long = " ".join([line, " ".join(word() for _ in range(3000)), line[200:3000]])
    texts = [(1, long), (2, line[1000:1500]), (3, line[:90])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    _repeats_by_counting([(i, t.encode()) for i, t in texts], by_id(suffix_dedup.remove(frame)), 400, 300)


def _words_by_counting(texts, got, length, words):
    bounds = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] for i, raw in texts}
    said = {i: [raw[a:b] for a, b in bounds[i]] for i, raw in texts}
    places = Counter(raw[a : a + length] for _, raw in texts for a in range(len(raw) - length + 1))
    passages = Counter(tuple(said[i][a : a + words]) for i, _ in texts for a in range(len(said[i]) - words + 1))
    for i, raw in texts:
        cover = _repeated(raw, length, places)
        removed = sum(cover)
        for a in range(len(said[i]) - words + 1):
            if passages[tuple(said[i][a : a + words])] > 1:
                start, stop = bounds[i][a][0], bounds[i][a + words - 1][1]
                cover[start:stop] = b"\1" * (stop - start)
        for r in got[i]:
            assert (r["n_removed"], r["n_repeated"]) == (removed, sum(cover))


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_suffix_dedup_counts_passages_of_words(spark, docs, rows, bucket, monkeypatch):
    _words_by_counting([(i, (t or "").encode()) for i, t, *_ in rows], by_id(suffix_dedup.remove(docs, bucket=bucket, words=12)), 400, 12)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    passage, texts = [word() for _ in range(40)], []
    for i in range(60):
        middle = [word() if rng.random() < 0.02 else x for x in passage[rng.randint(0, 8) :]]
        texts.append((i, rng.choice([" ", "\n", " \t"]).join([*(word() for _ in range(rng.randint(0, 30))), *middle, *(word() for _ in range(rng.randint(0, 30)))])))
    texts += [(60, "n " * 90), (61, " ".join([*passage, *passage])), (62, "x" * 90 + " " + " ".join(passage) + " " + "x" * 90), (63, "x" * 90)]
    whole = {i: suffix_dedup.word_hashes(t.encode()).tolist() for i, t in texts}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)  # words of 90 bytes are longer
    for i, t in texts:
        parts = suffix_dedup.word_hashes(t.encode()).tolist()
        assert [a == b for a, b in zip(parts, whole[i], strict=True)] == [len(x) <= 64 for x in t.split()]
    assert len({suffix_dedup.word_hashes(t.encode()).tolist()[-1] for _, t in texts[62:]}) == 1
    _words_by_counting([(i, t.encode()) for i, t in texts], by_id(suffix_dedup.remove(spark.createDataFrame(texts, "doc_id long, text string"), bucket=bucket, words=12)), 400, 12)


def test_op8_tells_of_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(9)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    more, fewer = some(51), some(50)  # 254 and 249 bytes, under the 400 that are removed
    texts = [(1, f"{some(30)} {more} {some(30)}"), (2, f"{some(9)}\n{more} {some(70)}"), (3, f"{some(30)} {fewer} {some(30)}"), (4, f"{some(9)} {fewer} {some(70)}"), (5, some(200))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op_queries.op8_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_repeated"]) for r in got} == {1: (0, 254), 2: (0, 254), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_suffix_array():
    rng = np.random.default_rng(3)
    for alphabet in (b"ab", b"ab\0c", bytes(range(256))):
        data = bytes(rng.choice(list(alphabet), 700))
        starts = np.array([0, 40, 300, 301, 500])
        stops, group = np.append(starts[1:], len(data)), np.array([0, 0, 1, 1, 1])
        places, levels, end = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), starts, stops, group)
        of = np.searchsorted(stops, np.arange(len(data)), side="right")
        key = [(group[of[p]], data[p : end[p]]) for p in places]
        assert sorted(places) == list(range(len(data))) and key == sorted(key)
        same = [len(os.path.commonprefix([x, y])) for (_, x), (_, y) in zip(key[:-1], key[1:], strict=True)]
        got = suffix_dedup.common_prefixes(places[:-1], places[1:], levels, end, np.frombuffer(data, np.uint8))
        across = np.array([a != b for (a, _), (b, _) in zip(key[:-1], key[1:], strict=True)])
        assert (got[~across] == np.array(same)[~across]).all()


def test_maximal_repeats():
    data = b"xabcdefYabcdefZZabcdeQ"
    found = dict()
    for size, places in suffix_dedup.repeats(data, np.array([0]), np.array([len(data)]), np.array([len(data)]), np.array([0]), np.array([256]), 4):
        found[size] = sorted(places)
    assert found == {6: [1, 8], 5: [1, 8, 16]}


# -- language model


@pytest.mark.parametrize("tokens", [40, 2_000_000])
def test_lm_scores(docs, rows, tokens):
    got = by_id(lm_scoring.score(docs, lm_scoring.held_out(), tokens))
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    lines = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    one, two, kinds = Counter(), Counter(), Counter()
    for i, words in lines:
        if not out[i]:
            one.update(words)
            two.update(zip([None, *words[:-1]], words, strict=True))
    for a, _ in two:
        kinds[a] += 1
    n, v = sum(one.values()), len(one)
    for i, words in lines:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words)
        total = 0.0
        for a, b in zip([None, *words[:-1]], words, strict=True):
            p = (one[b] + 1) / (n + v + 1)
            total += math.log10((max(two[a, b] - 0.75, 0) + 0.75 * kinds[a] * p) / one[a] if one[a] else p)
        for r in got[i]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(words), sum(one[w] > 0 for w in words), n)
            assert math.isclose(r["base_score"], base, abs_tol=1e-6)
            assert abs(r["score"] - total) <= 0.015 * len(words)  # half a step of the codes


def test_lm_probabilities_are_not_clipped():
    counts = np.array([1, 40, 100_000_000])
    owner = np.array([0] + [1] * 3 + [2] * 1000)
    bigrams = np.array([1, 1, 3, 36] + [1] * 998 + [5_000_000, 94_999_002])
    numbered = np.bincount(owner) + 1
    number = np.arange(len(owner)) - np.array([0, 1, 4])[owner]
    trie = lm_scoring.Trie(np.array([5, 9, 12], dtype=np.uint64), counts, numbered, owner, number, bigrams)
    codes = trie.codes(owner, number)
    assert not trie.codes(np.array([0, 1, 2, -1]), numbered[[0, 1, 2, 0]] - 1).any()  # numbered, but never seen
    assert trie.contexts(np.array([5, 9, 12, 0, 7, 99], dtype=np.uint64))[0].tolist() == [0, 1, 2, -1, -1, -1]
    found, want = lm_scoring.probability(codes, counts[owner]), (bigrams - 0.75) / counts[owner]
    assert np.allclose(found[bigrams == 1], want[bigrams == 1], rtol=1e-9)
    assert (np.abs(np.log10(found / want)) <= 0.018).all()
    assert (lm_scoring.probability(np.zeros(3, np.uint8), counts) == 0).all()


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (500, 700), (3000, 1 << 50), (70_000, 1 << 20)):
        values = np.sort(rng.choice(universe, n, replace=False) if universe < 1 << 21 else rng.integers(0, universe, n)).astype(np.uint64)
        coded = lm_scoring.Monotone.encode(values, universe)
        if n:
            assert (coded.get(np.arange(n)) == values).all()
            assert (values[coded.find(values)] == values).all()
            asked = rng.integers(0, universe, 2000).astype(np.uint64)
            assert ((coded.find(asked) >= 0) == np.isin(asked, values)).all()


# -- personal data


def test_pii_base_spans(spark):
    text = "mail a.b@c-d.org, x@y.z@w.q then +1 (415) 555-0199; 10.0.0.255 and 10.0.0.256, 漢 4111 1111 1111 1111; 4111 1111 1111 1112 +12 q@r"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(frame).collect()}
    spans = [(s["kind"], text[s["start"] : s["end"]]) for s in got[1]["base"]]
    assert spans == [("email", "a.b@c-d.org"), ("email", "x@y.z"), ("phone", "+1 (415) 555-0199"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")]
    assert got[2]["base"] == [] and got[3]["spans"] == []


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a@b.co", "x_y@z", "+44 20 7946 0018 ", "192.168.0.1", "1.2.3.4.5", "4539 1488 0343 6467", "4539-1488-0343-6468", "é", " ", "5", "-", ".", "@", "+", "(", "word", "\n", "00012.0.0.255"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(300)]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(plain.items()) for m in re.finditer(p, text) if fine(kind, m[0]))
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in got[i]["base"]] == want, text


def test_pii_finds_disclosing_terms(spark):
    rows = [(i, f"note {i} the clerk zorblax wrote from ann@corp.org about item {i} today") for i in range(5)]
    rows += [(100 + i, f"plain text {i} where the clerk has nothing about item {i} today") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        words = {rows[i][1][s["start"] : s["end"]] for s in got[i]["spans"] if s["kind"] == "term"}
        assert words >= {"zorblax"} and not words & {"the", "clerk", "about", "item", "today"}
    assert all(not got[100 + i]["spans"] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and "ann@" not in clean[0] and clean[100] == rows[5][1]


def _terms(spark, texts):
    """Words of term spans by document."""
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"} for r in got}


def test_pii_copies_add_and_take_no_support(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    said = lambda k: " ".join(rng.choices(words, k=k))
    left, right = said(60), said(60)
    copies = [f"{said(1)} {left} zorblax ann@corp.org {right}" for _ in range(30)]
    others = [f"{said(60)} zorblax ann@corp.org {said(60)}" for _ in range(12)]
    signed = [f"{said(60)} kind regards from the northern office of Velquist Trading, bob@corp.org, which sends this to nobody else at any time" for _ in range(20)]
    # copies of which each has one change beside the entity
    changed = [f"{left} plimworth {said(1)} eve@corp.org {right} {said(1)}" for _ in range(30)]
    plain = [said(100) for _ in range(400)]
    found = _terms(spark, copies + others + signed + changed + plain)
    assert all("zorblax" in found[i] for i in range(42))
    assert all("Velquist" in found[i] for i in range(42, 62))
    assert not any("plimworth" in found[i] for i in range(62, 92))
    assert not any(found[i] for i in range(92, len(found)))


def test_pii_counts_documents_that_hold_both(spark):
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    said = lambda k: " ".join(rng.choices(words, k=k))
    # in five of 40 documents the term is beside the entity, in the others far from it
    texts = [f"{said(40)} zorblax ann@corp.org {said(40)}" if i < 5 else f"zorblax {said(40)} ann@corp.org {said(40)}" for i in range(40)]
    found = _terms(spark, texts + [said(80) for _ in range(400)])
    assert all("zorblax" in found[i] for i in range(40))


def test_pii_terms_equal_counting(spark):
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    said = lambda k: " ".join(rng.choices(words, k=k))
    people = ["ann@corp.org", "bob@corp.org", "eve@lake.net", "10.1.2.3", "10.1.2.9", "+1 (415) 555-0199"]
    hints = ["zebrafish", "quillon", "marmot", "ostrava", "pelmet", "yarrow"]
    texts = []
    for i in range(240):
        parts = [said(25), said(25)]
        for person, hint in zip(people, hints, strict=True):
            if rng.random() < 0.06:
                parts.append(f"{person} , {hint if rng.random() < 0.9 else ''} {said(5)}")
        texts.append(" ".join(rng.sample(parts, len(parts))))
    texts += [f"{said(20)} zebrafish {said(20)}", f"{said(20)} quillon {said(9)}", said(50), texts[0], texts[0]]
    entity = {"ann@corp.org": "@corp.org", "bob@corp.org": "@corp.org", "eve@lake.net": "@lake.net", "10.1.2.3": "10.1.2.*", "10.1.2.9": "10.1.2.*", "+1 (415) 555-0199": "phone:1415555"}
    held, known = {}, {}
    for text in set(texts):
        bare = text
        for person in people:
            if person in text:
                bare = bare.replace(person, " ")
                for e in (person, entity[person]):
                    held.setdefault(e, set()).add(text)
        known[text] = (set(re.findall(r"[a-z0-9]+", bare)), set(re.findall(r"[a-z0-9]+", text)))
    n, want = len(set(texts)), set()
    for e, inside in held.items():
        for term in set().union(*(known[x][0] for x in inside)):
            together = sum(term in known[x][0] for x in inside)
            given = (together - 0.5) / (sum(term in w for _, w in known.values()) + 1)
            if len(term) > 1 and together >= 3 and len(inside) >= 3 and math.log(given * n / len(inside)) / math.log(n / len(inside)) >= 0.8:
                want.add(term)
    assert {"zebrafish", "quillon"} <= want and not want & {"corp", "org"}
    found = _terms(spark, texts)
    assert all(found[i] == want & set(re.findall(r"[a-z0-9]+", x)) for i, x in enumerate(texts))
    assert "zebrafish" in found[240] and "quillon" in found[241]  # with no entity beside them


def test_pii_long_runs_do_not_overflow(spark):
    texts = ["1 " * 20_000, "1-" * 20_000 + "1", "a." * 20_000 + "@b", "x@" + "a." * 20_000 + "b", "+1" + "(" * 20_000 + "2"]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(got[i]["base"]) for i in range(5)] == [0, 0, 0, 1, 0]


# -- toxicity


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    bad = ["grumbold", "snarfle", "vexpator"]
    rows = []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_held_out_accuracy(spark, insults):
    docs = spark.createDataFrame([r[:2] for r in insults], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in insults], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, spans=True).collect()}
    test = [r for r in insults if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in test) >= 0.95 * len(test)
    for i, text, y in test:
        words = {text[s["start"] : s["end"]] for s in got[i]["spans"]}
        assert not y or any(w.startswith(("grumb", "snarf", "vexpa")) for w in words)
    kept = toxicity.reject(docs.withColumn("score", F.lit("own")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.5}


def test_toxicity_chain_against_enumeration():
    rng = np.random.default_rng(0)
    n = 6
    odds, moves = np.exp(rng.standard_normal((1, n))), rng.standard_normal((2, 2))
    forward, backward = toxicity.chain(odds, np.array([n]), moves)
    p = forward * backward / (1 + forward * backward)
    mass = np.zeros((n, 2))
    for code in range(1 << n):
        s = [code >> t & 1 for t in range(n)]
        w = np.prod([odds[0, t] ** s[t] for t in range(n)]) * np.exp(sum(moves[s[t], s[t + 1]] for t in range(n - 1)))
        for t in range(n):
            mass[t, s[t]] += w
    assert np.allclose(p[0], mass[:, 1] / mass.sum(axis=1))


def test_toxicity_without_both_classes(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scores) == 1 and scores.pop() < 1e-6
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


# -- empty tables and rows of nulls


def test_empty_tables(empty):
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count(empty, PIECES).count() == 0
    assert mixing.mix(empty).count() == 0
    assert winnowing.compare(empty).count() == 0
    assert simhash.clusters(empty).count() == 0 and simhash.representatives(empty).count() == 0
    assert suffix_dedup.remove(empty).count() == 0
    assert lm_scoring.score(empty, lm_scoring.held_out()).count() == 0
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_rows_of_nulls(odd):
    assert byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN).count() == 2
    assert token_counts.count(odd, PIECES).count() == 2
    assert mixing.copies(odd, mixing.rates(odd)).count() == 2
    assert winnowing.compare(odd).count() == 2
    assert {r["doc_id"]: r["component_id"] for r in simhash.clusters(odd).collect()} == {None: None, 7: 7}
    assert simhash.representatives(odd).count() == 2
    assert suffix_dedup.remove(odd).count() == 2
    assert {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score(odd, lm_scoring.held_out()).collect()} == {None: 1, 7: 4}
    assert pii.find(odd).count() == 2 and pii.sanitise(odd).columns == odd.columns
