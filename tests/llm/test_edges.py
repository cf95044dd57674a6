"""The values that operators define for rows of nulls and empty texts, beside an ordinary row; clashing names and long texts."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketweave.llm import byte_bpe, lm_scoring, mixing, pii, simhash, suffix_dedup, token_counts, toxicity, winnowing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_empty_texts_have_no_tokens(odd):
    got = rows(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN))
    assert (got[None]["n_tokens"], got[None]["ids"], got[None]["ids_sha256"], got[None]["decoded_sha256"]) == (0, [], EMPTY, EMPTY)
    assert got[7]["n_tokens"] > 0 and got[7]["decoded_sha256"] == hashlib.sha256(b"some words here").hexdigest()
    got = rows(token_counts.count(odd, public_tokenizers.path("piece_bpe_32k.model")))
    assert (got[None]["n_bytes"], got[None]["n_tokens"]) == (0, 0) and got[7]["n_bytes"] == 15 and got[7]["n_tokens"] >= 3


def test_sources_without_words_take_nothing(odd):
    got = rows(mixing.copies(odd, mixing.rates(odd)))
    # the null source has no words; its share goes to the other one
    assert (got[None]["source_size"], got[None]["target"], got[None]["copies"]) == (0, 0.0, 0)
    assert (got[7]["source_size"], got[7]["target"]) == (3, 4.5) and got[7]["copies"] in (1, 2)


def test_fingerprints_of_empty_texts(odd):
    got = rows(winnowing.compare(odd))
    none, other = got[None], got[7]
    assert (none["n_chars"], none["edited_sha256"], none["fingerprint"], none["edited_fingerprint"], none["near_edited"], none["near_next"]) == (0, EMPTY, "", "", 1.0, 0.0)
    # the next of the ordinary row is the empty one: its last third goes and nothing comes
    assert other["edited_sha256"] == hashlib.sha256(b"some words").hexdigest() and other["near_next"] == 0.0 and other["fingerprint"]


def test_nothing_repeats_in_empty_texts(odd):
    got = rows(suffix_dedup.remove(odd))
    assert (got[None]["n_bytes"], got[None]["n_removed"], got[None]["n_spans"], got[None]["kept_sha256"]) == (0, 0, 0, EMPTY)
    assert (got[7]["n_bytes"], got[7]["n_removed"]) == (15, 0)


def test_no_personal_data_in_empty_texts(odd):
    got = rows(pii.find(odd))
    assert all(got[i][f"n_{kind}"] == 0 for i in got for kind in pii.KINDS) and got[None]["spans"] == [] == got[7]["spans"]
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(odd).collect()}[7] == "some words here"


def test_components_of_empty_and_equal_prints(spark, odd):
    again = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1))
    got = simhash.clusters(again).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 0), (7, 7), (7, 7), (8, 7)]
    kept = simhash.representatives(again.withColumns({"root": F.lit("mine"), "fp": F.lit("own"), "times": F.lit(3)}))
    assert sorted((r["doc_id"] or 0, r["root"], r["fp"], r["times"]) for r in kept.collect()) == [(0, "mine", "own", 3), (7, "mine", "own", 3)]


@pytest.fixture(scope="module")
def toxic(spark):
    texts = [f"plain words about weather number {i}" for i in range(40)] + [f"vile slurword grimlok insult {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_scores_of_empty_and_very_long_texts(spark, toxic):
    long = "plain words about weather " * 40_000
    texts = [(1, None), (2, ""), (3, " \n"), (4, long), (5, f"{long} vile slurword grimlok insult"), (None, "vile slurword grimlok insult"), (6, "vile slurword grimlok insult"), (6, "vile slurword grimlok insult")]
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), toxic).collect()]
    assert len(got) == len(texts) and all(0 <= s <= 1 for _, s in got)
    of = dict(got)
    assert of[1] == of[2] == of[3] < 0.5 and of[4] < 0.5 < of[6] == of[None]
    # one toxic span counts however long the clean rest is
    assert of[5] > of[4]


def test_scores_of_empty_texts_by_the_language_model(odd):
    got = rows(lm_scoring.score(odd, lm_scoring.held_out()))
    assert got[None]["n_tokens"] == 1 and got[None]["n_known"] <= 1 and got[None]["score"] < 0
