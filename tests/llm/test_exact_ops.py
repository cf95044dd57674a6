"""Grace deduplication, Merkle manifests and hard negatives against plain computations and their SQL."""

import hashlib
import math
import random
import string
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketweave.llm import grace_dedup, hard_negatives, merkle, queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_grace_dedup", "op12_merkle", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows and rows == sorted(want.fetchall())


# -- Grace deduplication


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return groups


@pytest.mark.parametrize("sizes", [{}, {"bucket": 4_000, "task": 2_000}, {"bucket": 300, "task": 300, "hash_bits": 3}, {"bucket": 1, "task": 1}])
def test_grace_equals_plain_groups(spark, docs, rows, sizes):
    got = grace_dedup.groups(docs, **sizes).collect()
    want = plain_groups(rows)
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    assert set(by_sha) == {sha(t) for t in want}
    for text, ids in want.items():
        of = by_sha[sha(text)]
        assert sorted(r["doc_id"] for r in of) == sorted(ids)
        assert {(r["keep_id"], r["group_size"]) for r in of} == {(max(ids), len(ids))}
        assert [r["doc_id"] for r in of if r["kept"]] == [max(ids)]  # one row, also of repeated ones


def test_grace_of_hot_text_and_awkward_rows(spark):
    hot = "The Same LINE. " * 50
    rows = [(i, hot if i % 3 else f"text {i % 500}", "x") for i in range(3_000)]
    rows += [(None, hot, "n"), (None, None, "n"), (None, "", "n"), (None, None, "n"), (7_000, "É", "a"), (7_001, "é", "a"), (7_002, "x" * 300_000, "a"), (7_003, "X" * 300_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string").repartition(7)
    got = grace_dedup.groups(df, bucket=5_000, task=3_000).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    size = sum(t == hot for _, t, _ in rows)
    assert of[1]["group_size"] == size and of[1]["keep_id"] == 2999 and sum(r["kept"] for r in got if r["group_size"] == size) == 1
    assert of[7_000]["kept"] and of[7_001]["kept"]  # only A-Z are lower-cased
    assert not of[7_002]["kept"] and of[7_003]["kept"]
    nulls = [r for r in got if r["text_sha256"] == sha("")]
    assert [(r["keep_id"], r["group_size"]) for r in nulls] == [(None, 3)] * 3 and sum(r["kept"] for r in nulls) == 1
    kept = grace_dedup.deduplicate(df, bucket=5_000, task=3_000)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    assert {r["content"] for r in kept.collect()} == {"x", "n", "a"}


def test_table_compares_contents_of_equal_hashes():
    table, rng = grace_dedup.Contents(), random.Random(1)
    texts = [bytes(rng.choices(range(256), k=rng.randint(0, 9))) for _ in range(3_000)]
    first = {}
    for t in texts:
        at = table.enter(len(t) % 2, memoryview(t))  # two hashes for all
        assert at == first.setdefault(t, len(first))
    assert len(table) == len(first) and [bytes(table.content(i)) for i in first.values()] == list(first)


def test_views_of_sliced_columns():
    column = pa.array(["a", None, "", "bé", "c"])
    assert [bytes(v) for v in grace_dedup._views(column[2:])] == [b"", "bé".encode(), b"c"]
    assert [bytes(v) for v in grace_dedup._views(column.cast(pa.large_binary())[3:])] == ["bé".encode(), b"c"]


def test_grace_of_no_rows(empty, odd):
    assert grace_dedup.groups(empty).count() == 0 and grace_dedup.deduplicate(empty).columns == empty.columns
    got = {r["doc_id"]: r for r in grace_dedup.groups(odd).collect()}
    assert got[None]["kept"] and got[None]["keep_id"] is None and got[7]["kept"] and got[7]["group_size"] == 1


# -- Merkle manifests


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fan):
    """Root of the nodes, and each one's siblings left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // fan * fan : i // fan * fan + fan]
            path.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], paths


def plain_manifest(rows, fan):
    """Sorted (doc_id, source, leaf, subroot, root, path)."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(by_source[s]), *climb([x[2] for x in sorted(by_source[s])], fan)) for s in sources]
    root, tops = climb([t[1] for t in trees], fan)
    out = []
    for source, (leaves, subroot, paths), top in zip(sources, trees, tops, strict=True):
        out += [(x[3], source, x[2], subroot, root, path + top) for x, path in zip(leaves, paths, strict=True)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("fan", "levels"), [(3, 6), (3, 1), (2, 2), (3, 2)])
def test_manifest_equals_plain_trees(docs, rows, fan, levels):
    got = merkle.manifest(docs, fan=fan, levels=levels).collect()
    plain = sorted([(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in got], key=str)
    assert plain == plain_manifest(rows, fan)
    assert all(r["folded_root"] == r["root"] for r in got)


def test_manifest_of_many_sources_and_one_hot(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"é{i % 200}", 2) for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    got = merkle.manifest(df, F.when(F.col("doc_id") == 5, F.lit("other")).otherwise(F.col("text")), levels=2).collect()
    assert sorted([(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in got], key=str) == plain_manifest(rows, 3)
    assert {r["doc_id"] for r in got if r["folded_root"] != r["root"]} == {5}


def test_manifest_of_awkward_rows(spark, empty, odd):
    assert merkle.manifest(empty).count() == 0
    got = {r["doc_id"]: r for r in merkle.manifest(odd).collect()}
    assert got[None]["leaf"] == sha("-----") == got[None]["subroot"] and got[7]["source"] == "a"
    assert got[7]["root"] == sha(got[None]["subroot"] + got[7]["subroot"])
    alone = merkle.manifest(odd.where("doc_id = 7")).select("root", "leaf", "path", merkle.proof(F.col("path")).alias("proof")).first()
    assert alone["root"] == alone["leaf"] and alone["path"] == [] and alone["proof"] == sha("")
    long = spark.createDataFrame([(1, "é\n" * 400_000, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r["leaf"] for r in merkle.manifest(long).collect()) == [sha("1:1---" + f"{1_200_000}:" + "é\n" * 400_000)] * 3


# -- hard negatives


def plain_negatives(rows, every, k, low):
    fit, best = [], {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, math.floor(256 * x))) for x in v]
        if vec_id not in best or (label, whole) < best[vec_id]:
            best[vec_id] = (label, whole)
    fit = [(i, *x) for i, x in best.items()]
    out = []
    for a, label, v in fit:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in fit if i != a)
        for score, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and low * -score <= 100 * -x[0] <= 100 * -score][:k]
            out += [(a, p, r, n, -score, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(128, 2_048, 32), (4, 16, 3), (1, 7, 1)])
def test_negatives_equal_plain_search(spark, sizes):
    rng = random.Random(5)
    near = [rng.gauss(0, 1) for _ in range(8)]
    vectors = [[x + rng.gauss(0, 0.3) * (i % 3) for x in near] for i in range(120)]
    rows = [(i, None if i % 31 == 1 else i % 2, v) for i, v in enumerate(vectors)]
    rows += [(200 + i, i % 2, vectors[0]) for i in range(12)]  # ties
    rows += [(300, 0, None), (301, 0, [None] * 8), (302, 1, [math.nan] * 8), (303, 1, [math.inf] * 8), (None, 1, near), (304, 1, [1.0, -2.0]), (305, 0, []), (306, 1, [1e200] * 8), (4, 1, near), (10, 0, near)]
    rows += [(400 + i, 2, [-x for x in near]) for i in range(6)] + [rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, part string")
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, sizes=sizes)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 5, 5, 80)


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0]), (1, 2, [1.0])], schema)  # no positive
    assert hard_negatives.mine(one, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(one, F.col("vec_id") == 3).count() == 0  # no anchor


def test_blocks_of_anchors_are_not_broadcast(spark):
    rows = spark.range(600).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"), F.array(*[F.lit(x) for x in range(4)]).alias("vector"))
    blocks = hard_negatives._blocks(rows, 6, 4, 2)
    tiles = hard_negatives._tiles(hard_negatives._blocks(rows.where("vec_id % 100 = 0"), 2, 4, 2), blocks, 6, 2)
    assert tiles.count() == 12
    assert "Broadcast" not in tiles._jdf.queryExecution().executedPlan().toString()


def test_product_of_large_numbers():
    a = np.full((2, 40), hard_negatives.LIMIT, np.int32)
    a[1, ::2] -= 1
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in a] for r in a]
    assert hard_negatives.product(a, a).tolist() == want
