"""The Merkle manifest against a tree built node by node."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from llm_fixtures import DOCS, odd

SF = "/root/testdata/sf0.001"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(r, text):
    fields = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return _h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(nodes):
    """(root, the siblings left and right of each node, level by level)."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owned = [], []
        for s in range(0, len(nodes), 16):
            run = nodes[s:s + 16]
            for k in range(len(run)):
                for i in under[s + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(_h("".join(run)))
            owned.append([i for k in range(len(run)) for i in under[s + k]])
        nodes, under = up, owned
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = _tree([x[2] for x in groups[s]])
    root, above = _tree([trees[s][0] for s in names])
    out = Counter()
    for s, upper in zip(names, above):
        for (_, _, leaf, r), path in zip(groups[s], trees[s][1]):
            path = path + upper
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = _leaf(r, text)
            for left, right in path:
                at = _h(left + at + right)
            out[r.doc_id, leaf, trees[s][0], root, _h("".join(a + b for a, b in path)), at, at == root] += 1
    return out


def _check(df):
    from scenaria.llm.merkle import tamper_report

    got = tamper_report(df).collect()
    assert Counter(map(tuple, got)) == brute(df.collect())
    return got


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [300, 5, 256, 257]])
def test_small_trees(spark, sizes):
    rows = [(i * 7 + j, f"Text {i} {j}" if j % 5 else None, "en", None if i == 2 else f"s{i}é", j) for i, n in enumerate(sizes) for j in range(n)]
    got = _check(spark.createDataFrame(rows, DOCS).repartition(3))
    assert len(got) == sum(sizes)


def test_several_rounds_of_small_blocks(spark, monkeypatch):
    """Blocks of 16 leaves and ranges of few rows: three rounds, and a source that is spread over all partitions."""
    from scenaria.llm import merkle as M

    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = [(j, f"T{j}", "en", "hot" if j % 3 else f"s{j % 50}", j) for j in range(1200)]
    _check(spark.createDataFrame(rows, DOCS).repartition(5))


def test_odd_rows(spark):
    from scenaria.llm.merkle import tamper_report

    df = odd(spark)
    df = df.unionByName(df).unionByName(spark.createDataFrame([(None, "A", None, None, None), (10, "ABC Ä", "", "", 3), (10, "ABC", "", "", None)], DOCS), allowMissingColumns=True)
    _check(df)
    assert tamper_report(df.limit(0)).collect() == []


def test_query_and_sql_against_the_plain_tree(spark):
    from scenaria.llm.queries import ORACLE_SQL, QUERIES

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    want = brute(rows)
    assert Counter(map(tuple, got)) == want
    assert 0 < sum(not r.verified for r in got) < len(got) / 2
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert Counter(con.sql(ORACLE_SQL["op12_merkle_manifest"]).fetchall()) == want


def test_a_path_leads_to_the_root(spark):
    from pyspark.sql import functions as F

    from scenaria.llm.merkle import folded, manifest

    rows = manifest(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("to", folded(F.col("leaf"), F.col("path")))
    assert rows.where("to <> root").count() == 0 and rows.select("root").distinct().count() == 1
