"""The manifest against hashlib, with blocks of few nodes, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from plenum.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, i):
    for level in levels[:-1]:
        j = i ^ 1
        yield j < i, level[j] if j < len(level) else None
        i >>= 1


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    inside = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups}
    trees = {g: climb([leaf(r) for r in inside[g]]) for g in groups}
    over = climb([trees[g][-1][0] for g in groups])
    for k, g in enumerate(groups):
        for i, r in enumerate(inside[g]):
            path = [*beside(trees[g], i), *beside(over, k)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4]) if tampered else r)
            for left, s in path:
                h = sha(s, h) if left and s else sha(h, s or "")
            yield (r[0], leaf(r), trees[g][-1][0], over[-1][0], sha(*(s for _, s in path if s)), h, h == over[-1][0])


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LANGS = ["de", "en", None, "", "é", "zz"]
ROWS = [(i, "s" if i % 3 else None, "en" if i % 2 else LANGS[i % 5], i * 7 if i % 9 else None, f"text ü {i}" if i % 11 else None) for i in range(150)] + [(3, "s", "en", 21, "text ü 3")] * 3 + [(None, None, None, None, None)] * 2 + [(9000, "", "zz", 5, ""), (7, "other", "en", 1, "again 7"), (9001, "s", "long", 1, "x" * 300_000)]


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS leaf", "2 AS tree", "'x' AS pos", "0 AS n", "3 AS level")
    assert sorted(map(str, brute(ROWS))) == sorted(str(tuple(r)) for r in merkle.digest(docs).collect())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    rows = ROWS[5 : 5 + n]
    found = merkle.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, brute(rows))) == sorted(str(tuple(r)) for r in found)


def test_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", ROWS)
    assert sorted(map(str, brute(ROWS))) == sorted(map(str, con.execute(merkle.SQL).fetchall()))


def test_store_and_other_columns(spark):
    """Other columns, groups and keys than those of documents; the store has every level; a proof holds for its own leaf only."""
    rows = spark.createDataFrame([(i % 4, f"k{i:03}", i) for i in range(40)], "shard int, name string, value int")
    m = merkle.manifest(rows, ["name", "value"], group="shard", key="name")
    assert {(r.level, r.n_) for r in m.store.nodes.groupBy("level").count().withColumnRenamed("count", "n_").collect()} == {(0, 40), (1, 20), (2, 12), (3, 8), (4, 4)}
    folded = merkle.proofs(m).withColumn("own", merkle.fold(merkle.F.col("leaf"), merkle.F.col("path"))).collect()
    assert len(folded) == 40 and all(r.own == m.root for r in folded)
    changed = merkle.manifest(rows.withColumn("value", merkle.F.expr("if(name = 'k007', 0, value)")), ["name", "value"], group="shard", key="name")
    assert changed.root != m.root
    a, b = ({r.tree: r.digest for r in x.subroots.collect()} for x in (m, changed))
    assert [t for t in a if a[t] != b[t]] == ["=3"]
