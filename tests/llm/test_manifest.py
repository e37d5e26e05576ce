"""The Merkle manifest against a plain tree, on odd rows, on one large source, and with tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings (left, right) of each node level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            i = at[k]
            run = nodes[i - i % 3 : i - i % 3 + 3]
            p.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    leaf = lambda r: H(*map(field, r))
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for r, path in zip(by[s], trees[s][1]):
            whole = path + top
            spoilt = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf((*r[:4], r[4].replace("\n", ""))) if spoilt else leaf(r)
            for a, b in whole:
                acc = H(a, acc, b)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(a + b for a, b in whole)), acc, acc == root))
    return sorted(out, key=str)


def found(docs):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in manifest.audit(docs).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (3, 1), (4, 9, 1), (10, 27, 28, 2, 1)])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(100 * k + i, f"s{k}", "en", i, f"text {i}\nof source {k}\n" if i % 3 else "one line") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(docs) == plain(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain(rows)  # nulls, ties, repeated rows, further columns
    assert manifest.audit(none).count() == 0
    names = odd.select("doc_id", "source", *(F.lit("mine").alias(c) for c in ("idx", "tree", "subroot", "_read", "_p", "a.b")), F.md5(F.col("text").cast("binary")).alias("leaf")).filter("leaf is not null")
    got = manifest.manifest(names)
    assert got.columns == ["doc_id", "source", "idx", "tree", "_read", "_p", "a.b", "leaf", "path", "subroot", "root"] and got.filter("`a.b` = 'mine' and _p = 'mine' and idx = 'mine'").count() == names.count()


def test_sources_of_any_name(spark):
    rows = [(i, s, None, None, "a\nb") for i, s in enumerate([None, "", "a", "B", "é", "漢", "𝄞", "￿", "a ", None, "", "𝄞"])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_one_large_source_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 9)
    rows = [(i // 2, "hot" if i % 5 else f"s{i % 3}", "en", i % 7, f"{i % 4}\n{i}") for i in range(3000)]
    rows += rows[:40]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_leaf_tells_fields_apart(spark):
    rows = [(1, "a", "b", None, "-"), (2, "-", None, 1, None)]
    got = {r[1] for r in found(spark.createDataFrame(rows, SCHEMA))}
    assert got == {H("1:1", "1:a", "1:b", "-", "1:-"), H("1:2", "1:-", "-", "1:1", "-")}
