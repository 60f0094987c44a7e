"""The Merkle manifest against brute force: every tree and every proof, for several fanouts."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle, queries
from tests.llm.conftest import SF, rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fanout):
    """(root, for each node its levels of (before, after))."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for s, i in zip(steps, at, strict=True):
            run = range(i - i % fanout, min(len(level), i - i % fanout + fanout))
            s.append(("".join(level[k] for k in run if k < i), "".join(level[k] for k in run if k > i)))
        at = [i // fanout for i in at]
        level = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], steps


def brute(data, fanout=2):
    """Rows of the contract; *data*: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for d in data:
        by[d[2]].append((d[0] is not None, d[0], sha(*map(told, d)), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rows_ in by.values():
        rows_.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    trees = {x: tree([r[2] for r in by[x]], fanout) for x in langs}
    root, above = tree([trees[x][0] for x in langs], fanout)
    out = []
    for x, own in zip(langs, above, strict=True):
        for (_, doc_id, leaf, d), steps in zip(by[x], trees[x][1], strict=True):
            changed = d[3] is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            got = sha(*map(told, (*d[:3], d[3] + 1, d[4]))) if changed else leaf
            for before, after in (*steps, *own):
                got = sha(before, got, after)
            out.append((doc_id, leaf, trees[x][0], root, sha("".join(b + a for b, a in (*steps, *own))), got, got == root))
    return sorted(out, key=repr)


def made(df, fanout):
    leaf = merkle.leaf_hash(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    return merkle.manifest(df.withColumn("leaf", leaf), fanout=fanout)


def of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_the_query_is_the_brute_force(spark, odd, docs, tmp_path):
    for name, df in (("odd", odd), ("docs", docs), ("one", odd.limit(1)), ("lone", odd.where("doc_id = 9004"))):
        df.withColumn("subroot", F.lit("x")).write.parquet(str(tmp_path / name / "documents.parquet"))
        df = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        assert rows(queries.op13_merkle_manifest(spark, str(tmp_path / name))) == brute(of(df))


def test_some_are_changed_and_only_these_fail(spark):
    got = queries.op13_merkle_manifest(spark, SF).collect()
    assert {r.doc_id for r in got if not r.verified} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 0} and len({r.root for r in got}) == 1


@pytest.mark.parametrize("fanout", [3, 16])
def test_other_fanouts(spark, odd, fanout):
    more = [(i, "s", f"l{i % 40}" if i % 3 else "é", i, str(i)) for i in range(300)]
    df = odd.select("doc_id", "source", "lang", "n_chars", "text").union(spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string"))
    got = made(df, fanout)
    told_ = got.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof")))
    assert rows(told_) == sorted(((*r[:5], r[3]) for r in brute(of(df), fanout)), key=repr)


def test_names_nulls_and_empty_tables(spark, odd, empty):
    clash = odd.withColumns({c: F.lit("x") for c in ("root", "proof", "hash", "idx", "row", "place", "run", "alone", "level", "o0")})
    got = made(clash, 2)
    assert got.columns == [*(c for c in clash.columns if c not in ("root", "proof")), "leaf", "subroot", "root", "proof"] and got.count() == odd.count()
    assert rows(made(empty, 2)) == [] and made(empty, 2).columns[-3:] == ["subroot", "root", "proof"]
    with pytest.raises(ValueError, match="two"):
        merkle.manifest(odd, fanout=1)
