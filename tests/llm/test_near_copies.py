"""The pipeline's near-dedup against brute force over five-word shingles."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import near_copies, simhash
from tests.llm.conftest import SF, rows


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute(data):
    """Ids of the rows that are the least of their component, all pairs compared."""
    sets, label = [brute_set(t) for _, t in data], list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (9 * len(a & b) >= 4 * (len(a) + len(b))) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    first = {}
    for (d, _), at in zip(data, label, strict=True):
        first[at] = min(first.get(at, d), d)
    return sorted(first.values())


def edited(base, n, rng):
    words = base.copy()
    for at in rng.choice(np.arange(2, len(base) - 2), n, replace=False):
        words[at] = f"x{rng.integers(10**9)}"
    return words


def test_copies_of_similarity_08_to_09_go(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(60):
        base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        a = brute_set(" ".join(base))
        while True:
            other = edited(base, 4 + i % 6, rng)
            b = brute_set(" ".join(other))
            if 0.8 <= len(a & b) / len(a | b) <= 0.9:
                break
        data += [(1000 + i, " ".join(base)), (2000 + i, " ".join(other).upper())]
        data.append((3000 + i, " ".join(edited(base, 60, rng))))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_copies.keep_one(df).select("doc_id").collect()}
    assert kept == set(range(1000, 1060)) | set(range(3000, 3060))
    by_bits = {r.doc_id for r in simhash.keep_one(df).select("doc_id").collect()}
    assert len(by_bits & set(range(2000, 2060))) > 30


def test_groups_of_near_copies_are_the_brute_force(spark):
    rng = np.random.default_rng(5)
    data, base = [], [f"w{x}" for x in rng.integers(0, 500, 120)]
    for i in range(80):
        data.append((i, " ".join(edited(base, 1 + i % 5, rng))))
    data += [(100, ""), (101, " \n"), (102, None), (103, "two words"), (104, "Two  WORDS"), (105, "two word")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == kept_by_brute(data)


def test_given_documents_are_the_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == kept_by_brute([tuple(r) for r in df.collect()])


def test_null_ids_and_repeats_stay(docs, empty):
    assert rows(near_copies.keep_one(empty)) == []
    clash = docs.withColumns({c: F.lit("x") for c in ("gone_id", "v", "keys", "label", "first")})
    assert near_copies.keep_one(clash).columns == clash.columns
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 9005").count() == 2


def test_copies_that_are_not_similar_make_no_pairs_of_all(spark, monkeypatch):
    """Every row shares keys with half of all others, and none is similar to another: pairs to verify grow with the rows, and all stay."""
    rng = np.random.default_rng(2)
    counts, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: counts.append(pairs.count()) or verified(pairs, sets))
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    for n in (150, 600):
        df = spark.createDataFrame([(i, " ".join(edited(base, 10, rng))) for i in range(n)], "doc_id long, text string").repartition(3)
        assert near_copies.keep_one(df).count() == n
    assert len(counts) == 2 and all(c <= near_copies.BANDS * n for c, n in zip(counts, (150, 600), strict=True)) and counts[1] < 6 * counts[0]


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    data = [(i, " ".join(edited(base, 1 + i % 6, rng))) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    rows_ = near_copies.signatures(df).select("v").distinct().withColumns({"key": F.lit(1), "label": F.col("v")})
    met = {frozenset((a.v, b.v)) for group in _by_group(near_copies.dealt(rows_, 7)) for a in group for b in group if a.v < b.v and (a.side != b.side or a.part.a == a.part.b)}
    assert len(met) == len({r.v for r in rows_.collect()}) * (rows_.count() - 1) // 2
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == kept_by_brute(data)


def _by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.key, r.part), []).append(r)
    return out.values()


def test_overlaps_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 5)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 1, 5, 30, 30, 50)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[2:]] for a in sets[:4]]
    assert near_copies.overlaps(sets[:4], sets[2:]).tolist() == want


def test_candidates_are_deletion_variants_of_fingerprints():
    """Fingerprints that differ in one part share the key without it; short sets share keys with what one or two shingles less leave."""
    prints, parts, bits = near_copies.PRINTS, near_copies.PARTS, near_copies.BITS
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2, (1, prints, parts, bits)).astype(np.uint8)
    b = 1 - a
    b[0, 3, [0, 2]] = a[0, 3, [0, 2]]
    shared = set(near_copies.deletions(a, prints, bits)[0].tolist()) & set(near_copies.deletions(b, prints, bits)[0].tolist())
    assert shared == {near_copies.deletions(a, prints, bits)[0].reshape(parts, prints)[1, 3]}
    for common, more_a, more_b in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (9, 0, 2), (12, 1, 2), (20, 2, 3), (240, 30, 30)):
        for _ in range(50):
            u = rng.integers(0, 2**64, common + more_a + more_b, np.uint64)
            x, y = np.unique(u[: common + more_a]), np.unique(np.concatenate([u[:common], u[common + more_a :]]))
            found = set(near_copies.shortened(x)) & set(near_copies.shortened(y))
            raw = np.array([np.frombuffer(near_copies.simhash(s, prints, bits), np.uint8) for s in (x, y)])
            p, q = near_copies.deletions(np.unpackbits(raw[:, 16:], axis=1)[:, : prints * parts * bits], prints, bits).tolist()
            assert found or common > 9 and set(p) & set(q) and np.bitwise_count(raw[0, :16] ^ raw[1, :16]).sum() <= near_copies.FAR


def test_rows_of_a_key_part_by_their_bits(monkeypatch):
    rng = np.random.default_rng(3)
    k = np.sort(rng.integers(0, 12, 400))
    low, high = rng.integers(-(2**63), 2**63 - 1, (2, 5))[:, rng.integers(0, 5, 400)]
    low = low ^ (1 << rng.integers(0, 60, 400))
    want = [min(np.flatnonzero((k == k[i]) & (high == high[i]))) if ((k == k[i]) & (high == high[i])).sum() > 1 else -1 for i in range(400)]
    assert near_copies.parted(k, low, high).tolist() == want
    monkeypatch.setattr(near_copies, "FEW", 3)
    assert near_copies.parted(k, low, high).tolist() == want
