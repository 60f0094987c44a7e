"""Line dedup, decontamination, near duplicates and secrets against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, line_dedup, secret_scan, simhash
from tests.llm.conftest import rows

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(data, least=40, docs=5, in_order=False):
    holders = defaultdict(set)
    for doc, text in data:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WS))
            if len(key) >= least and doc is not None:
                holders[key].add(doc)
    out = []
    for doc, text in data:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(k := lower(x.strip(WS)), ())) >= docs and doc != max(holders[k]))]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out if in_order else sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "shard"), [(16, 2_000_000), (1, 700), (16, 50)])
def test_line_dedup_is_the_brute_force(docs, bits, shard):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    clash = {c: F.lit("x") for c in ("n_lines", "n_dropped", "lost_id", "lost_hash", "lost_keys", "digest", "text_hash", "keys", "keep", "repeated")}
    got = line_dedup.dedup_lines(docs.withColumns(clash), bits_a_key=bits, shard_rows=shard)
    assert got.columns == [*docs.columns, *(c for c in clash if c not in ("n_lines", "n_dropped", *docs.columns)), "n_lines", "n_dropped"]
    assert rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == brute_lines(data)
    assert got.agg(F.sum("n_dropped")).first()[0] > 10


def test_line_dedup_of_rows_without_an_id(spark):
    line = "a line that is long enough to be a key of its own"
    data = [(i, line) for i in range(5)] + [(None, f"{line}\nand {i}") for i in range(40)] + [(None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == brute_lines(data)


def test_line_dedup_of_an_empty_table(empty):
    assert rows(line_dedup.dedup_lines(empty)) == []


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    first, second, third = line_dedup.suspected([a, np.concatenate((b, a[:700])), b[:5].repeat(2)])
    assert first[:700].all() and second[5000:].all() and second[:5].all() and third.all()
    assert first[700:].mean() < 0.05 and second[5:5000].mean() < 0.05


@pytest.mark.parametrize("docs", [500, 5000])
def test_few_unique_lines_are_suspected_at_any_number_of_keys(spark, docs):
    """Ten unique lines a document: with ten times the keys there are ten times the shards, and no more of the keys are suspected."""
    line = F.concat(F.lit("a line of its own, long enough to be a key: "), F.col("id").cast("string"), F.lit("/"), F.col("k").cast("string"))
    unique = spark.range(docs).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).groupBy("id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    seen = line_dedup.seen_keys(unique.select(F.col("id").alias("doc_id"), "text"), 40)
    assert seen.count() == docs * 10
    assert line_dedup.suspects(seen, shard_rows=500).count() < docs * 10 * 0.05


def brute_contamination(data, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add("" if item is None else str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in data:
        w = word.findall(lower(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [200_000, 100])
def test_contamination_is_the_brute_force(spark, docs, block):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(7001, "quick brown FOX"), (7002, None), (7003, "!!"), (7001, "lazy dog"), (None, "old stone bridge"), (7004, "own 3 line The quick brown fox jumps over the lazy dog near"), (7005, "wort " * 12)], "item_id long, text string")
    items = benchmark.union(more)
    got = decontamination.contamination(docs, items, block_words=block)
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert rows(got.select("doc_id", "n_words", "n_hit", "items")) == want
    assert sum(x[2] > 0 for x in want) > 8
    clash = {c: F.lit("x") for c in ("n_words", "n_hit", "items", "hit_words", "item_id")}
    assert rows(decontamination.contamination(docs.withColumns(clash), items.withColumn("n_hit", F.lit(1)), block_words=block).select("doc_id", "n_words", "n_hit", "items")) == want
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(x[2] == 0 for x in want)


def test_contamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("n_hit > 0").count() == 0
    assert rows(decontamination.contamination(empty, none)) == []


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """Least index of each fingerprint's component at three or fewer differing bits."""
    label = list(range(len(fps)))
    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_are_the_brute_force(docs):
    data = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_fingerprint(t) for _, t in data]
    label = brute_components(fps)
    want = sorted(((d, f"{f:016x}", data[at][0]) for (d, _), f, at in zip(data, fps, label, strict=True)), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


@pytest.mark.parametrize("block", [4096, 4])
def test_links_join_all_near_fingerprints(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(2**63), 2**63, 40)
    flips = [int(c) ^ 0 for c in centre]
    for c in centre[:6]:
        for _ in range(25):
            v = np.uint64(np.int64(c))
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= np.uint64(1) << np.uint64(b)
            flips.append(int(np.int64(v)))
    fps = sorted(set(flips))
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block))
    got = {r.v: r.label for r in found.collect()}
    label = brute_components([np.uint64(np.int64(f)) for f in fps])
    assert {f: got.get(f, f) for f in fps} == {f: fps[at] for f, at in zip(fps, label, strict=True)}


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_near_duplicates_of_an_empty_table(empty):
    assert rows(simhash.near_duplicates(empty)) == [] == rows(simhash.keep_one(empty))


def test_keep_one_keeps_null_ids_and_repeats(docs):
    clash = docs.withColumns({c: F.lit("x") for c in ("gone_id", "fp", "component_id", "fingerprint")})
    assert simhash.keep_one(clash).columns == clash.columns
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 9001").count() == 1 and kept.where("doc_id = 9002").count() == 0
    assert kept.where("doc_id = 9005").count() == 2


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def entropies(s, n):
    out = []
    for i in range(len(s) - n + 1):
        w = s[i : i + n]
        p = np.array([w.count(c) for c in set(w)]) / n
        out.append(float(-(p * np.log2(p)).sum()))
    return out


def brute_added(text):
    """By the rule's words: blanks for allowed words in either case, runs of 20 token characters, UUIDs and plain paths left out, every window counted anew."""
    text = text or ""
    for word in ("example", "placeholder", "sample", "dummy", "xxxx", "0123456789", "abcdefgh"):
        text = re.sub(word, " " * len(word), text, flags=re.I | re.A)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
        run = m[0]
        uuid = re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run)
        plain = all(len(x) <= 15 and x.isalpha() or len(x) <= 8 and x.isdigit() or not x for x in re.split("[/_+-]", run))
        if uuid or plain or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        kind, least = (3, 3.2) if re.fullmatch("[0-9A-Fa-f]+", run) else (4, 3.7) if run.isalnum() else (5, 3.8)
        high = [i for i, h in enumerate(entropies(run, 20)) if h >= least]
        if high:
            out.append((m.start() + high[0], kind, m.start() + high[-1] + 20))
    return sorted(out)


def test_neither_a_name_nor_a_placeholder_hides_a_secret(spark):
    rng = np.random.default_rng(3)
    blob = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWYZabcdefghijklmnopqrstuvwyz0123456789+/"), 960))
    secret, hexes = "Zk3vQ9xT7bLm2RpW8sYc4NfH", "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    texts_ = [f"sample_key={secret}", f"key={hexes}", f"key {hexes}", blob, f"{blob}xXxX{blob}", f"example {secret}Example{secret} dummy={secret}", "example_value_of_a_sample=placeholder", "=".join(["a"] * 40)]
    got = [[tuple(s) for s in r.added] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert got == [brute_added(t) for t in texts_]
    assert got[0] == [(11, 4, 35)] and got[1] == [(4, 3, 44)] and got[2] == [(4, 3, 44)] and len(got[5]) == 3 and got[6:] == [[], []]
    assert got[3][0][0] < 20 and got[3][-1][2] > 940
    assert sum(e - s for s, _, e in got[4]) > 2 * sum(e - s for s, _, e in got[3]) - 80


def test_secrets_are_the_brute_force(docs):
    got = secret_scan.scan(docs).select("doc_id", "text", "base", "added").collect()
    for r in got:
        assert [tuple(s) for s in r.base] == brute_base(r.text), r.doc_id
        assert [tuple(s) for s in r.added] == brute_added(r.text), r.doc_id
    by = {r.doc_id: r for r in got}
    assert len(by[9023].base) >= 4
    assert [s.kind for s in by[9024].added] == [4]


def test_window_entropy_by_counts(spark):
    s = "aB3" * 9 + "Zk3vQ9xT7bLm2RpW8sYc4NfH"
    for least in (1.5, 3.0, 4.0, 4.2, 5.0):
        got = spark.createDataFrame([(s,)], "s string").select(secret_scan.high_entropy(F.col("s"), F.lit(least), F.lit(62))).first()[0]
        high = [i + 1 for i, h in enumerate(entropies(s, 20)) if h >= least] or [0]
        assert tuple(got) == (high[0], high[-1])


def test_secrets_in_a_text_of_very_many_matches(spark):
    """Places over several groups of matches, beside characters of two and four bytes."""
    text = " é😀 ".join(hashlib.sha256(str(i).encode()).hexdigest()[: 12 + i % 20] for i in range(3000))
    data = [(1, text), (2, "deadbeefdeadbeef " * secret_scan.TOGETHER), (3, "deadbeefdeadbeef")]
    for r in secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect():
        assert [tuple(s) for s in r.base] == brute_base(r.text)
        assert [tuple(s) for s in r.added] == brute_added(r.text)


def test_secrets_replace_columns_of_their_names(docs):
    clash = docs.withColumns({c: F.lit("x") for c in ("base", "added", "spans", "found", "start")})
    got = secret_scan.scan(clash)
    assert sorted(got.columns) == sorted(clash.columns) and rows(got.select("doc_id", "base", "added")) == rows(secret_scan.scan(docs).select("doc_id", "base", "added"))


def test_secrets_of_an_empty_table(empty):
    assert rows(secret_scan.scan(empty)) == []


def test_digest_of_no_span():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_equal_words_on_both_sides_are_looked_at_once():
    """An item and a document of 20,000 equal words: one window, and one look for each place."""
    import time

    words = [b"same"] * 20_000
    index = decontamination.Windows([("a", words), ("b", words[:500]), ("c", [b"same", b"other"] * 300)], 10, 3)
    index.index({})
    assert len(index.windows) == 3
    began = time.perf_counter()
    covered, items = index.hits(index.ids(words))
    assert covered.all() and items == ["a", "b"] and time.perf_counter() - began < 1
