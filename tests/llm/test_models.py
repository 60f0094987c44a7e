"""Language ID, the lattice model, token counts, chat windows, mixing and search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import chat_windows, language_id, lattice, lattice_lm, mixing, token_counts, vector_search
from tallyloom.llm.common import fold
from tests.llm.conftest import SF, rows


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def crc(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5


def all_segmentations(own, word, weights):
    """The summed probability by listing every segmentation."""

    def go(at):
        if at == len(word):
            return [0.0]
        out = []
        for end in range(at + 1, len(word) + 1):
            piece = own.number.get(word[at:end], own.unknown if end == at + 1 else None)
            if piece is not None:
                out += [weights[piece, 0] + rest for rest in go(end)]
        return out

    return np.logaddexp.reduce(go(0))


def test_forward_sums_all_segmentations():
    own = lattice.pieces(lattice.VOCABULARY)
    weights = np.log(np.random.default_rng(1).dirichlet(np.ones(own.size)))[:, None]
    words = ["the", "thing", "réoueux", "日x", "", "Zq"]
    got = own.forward(words, weights)[:, 0]
    assert np.allclose(got, [all_segmentations(own, lattice.MARK + w, weights) for w in words])
    rng = np.random.default_rng(4)
    many = ["".join(rng.choice(list("thainge日éo"), rng.integers(0, 30))) for _ in range(300)]
    assert np.allclose(own.forward(many, weights)[:, 0], [own._forward_one(lattice.MARK + w, weights)[0] for w in many])
    long = "ab" * 40
    assert np.allclose(own.forward([long], weights), own._forward_one(lattice.MARK + long, weights))
    assert np.allclose(own._forward_one(lattice.MARK + "thing", weights), got[1])


def test_language_id_is_right_on_held_out_documents(spark, docs):
    found = language_id.identify(docs, fold() != 0)
    assert set(docs.columns) < set(found.columns)
    rest = [r for r in found.collect() if crc(r.doc_id) == 0 and r.lang and r.text and r.doc_id < 9000]
    assert len(rest) > 20 and sum(r.lang == r.lang_pred for r in rest) / len(rest) > 0.95
    by = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert all(by[d] == ("und", 0.0) for d in (9001, 9002, 9003, 9004))
    assert all(0 <= s <= 1 for _, s in by.values())


def test_language_id_reads_no_label_of_a_prediction(docs):
    langs, weights = language_id.train(docs, fold() != 0)
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    a = language_id.predict(docs, langs, weights).select("text", "lang_pred", "score")
    assert rows(a) == rows(language_id.predict(changed, langs, weights).select("text", "lang_pred", "score"))


def test_language_id_is_the_brute_force(spark):
    """Training and prediction, word by word and segmentation by segmentation."""
    data = [(1, "the thing and", "en"), (2, "der Ding und", "de"), (3, "the x", "en"), (4, None, "de"), (5, "12", "en"), (6, "la réo", None), (7, "und the", "fr"), (8, "der der the", "de"), (8, "der der the", "de"), (None, "the the", "en"), (9, "日 the", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    clash = df.withColumns({c: F.lit("x") for c in ("lang_pred", "score", "margin", "characters", "words")})
    own = lattice.pieces(lattice.VOCABULARY)
    split = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", lower(t or ""))
    langs = sorted({x for d, _, x in data if x and crc(d) != 0})
    counts = np.zeros((own.size, len(langs)))
    for d, t, x in data:
        if x and crc(d) != 0:
            for ids in own.encode([w.lower() for w in split(t)]):
                np.add.at(counts, (own._of[ids], langs.index(x)), 1)
    weights = np.log((counts + language_id.SMOOTHING) / (counts + language_id.SMOOTHING).sum(axis=0))
    want = []
    for d, t, _ in data:
        words = split(t)
        if not any(c.isalpha() for c in t or ""):
            want.append((d, "und", 0.0, None))
            continue
        logs = np.array([sum(all_segmentations(own, lattice.MARK + w.lower(), weights[:, [k]]) for w in words) for k in range(len(langs))])
        best = int(logs.argmax())
        by_chance = -sum(len(w) + 1 for w in words) * math.log(27)
        want.append((d, langs[best], 1 / np.exp(logs - logs[best]).sum(), (logs[best] - by_chance) / math.log(10)))
    learned = language_id.train(df, fold() != 0)
    assert learned[0] == langs and np.allclose(learned[1], weights)
    got = rows(language_id.predict(clash, *learned, margin=True).select("doc_id", "lang_pred", "score", "margin"))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and (a[2:] == b[2:] if b[3] is None else a[2:] == pytest.approx(b[2:], rel=1e-9))


def test_all_languages_are_learned_in_blocks(spark):
    """300 labels, each with words of its own; blocks of any size give the same languages and scores."""
    data = [(i, f"{'xyzwvuq'[k % 7] * 2}{'aeiou'[k % 5]}{chr(98 + k % 20)} {k:03d}q{chr(97 + k // 20)}{chr(97 + k % 20)}z the", f"l{k:03d}") for i, k in enumerate([*range(300), *range(300)])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    found = []
    for block in (256, 1000, 7):
        langs, weights = language_id.train(df, F.lit(True), block=block)
        assert langs == sorted({x for *_, x in data}) and isinstance(weights, np.ndarray) == (block == 1000)
        found.append({r.doc_id: (r.lang_pred, r.score, r.margin) for r in language_id.predict(df, langs, weights, margin=True).collect()})
    assert len({p for p, *_ in found[0].values()}) > 100
    for other in found[1:]:
        assert all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9) for a, b in zip(found[0].values(), (other[d] for d in found[0]), strict=True))


def test_language_id_without_training_rows(docs, empty):
    found = language_id.identify(docs, F.lit(False))
    assert {r.lang_pred for r in found.collect()} == {"und"}
    assert rows(language_id.identify(empty, fold() != 0)) == []


@pytest.mark.parametrize("block", [4_000_000, 20_000])
def test_lattice_lm_is_the_brute_force(docs, block):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    train = [split(t) for d, t in data if crc(d) != 1]
    counts = Counter(w for ws in train for w in ws)
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    own = lattice.pieces(lattice.VOCABULARY)
    pieces = np.zeros(own.size)
    for ids, c in zip(own.encode(list(counts)), counts.values(), strict=True):
        for i in ids:
            pieces[own._of[i]] += c
    share = (ends + 0.5) / (pieces.sum() + ends + 1)
    weights = lattice.log_weights(pieces[:, None], lattice_lm.SMOOTHING) + math.log1p(-share)
    every = sorted({w for _, t in data for w in split(t)})
    logs = dict(zip(every, own.forward(every, weights)[:, 0], strict=True))
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = defaultdict(list)
    for d, t in data:
        ws = split(t)
        want[d].append((crc(d) != 1, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, sum(p(counts[w]) for w in ws) + p(ends), (sum(logs[w] for w in ws) + math.log(share)) / math.log(10)))
    got = lattice_lm.log_likelihood(docs, fold() != 1, block_bytes=block).collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r[1:]) == pytest.approx(want[r.doc_id][0], rel=1e-9)


def test_lattice_lm_of_an_empty_table(docs, empty):
    assert rows(lattice_lm.log_likelihood(empty, fold() != 1)) == []
    clash = docs.withColumns({c: F.lit("x") for c in ("learned", "block", "word", "words", "place", "c", "score")})
    assert rows(lattice_lm.log_likelihood(clash.where("doc_id > 9020"), F.lit(False)).select("doc_id", "n_known", "train_tokens")) == sorted(((r.doc_id, 0, 0) for r in docs.where("doc_id > 9020").collect()), key=repr)


def test_words_of_long_texts_are_cut_alike(monkeypatch):
    monkeypatch.setattr(lattice_lm, "SLICE", 7)
    text = " Some words,\n\tand anotherverylongone x ".encode() * 5
    assert [w for part in lattice_lm.words_of(text) for w in part] == text.lower().split()
    numbers = np.array([65_536, 0, 1, 65_535, 9_999_999, 1, 0], np.int32)
    assert lattice_lm.unpacked(lattice_lm.packed(numbers)).tolist() == sorted(numbers.tolist())
    assert len(lattice_lm.unpacked(lattice_lm.packed(numbers[:0]))) == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_add_up(docs, rule):
    got = defaultdict(lambda: [0.0, 0])
    for r in token_counts.section_tokens(docs, rule).collect():
        got[r.doc_id][0] += r.n_tokens
        got[r.doc_id][1] += 1
    encoder, _ = token_counts.encoding(token_counts.RANKS)
    want = defaultdict(lambda: [0.0, 0])
    for r in docs.collect():
        want[r.doc_id][0] += len(encoder.encode_ordinary(r.text or ""))
        want[r.doc_id][1] += (r.text or "").count("\n") + 1
    assert {k: (round(a, 6), b) for k, (a, b) in got.items()} == {k: (a, b) for k, (a, b) in want.items()}


def brute_sections(text, rule):
    """Tokens by line, one token after the other."""
    encoder, _ = token_counts.encoding(token_counts.RANKS)
    line_of = [text[:i].count("\n") for i in range(len(text))]
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [0.0] * (text.count("\n") + 1), 0
    for t in encoder.encode_ordinary(text):
        raw = encoder.decode_single_token_bytes(t)
        chars = sorted({of_byte[b] for b in range(at, at + len(raw))})
        at += len(raw)
        own = Counter(line_of[c] for c in chars)
        if rule == "share":
            for line, n in own.items():
                out[line] += n / len(chars)
        else:
            out[{"start": line_of[chars[0]], "end": line_of[chars[-1]], "majority": min(own, key=lambda x: (-own[x], x))}[rule]] += 1
    return out


def test_section_tokens_of_an_empty_table(docs, empty):
    assert rows(token_counts.section_tokens(empty)) == []
    clash = docs.withColumns({c: F.lit("x") for c in ("section", "cuts", "n_tokens", "char_start")})
    assert rows(token_counts.section_tokens(clash)) == rows(token_counts.section_tokens(docs))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_are_the_brute_force(spark, rule):
    texts = ["", "a\n\n\n  b\n", "\n\n\n\n", "é😀\n\n日本\n\n\n   語 x\n", "one two\n\n\n\nthree\n \n \n"]
    got = defaultdict(list)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sorted(token_counts.section_tokens(df, rule).collect()):
        got[r.doc_id].append(round(r.n_tokens, 9))
        assert texts[r.doc_id][r.char_start : r.char_end].count("\n") <= 1
    assert [got[i] for i in range(len(texts))] == [[round(x, 9) for x in brute_sections(t, rule)] for t in texts]


def test_very_long_runs_are_encoded_alike():
    encoder, _ = token_counts.encoding(token_counts.RANKS)
    text = "a  b\n\n c" + " " * 3_000 + "dé ' x's 12 3\n" + "\n" * 500
    import public_tokenizers
    import regex

    by_piece = [t for m in regex.finditer(public_tokenizers.PATTERN, text) for t in encoder._encode_single_piece(m.group().encode())]
    assert by_piece == encoder.encode_ordinary(text)
    starts, ends = token_counts.token_spans(b"x" + b" " * 1_500_000 + b"y")
    assert ends[-1] == 1_500_002 and (starts[1:] == ends[:-1]).all()


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "a title", None, "body text\n"), (2, "", "", "")], "doc_id long, a string, b string, c string")
    got = rows(token_counts.field_tokens(df, ["a", "b", "c"]).groupBy("doc_id").agg(F.sum("n_tokens"), F.count("*")))
    encoder, _ = token_counts.encoding(token_counts.RANKS)
    assert got == [(1, float(len(encoder.encode_ordinary("a title\n\nbody text\n"))), 3), (2, float(len(encoder.encode_ordinary("\n\n"))), 3)]


def chats(spark):
    long = "word " * 900
    data = [(1, t, r, x, "k") for t, (r, x) in enumerate([("system", "be <|turn|> kind \\"), ("user", "hi <|end|> \\| <\\| <"), ("assistant", ""), ("user", None), ("assistant", long), *[("user" if i % 2 else "assistant", f"turn {i} " * 30 + "\\") for i in range(30)]])]
    data += [(2, 0, "system", "only", "k"), (None, 5, "assistant", "a\nb", "k"), (None, None, None, "first", "k")]
    data += [(3, 1, "assistant", "same", "k")] * 2 + [(4, 0, "user", "😀<|", None), (4, 1, "assistant", "é" * 300, None)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, window string"), data


def test_chat_windows_round_trip(spark):
    df, data = chats(spark)
    by = defaultdict(list)
    for conv, turn, role, text, _ in data:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_windows.digests(chat_windows.format_chats(df, budget=400, history=100)).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_windows > 5


def test_chat_windows_keep_the_budget_the_system_turn_and_history(spark):
    df, _ = chats(spark)
    windows = chat_windows.turn_windows(df, budget=400, history=100).orderBy("window").where("conv_id = 1").collect()
    seen = []
    for w in windows:
        assert w.segments[0].role == "system"
        new = [s for s in w.segments if s.kind == 1]
        assert sum(s.tokens for s in w.segments) <= 400 or len(new) == 1 and new[0].tokens > 120
        assert [s.pos for s in new] == list(range(new[0].pos, new[0].pos + len(new)))
        old = [s for s in w.segments if s.kind == 0 and s.pos]
        assert len(old) <= 2 and sum(s.tokens for s in old) <= 100 and all(s.pos < new[0].pos for s in old)
        seen += [s.pos for s in new]
    assert seen == list(range(1, 36))
    assert any(s.kind == 0 and s.pos for w in windows for s in w.segments)


def test_chat_windows_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat_windows.digests(chat_windows.format_chats(none))) == []


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_its_targets(docs):
    data = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in data:
        sizes[s] += n
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(data, key=repr)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and abs(r.copies - r.rate) < 1
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * max(n for _, x, n in data if x == s), s


def test_rates_that_are_not_solved_are_an_error(spark, monkeypatch):
    cells = spark.createDataFrame([("a", 1, 1, 0.5, 1.1), ("a", 2, 1, 1.5, 1.1)], "source string, size long, n long, z double, want double")
    exact = mixing.solve(cells).first().lam
    monkeypatch.setattr(mixing, "NEWTON", 0)  # halving alone gets there too
    assert abs(mixing.solve(cells).first().lam - exact) < 1e-8
    monkeypatch.setattr(mixing, "ITERATIONS", 3)
    with pytest.raises(RuntimeError, match="1 sources"):
        mixing.solve(cells)


def test_solved_rates_are_exponential_and_exact(spark):
    sizes = [int(x) for x in np.random.default_rng(5).pareto(1, 300) * 50 + 1]
    cells = [(s, z, n, z * len(sizes) / sum(sizes), f * len(sizes)) for s, f in (("a", 0.2), ("b", 1.7), ("c", 2.0), (None, 1.0)) for z, n in Counter(sizes).items()]
    lam = {r.source: r.lam for r in mixing.solve(spark.createDataFrame(cells, "source string, size long, n long, z double, want double")).collect()}
    for s, f in (("a", 0.2), ("b", 1.7), ("c", 2.0), (None, 1.0)):
        total = sum(n * z * min(2, math.exp(min(50, lam[s] * z))) for x, _, n, z, _ in cells if x == s)
        assert total == pytest.approx(f * len(sizes), rel=1e-8)


def brute_rates(sizes, target, cap=2):
    """The rate of each size of one source, by halving."""
    mean = sum(sizes) / len(sizes)
    if not mean:
        return dict.fromkeys(sizes, 1.0)
    rate = lambda lam, z: min(cap, math.exp(min(50.0, lam * z)))
    low, high = -700.0 * mean / min(x for x in sizes if x), math.log(cap) * mean / min(x for x in sizes if x) * 1.001
    for _ in range(300):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(x * rate(lam, x / mean) for x in sizes) < target else (low, lam)
    return {x: rate(high, x / mean) if x else 1.0 for x in sizes}


def lot(doc):
    """Spark's hash of an id as text and a word, signed."""
    seed = 42 if doc is None else xxhash.xxh64_intdigest(str(doc), 42)
    return (xxhash.xxh64_intdigest("mix", seed) ^ 1 << 63) - (1 << 63)


def brute_copies(data, rates):
    """Copies by source: places along (size, cell), and in a cell by lot."""
    out = defaultdict(list)
    for source in {s for _, s, _ in data}:
        own = [(d, n) for d, s, n in data if s == source]
        count = Counter(n for _, n in own)
        cells = defaultdict(list)
        for d, n in own:
            cells[n, (lot(d) % (1 << 64) >> 20) % math.ceil(count[n] / mixing.CELL)].append((lot(d), d is not None, d or 0, d))
        upto = 0
        for (n, _), members in sorted(cells.items()):
            rate = rates[source, n]
            part = round((rate - math.floor(rate)) * 1e9) * len(members)
            extra = (upto + part + 500_000_000) // 10**9 - (upto + 500_000_000) // 10**9
            upto += part
            for rank, (*_, d) in enumerate(sorted(members)):
                out[d].append(math.floor(rate) + (rank < extra))
    return out


@pytest.mark.parametrize("cell", [256, 3])
def test_mixing_rates_and_copies_are_the_brute_force(spark, docs, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    ties = spark.createDataFrame([(20_000 + i, "four words of text", "z") for i in range(700)] + [(30_000, None, "nothing"), (30_001, "", "nothing")], "doc_id long, text string, source string")
    clash = {c: F.lit("x") for c in ("size", "rate", "copies", "taken", "target", "source_size", "lot", "cell", "part", "n", "rank")}
    own = docs.select("doc_id", "text", "source").union(ties)
    got = mixing.mix(own.withColumns(clash)).collect()
    data = [(r.doc_id, r.source, r.size) for r in got]
    sizes = defaultdict(list)
    for _, s, n in data:
        sizes[s].append(n)
    want = brute_targets({s: sum(x) for s, x in sizes.items()})
    by_hand = {s: brute_rates(x, want[s]) for s, x in sizes.items()}
    for r in got:
        assert r.rate == pytest.approx(by_hand[r.source][r.size], rel=1e-6, abs=1e-6)
    copies = brute_copies(data, {(r.source, r.size): r.rate for r in got})
    told = defaultdict(list)
    for r in got:
        told[r.doc_id].append(r.copies)
    assert {d: sorted(x) for d, x in told.items()} == {d: sorted(x) for d, x in copies.items()}


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("k")).alias("k")).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that there are several ranges
    try:
        got = mixing.running(df, [F.col("x")], {"upto": F.col("x"), "n": F.lit(1)}, ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for r in got:
        below = [s.x for s in got if s.k == r.k and s.x <= r.x]
        assert (r.upto, r.n) == (sum(below), len(below))


def test_mixing_reruns_agree_and_take_empty_tables(docs, empty):
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(2)))
    assert rows(mixing.mix(empty)) == []
    some = docs.where("doc_id < 9000").withColumn("mixed_id", F.lit("x"))
    told = mixing.mix(some)
    again = mixing.repeated(some, told)
    assert again.columns == some.columns
    assert rows(again.groupBy("doc_id").agg(F.count("*"))) == rows(told.where("copies > 0").select("doc_id", "copies"))


def brute_top(data, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i is not None and i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i is not None and i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out, key=repr)


ODD_VECTORS = [(5000, None), (5050, [1.0, None]), (5100, [float("nan"), 1.0]), (5150, [float("inf")]), (5200, []), (5250, [0.5, 2.0]), (None, [1.0] * 64), *((5300 + i, [9.0] * 64) for i in (0, 1, 2, 3, 3)), (5350, [1.0, 2.0]), (5350, [1.0, -2.0])]
VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("block", [8192, 3])
def test_vector_search_is_the_brute_force(spark, block):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").union(spark.createDataFrame(ODD_VECTORS, VECTORS))
    clash = {c: F.lit("x") for c in ("score", "asked", "v", "query_id", "rank")}
    got = vector_search.top_k(data.repartition(3).withColumns(clash), F.col("vec_id") % 50 == 0, block=block)
    assert rows(got) == brute_top([tuple(r) for r in data.collect()])


@pytest.mark.parametrize("size", [1.0, 3e5])
def test_clustered_vectors_are_skipped_without_loss(spark, size):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    data = [(i, [float(x) for x in (centres[i % 40] + rng.normal(size=16) * 0.05) * size]) for i in range(3000)]
    got = vector_search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2), F.col("vec_id") % 50 == 0)
    assert rows(got) == brute_top(data)


def test_a_search_evaluates_few_of_clustered_candidates():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(32, 16)) * 1000
    own = np.floor(centres[np.arange(4096) % 32] + rng.normal(size=(4096, 16))).astype(np.int64)
    own = (own * 1000 / np.linalg.norm(own, axis=1)[:, None]).astype(np.int64)
    queries = vector_search.Queries(np.arange(100), own[:100], own[:32], np.arange(32), True, 5)
    best = vector_search.Best(queries)
    assert vector_search.search(queries, best, np.arange(4096), own, vector_search.distances(own, own[:32])) < 100 * 4096 / 8
    scores = own[:100] @ own.T
    scores[np.arange(100), np.arange(100)] = vector_search.NONE
    assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()


@pytest.mark.parametrize("size", [1, 10**7])
def test_unclustered_vectors_and_bounds_at_any_size(size):
    """No bound is below its score, in the order of bounds nothing is lost, and pivots are far apart."""
    rng = np.random.default_rng(4)
    own = rng.integers(-40, 41, (700, 6)) * size
    pivots = vector_search.far_apart(own, 24)
    assert len(set(pivots.tolist())) == 24
    near = vector_search.distances(own, own[pivots])
    queries = vector_search.Queries(np.arange(60), own[:60], own[pivots], pivots, 4 * own.max() ** 2 * 6 < 2**53, 5)
    best = vector_search.Best(queries)
    products = sum(vector_search.search(queries, best, np.arange(at, min(at + 256, 700)), own[at : at + 256], near[at : at + 256]) for at in range(0, 700, 256))
    scores = own[:60] @ own.T
    scores[np.arange(60), np.arange(60)] = vector_search.NONE
    order = np.lexsort((np.broadcast_to(np.arange(700), scores.shape), -scores), axis=1)[:, :5]
    assert (best.id == order).all() and products < 60 * 700 * 0.7


def test_vector_search_of_few_or_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], VECTORS)
    asked = F.col("vec_id") % 50 == 0
    assert rows(vector_search.top_k(one, asked)) == [] == rows(vector_search.top_k(one.limit(0), asked))
    assert rows(vector_search.top_k(spark.createDataFrame([x for x in ODD_VECTORS if x[0] is None or x[0] < 5200], VECTORS), asked)) == []
    empty = [(0, []), (50, []), (51, [])]
    assert rows(vector_search.top_k(spark.createDataFrame(empty, VECTORS), asked)) == brute_top(empty)
    assert rows(vector_search.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], VECTORS), asked)) == []
