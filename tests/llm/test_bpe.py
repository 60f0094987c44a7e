"""Byte-pair encoding against the vocabulary's own library, for texts cut into leaves of any size."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, queries
from tests.llm.conftest import SF, rows

OWN = Tokenizer.from_file(bpe.VOCABULARY)
#: What the pattern, special tokens and merges across a cut hang on.
BITS = [" ", "  ", "\n", "\n\n ", "'", "'s", "'re", "'ll", "s", "t", "re", "<|endoftext|>", "<|endo", "ftext|>", "<", "|>", "a", "the", "ing", "1", "2345", "!", "--", "é", "日本", "語", "　", " ", "\u0085", "\t", "😀", "aaaa", "x" * 40, "é"]


def ids_of(text):
    return OWN.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_two_texts_are_joined_exactly_at_any_place(seed):
    rng, own, again = random.Random(seed), bpe.codec(), 0
    for k in range(1500):
        bits = rng.sample(BITS, rng.randint(1, 5)) if k % 3 else BITS
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))
        cut, want = rng.randint(0, len(text)), ids_of(text)
        a, b = own.encode(text[:cut]), own.encode(text[cut:])
        assert own.encode(text).tolist() == want
        assert bpe.joined(own, a, b, window=1).tolist() == want
        again += [*a.tolist(), *b.tolist()] != want
    assert again > 300


def test_a_join_encodes_a_window_and_not_the_whole(monkeypatch):
    own, rng, seen = bpe.codec(), random.Random(1), []
    text = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    a, b = own.encode(text[:20_001]), own.encode(text[20_001:])
    encode = own.encode
    monkeypatch.setattr(own, "encode", lambda t: seen.append(len(t)) or encode(t))
    assert bpe.joined(own, a, b).tolist() == ids_of(text) and sum(seen) < 1000


def long_texts():
    rng = random.Random(7)
    return [
        "x" * 5000, "x" * 4097, " " * 3000, "'" * 700, "日本語の文章" * 400, "ab" * 3001, "0123456789" * 333, "<|endoftext|>" * 90, "é" * 999, "😀👍" * 500, "\n" * 513 + "end",
        "".join(rng.choice("abcdefgh") for _ in range(6001)), "".join(rng.choice(BITS) for _ in range(1200)), " ".join(rng.choice(["the", "it's", "1", "Größe", "—"]) for _ in range(2000)),
    ]


@pytest.mark.parametrize(("leaf", "window"), [(7, 1), (256, 32), (1000, 4)])
def test_long_texts_are_encoded_as_a_tree(spark, leaf, window):
    data = [(i, t) for i, t in enumerate(long_texts())] + [(i, "twice " * 600) for i in (90, 90)] + [(None, "no id " * 500), (91, None), (92, ""), (93, "short")]
    got = bpe.encode(spark.createDataFrame(data, "doc_id long, text string").repartition(4), leaf=leaf, window=window)
    assert sorted(((r.doc_id, r.text, r.ids) for r in got.collect()), key=repr) == sorted(((i, t, ids_of(t)) for i, t in data), key=repr)


def test_other_columns_stay(spark, odd):
    clash = {c: F.lit(c) for c in ("n", "at", "size", "number", "more", "t", "leaves")}
    got = bpe.encode(odd.withColumns(clash).withColumn("ids", F.lit("old")), leaf=4000)
    assert set(got.columns) == {*odd.columns, *clash, "ids"} and got.columns[-1] == "ids"
    assert rows(got.select(*odd.columns, *clash)) == rows(odd.withColumns(clash)) and all(r.ids == ids_of(r.text) for r in got.collect())


def test_decoding_is_the_librarys(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 60))] for _ in range(300)] + [[], None, [50_256, 220], [-1, 99_999, 64, None]]
    got = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, ids array<int>").withColumn("decoded", F.lit(1)))
    want = {i: OWN.decode([t for t in x or [] if t is not None and 0 <= t < 50_257], skip_special_tokens=False) for i, x in enumerate(lists)}
    assert {r.id: r.decoded for r in got.collect()} == want


def test_an_empty_table(empty):
    assert rows(bpe.decode(bpe.encode(empty))) == []


def test_a_vocabulary_in_another_order_is_refused(tmp_path):
    held = OWN.to_str()
    import json

    other = json.loads(held)
    other["model"]["merges"][:2] = other["model"]["merges"][1::-1]
    (tmp_path / "v.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="order"):
        bpe.Codec(str(tmp_path / "v.json"))


def test_the_query_is_the_librarys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(r.doc_id, len(i := ids_of(r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs]
    assert rows(queries.op11_bpe(spark, SF)) == sorted(want, key=repr)


def test_a_null_list_reads_as_none():
    import pyarrow as pa

    column = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert [x.tolist() for x in bpe.lists_of(column)] == [[1, 2], [], [], [3]] and bpe.int_lists([np.array([1, 2]), np.array([], np.int32)]).to_pylist() == [[1, 2], []]
