import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import tokens

ODD = [
    (1, None),
    (2, ""),
    (3, "Hello  world\n\n \n it's 12345 o'clock<|endoftext|> tail  "),
    (4, "a\x1cb !\x1c! é x  y　\t\tz"),
    (5, "ΑΣ Σίσυφος İstanbul é ﬁ Ⅷ ½ ١٢٣ 漢字 🙂🙂"),
    (6, "x" * 5000 + " " * 300 + "y"),
    (6, "x" * 5000 + " " * 300 + "y"),
    (None, "null id"),
    (8, "<|startoftext|>We'LL don'T <|endoftext|>"),
    (9, "lorem ipsum dolor " * 900),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA + ", ids string")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text):
    return np.array(library(name).encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_counts_match_the_library(docs):
    got = sorted((r._id is None, r._id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect())
    want = sorted((i is None, i, len((t or "").encode()), n := len(ids_of("byte_bpe_50k.json", t)), n > 1024) for i, t in ODD)
    assert got == want


def test_byte_encoder_reads_the_json_file_alike():
    a, b = tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.json")), tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _, text in ODD:
        assert a[0].encode(text or "", a[1]) == b[0].encode(text or "", b[1])


def test_pieces_are_whole_and_of_binary_length(docs):
    rows = tokens.packed_pieces(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in rows)
    for i, text in dict(ODD).items():
        ids = np.r_[ids_of("byte_bpe_50k.json", text), 0].astype("<u4")
        mine = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r._id == i})
        assert sum(n for _, n, _, _ in mine) == len(ids)
        assert mine == [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n, _, _ in mine]


def test_binary_pieces():
    assert tokens.binary_pieces(2048 + 11, 1024) == [1024, 1024, 8, 2, 1]
    assert tokens.binary_pieces(0, 1024) == []


def test_grammar_files_round_trip(docs):
    rows = tokens.grammar_round_trip(docs.repartition(3)).orderBy("start").collect()
    assert len(rows) == len(ODD)
    keys = [(r._id is not None, r._id or 0) for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        ids = np.r_[ids_of("word_bpe_49k.json", dict(ODD)[r._id]), 2].astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_repair_gives_back_any_slice():
    rng = np.random.default_rng(1)
    phrase = rng.integers(3, 40, 50)
    docs = [np.r_[np.tile(phrase, int(rng.integers(0, 9))), rng.integers(3, 49_000, 30), 2] for _ in range(60)]
    ids = np.concatenate(docs).astype(np.uint32)
    seq, left, right = tokens.repair(ids, 49_408, 2, rounds=6)
    assert len(seq) < len(ids) / 2
    lengths = tokens.rule_lengths(left, right, 49_408).astype("<u4")
    shard = tokens.Shard(seq.tobytes(), left.tobytes(), right.tobytes(), lengths.tobytes(), 49_408)
    assert (shard.ids(0, len(ids)) == ids).all()
    for a, n in ((0, 1), (7, 33), (len(ids) - 1, 1), (100, 200)):
        assert (shard.ids(a, n) == ids[a : a + n]).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokens.token_counts(none).count() == tokens.packed_pieces(none).count() == tokens.grammar_round_trip(none).count() == 0


def test_buckets_are_folders(docs, spark, tmp_path):
    tokens.write_buckets(tokens.packed_pieces(docs).select("_id", "length", "ids"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where(F.length("ids") != 4 * F.col("length"))
    assert back.count() == 0


def test_word_encoder_on_random_words():
    import random

    rng = random.Random(3)
    encode, lib = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    letters = "aeinorst" * 4 + "bcdxyz" + "AÉéßñ'.,!?-%|19 \n\u00a0\x1c\u0130Σσ"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_encoder_on_random_texts():
    import random

    rng = random.Random(4)
    lib = library("byte_bpe_50k.json")
    core, special = tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    letters = "aeinorst" * 3 + "bcxyz" + "AÉé'.,!|19   \n\n\t\u00a0\u3000\x1c\u200b漢🙂"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        assert core.encode(text, special) == lib.encode(text, add_special_tokens=False).ids, repr(text)


def code_points():
    return [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_has_the_ids_of_the_library(name):
    lib = library(name)
    if name.startswith("byte"):
        core, special = tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        encode = lambda t: core.encode(t, special)
    else:
        made = tokens.WordEncoder(public_tokenizers.path(name))
        encode = lambda t: np.frombuffer(made(t), "<u4").tolist()
    settled = [c for c in code_points() if not tokens._UNSETTLED(c)]
    rest = [c for c in code_points() if tokens._UNSETTLED(c)]
    assert len(settled) > 20_000
    for some, step in ((settled, 8), (rest, 64)):
        texts = ["".join(f"a{c}b {c}{c}1{c} " for c in some[i : i + step]) for i in range(0, len(some), step)]
        for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encode(text) == want.ids, repr(text)


def test_random_mixes_have_the_ids_of_the_library():
    import random

    rng = random.Random(8)
    settled = [c for c in code_points() if not tokens._UNSETTLED(c)]
    marks = [chr(c) for c in (*range(0x300, 0x36F), 0x1AB0, 0x0345, 0x1F600, 0x0E33, 0x0903, 0x2126, 0x212B, 0x1E9E, 0xFB01)]
    made, lib = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    blib = library("byte_bpe_50k.json")
    core, special = tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    latin = settled[:580]
    for k in range(3000):
        text = "".join(rng.choice((latin, settled, "abc  1'.\n", marks if k % 3 == 0 else latin)[rng.randrange(4)]) for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(made(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
        assert core.encode(text, special) == blib.encode(text, add_special_tokens=False).ids, repr(text)


def test_vocabularies_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        tokens.repair(np.array([70_000, 2], np.uint32), 49_408, 2)
    with pytest.raises(ValueError):
        tokens.repair(np.array([5, 2], np.uint32), 70_000, 2)
