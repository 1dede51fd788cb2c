import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.packing import PackingConfig, TextEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"


def check(rows, docs, length=2048):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for group in windows.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        padding += length - at if at & (at - 1) else 0
    return padding


def test_round_trip_and_padding(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(["alpha", "Beta,", "don't", "naïve", "x1y2", "été"]) for _ in range(rng.choice([0, 3, 40, 700, 5000])))) for k in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "a" * 50_000), (1003, "日本語 <|endoftext|> x\x1cy Σίσυφος İ ﬁ é")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(9)
    assert check(pack(frame, PackingConfig(PATH, open_windows=3, merged=2)).collect(), docs) == 0
    assert check(pack(frame, PackingConfig(PATH)).collect(), docs) == 0


def test_other_length_and_empty(spark):
    docs = [(k, "one two three " * k) for k in range(30)]
    assert check(pack(spark.createDataFrame([(*d, "") for d in docs], SCHEMA), PackingConfig(PATH, length=64)).collect(), docs, 64) == 0
    assert pack(spark.createDataFrame([], SCHEMA), PackingConfig(PATH)).collect() == []


def test_repeated_rows_and_null_id(spark):
    rows = pack(spark.createDataFrame([(None, "a b", ""), (1, "c", ""), (1, "c", "")], SCHEMA), PackingConfig(PATH)).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 3 and sum(r.length for r in rows if r.doc_id == 1) == 4


def test_encoder_equals_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), TextEncoder(PATH, 50)
    rng = random.Random(1)
    marks = ["'s", "''ll", "…", " ", " ", "½", "٣", "ß", "Å", "Å", "_", "<|", "<|startoftext|>", "​", "é", "ǅ", "x\u0085y", "﻿"]
    for _ in range(300):
        text = " ".join("".join(rng.choice([*marks, "The", "qu", "9", "-"]) for _ in range(rng.randrange(1, 6))) for _ in range(12))
        ids = np.frombuffer(encoder.ids(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def same_ids(encoder, tokenizer, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_alone_and_inside_words():
    tokenizer, encoder = Tokenizer.from_file(PATH), TextEncoder(PATH, 2000)
    for c in map(chr, range(1, 0x3000)):
        same_ids(encoder, tokenizer, c)
        same_ids(encoder, tokenizer, f"ab{c}cd x{c} {c}y {c}{c}")


def test_fuzz_with_control_characters():
    tokenizer, encoder = Tokenizer.from_file(PATH), TextEncoder(PATH, 3000)
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(1, 0x180), 0x300, 0x301, 0x2019, 0x2026, 0x20AC, 0x3A3, 0x130, 0x2028]] + ["the", "ing", "'ll", "  ", "\n"]
    for _ in range(50_000):
        same_ids(encoder, tokenizer, "".join(rng.choices(letters, k=rng.randrange(1, 14))))


def test_other_layouts_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), TextEncoder(path, 100)
    assert TextEncoder(PATH, 100).by_word and not encoder.by_word
    for text in ["Hello  World\x7f", " a b", "don't\n\n x"]:
        same_ids(encoder, tokenizer, text)
    rows = pack(spark.createDataFrame([(1, "Hello  World", "")], SCHEMA), PackingConfig(path, end_id=50256)).collect()
    assert sum(r.length for r in rows) == len(tokenizer.encode("Hello  World").ids) + 1


def test_control_characters_in_documents(spark):
    docs = [(1, "ab \x7f cd\x01"), (2, "\x7f"), (3, "\x01\x02 \x0e\x1b")]
    rows = pack(spark.createDataFrame([(*d, "") for d in docs], SCHEMA), PackingConfig(PATH)).collect()
    assert check(rows, docs) == 0 and {r.doc_id: r.doc_tokens for r in rows}[1] == 5
