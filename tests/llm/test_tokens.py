import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm.token_store import ByteLevelEncoder, TokenConfig, TokenFile, ids_of, planes_of, read_documents, round_trip, write_tokens
from lectern.llm.warc_store import _filesystem
from lectern.tables import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, file string"


def expected(docs):
    """Documents in the order of their ids, null first; those with one id in the order given."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        for top in (1, 2, 255, 256, 50_257, 1 << 20, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (ids_of(planes_of(ids, kind), n, kind) == ids).all()
    assert planes_of(np.zeros(5, "<u4"), kind) == [] and ids_of([], 5, kind).tolist() == [0] * 5
    assert len(planes_of(np.array([50_256], "<u4"), kind)) == (16 if kind == "bit" else 2)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_round_trip(spark, kind):
    rng = random.Random(3)
    docs = [(rng.randrange(-500, 500) * 1000 + k, " ".join(rng.choice(["The", "don't", "naïve", "x1!", "über,", "\nNew"]) for _ in range(rng.choice([0, 1, 40, 900])))) for k in range(150)]
    docs += [(None, "no id"), (7_000_000, None), (7_000_001, ""), (-9_000_000, "long " * 30_000), (8_000_000, "日本語 <|endoftext|> x\x1cy ﬁ  two\n\n blanks \n")]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(7)
    cfg = TokenConfig(PATH, block=1 << 10, planes=kind, file_ids=5000, read_ids=20_000)
    assert sorted(map(tuple, round_trip(frame, cfg).collect()), key=lambda r: r[1]) == expected(docs)


def test_random_access_and_files(spark):
    docs = [(k, f"document {k} has some words " * (k % 5)) for k in range(60)]
    frame = spark.createDataFrame([(*d, "", "") for d in docs], SCHEMA)
    cfg, folder = TokenConfig(PATH, block=64, file_ids=200), scratch(spark, "tokens")
    files = write_tokens(frame, folder, cfg)
    rows = read_documents(files, folder, cfg, ids=True).orderBy("start").collect()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    store, root = _filesystem(folder)
    assert files.count() > 3
    for f in files.collect():
        file = TokenFile(store, f"{root}/{f.file}")
        assert file.n == f.ids and len(file.docs) == f.docs
        for start, n in ((0, 0), (0, 1), (63, 2), (100, file.n - 100)):
            assert file.ids(start, n).tolist() == whole[f.start + start : f.start + start + n].tolist()
        for position in (0, 70, file.n - 1):
            at = file.document_at(position)
            assert file.starts[at] <= position < file.starts[at + 1]
    with pytest.raises(ValueError, match="no whole file"):
        with store.open_output_stream(f"{root}/cut.tokens") as out:
            out.write(b"x" * 40)
        TokenFile(store, f"{root}/cut.tokens")


def test_repeated_rows_and_ties(spark):
    docs = [(1, "a"), (1, "b c"), (1, "a"), (None, "z"), (None, "z"), (0, "q")]
    rows = sorted(map(tuple, round_trip(spark.createDataFrame([(*d, "", "") for d in docs], SCHEMA).coalesce(1), TokenConfig(PATH)).collect()), key=lambda r: r[1])
    assert rows == expected(docs)


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), TokenConfig(PATH)).collect() == []


def test_encoder_equals_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), ByteLevelEncoder(PATH, 500)
    assert encoder.by_part
    rng = random.Random(2)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "the", "Hello", "'s", "'ll", "'S", "123", "½", "٣", "é", "é", "日本", "<|endoftext|>", "<|", "!", "...", "\x85", "　", " ", "᠎", "​", "\x1c", "﻿", "\x00", "\x0b", "\x0c", " ", "ª", "ß", "ǅ", "€"]
    for _ in range(30_000):
        text = "".join(rng.choices(marks, k=rng.randrange(1, 9)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point():
    tokenizer, encoder = Tokenizer.from_file(PATH), ByteLevelEncoder(PATH, 2000)
    for c in map(chr, range(1, 0x3000)):
        for text in (c, f"ab{c}cd x{c} {c}y {c}{c} "):
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_layouts_are_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    assert not ByteLevelEncoder(path, 10).by_part
    rows = round_trip(spark.createDataFrame([(1, "Hello  World", "", "")], SCHEMA), TokenConfig(path, end_id=1)).collect()
    assert rows[0].n_tokens == len(tokenizer.encode("Hello  World", add_special_tokens=False).ids) + 1
