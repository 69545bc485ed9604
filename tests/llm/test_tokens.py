"""The encoder and packing against the tokenizers library itself."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

from tessella.llm import packing, tokens

CHARACTERS = [chr(c) for c in range(0x250) if tokens.PLAIN.fullmatch(chr(c))]


@pytest.fixture(scope="module")
def exact():
    known = Tokenizer.from_file(tokens.default_vocabulary()[0])
    return lambda text: known.encode(text, add_special_tokens=False).ids


def test_every_plain_character_gives_the_ids_of_tokenizers(exact):
    encode = tokens.encoder(tokens.default_vocabulary())
    for c in CHARACTERS:
        for text in (c, c * 3, f"a{c}b", f" {c} ", f"1{c}2", f"a {c}\n{c}{c} b", f"'{c}s"):
            assert list(encode(text)) == exact(text), repr(text)


def test_random_texts_give_the_ids_of_tokenizers(exact):
    encode, r = tokens.encoder(tokens.default_vocabulary()), random.Random(2)
    for _ in range(1500):
        text = "".join(r.choices(CHARACTERS + [" "] * 60 + ["世", "　", "е"] * (r.random() < 0.2), k=r.randint(0, 60)))
        assert list(encode(text)) == exact(text), repr(text)


def test_packing_holds_the_ids_of_tokenizers(spark, exact):
    r = random.Random(3)
    rows = [(k, " ".join("".join(r.choices("abcdeéß世' .,19", k=r.randint(1, 9))) for _ in range(r.randint(0, 900)))) for k in range(30)]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    placed = packing.pack(docs).collect()
    for k, text in rows:
        ids = [*exact(text), 0]
        mine = [p for p in placed if p["doc_id"] == k]
        assert sum(p["length"] for p in mine) == len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[p["start"] : p["start"] + p["length"]]))
