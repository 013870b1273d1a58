import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import bpe as module
from lattica.llm.bpe import WordBPE, bpe_tokens
from lattica.llm.queries import op7_bpe, tokenizer_path


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(tokenizer_path())
    made.no_truncation()
    made.no_padding()
    return made


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_equals_library(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op7_bpe(spark, small).collect():
        ids, text = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_texts_equal_library(docs_of, library):
    rng = random.Random(5)
    texts = [None, "", " \n", "a" * 500 + "b" * 300, "ΣΑΣ Σας İstanbul", "é ẛ̣", "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>", "it's I'LL we'Re", "² ½ １２ ⅷ", "a\x1cb\x1d\x85c", "\0 a\0b", "日本語 テキスト", "👩‍👩‍👧 ok", "same", "same"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x391, 0x3AA), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(80)) for _ in range(100)]
    rows = {r.doc_id: r for r in bpe_tokens(docs_of(texts), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].ids, rows[i].decoded) == expected(library, t)
        assert rows[i].n_tokens == len(rows[i].ids)


def test_every_code_point_equals_library(library):
    own = WordBPE(tokenizer_path())
    memory = module.Memory(own)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 64):
        some = points[at : at + 64]
        text = " ".join(f"a{chr(c)}b{chr(c)}1 {chr(c)}" for c in some)
        ids = np.frombuffer(memory.encode([text])[0][0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, hex(some[0])


def test_long_words_and_full_cache(library, monkeypatch):
    own = WordBPE(tokenizer_path())
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdeést") for _ in range(n)) for n in (60, 64, 65, 200, 5000)]
    assert own.encode_batch(long) == [library.encode(t, add_special_tokens=False).ids for t in long]
    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    memory = module.Memory(own)
    for _ in range(3):
        for text in ("one two three four five", "two six seven eight"):
            assert np.frombuffer(memory.encode([text])[0][0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty_table(docs_of):
    assert bpe_tokens(docs_of(["x"]).where("false"), tokenizer_path()).count() == 0
