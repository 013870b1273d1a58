from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import token_alignment
from lattica.llm.queries import op13_token_alignment
from lattica.llm.token_alignment import align_tokenizers, encoders, linked_pairs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a▁b", "<|endoftext|> x <s></s>", "日本語のテキスト😀😀", "\x00\n\t", "a" * 3000, "é" * 500, "👩‍👩‍👧" * 300, " " * 700, "tail \n", "\u0085x y", "' 'll 'LL"]


def plain(texts):
    a_of, b_of = Tokenizer.from_file(str(A)), sentencepiece.SentencePieceProcessor(model_file=str(B))
    a_of.encode_special_tokens = True
    names = {i: t for t, i in a_of.get_vocab().items()}
    letters, n = {}, 0
    for b in range(256):
        own = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letters[chr(b if own else 256 + n)] = b
        n += not own
    docs, count = [], Counter()
    for text in texts:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_of.id_to_piece(i)[1:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut, k) + 1 for e, k in zip(ends, at)]
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        links = Counter((x, y) for own, other in groups for x in own for y in other)
        count.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in doc[2])
        links = doc[3]
        out.append((doc[0], doc[1], len(doc[2]), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def found(frame):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()), key=str)


def short_texts(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_query_equals_plain(spark, small):
    rows = short_texts(spark, small)
    rows = [(d, t) for d, t in rows if t is None or len(t) < 12000]
    have = {x[0]: x for x in found(op13_token_alignment(spark, small))}
    whole = found(align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), str(A), str(B)))
    assert whole == sorted(((d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows]))), key=str)
    assert all(have[x[0]][1:5] == x[1:5] and have[x[0]][7] == x[7] for x in whole)  # what does not depend on other documents
    assert len(have) == spark.read.parquet(f"{small}/documents.parquet").count()


@pytest.mark.parametrize("block", [1 << 22, 100])
def test_odd_texts_in_blocks(spark, monkeypatch, block):
    rows = [(2**62 + i, t) for i, t in enumerate(ODD)] + [(None, "hello world"), (5, "hello world"), (5, "hello world")]
    docs = spark.createDataFrame([(d, t, 1, "s", {"a": [2**60 + 1, None]}, float("nan")) for d, t in rows], "doc_id long, text string, n_links int, block string, more map<string, array<long>>, share double")
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    made = align_tokenizers(docs, str(A), str(B))
    assert made.columns[:5] == ["doc_id", "text", "block", "more", "share"]
    assert made.where("more['a'][0] = 1152921504606846977 and share = double('NaN') and block = 's'").count() == len(rows)
    assert found(made) == sorted(((d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows]))), key=str)
    assert align_tokenizers(docs.limit(0), str(A), str(B)).count() == 0


def test_fast_encoder_equals_the_library():
    known = encoders(str(A), str(B))
    texts = [" " + t for t in ODD if t] + [chr(i) * 2 + " " + chr(i) + "x" for i in range(1, 0x3000, 7) if not 0xD800 <= i < 0xE000]
    assert [known.fast.encode_ordinary(t) for t in texts] == [known.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_of_large_groups_add_up(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 400)
    group_a, group_b = np.sort(rng.integers(0, 3, 500)), np.sort(rng.integers(0, 3, 400))
    docs = np.array([0, 0, 1])
    want = Counter((int(docs[g]), int(x) << 3 | int(y)) for g, x in zip(group_a, a) for h, y in zip(group_b, b) if g == h)
    monkeypatch.setattr(token_alignment, "EXPAND", 5)
    doc, pair, links = linked_pairs(a, b, group_a, group_b, docs, 7, 3)
    assert dict(zip(zip(doc.tolist(), pair.tolist()), links.tolist())) == want
