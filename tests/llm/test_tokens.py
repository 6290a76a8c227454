import random
import struct
import zlib

import numpy as np
import pytest

from attesta.llm import queries as q
from attesta.llm import tokens

BPE = q.tokenizer("word_bpe_49k.json")
SP = q.tokenizer("piece_bpe_32k.model")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, docs):
    want = {}
    for (doc, text), ids in zip(docs, reference_ids([t for _, t in docs]), strict=True):
        want.setdefault(doc, []).append(ids)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for doc, parts in got.items():
        ids = want[doc][0]
        parts = sorted(parts, key=lambda r: (r["start"], r["sequence_id"]))[:: len(want[doc])]
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["doc_tokens"] == len(ids) and r["offset"] == 0
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


def test_packing_matches_the_tokenizer(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(q.op8_packing(spark, data).collect(), docs)


def test_packing_odd(spark, odd, none):
    out = tokens.pack(odd, BPE)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows = out.collect()
    check_packing(rows, docs)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert tokens.pack(none, BPE).count() == 0


def test_strings_of_added_tokens(spark):
    """They are what the plain tokenizer makes of them: one id each, alone, glued to words, in a row and across words."""
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y.", "<|endoftext|><|startoftext|>", "<|endof text|>", "<|ENDOFTEXT|> é<|endoftext|>", "<|endoftext|>, <|endoftext"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(9, texts[1]), (9, texts[1]), (None, texts[2])]
    rows = tokens.pack(spark.createDataFrame(docs, "doc_id long, text string"), BPE).collect()
    check_packing(rows, docs)
    assert {r["doc_tokens"] for r in rows if r["doc_id"] == 1} == {4}


def test_word_ids_match_whole_texts():
    words = tokens.WordIds(BPE)
    texts = ["Don't stop, I'll go.", "ÀB ΣΑΣ İI été ́x", "a\x1cb\xa0c d", "x<|endoftext|>y", "!!!...;; 12ab3 | |", "STRAẞE ǅ ŉ"]
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert b"".join(words[w] for w in text.encode().split()) == np.array(ids[:-1], "<u4").tobytes(), text


def unigram_model():
    """The public model file with the model type turned to Unigram and the file's own scores, for the library to run."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    uni = tokens.Unigram.load(SP)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    body = b""
    for i, p in enumerate(uni.pieces):
        kind = 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 1
        m = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", uni.scores[i]) + b"\x18" + varint(kind)
        body += b"\x0a" + varint(len(m)) + m
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # model_type UNIGRAM; byte_fallback
    normal = b"\x0a\x08identity" + b"\x18\x01\x20\x00\x28\x01"
    body += b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normal)) + normal
    return uni, sentencepiece.SentencePieceProcessor(model_proto=body)


def test_unigram_matches_the_library(spark, data):
    """The library adds in single precision, where pieces of -1e9 swallow differences of up to 64; so its best path may be
    worse than ours by such a step, never better. Its n-best list, which has no such pieces in it, has our score first."""
    uni, sp = unigram_model()
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(150).collect()]
    words = sorted({w for t in texts[:40] for w in t.split()})[::7]
    texts += ["  two  spaces ", "a\n\n b\n", "漢字 🙂\t\x00 tab", " ", "\n", "▁x", "1,234.50€"]
    byte_ids = set(uni.byte_ids)
    score = lambda x: sum(uni.scores[i] if i not in byte_ids else 0 for i in x)
    for text in texts:
        ids = [int(i) for a in uni.encode_many(uni.chunks(text)) for i in a]
        want = sp.encode(text)
        same = [i for i in ids if i in byte_ids] == [i for i in want if i in byte_ids]
        assert same and (ids == want or score(ids) >= score(want)), text[:80]
        assert uni.decode(ids) == text.replace("▁", " ")
    for word in words:
        ids = [int(i) for a in uni.encode_many(uni.chunks(word)) for i in a]
        assert score(ids) >= score(sp.nbest_encode(word, 1)[0]), word


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(5)
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb"]
    scores = [0.0] * 257 + [-rng.uniform(1, 9) for _ in pieces[257:]]
    uni = tokens.Unigram(pieces, scores, list(range(1, 257)), set(range(257)))
    keys = {p.encode(): s for p, s in zip(pieces[257:], scores[257:], strict=True)}

    def brute(b):
        best = {0: 0.0}
        for i in range(len(b)):
            if i not in best:
                continue
            for j in range(i + 1, len(b) + 1):
                if b[i:j] in keys:
                    best[j] = max(best.get(j, -1e9), best[i] + keys[b[i:j]])
            size = 1 + (b[i] >= 0xC0) + (b[i] >= 0xE0) + (b[i] >= 0xF0)
            if b[i : i + size] not in keys and i + size <= len(b):
                best[i + size] = max(best.get(i + size, -1e9), best[i] + uni.unknown)
        return best[len(b)]

    for _ in range(200):
        text = "".join(rng.choice("abbaac é") for _ in range(rng.randint(1, 14)))
        ids = [int(i) for a in uni.encode_many(uni.chunks(text)) for i in a]
        got, k = 0.0, 0
        while k < len(ids):
            if ids[k] <= 256:
                size = 1 + (ids[k] - 1 >= 0xC0) + (ids[k] - 1 >= 0xE0)
                got, k = got + uni.unknown, k + size
            else:
                got, k = got + scores[ids[k]], k + 1
        assert got == pytest.approx(sum(brute(c) for c in uni.chunks(text)))
        assert uni.decode(ids) == text


def test_double_array():
    rng = random.Random(3)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))): i for i in range(800)}
    trie = tokens.DoubleArray.build(keys)
    assert all(trie.find(k) == v for k, v in keys.items())
    assert trie.find(b"\x00" * 9) == -1


def test_unigram_odd(spark, odd, none):
    rows = tokens.unigram_encode(odd, SP).collect()
    assert len(rows) == 9 and all(r["round_trip"] in (True, None) for r in rows)
    assert [r["round_trip"] for r in rows if r["doc_id"] == 4] == [None]
    assert tokens.unigram_encode(none, SP).count() == 0
