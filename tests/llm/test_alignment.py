import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from attesta.llm import alignment, queries

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, decoders.ByteLevel(), sentencepiece.SentencePieceProcessor(model_file=B)


def plain(docs, tools):
    """Whole texts through both tokenizers, groups by sets of ends, counts in a dictionary."""
    from attesta.llm.tokens import _byte_chars

    t, _, sp = tools
    byte = {c: b for b, c in _byte_chars().items()}
    found, count = [], Counter()
    for doc, text in docs:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ra = [bytes(byte[c] for c in t.id_to_token(x)) for x in a]
        rb = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [sp.id_to_piece(x)]]
        if not text or not b"".join(ra) == b"".join(rb) == (" " + text).encode():
            found.append((doc, 0, 0, [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ra]), np.cumsum([len(x) for x in rb])
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
        groups = [([], []) for _ in cuts]
        for side, ids, own in ((0, a, ga), (1, b, gb)):
            for x, g in zip(ids, own.tolist(), strict=True):
                groups[g][side].append(x)
        links = [(x, y) for p, q in groups for x in p for y in q]
        count.update(set(links))
        found.append((doc, len(a), len(b), groups, links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    text = lambda gs: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in gs)
    return sorted([(d, na, nb, len(gs), len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), text(gs)) for d, na, nb, gs, ls in found], key=repr)


def run(spark, docs, parts=2):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(df, A, B).collect()), key=repr)


ODD_TEXTS = [
    "", None, "a ", " a", "  a   b  ", "\n", " \n \n", "x\n\ny \n z", "tab\tand\r\nline", "don't we'll I'm 12345 3.14", "<|endoftext|> </s> <s> <0x41> <unk>", "▁ marker ▁▁", "a▁b",
    "漢字かな交じり文、句読点。", "🙂👩‍👩‍👧 é ﬁ ß ç", "\x00nul \x1c sep\x1c x\x85y\xa0z", "　wide  line ﻿bom", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "..., !!! --- '''s", "a\x1c b\x85 c  d\n  e",
]


def test_odd_texts_against_whole_texts(spark, tools):
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (7, "x"), (7, "x"), (7, "y x")]
    assert run(spark, docs) == plain(docs, tools)


def test_random_texts_against_whole_texts(spark, tools):
    rng = random.Random(2)
    words = ["the", "aligner's", "Größe", "12", " ", "\n", "漢", "🙂", "x_y", "(a)", "\t", "don't", "unbelievable", "zq", "é", " ", "-", "ﬁn"]
    docs = [(i, "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n", ", "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    assert run(spark, docs, 3) == plain(docs, tools)


def test_table(spark, data, tools):
    """The query over part of a real table's texts, on all of its own rows."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 800").collect()]
    assert run(spark, docs, 4) == plain(docs, tools)


def test_many_documents_in_few_containers(spark, tools, monkeypatch):
    """Bitmaps of the dense form, several planes, several containers in a task, a cache that starts anew."""
    docs = [(i, "the " * (i % 11) + ("common passage" if i % 3 else f"rare{i}")) for i in range(20_000)]
    want = plain(docs, tools)
    assert run(spark, docs, 1) == want
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "CACHE", 50)
    got = [r[:4] for i in range(0, 2000, 100) for r in aligner.align([t for _, t in docs[i : i + 100]])[0]]
    assert sorted(got) == sorted(w[1:5] for w in want if w[0] < 2000)


def test_bitmaps():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(alignment.ROWS, n, replace=False)) for n in (1, 511, 512, 513, 8192, 2, 0, 4000)]
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits = alignment.compress(np.concatenate(sets), ends)
    row, place = alignment.expand(bits)
    assert alignment.popcounts(bits).tolist() == [len(s) for s in sets] and max(len(x.as_py()) for x in bits) == alignment.ROWS // 8
    for i, s in enumerate(sets):
        assert np.sort(place[row == i]).tolist() == s.tolist()
    doc, pair, times = rng.integers(0, 3000, 20_000), rng.integers(0, 20, 20_000), rng.integers(1, 40, 20_000)
    want = Counter()
    for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True):
        want[p, d] += t
    key, n_docs, links, docs, planes = alignment.postings(doc, pair, times)
    got = Counter()
    for i, p in enumerate(key.to_pylist()):
        for d in alignment.expand(docs.slice(i, 1))[1].tolist():
            got[p, d] += 1
        for j, plane in enumerate(planes[i].as_py()):
            import pyarrow as pa

            for d in alignment.expand(pa.array([plane], pa.binary()))[1].tolist():
                got[p, d] += 1 << j
    assert got == want
    assert n_docs.to_pylist() == [sum(k[0] == p for k in want) for p in key.to_pylist()] and links.to_pylist() == [sum(v for k, v in want.items() if k[0] == p) for p in key.to_pylist()]


def test_empty_and_clashing(spark, odd, none, tools):
    out = alignment.align_tokenizers(odd, A, B, keep_groups=False)
    rows = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in plain([(r["doc_id"], r["text"]) for r in odd.collect()], tools)]
    assert rows == sorted(want, key=repr)
    assert alignment.align_tokenizers(none, A, B).count() == 0 and alignment.pair_counts(none, A, B).count() == 0
    counts = alignment.pair_counts(spark.createDataFrame([(1, "the cat the"), (2, "the dog")], "doc_id long, text string"), A, B)
    assert max((r["n_docs"], r["n_links"]) for r in counts.collect()) == (2, 3)
