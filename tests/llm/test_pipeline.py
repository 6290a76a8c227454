import pytest
from test_jaccard import brute as brute_groups
from test_lines import brute as brute_lines
from test_suffix import covered
from test_tokens import check_packing

import __spark_entry__ as entry
import corpus_pipeline as cp
from attesta.llm import common, quality

WHITE = " \t\n\r\x0b\x0c"
SMALL = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "suffix_dedup", "packing"]
    outs, cur = [rows(docs)], docs
    for _, stage in cp.STAGES[:-1]:
        cur = common.staged(stage(spark, cur, SMALL), "test-stage")
        assert cur.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        outs.append(rows(cur))
    start, good, lines, groups, passages = outs

    scores = quality.score_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert set(good) == {r["doc_id"] for r in scores if r["predicted"] == 1}
    assert all(good[d] == start[d] for d in good)

    want = brute_lines([(d, r["text"]) for d, r in good.items()])
    assert {d: r["text"] for d, r in lines.items()} == {d: t for d, (t, lost) in want.items() if not lost or t.strip(WHITE)}

    comp = brute_groups([(d, r["text"]) for d, r in lines.items()], 5, 80)
    assert set(groups) == {d for d, (_, c) in comp.items() if c == d}

    texts = [(d, r["text"].encode()) for d, r in groups.items()]
    left = {}
    for (d, t), mask in zip(texts, covered([t for _, t in texts], 200), strict=True):
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m).decode("utf-8", "ignore")
        if not mask.any() or kept.strip(WHITE):
            left[d] = kept
    assert {d: r["text"] for d, r in passages.items()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in passages.values())

    packed = cp.STAGES[-1][1](spark, cur, SMALL).collect()
    by_id = sorted(packed, key=lambda r: r["sequence_id"])
    check_packing([dict(r.asDict(), sequence_id=i) for i, r in enumerate(by_id)], [(d, r["text"]) for d, r in passages.items()])


def test_empty_and_odd(spark, odd, none):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SMALL)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.collect()
        assert stage(spark, none, SMALL).count() == 0
    assert cp.STAGES[-1][1](spark, odd, SMALL).count() > 0


def test_equal_rows_and_white_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(2, text, "en", "s", 1), (2, text, "en", "s", 1), (5, text + " end", "en", "s", 1), (2, "other", "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.one_of_each_group(spark, docs, SMALL).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out)) == [(0, text), (2, "other"), (2, text)]
    white = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\n", "en", "s", 1), (2, "a\nb\nc\nd\ne\nf\n", "en", "s", 1), (3, "\t\n", "en", "s", 1), (4, None, "en", "s", None)], docs.schema)
    kept = {r["doc_id"]: r["text"] for r in cp.drop_lines(spark, white, SMALL).collect()}
    assert kept[1] == "a\nb\nc\nd\ne\nf\n" and kept[3] == "\t\n" and kept[4] is None
    assert kept.get(2, "x").strip()


def test_registered():
    assert "pipeline" in entry.queries()
    for n in range(1, 11):
        assert [q for q in entry.queries() if q.startswith(f"op{n}_")], n


@pytest.mark.parametrize("paths", [[], ["file:///tmp/nothing-here"]])
def test_release_of_nothing(spark, paths):
    common.STAGED.extend(paths)
    common.release(spark, paths)
    assert not set(paths) & set(common.STAGED)
