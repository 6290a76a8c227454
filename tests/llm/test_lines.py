import hashlib
import random

import pytest

from attesta.llm import lines


def chunks(text, min_lines=2):
    """(first line, lines) of the chunks of two cuttings: a line ends a chunk of one or of the other."""
    ls = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
    mark = [(h[i] + (h[i - 1] * 257 if i else 0)) % 1_000_003 % 2 for i in range(len(ls))]
    out = []
    for s in (0, 1):
        lo = 0
        for i in range(len(ls)):
            if i == len(ls) - 1 or mark[i] == s:
                if i - lo + 1 >= min_lines:
                    out.append((lo, ls[lo : i + 1]))
                lo = i + 1
    return out


def brute(docs):
    """doc -> (text, lines removed), by a dictionary of chunks in order of place."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        lost = set()
        for lo, run in sorted(chunks(text)):
            if tuple(run) in seen:
                lost |= set(range(lo, lo + len(run)))
            seen.add(tuple(run))
        out[doc] = ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost), len(lost))
    return out


def test_matches_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    passage = "\n".join(f"shared line {i}" for i in range(30))
    docs += [(10_000 + i, f"own {i}\n" + passage + f"\nend {i}\n") for i in range(40)]
    want = brute(docs)
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in rows} == want
    assert sum(r["n_removed_lines"] for r in rows) > 40 * 15


def test_odd(spark, odd, none):
    extra = spark.createDataFrame([(20, "p\nq\nr\ns"), (21, "p\nq\nr\ns"), (21, "p\nq\nr\ns"), (None, "p\nq\nr\ns")], "doc_id long, text string")
    df = odd.unionByName(extra, allowMissingColumns=True)
    rows = lines.dedup_lines(df).collect()
    assert len(rows) == 13 and set(rows[0].asDict()) >= set(odd.columns)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[4][0]["text"] is None and by[4][0]["n_lines"] == 0
    assert by[3][0]["text"] == "" and by[3][0]["n_lines"] == 1
    whole = [r for r in by[None] if r["n_lines"] == 4][0]
    assert whole["n_removed_lines"] == 0  # nulls first
    assert [r["text"] for r in by[21]] == [by[20][0]["text"]] * 2
    assert by[7][0]["text"] == "x\ty\n\nz  w " * 4000 or by[7][0]["n_removed_lines"] > 0
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_chunks_are_those_of_the_rule(spark, n):
    text = "\n".join(f"l{i}" for i in range(n))
    for least in (1, 2):
        got = spark.createDataFrame([(text,)], "t string").select(lines.chunk_column(spark_col(), 2, least).alias("c")).first()["c"]
        assert sorted((c["lo"], len(c["key"])) for c in got) == sorted({(lo, len(run)) for lo, run in chunks(text, least)})


def test_hashes_that_lie_remove_nothing(spark, monkeypatch):
    """With a hash that takes lines of one length for one, chunks of different lines are not taken for repeats."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "line_hash", lambda line: F.length(line).cast("long"))
    docs = [(i, "\n".join(f"{i}-{k}" for k in range(9))) for i in range(9)]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(docs)


@pytest.mark.parametrize(("m", "least"), [(3, 0.1), (5, 0.3), (10, 0.6), (25, 0.8)])
def test_recall_of_planted_passages(m, least):
    """Passages of ``m`` lines in two documents with other lines around them: the share of lines that go from the second."""
    rng, gone = random.Random(m), 0
    line = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    for _ in range(300):
        passage = [line() for _ in range(m)]
        docs = [(i, "\n".join([line() for _ in range(6)] + passage + [line() for _ in range(6)])) for i in range(2)]
        gone += brute(docs)[1][1]
    assert gone / (300 * m) >= least


def test_few_kinds_of_lines(spark):
    """Every line that goes has a copy that stays."""
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: t for d, t in rows.items()} == {d: t for d, (t, _) in brute(docs).items()}


def spark_col():
    from pyspark.sql import functions as F

    return F.col("t")
