"""Operator 3: deduplication of content-defined runs of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

BASE, PRIME = 257, 1_000_003  # of the rolling hash


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lit("line"), line)


def chunk_column(text: Column, divisor: int, min_lines: int = 2) -> Column:
    """A text's chunks of ``min_lines`` lines or more: array<struct<lo, key>>, lo the first line from 0, key its lines' hashes.

    The rolling hash of a line covers the first 28 bits of its MD5 and of the line's before it; its rest by ``divisor`` names
    the one of ``divisor`` cuttings of the text in which a chunk ends there. All of them end with the text. So a boundary
    depends on two lines alone and survives insertions elsewhere; and every line ends a chunk in one of the cuttings.
    """
    lines = F.split(text, "\n")
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    marks = lambda h: F.transform(h, lambda x, i: (x + F.when(i > 0, F.get(h, i - 1)).otherwise(F.lit(0)) * BASE) % PRIME % divisor)
    both = F.struct(F.transform(lines, line_hash).alias("keys"), F.element_at(F.transform(F.array(hashes), marks), 1).alias("marks"))
    return F.array_distinct(F.element_at(F.transform(F.array(both), _chunks_of(divisor, min_lines)), 1))


def _chunks_of(divisor: int, min_lines: int):
    def build(x: Column) -> Column:
        keys, marks = x["keys"], x["marks"]
        n = F.size(keys)

        def cutting(s: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(marks, i) == s))
            spans = lambda e: F.transform(e, lambda end, k: F.struct(F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1).alias("lo"), end.alias("hi")))
            long = F.filter(F.element_at(F.transform(F.array(ends), spans), 1), lambda c: c["hi"] - c["lo"] >= min_lines - 1)
            return F.transform(long, lambda c: F.struct(c["lo"].alias("lo"), F.slice(keys, c["lo"] + 1, c["hi"] - c["lo"] + 1).alias("key")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(divisor - 1)), cutting))

    return build


def dedup_lines(docs: DataFrame, divisor: int = 2, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the lines of every chunk of ``min_lines`` lines or more that stood in the table before.

    The first place of a chunk (smallest document id, nulls first, then text hash, then line) stays, so every line that goes
    has a copy that stays. Chunks are equal when the hashes of their lines are and each of these hashes is of one text: lines
    of equal hashes are compared byte for byte, by grouping, and chunks with a line whose hash lies stay. Joins with lists
    per chunk or document, which grow with the table, are merge joins at every size.
    Returns the columns of ``docs`` with the text replaced, and n_lines, n_removed_lines and n_removed_chunks. The text of a
    document that loses everything is empty. A null text stays null with all counts 0; an empty text is one line. Rows
    that are equal in id and text count as one document, so both keep or lose the same chunks. Columns with the names of
    the new ones are replaced.
    """
    base = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks").withColumn("_th", F.xxhash64(F.lit("text"), text_col))
    texts = base.where(F.col(text_col).isNotNull())
    places = texts.select(F.col(id_col).alias("_id"), "_th", F.explode(chunk_column(F.col(text_col), divisor, min_lines)).alias("_c"))
    places = staged(places.select("_id", "_th", F.col("_c.lo").alias("_lo"), F.col("_c.key").alias("_key")), "chunk-places")
    often = places.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select("_key")
    again = staged(places.join(often.hint("merge"), "_key"), "repeated-places")
    discard(places)

    # the comparison of bytes: equal lines meet in one group; a hash with two texts would say nothing
    line = texts.select(F.explode(F.split(text_col, "\n")).alias("_t")).select(line_hash(F.col("_t")).alias("_h"), "_t")
    lies = line.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_many")).groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h")
    lies = staged(lies, "lying-hashes")
    bad = again.select("_key", F.explode("_key").alias("_h")).join(lies, "_h", "left_semi").select("_key").distinct()
    first = again.join(bad, "_key", "left_anti").groupBy("_key").agg(F.min(F.struct("_id", "_th", "_lo")).alias("_first"))
    gone = again.join(first.hint("merge"), "_key").where(~F.struct("_id", "_th", "_lo").eqNullSafe(F.col("_first")))
    gone = gone.groupBy("_id", "_th").agg(F.collect_set(F.struct("_lo", F.size("_key").alias("_n"))).alias("_gone"))
    gone = staged(gone.select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), "_gone"), "lost-chunks")
    discard(again, lies)

    out = base.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    lost = F.array_distinct(F.flatten(F.transform("_gone", lambda g: F.sequence(g["_lo"], g["_lo"] + g["_n"] - 1))))
    out = out.withColumn("_lost", F.when(F.col("_gone").isNotNull(), lost)).withColumn("_l", F.when(F.col(text_col).isNotNull(), F.split(text_col, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_lost"))
    many = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return out.withColumns(
        {
            text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("_l", i)), "\n")),
            "n_lines": many("_l"),
            "n_removed_lines": many("_lost"),
            "n_removed_chunks": many("_gone"),
        }
    ).drop("_th", "_gid", "_gth", "_gone", "_lost", "_l")


#: The same rules in DuckDB SQL.
ORACLE = """
with d as (select doc_id, string_split(text, chr(10)) l from documents),
h as (select *, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) hs, len(l) n from d),
m as (select *, list_transform(range(1, n + 1), lambda i: (hs[i] + case when i > 1 then hs[i-1] else 0 end * 257) % 1000003 % 2) marks from h),
e as (select doc_id, l, s, list_filter(range(1, n + 1), lambda i: i = n or marks[i] = s) ends from m, unnest([0, 1]) u(s)),
c as (select doc_id, l, case when k = 1 then 1 else ends[k-1] + 1 end lo, ends[k] hi from e, unnest(range(1, len(ends) + 1)) u(k)),
t as (select doc_id, lo, hi, array_to_string(l[lo:hi], chr(10)) chunk from c where hi > lo),
g as (select doc_id, lo, hi, row_number() over (partition by chunk order by doc_id, lo) > 1 gone from t),
r as (select doc_id, count(*) many, list_distinct(flatten(list(range(lo, hi + 1)))) lost from g where gone group by doc_id)
select doc_id, coalesce(n, 0)::bigint n_lines, coalesce(len(lost), 0)::bigint n_removed_lines, coalesce(many, 0)::bigint n_removed_chunks,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: not list_contains(coalesce(lost, []), i)), lambda i: l[i]), chr(10)), '')) kept_sha256
from h left join r using (doc_id)
"""
