"""Operator 13: benchmark decontamination by winnowed k-gram fingerprints. Native: DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORDS = "cast(array() as array<string>)"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    return F.coalesce(F.filter(F.split(F.translate(text, UPPER, LOWER), NO_WORD), lambda w: w != ""), F.expr(NO_WORDS))


def _runs(n: Column, size: int, f) -> Column:
    """``f`` of each start of a run of ``size`` among ``n`` places; none where there are fewer."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), f)).otherwise(F.expr("cast(array() as array<bigint>)"))


def fingerprints(texts: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """For each length, ``f<length>``: the fingerprint of the window of so many words at each start, added to a frame with
    ``words``.

    A window's fingerprint is the least hash of the k-grams inside, k being ``gram`` or the window's length if that is less.
    Neighbouring windows mostly share it, and windows of equal words always have the same one: that is winnowing's guarantee
    that each shared span as long as a window has a fingerprint on both sides.
    """
    texts = texts.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = sorted({min(gram, m) for m in lengths})

    def gram_hashes(k: int) -> Column:
        return _runs(F.size("_h"), k, lambda i: F.xxhash64(F.lit(k), *(F.get(F.col("_h"), i + j) for j in range(k))))

    def window_hashes(m: int) -> Column:
        k = min(gram, m)
        inside = lambda s: [F.get(F.col(f"_k{k}"), s + j) for j in range(m - k + 1)]
        return _runs(F.size("_h"), m, lambda s: F.xxhash64(F.lit(m), F.least(*inside(s)) if m > k else inside(s)[0]))

    texts = texts.withColumns({f"_k{k}": gram_hashes(k) for k in grams})
    return texts.withColumns({f"f{m}": window_hashes(m) for m in lengths}).drop("_h", *(f"_k{k}" for k in grams))


def _windows(texts: DataFrame, lengths: list[int], hits: Column | None = None) -> DataFrame:
    """A row for each window (or those whose fingerprint is in ``hits``): its first word, length and words as one string."""

    def of(m: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(f"f{m}") - 1), lambda s: F.array_contains(hits, F.get(F.col(f"f{m}"), s))) if hits is not None else F.sequence(F.lit(0), F.size(f"f{m}") - 1)
        rows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(m).alias("length"), F.array_join(F.slice("words", s + 1, m), " ").alias("window")))
        return F.when(F.size(f"f{m}") > 0, rows)

    none = F.expr("cast(array() as array<struct<start:int,length:int,window:string>>)")
    every = F.concat(*(F.coalesce(of(m), none) for m in lengths))
    keep = [c for c in texts.columns if c not in {"words", "_hits", *(f"f{m}" for m in lengths)}]
    return texts.select(*keep, F.explode_outer(every).alias("_w")).where("_w is not null").select(*keep, "_w.*")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The words of each document that stand in a window of some benchmark item, and the items.

    ``docs`` has doc_id and text, ``benchmark`` has item_id and text. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. Returns a row per document: doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items and items (ids, as sorted strings, of the items with windows that occur), contaminated.

    Fingerprints of the documents meet those of all items in a semi-join; a hit is extended to the windows that chose it,
    which meet the items' windows word by word. Equal texts are one key from then on, equal windows one entry with a list of
    items, and documents with the same windows share one list of items, so copies and common passages multiply nothing.
    Spark broadcasts the items' side where its size allows and shuffles both sides where not.

    A null or empty text has no words and no hits. Rows that are equal, share an id or have none are each answered. Items
    that share an id are one item; an item without id marks words but is in no list. Other columns are dropped. An empty
    benchmark hits nothing; an empty table of documents gives an empty one.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    items = staged(items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # ``window`` values at most
    blank = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if not lengths:
        return blank.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.expr(NO_WORDS).alias("items"), F.lit(False).alias("contaminated"))
    found = None
    for m in lengths:
        part = _windows(fingerprints(items.where(F.col("length") == m).select("item_id", "words"), [m], gram).withColumn("_f", F.col(f"f{m}")), [m])
        part = part.select("item_id", "length", "window", F.get(F.col("_f"), F.col("start")).alias("f"))
        found = part if found is None else found.unionByName(part)
    found = staged(found.distinct(), "item-windows")
    entry = F.md5(F.concat_ws(" ", F.col("length").cast("string"), F.col("window")).cast("binary"))

    texts = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("_key"), words(F.col("text")).alias("words"))
    prints = fingerprints(texts, lengths, gram)
    seen = prints.select("_key", F.explode_outer(F.array_distinct(F.concat(*(F.col(f"f{m}") for m in lengths)))).alias("f"))
    hits = seen.join(found.select("f").distinct(), "f", "left_semi").groupBy("_key").agg(F.collect_set("f").alias("_hits"))
    hits = staged(hits, "fingerprint-hits")

    suspects = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("_key"), "text").join(hits, "_key")
    suspects = suspects.select("_key", "_hits", words(F.col("text")).alias("words"))
    opened = _windows(fingerprints(suspects, lengths, gram), lengths, F.col("_hits"))
    spans = opened.join(found.select("length", "window").distinct(), ["length", "window"]).select("_key", "start", "length", entry.alias("entry")).distinct()
    places = F.sort_array(F.collect_list(F.struct("start", "length")))
    add = lambda at, s: F.struct(F.greatest(at["end"], s["start"] + s["length"]).alias("end"), (at["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(at["end"], s["start"]))).alias("n"))
    hit = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"]
    per_text = spans.groupBy("_key").agg(places.alias("_places"), F.sort_array(F.collect_set("entry")).alias("_entries"))
    per_text = staged(per_text.select("_key", hit.cast("long").alias("n_hit"), "_entries", F.md5(F.concat_ws(",", "_entries").cast("binary")).alias("_set")), "hit-texts")

    sets = per_text.groupBy("_set").agg(F.first("_entries").alias("_entries"))
    owners = found.select(entry.alias("entry"), "item_id").distinct()
    lists = sets.select("_set", F.explode("_entries").alias("entry")).join(owners, "entry").groupBy("_set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    answer = per_text.select("_key", "n_hit", "_set").join(lists, "_set", "left").drop("_set")
    out = blank.join(answer, "_key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr(NO_WORDS)).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: For unique doc_id and item_id, as the tables have them.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, coalesce({_SQL_WORDS}, []) AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM b)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, m, s FROM dw JOIN iw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
