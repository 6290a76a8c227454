"""Operator 4: an exact Jaccard self-join on word n-grams by a token-group matrix.

Documents with equal sets form a class. A class is queried by its prefix: rare tokens first, so many that any set within the
threshold holds at least ``EXTRA`` of them in its own prefix (or all that its size asks for). Rounds of star links (every
class of a token against that token's leader) partition similar classes into groups; the matrix then holds each group's
union of prefix tokens. How many of a class's tokens are in a group's union bounds its overlap with every member; only
groups that reach what a link needs, and whose sizes can fit, are opened. Work is bounded by tokens and groups: classes
that are linked already are never compared again. What is opened is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, components, discard, mix, slices, staged, true_to_bytes, word_hashes

BITS = (20, 24)  # log2 of the least and the most buckets of the frequency table
BLOCK = 64  # classes in a block of the matrix, about
EXTRA = 3  # tokens that prefixes of a link have in common
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _shingles(w: np.ndarray, row: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first word, number of words) of every ``k``-word shingle of ``n`` rows; fewer words are one shingle."""
    count = np.bincount(row, minlength=n)
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for i in range(k):
        h = mix(h * _STEP + w[i : len(w) - k + 1 + i]) if len(h) else h
    whole = np.flatnonzero(row[: len(h)] == row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    at = np.concatenate(([0], np.cumsum(count)))[short]
    s = np.zeros(len(short), np.uint64)
    for i in range(k - 1):
        go = i < count[short]
        s[go] = mix(s[go] * _STEP + w[at[go] + i])
    s = mix(s + count[short].astype(np.uint64))
    return np.concatenate([row[whole], short]), np.concatenate([h[whole], s]), np.concatenate([whole, at]), np.concatenate([np.full(len(whole), k), count[short]])


def _unique(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[fresh], h[fresh]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), unique and sorted by row then hash, of the ``k``-word shingles; fewer words are one shingle."""
    w, row, _, _ = word_hashes(data, offsets)
    return _unique(*_shingles(w, row, len(offsets) - 1, k)[:2])


def exact_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with equal numbers for equal shingles alone: words are compared byte by byte and shingles word by
    word; where hashes would lie, tuples of words are numbered instead."""
    w, row, start, end = word_hashes(data, offsets)
    r, h, first, size = _shingles(w, row, len(offsets) - 1, k)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = order[same], order[same + 1]
    true = true_to_bytes(data, w, start, end) and (size[a] == size[b]).all()
    for i in range(k if true else 0):
        go = i < size[a]
        true = true and (w[first[a[go]] + i] == w[first[b[go]] + i]).all()
    if not true:
        raw, known = data.tobytes(), {}
        words = [raw[s:e].lower() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        h = np.array([known.setdefault(tuple(words[f : f + n]), len(known)) for f, n in zip(first.tolist(), size.tolist(), strict=True)], np.uint64)
    return _unique(r, h)


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """log2 of how many documents' tokens fall into each bucket of hashes, over all documents. The number of buckets, a power
    of two, grows with the bytes of the texts within ``BITS``. Tables of tasks are added up in two rounds, block by block."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, blocks = min(BITS[1], max(BITS[0], int(n_bytes).bit_length() - 9)), 256
    size = 1 << bits

    def count(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size, np.uint32)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                _, h = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                np.add.at(total, _bucket(h, bits), np.uint32(1))
        if total.any():
            parts = [zlib.compress(x.astype(np.uint64).tobytes(), 1) for x in np.split(total, blocks)]
            task = TaskContext.get().partitionId() // 512
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([task] * blocks, pa.int32()), pa.array(parts)], ["block", "tasks", "counts"])

    def add(pdf):
        import zlib

        total = sum(np.frombuffer(zlib.decompress(c), np.uint64) for c in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])

    def level(pdf):
        import zlib

        return add(pdf).assign(counts=lambda d: [np.log2(np.frombuffer(zlib.decompress(c), np.uint64) + 1.0).astype(np.uint8).tobytes() for c in d["counts"]])

    schema = "block int, tasks int, counts binary"
    some = docs.select("text").mapInArrow(count, schema).groupBy("block", "tasks").applyInPandas(add, schema)
    out = np.zeros(size, np.uint8)
    for r in some.groupBy("block").applyInPandas(level, schema).collect():  # 2**24 bytes at most
        out[r["block"] * (size // blocks) :][: size // blocks] = np.frombuffer(r["counts"], np.uint8)
    return out


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def parity(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per set a bitmap of a power of two of bits, twice its size at least, each bit the parity of the tokens on it. The
    bits that differ between two bitmaps, folded to one length, are no more than the tokens that one set alone has."""
    size = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(size)))
    bits = np.bincount(at[row] + (mix(h) & (size[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(at[-1])).astype(np.uint8) & 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many bits differ in each pair of bitmaps, the longer one folded."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for key in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == key[0]) & (lb == key[1]))
        least = min(key)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([v[i] for i in at]), np.uint64).reshape(len(at), -1, least // 8), axis=1) for v in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, prefix, bits): the set's size, a 128-bit hash of it, its prefix tokens in the global order and
    its parity bitmap."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))
    bits = len(levels.value).bit_length() - 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                row, h = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.bincount(row, minlength=j - i)
                ends = np.concatenate(([0], np.cumsum(n)))
                pick = np.minimum(ends[:-1], max(0, len(h) - 1))
                h1 = np.where(n > 0, np.add.reduceat(mix(h), pick), 0) if len(h) else np.zeros(j - i, np.uint64)
                h2 = np.where(n > 0, np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5BD1E995)), pick), 0) if len(h) else h1
                order = np.lexsort((h, levels.value[_bucket(h, bits)], row))
                length = np.minimum(n, n - (percent * n + 99) // 100 + EXTRA)
                keep = np.arange(len(h)) - np.repeat(ends[:-1], n) < np.repeat(length, n)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(h[order][keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), prefix, pa.array(parity(row, h, n), pa.binary())], ["doc_id", "n", "h1", "h2", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, bits binary")


def possible(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the bitmaps (id, n, bits) do not rule out: a link of sizes x and y leaves
    x + y - 2 * ceil(percent * (x + y) / (100 + percent)) tokens at most that one set alone has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = apart(batch.column(3).to_pylist(), batch.column(5).to_pylist()) <= most
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    sa, sb = (shapes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    full = pairs.join(sa, "a").join(sb, "b").where(fits("n_a", "n_b", "n_b", percent)).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return full.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets of words reach the threshold, from the whole texts (id, zip)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(a), bool)
            for i, j in slices(buffers(batch.column(2))[1] + buffers(batch.column(3))[1], 1 << 19):
                raw = [z.decompress(x) for c in (2, 3) for x in batch.column(c).slice(i, j - i).to_pylist()]
                row, key = exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), k)
                m = j - i
                size = np.bincount(row, minlength=2 * m)
                row, key = _pairs(row % m, key)
                common = np.bincount(row[:-1][(row[1:] == row[:-1]) & (key[1:] == key[:-1])], minlength=m)
                good[i:j] = 100 * common >= percent * (size[:m] + size[m:] - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    ta, tb = (texts.select(F.col("id").alias(c), F.col("zip").alias(f"zip_{c}")) for c in "ab")
    full = pairs.join(ta, "a").join(tb, "b").select("a", "b", "zip_a", "zip_b")
    return full.mapInArrow(run, "a long, b long").distinct()


def _pairs(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    return row[order], key[order]


def zipped(docs: DataFrame) -> DataFrame:
    """(id, zip): compressed texts of documents that have an id and a text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z

        c = z.ZstdCompressor(level=1)
        for batch in batches:
            for i, j in slices(buffers(batch.column(1))[1], 1 << 23):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([c.compress(t.as_buffer()) for t in batch.column(1).slice(i, j - i)], pa.binary())], ["id", "zip"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "id long, zip binary")


def fits(x: str, lo: str, hi: str, percent: int):
    """A set of size x can reach the threshold with one of a size in [lo, hi]."""
    return (F.col(x) * 100 >= F.col(lo) * percent) & (F.col(hi) * 100 >= F.col(x) * percent)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, stars: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of ``k``-word shingles, and the smallest id
    that links of Jaccard ``percent`` / 100 or more lead to.

    Words are what stands between ASCII white space, with A-Z lower-cased; a text of fewer words is one shingle, and one
    without words links with nothing. Rows that share an id are one document: a link of one is a link of all. A row
    without id links with nothing and has a null component. Other columns are dropped; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = staged(signatures(docs, k, percent), "signatures")
    used = sig.where("n > 0 and doc_id is not null")
    classes = used.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    full = staged(classes, "classes-with-prefix")
    classes = staged(full.drop("prefix", "bits"), "classes")
    shapes = staged(full.select(F.col("rep").alias("id"), "n", "bits"), "shapes")
    sizes = staged(sig.drop("prefix", "bits"), "sizes")
    discard(sig)
    post = full.select(F.col("rep").alias("id"), "n", F.explode("prefix").alias("token"))
    # tokens that stand in one class alone lead nowhere
    tokens = staged(post.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "tokens")
    post = staged(post.join(tokens, "token").select("token", "id", "n"), "postings")
    discard(full, tokens)
    # the share of its prefix that a class has in common with others: copies gather round those with a high share
    shared = post.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("share", F.col("c") / F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + EXTRA))
    shared = staged(shared.select("id", "share"), "shares")
    first = post
    post = staged(first.join(shared, "id").select("token", "id", "n", "share", F.col("id").alias("group")), "postings")
    discard(first)
    texts = staged(zipped(docs).join(shared.select("id"), "id", "left_semi"), "texts")
    links = asked = None
    for r in range(stars + 1):
        if r < stars:
            # the leader of a token: a high share, and chance in every round anew
            place = F.col("share") + F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(1000)) / 1000 * (0.001 if r == 0 else 0.25)
            lead = staged(post.groupBy("token").agg(F.max_by(F.struct("id", "group", "n"), F.struct(place, "id")).alias("lead")), "leaders")
            new = post.join(lead, "token").where("group <> lead.group").withColumn("ln", F.col("lead.n")).where(fits("n", "ln", "ln", percent))
            new = new.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
        else:
            new = opened_groups(post.select("token", "id", "n", "group"), shapes, percent)
        if asked is not None:
            new = new.join(asked, ["a", "b"], "left_anti")
        if r < stars:
            new = possible(staged(new, "pairs"), shapes, percent)
        new = staged(new, "possible")
        asked = new if asked is None else staged(asked.union(new), "asked")
        more = verified(new, texts, k, percent)
        links = staged(more if links is None else links.union(more).distinct(), "links")
        if r < stars:
            comp = components(links).withColumnRenamed("node", "id")
            old = post
            post = staged(post.drop("group").join(comp, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"), "postings")
            # a token whose classes are all of one group has nothing left to tell
            mixed = staged(post.groupBy("token").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 <> g2").select("token"), "tokens")
            rest = staged(post.join(mixed, "token"), "postings")
            discard(old, post, mixed)
            post = rest
            if post.isEmpty():
                break
    comp = components(links)

    found = classes.join(comp, classes["rep"] == comp["node"], "left").select("h1", "h2", F.col("n").alias("cn"), F.coalesce("component", "rep").alias("cid"))
    found = staged(found, "class-components")
    s = sizes.withColumns({"g1": F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("h1")), "g2": F.col("h2")}).drop("h1", "h2")
    out = s.join(found, (s["g1"] == found["h1"]) & (s["g2"] == found["h2"]) & (s["n"] == found["cn"]), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("cid", "doc_id").alias("component_id"))
    return out


def opened_groups(post: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different groups to compare, from postings (token, id, n, group).

    Classes that stars have linked are in the group of their component, a class on its own in that of its commonest token;
    groups of many are cut into blocks of about ``BLOCK``. The matrix has a row per token and block: the block's union of
    tokens, with the sizes and groups in it. A class of n tokens opens a block only if at least ``EXTRA`` of its tokens are
    in the union (or as many as any set linked to it must share, if fewer), with sizes that fit and another group; in it
    the bitmaps bound the overlap with each member. What two tables' rows meet in is classes by blocks, never all pairs.
    """
    many = post.groupBy("token").agg(F.count(F.lit(1)).alias("many"))
    members = post.join(many, "token").groupBy("id", "n", "group").agg(F.max_by("token", F.struct("many", "token")).alias("home"))
    members = staged(members, "members")
    crowd = members.groupBy("group").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = staged(members.join(crowd, "group", "left").withColumn("home", F.when(F.col("crowd").isNotNull(), F.col("group")).otherwise(F.col("home"))).drop("crowd"), "members")
    cut = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cut"))
    members = staged(members.join(cut, "home").select("id", "n", "group", "home", F.pmod(F.xxhash64("id"), "cut").alias("block")), "members")
    post = staged(post.select("token", "id").join(members, "id"), "postings")
    matrix = post.groupBy("token", F.col("home").alias("to"), F.col("block").alias("to_block")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("group").alias("g1"), F.max("group").alias("g2"))
    matrix = staged(matrix, "matrix")
    asked = post.join(matrix, "token").where(fits("n", "lo", "hi", percent) & ~((F.col("g1") == F.col("group")) & (F.col("g2") == F.col("group"))))
    asked = asked.where((F.col("home") < F.col("to")) | (F.col("home") == F.col("to")) & (F.col("block") <= F.col("to_block")))
    need = F.least(F.lit(EXTRA), F.ceil(F.col("n") * percent / 100))
    asked = asked.groupBy("id", "n", "group", "to", "to_block").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= need)
    asked = staged(asked.drop("n", "overlap"), "asked")
    discard(post, matrix)
    filled = members.join(shapes.select("id", "bits"), "id").groupBy(F.col("home").alias("to"), F.col("block").alias("to_block")).agg(F.collect_list(F.struct("id", "n", "group", "bits")).alias("members"))
    filled = staged(filled.join(asked.select("to", "to_block").distinct(), ["to", "to_block"], "left_semi"), "blocks")

    def open_(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids, groups, sizes = (part.column(c).to_numpy() for c in range(3))
                inner = part.column(4).flatten()
                b_id, b_n, b_group = (inner.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                row = np.repeat(np.arange(part.num_rows), part.column(4).value_lengths().to_numpy())
                low, high = np.minimum(sizes[row], b_n), np.maximum(sizes[row], b_n)
                go = np.flatnonzero((b_group != groups[row]) & (100 * low >= percent * high))
                total = sizes[row[go]] + b_n[go]
                bits, own = inner.field(3).take(pa.array(go)).to_pylist(), part.column(3).take(pa.array(row[go])).to_pylist()
                keep = go[apart(own, bits) <= total - 2 * -(-percent * total // (100 + percent))]
                x, y = ids[row[keep]], b_id[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    full = asked.join(shapes, "id").join(filled, ["to", "to_block"]).select("id", "group", "n", "bits", "members")
    return full.mapInArrow(open_, "a long, b long").distinct()


#: The same rows in DuckDB SQL, for the parameters of the registered query.
ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') l from documents),
s as (select distinct doc_id, unnest(case when len(l) = 0 then [] when len(l) < 4 then [l] else list_transform(range(1, len(l) - 2), lambda i: l[i:i+3]) end) t from w),
n as (select doc_id, count(*) n from s group by 1),
t as (select t from s group by 1 having count(*) > 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join t using (t) join s b using (t) where a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from e union select b, a from e),
r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join both_ways e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id
from documents d left join n using (doc_id) join (select a doc_id, min(b) component_id from r group by 1) c using (doc_id)
"""
