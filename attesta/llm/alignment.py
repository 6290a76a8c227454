"""Operator 11: alignment of two tokenizers, with corpus-wide pair counts from inverted bitmaps."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buffers, slices, staged
from .tokens import _byte_chars

CACHE = 400_000  # chunks that a Python worker remembers at most, and their bytes
CACHE_BYTES = 1 << 25
ROWS = 8192  # documents of a container: the reach of one bitmap
POSTINGS = 1 << 21  # a container is closed earlier when it holds so many

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A chunk starts with a space or line end behind something that is not white space: no token of either kind crosses that.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


class Aligner:
    """Chunks of text, each with its tokens of both kinds, groups and pairs of ids; chunks that return are looked up."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in _byte_chars().items()}
        vocabulary = self.a.get_vocab()
        self.raw_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw_a[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        name = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(name)]
        self.space = self.b.piece_to_id("▁")
        self.whole = any("▁" in p.lstrip("▁") or "\n" in p for p in name)  # then pieces may cross the cuts, and texts stay whole
        self.len_a, self.len_b = np.array(list(map(len, self.raw_a))), np.array(list(map(len, self.raw_b)))
        self.tokenize, self.chars = self.a.model.tokenize, _byte_chars()
        #: ids in decimal, with what may follow them: the same group's next id, its ids of the other kind, a new group, nothing
        self.span = max(len(self.raw_a), len(self.raw_b))
        self.number = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.span)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tails = {}
        self.groups: list[str] = []
        #: of each chunk: tokens of both kinds, groups, links, and whether its bytes differ; then its pairs and their times
        self.stats, self.ends, self.pairs, self.times, self.held = array("q"), array("q", [0]), array("q"), array("q"), 0

    def chunks(self, text: str) -> list[str]:
        return [" " + text] if self.whole else _CUT.split(" " + text)

    def ids_a(self, chunks: list[str]) -> list[list[int]]:
        """A's tokens of each chunk. A space, Latin letters and ASCII marks are two pre-tokens, which need no regex."""
        out: list[list[int]] = [[]] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            core = c.rstrip(_MARKS)
            word = core[1:]
            if c[0] == " " and word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                tail = c[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = self.part(tail) if tail else []
                out[i] = self.part(core) + self.tails[tail]
            else:
                rest.append(i)
        for i, e in zip(rest, self.a.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def part(self, text: str) -> list[int]:
        return [t.id for t in self.tokenize("Ġ" + text[1:] if text.isascii() and text[0] == " " else text if text.isascii() else "".join(map(self.chars.__getitem__, text.encode())))]

    def learn(self, chunks: list[str]) -> None:
        """Tokens, groups and pairs of new chunks, all at once: tokens of both kinds lie in one row of bytes each."""
        ids_a = self.ids_a(chunks)
        # a leading space is the one that the encoder adds; in front of a line end it adds one that goes again
        ids_b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        ids_b = [x[1:] if c[0] != " " else x or [self.space] for c, x in zip(chunks, ids_b, strict=True)]
        raw = [c.encode() for c in chunks]
        size = np.array(list(map(len, raw)))
        self.known.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.held += int(size.sum())
        flat = lambda ids: np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        good = np.ones(len(chunks), bool)
        if not b"".join([self.raw_a[x] for x in chain.from_iterable(ids_a)]) == b"".join(raw) == b"".join([self.raw_b[x] for x in chain.from_iterable(ids_b)]):
            good = np.array([b"".join([self.raw_a[x] for x in xa]) == c == b"".join([self.raw_b[x] for x in xb]) for c, xa, xb in zip(raw, ids_a, ids_b, strict=True)])
            empty: list[int] = []
            ids_a, ids_b = ([x if g else empty for g, x in zip(good, ids, strict=True)] for ids in (ids_a, ids_b))
        xa, xb = flat(ids_a), flat(ids_b)
        na, nb = np.array(list(map(len, ids_a))), np.array(list(map(len, ids_b)))
        ends_a, ends_b = np.cumsum(self.len_a[xa]), np.cumsum(self.len_b[xb])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # the ends of groups; every chunk ends one
        ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        many_a, many_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        chunk = np.searchsorted(np.cumsum(np.where(good, size, 0)), cuts)
        links = many_a * many_b
        total = lambda v: np.bincount(chunk, v, len(chunks)).astype(np.int64)  # noqa: E731  exact below 2**53
        self.stats.extend(np.stack([na, nb, total(np.ones(len(cuts))), total(links), ~good], axis=1).ravel().tolist())

        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        key, ids = np.concatenate([2 * ga, 2 * gb + 1])[order], np.concatenate([xa, xb])[order]
        last = np.cumsum(na + nb) - 1
        after = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
        after = np.append(after, 3)
        after[last[na > 0]] = 3
        words = list(map(self.number.__getitem__, (after * self.span + ids).tolist()))
        ends = np.cumsum(na + nb).tolist()
        self.groups += ["".join(words[i:j]) for i, j in zip([0, *ends], ends)]

        wide = np.flatnonzero(links > 4096)  # groups so wide repeat ids, which are counted before they are paired
        plain = np.where(links > 4096, 0, links)
        group = np.repeat(np.arange(len(cuts)), plain)
        k = np.arange(len(group)) - np.repeat(np.cumsum(plain) - plain, plain)
        pair = xa[first_a[group] + k // many_b[group]] << 32 | xb[first_b[group] + k % many_b[group]]
        owner, times = [chunk[group]], [np.ones(len(group), np.int64)]
        pairs = [pair]
        for g in wide:
            (ia, ta), (ib, tb) = (np.unique(x[f[g] : f[g] + m[g]], return_counts=True) for x, f, m in ((xa, first_a, many_a), (xb, first_b, many_b)))
            pairs.append((ia[:, None] << 32 | ib).ravel())
            times.append((ta[:, None] * tb).ravel())
            owner.append(np.full(len(pairs[-1]), chunk[g]))
        owner, pairs, times = (np.concatenate(x) for x in (owner, pairs, times))
        by = np.argsort(owner, kind="stable")
        self.pairs.extend(pairs[by].tolist())
        self.times.extend(times[by].tolist())
        self.ends.extend((self.ends[-1] + np.cumsum(np.bincount(owner, minlength=len(chunks)))).tolist())

    def align(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_groups, n_links, groups), and the postings of all as (text, pair, times)."""
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        new = {c for cs in cut for c in cs if c not in self.known}
        if new:
            self.learn(list(new))
        at = [np.fromiter(map(self.known.__getitem__, cs), np.int64, len(cs)) for cs in cut]
        stats, ends = np.array(self.stats, np.int64).reshape(-1, 5), np.array(self.ends, np.int64)
        rows = []
        for i, own in enumerate(at):
            total = stats[own].sum(0)
            if total[4] or not len(own):
                at[i] = own[:0]
                rows.append((0, 0, 0, 0, ""))
            else:
                rows.append((*total[:4].tolist(), ";".join(map(self.groups.__getitem__, own.tolist()))))
        doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
        key, often = np.unique(doc * len(ends) + np.concatenate([np.zeros(0, np.int64), *at]), return_counts=True)
        doc, chunk = np.divmod(key, len(ends))
        size = ends[chunk + 1] - ends[chunk]
        src = np.arange(size.sum()) + np.repeat(ends[chunk] - (np.cumsum(size) - size), size)
        return rows, np.repeat(doc, size), np.array(self.pairs, np.int64)[src], np.array(self.times, np.int64)[src] * np.repeat(often, size)


# --- compressed bitmaps -----------------------------------------------------------------------------------------------


def compress(place: np.ndarray, ends: np.ndarray):
    """Sets of places below ``ROWS`` (sorted within each) as an Arrow binary array: a bitmap of ROWS / 8 bytes where that is
    the shorter form, else the places as uint16."""
    import pyarrow as pa

    full = ROWS // 8
    count = np.diff(ends)
    dense = 2 * count >= full
    to = np.concatenate(([0], np.cumsum(np.where(dense, full, 2 * count))))
    data = np.zeros(to[-1] // 2, "<u2")
    if not dense.all():
        data[np.repeat(~dense, np.where(dense, full // 2, count))] = place[np.repeat(~dense, count)]
    data = data.view(np.uint8)
    for i in np.flatnonzero(dense):
        bits = np.zeros(ROWS, np.uint8)
        bits[place[ends[i] : ends[i + 1]]] = 1
        data[to[i] : to[i + 1]] = np.packbits(bits)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])


def expand(bitmaps) -> tuple[np.ndarray, np.ndarray]:
    """(set, place) of all bits of an Arrow array of compressed bitmaps."""
    data, at = buffers(bitmaps)
    size = np.diff(at)
    dense = size == ROWS // 8
    sparse = np.where(dense, 0, size // 2)
    rows, places = [np.repeat(np.arange(len(size)), sparse)], [np.ascontiguousarray(data[np.repeat(~dense, size)]).view("<u2").astype(np.int64)]
    for i in np.flatnonzero(dense):
        places.append(np.flatnonzero(np.unpackbits(data[at[i] : at[i + 1]])))
        rows.append(np.full(len(places[-1]), i))
    return np.concatenate(rows), np.concatenate(places)


def popcounts(bitmaps) -> np.ndarray:
    """Bits of each compressed bitmap."""
    data, at = buffers(bitmaps)
    size = np.diff(at)
    out = size // 2
    for i in np.flatnonzero(size == ROWS // 8):
        out[i] = np.bitwise_count(data[at[i] : at[i + 1]]).sum()
    return out


def postings(doc: np.ndarray, pair: np.ndarray, times: np.ndarray):
    """One row per pair: the bitmap of its documents (what all parts of the container say, in one by OR), and planes: the
    bitmap of plane j holds the documents whose multiplicity less one has bit j. Returns Arrow columns pair, n_docs, n_links,
    docs, planes."""
    import pyarrow as pa

    order = np.lexsort((doc, pair))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))[: len(pair)])
    times = np.add.reduceat(times, new, dtype=np.int64) if len(new) else times.astype(np.int64)
    doc, pair = doc[new], pair[new]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
    ends = np.append(first, len(pair))
    docs = compress(doc, ends)
    n_docs = popcounts(docs)
    links, row = n_docs.astype(np.int64), np.repeat(np.arange(len(first)), np.diff(ends))
    planes, rest, j = [], times - 1, 0
    while len(rest) and (some := np.flatnonzero(rest)).size:
        doc, row, rest = doc[some], row[some], rest[some]
        odd = np.flatnonzero(rest & 1)
        who, count = np.unique(row[odd], return_counts=True)
        bits = compress(doc[odd], np.concatenate(([0], np.cumsum(count))))
        links[who] += popcounts(bits) << j
        planes.append((who, np.full(len(who), j), bits))
        rest, j = rest >> 1, j + 1
    # planes of a row in order; a plane that is empty within a row stands as an empty bitmap
    depth = np.zeros(len(first), np.int64)
    for who, level, _ in planes:
        depth[who] = level + 1
    at = np.concatenate(([0], np.cumsum(depth)))
    take, have, parts = np.zeros(at[-1], np.int64), 1, [pa.array([b""], pa.binary())]
    for who, level, bits in planes:
        take[at[who] + level] = have + np.arange(len(who))
        have += len(who)
        parts.append(bits)
    values = pa.concat_arrays(parts).take(pa.array(take))
    return pa.array(pair[first]), pa.array(n_docs.astype(np.int32)), pa.array(links), docs, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_SCHEMA = "container long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, pair_docs int, pair_links long, docs binary, planes array<binary>"


def inverted(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool) -> DataFrame:
    """Both tokenizers over each text, once. Returns two kinds of rows: of documents (container, place, doc_id, n_a, n_b,
    n_groups, n_links, groups: the text, or its digest) and of pairs (container, pair, pair_docs, pair_links, docs, planes).

    A container is up to ``ROWS`` documents of one task, numbered by place. It is wholly one task's, so the bitmaps of a pair
    in different containers are disjoint, and their counts add up.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = _ALIGNERS.get((byte_bpe, pieces)) or _ALIGNERS.setdefault((byte_bpe, pieces), Aligner(byte_bpe, pieces))
        container, place, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        schema = pa.schema([("container", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _DOC[1:5]), ("groups", pa.string()), ("pair", pa.int64()), ("pair_docs", pa.int32()), ("pair_links", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))])

        def rows(n: int, columns: dict):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def close() -> Iterator:
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts.clear()
                pair, n_docs, links, bits, planes = postings(*columns)
                step = 1 << 16
                for i in range(0, len(pair), step):
                    cut = {"pair": pair, "pair_docs": n_docs, "pair_links": links, "docs": bits, "planes": planes}
                    cut = {c: x.slice(i, step) for c, x in cut.items()}
                    n = len(cut["pair"])
                    yield rows(n, cut | {"container": pa.array(np.full(n, container))})

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in slices(buffers(texts)[1], 1 << 21):
                while i < j:
                    if place == ROWS or held > POSTINGS:
                        yield from close()
                        container, place, held = container + 1, 0, 0
                    k = min(j, i + ROWS - place)
                    found, doc, pair, times = aligner.align(texts.slice(i, k - i).to_pylist())
                    small = np.int32 if times.max(initial=0) < 1 << 31 else np.int64
                    parts.append(((doc + place).astype(np.int16), pair, times.astype(small)))
                    held += len(doc)
                    columns = dict(zip(_DOC[1:5], (pa.array([r[c] for r in found], pa.int64()) for c in range(4)), strict=True))
                    groups = [r[4] if keep_groups or not r[0] else hashlib.sha256(r[4].encode()).hexdigest() for r in found]
                    columns |= {"container": pa.array(np.full(k - i, container)), "place": pa.array(np.arange(place, place + k - i, dtype=np.int32)), "doc_id": ids.slice(i, k - i), "groups": pa.array(groups, pa.string())}
                    yield rows(k - i, columns)
                    place, i = place + k - i, k
        yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _scores(batches: Iterator) -> Iterator:
    """Postings with the counts of their pairs, in order of container, back to documents."""
    import pyarrow as pa

    container, best, total = None, np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)

    def out() -> Iterator:
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), container)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["container", "place", "n_best", "count_sum"])

    for batch in batches:
        where = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else []
        for i, j in zip(edges, [*edges[1:], len(where)], strict=True):
            if where[i] != container:
                yield from out()
                container = int(where[i])
                best[:], total[:] = 0, 0
            part = batch.slice(i, j - i)
            count, top = part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
            row, place = expand(part.column(1))
            levels = part.column(2)
            size = np.diff(levels.offsets.to_numpy())
            owner, level = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            more, where_more = expand(levels.flatten())
            times = np.concatenate([np.ones(len(row), np.int64), np.int64(1) << level[more]])
            row, place = np.concatenate([row, owner[more]]), np.concatenate([place, where_more])
            np.add.at(total, place, times * count[row])
            np.add.at(best, place, times * top[row])
    yield from out()


def align_tokenizers(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = True) -> DataFrame:
    """How the tokens of two vocabularies cover the same bytes, and how common each pair of linked ids is.

    ``byte_bpe`` (A, a byte-level BPE file) encodes a space and the text, ``pieces`` (B, a SentencePiece model, which puts the
    space in front itself) the text; strings of special tokens are plain text. Where tokens of both end, a group ends; tokens of
    one group are linked. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A
    id), count_sum (of the counts of all links) and groups (``a1,a2|b1;a3|b2``, or its SHA-256 if ``keep_groups`` is false).
    The count of a pair is the number of documents (rows) that hold it linked.

    Each pair has a compressed bitmap of the documents per container (``inverted``), with planes of multiplicity; population
    counts add up to the pair's counts; the postings then meet the counts and, dealt by container, return scores to their documents.
    So a pair that all documents hold is one row per container, and no document's pairs are listed.

    A null or empty text, and one that either vocabulary doesn't give back byte for byte (a text that holds U+2581), has no
    tokens: zeros, and empty groups. Rows without id, and rows that are equal or share an id, are documents of their own. Other
    columns are dropped; an empty table gives an empty one. A text is cut where neither vocabulary can join tokens; the longest
    stretch without a space or line end is held in one piece.
    """
    both = staged(inverted(docs, byte_bpe, pieces, keep_groups), "alignment")
    posts = both.where("pair is not null").select("pair", "container", "pair_docs", "docs", "planes")
    counts = posts.groupBy("pair").agg(F.sum("pair_docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(of_a)).cast("long"))
    dealt = posts.select("pair", "container", "docs", "planes").join(counts, "pair").select("container", "docs", "planes", "count", "best")
    scores = dealt.repartition("container").sortWithinPartitions("container").mapInArrow(_scores, "container long, place int, n_best long, count_sum long")
    rows = both.where("pair is null").select("container", "place", *_DOC)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(scores, ["container", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups")


def pair_counts(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """The corpus-wide table of linked ids: a_id, b_id, n_docs (documents that hold them linked) and n_links."""
    posts = staged(inverted(docs, byte_bpe, pieces, False), "alignment").where("pair is not null")
    counts = posts.groupBy("pair").agg(F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n_docs", "n_links")
