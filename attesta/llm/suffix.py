"""Operator 2: removal of byte strings that repeat across a corpus, by threshold-bounded interval expansion on a BWT.

A string of ``length`` bytes is found through its anchor, the least hash of the ``GRAM``-byte strings in it: equal
strings have equal anchors at equal places. Windows in a row with one anchor form a segment; segments meet by anchor
hash. Equal segments (equal in anchor hash, place of the anchor, length and BLAKE2b of their bytes) are one entry with a
count. The different segments of an anchor go, block by block, into a Burrows-Wheeler transform, and a breadth-first
backward extension sets their common prefixes by increasing value up to ``length``: what is left unset repeats. Where an
anchor has more than ``KINDS`` different segments, they are split by the place of the anchor in the window and by the bytes
that all windows with these places have in common: 32 for all places, more for fewer, the whole string for one. Equal strings
still meet, and every transform stays bounded. Texts travel compressed and are cut where the segments lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, digests, discard, mix, powers, rolling, slices, staged

GRAM = 32  # bytes of an anchor
BLOCK = 1 << 20  # bytes in a transform, about
PIECE = 1 << 22  # window starts that are looked at in one go; positions there must fit into 24 bits
KINDS = 4096  # most different segments that meet in one transform for one anchor; more are split further
SPAN = 1 << 16  # bytes of a document whose ranges are merged in one go
END = 0xFF  # never a byte of UTF-8 text; the largest symbol, behind each segment


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window start within the row, number of windows, anchor hash, segment hash) of all rows.

    Long data are cut into pieces that overlap by ``length - 1`` bytes, so each window start is in one piece.
    """
    parts = []
    for s in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[s : s + PIECE + length - 1]
        row, start, *rest = _piece_segments(piece, np.clip(offsets - s, 0, len(piece)), length)
        parts.append((row, start + np.maximum(s - offsets[row], 0), *rest))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _piece_segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    w = length - GRAM + 1
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = rolling(data)
    gram = mix((h[GRAM:] - h[:-GRAM]) * powers(len(h))[1][: len(h) - GRAM])
    m = len(gram)
    if m > 1 << 24:
        raise ValueError(f"length {length} is too great")
    # the least hash in each window, the leftmost on a tie: minima from block starts and from block ends
    key = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    pad = np.full(-(-m // w) * w, np.iinfo(np.uint64).max)
    pad[:m] = key
    pad = pad.reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + length <= offsets[row + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new & valid)
    # a run ends where the next begins or the row's last window stands
    nxt = np.concatenate((np.flatnonzero(new)[1:], [n]))[np.searchsorted(np.flatnonzero(new), start)]
    r = row[start]
    many = np.minimum(nxt, offsets[r + 1] - length + 1) - start
    a = anchor[start]
    where = (a - start).astype(np.uint64)
    whole = digests(data.tobytes(), start, start + many + length - 1) ^ mix(where * np.uint64(0x9E3779B97F4A7C15) + many.astype(np.uint64))
    return r, start - offsets[r], many, gram[a], whole


def bwt_order(x: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` bytes at least, by doubling."""
    n = len(x)
    padded = np.concatenate((x, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    span = 8
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(np.uint64) + np.uint64(1)
        if span >= depth:
            return order
        beyond = np.concatenate((rank[span:], np.zeros(min(span, n), np.uint64)))[:n]
        key = rank << np.uint64(32) | beyond
        span *= 2


class Wavelet:
    """Bit planes of a byte sequence with ranks: the different bytes of a range, and their counts before it."""

    def __init__(self, b: np.ndarray):
        self.ranks, self.zeros = [], []
        cur = b
        for k in range(7, -1, -1):
            bit = (cur >> k & 1).astype(bool)
            self.ranks.append(np.concatenate(([0], np.cumsum(~bit))).astype(np.int32))
            self.zeros.append(int(self.ranks[-1][-1]))
            cur = np.concatenate((cur[~bit], cur[bit]))
        self.first = np.zeros(257, np.int64)  # where each byte begins in the last order
        starts = np.flatnonzero(np.concatenate(([True], cur[1:] != cur[:-1]))) if len(cur) else np.zeros(0, int)
        self.first[cur[starts]] = starts

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte, how many of it stand before lo, before hi) for every different byte of every range."""
        sym = np.zeros(len(lo), np.int64)
        for rank, zeros in zip(self.ranks, self.zeros, strict=True):
            l0, h0 = rank[lo].astype(np.int64), rank[hi].astype(np.int64)
            l1, h1 = zeros + lo - l0, zeros + hi - h0
            a, b = h0 > l0, h1 > l1
            sym = np.concatenate((sym[a] << 1, sym[b] << 1 | 1))
            lo, hi = np.concatenate((l0[a], l1[b])), np.concatenate((h0[a], h1[b]))
        return sym, lo - self.first[sym], hi - self.first[sym]


def repeated_starts(x: np.ndarray, length: int) -> np.ndarray:
    """Which positions of ``x`` (bytes, END behind every segment) begin a string of ``length`` bytes without END that
    also begins elsewhere in ``x``."""
    n = len(x)
    order = bwt_order(x, length)
    b = x[order - 1]
    counts = np.bincount(x, minlength=257)
    first = np.concatenate(([0], np.cumsum(counts)))
    wave = Wavelet(b)
    open_ = np.ones(n + 1, bool)  # common prefix with the suffix before not known to be shorter than ``length``
    open_[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        sym, l, h = wave.extend(lo, hi)
        go = sym != END
        sym, l, h = sym[go], l[go] + first[sym[go]], h[go] + first[sym[go]]
        go = open_[h] | (h == n)
        lo, hi = l[go], h[go]
        fresh = open_[hi]
        open_[hi] = False
        # an interval at the very end sets nothing but must go on while it is the only way to longer strings
        last = ~fresh
        if not fresh.any() and not last.any():
            break
    same = open_[:n]
    both = same.copy()
    both[:-1] |= same[1:]
    out = np.zeros(n, bool)
    out[order[both]] = True
    end = np.concatenate((np.flatnonzero(x == END), [n]))
    room = end[np.searchsorted(end, np.arange(n))] - np.arange(n)
    return out & (room >= length)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, th, zip, rest): texts as compressed bytes; th tells rows of one id apart, rest holds the other columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z

        c = z.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            raw = data.tobytes()
            for i, j in slices(offsets, 1 << 23):
                texts = [raw[offsets[k] : offsets[k + 1]] for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([c.compress(t) for t in texts], pa.binary()), batch.column(3).slice(i, j - i)], ["doc_id", "th", "zip", "rest"])

    return docs.mapInArrow(run, f"doc_id long, th long, zip binary, rest {docs.schema['rest'].dataType.simpleString()}")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("t"), text).alias("th"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("_")]).alias("rest"))


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def stretches(row: np.ndarray, lo: np.ndarray, many: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, times): equal segments in a row, as a run of one byte or of a short period makes them, are one entry."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] != lo[:-1] + many[:-1]) | (many[1:] != many[:-1]) | (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(row)))


def parts(data: np.ndarray, offsets: np.ndarray, many: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(segment, first window, number of windows, group) of the parts of segments of one anchor: a part holds the windows in
    which the anchor has one of ``width`` neighbouring places. Its group tells these places and the bytes around the anchor
    that all windows with them share, ``length + 1 - width`` in number, so equal windows are in one group."""
    w = length - GRAM + 1
    h = rolling(data)
    gram = mix((h[GRAM:] - h[:-GRAM]) * powers(len(h))[1][: len(h) - GRAM]) >> np.uint64(24)
    at = np.argmin(gram[offsets[:-1, None] + np.arange(w)], axis=1)  # of the anchor, as ``segments`` chose it
    raw, out = data.tobytes(), []
    for g in range(-(-w // width)):
        lo, hi = (np.clip(at - e * width + 1, 0, many) for e in (g + 1, g))
        seg = np.flatnonzero(hi > lo)
        core = offsets[seg] + at[seg] - g * width
        out.append((seg, lo[seg], (hi - lo)[seg], digests(raw, core, core + length + 1 - width) ^ mix(np.full(len(seg), g, np.uint64))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def expanded(bits: DataFrame, length: int, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """((anchor, whole, many, i, j), staged tables it reads): which windows [i, j) of the segments (anchor, whole, many, kinds,
    bytes) repeat in other segments of their anchor."""

    def expand(batches: Iterator) -> Iterator:
        """Blocks of whole anchors; rows come in the order of their anchor."""
        import pyarrow as pa

        waiting: list[tuple] = []
        size = 0

        def solve():
            x = np.frombuffer(b"".join([r[3] + b"\xff" for r in waiting]), np.uint8)
            flags = repeated_starts(x, length)
            ends = np.cumsum([len(r[3]) + 1 for r in waiting])
            rows = [(r[0], r[1], r[2], i, j) for r, e in zip(waiting, ends.tolist(), strict=True) for i, j in runs(flags[e - len(r[3]) - 1 :][: r[2]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["anchor", "whole", "many", "i", "j"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= BLOCK and row[0] != waiting[-1][0]:
                    yield from solve()
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[3]) + 1
        if waiting:
            yield from solve()

    calm = bits.where(F.col("kinds") <= KINDS).select("anchor", "whole", "many", "bytes")
    found = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(expand, "anchor long, whole long, many int, i int, j int")
    more = bits.where(F.col("kinds") > KINDS).select("anchor", "whole", "many", "bytes")
    if more.isEmpty():
        return found, []
    width = -(-width // 2)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(3))
            many = batch.column(2).to_numpy()
            for a, b in slices(offsets, 1 << 20):
                start = offsets[a : b + 1] - offsets[a]
                block = data[offsets[a] : offsets[b]]
                seg, i, size, group = parts(block, start, many[a:b], length, width)
                raw, lo, hi = block.tobytes(), start[seg] + i, start[seg] + i + size + length - 1
                own = digests(raw, lo, hi)
                cut = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                ids = [batch.column(k).take(pa.array(seg + a)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(own.view(np.int64)), pa.array(size.astype(np.int32)), *ids, pa.array(i.astype(np.int32)), cut], ["anchor", "whole", "many", "of_anchor", "of_whole", "of_many", "from", "bytes"])

    piece = staged(more.mapInArrow(split, "anchor long, whole long, many int, of_anchor long, of_whole long, of_many int, from int, bytes binary"), "segment-parts")
    kinds = staged(piece.groupBy("anchor", "whole", "many").agg(F.count(F.lit(1)).alias("n"), F.any_value("bytes").alias("bytes")), "part-kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    below = staged(kinds.join(several, "anchor").select("anchor", "whole", "many", "kinds", "bytes"), "part-bytes")
    hits, used = all_hits(kinds, below, length, width)
    back = piece.drop("bytes").join(hits, ["anchor", "whole", "many"])
    back = back.select(F.col("of_anchor").alias("anchor"), F.col("of_whole").alias("whole"), F.col("of_many").alias("many"), (F.col("from") + F.col("i")).alias("i"), (F.col("from") + F.col("j")).alias("j"))
    return found.union(back), [piece, kinds, below, *used]


def all_hits(kinds: DataFrame, bits: DataFrame, length: int, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """As ``expanded``, for all segments (anchor, whole, many, n): those that stand ``n > 1`` times repeat as a whole."""
    found, used = expanded(bits, length, width)
    copies = kinds.where("n > 1").select("anchor", "whole", "many", F.lit(0).alias("i"), F.col("many").alias("j"))
    return copies.union(found.join(kinds.where("n = 1").select("anchor", "whole", "many"), ["anchor", "whole", "many"])), used


def merged(ranges: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi), one row a document: its ranges as two arrays, overlapping and touching ones joined within each
    ``SPAN`` bytes before they are collected."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for item in batch.column(2):
                lo, hi = (item.values.field(c).to_numpy() for c in (0, 1))
                order = np.argsort(lo)
                lo, far = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > far[:-1])))
                out.append((lo[new], far[np.append(new[1:], len(lo)) - 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (0, 1))], ["doc_id", "th", "lo", "hi"])

    near = ranges.groupBy("doc_id", "th", F.expr(f"lo div {SPAN}").alias("span")).agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    near = near.select("doc_id", "th", "r").mapInArrow(run, "doc_id long, th long, lo array<long>, hi array<long>")
    return near.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("doc_id", "th", F.flatten("r.lo").alias("lo"), F.flatten("r.hi").alias("hi"))


def removed_ranges(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, th, lo, hi): byte ranges of each document that strings of ``length`` bytes with another start cover."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets, 1 << 20):
                row, lo, many, anchor, whole = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                at, times = stretches(row, lo, many, anchor, whole)
                take = pa.array(row[at] + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(lo[at].astype(np.int64)), pa.array(many[at].astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(anchor[at].view(np.int64)), pa.array(whole[at].view(np.int64))], ["doc_id", "th", "lo", "many", "times", "anchor", "whole"])

    seg = staged(keyed(docs).select("doc_id", "th", "text").mapInArrow(cut, "doc_id long, th long, lo long, many int, times int, anchor long, whole long"), "segments")
    shared = staged(seg.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")
    cut_all, seg = seg, staged(seg.join(shared, "anchor"), "shared-segments")
    discard(cut_all)

    kinds = seg.groupBy("anchor", "whole", "many").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("at"))
    kinds = staged(kinds, "segment-kinds")
    several = staged(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-anchors")
    mixed = kinds.join(several, "anchor").select("anchor", "whole", "many", "n", "kinds", F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"), F.col("at.lo").alias("lo"))
    per_doc = mixed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "whole", "many", "kinds", "lo")).alias("cuts"))
    d = _zipped(keyed(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "th"]))
    held = d.join(per_doc, same_row(d, per_doc)).select("zip", "cuts")

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for raw, cuts in zip(batch.column(0), batch.column(1), strict=True):
                text = z.decompress(raw.as_py()) if len(raw.as_buffer()) else b""
                for c in cuts.as_py():
                    rows.append((c["anchor"], c["whole"], c["many"], c["kinds"], text[c["lo"] : c["lo"] + c["many"] + length - 1]))
                    held += len(rows[-1][4])
                if held > 1 << 21:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    def pack(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["anchor", "whole", "many", "kinds", "bytes"])

    bits = staged(held.mapInArrow(fetch, "anchor long, whole long, many int, kinds long, bytes binary"), "segment-bytes")

    hits, used = all_hits(kinds, bits, length, length - GRAM + 1)
    hits = staged(hits, "hits")
    discard(bits, kinds, several, shared, *used)
    # a segment that stands several times in a row repeats as a whole
    out = seg.join(hits, ["anchor", "whole", "many"])
    out = out.select("doc_id", "th", (F.col("lo") + F.col("i")).alias("lo"), (F.col("lo") + (F.col("times") - 1) * F.col("many") + F.col("j") + (length - 1)).alias("hi"))
    out = staged(out, "repeated-ranges")
    discard(seg, hits)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, rest) of each row: ``kept`` are the bytes that no repeated string covers,
    ``rest`` is a struct of the other columns. With ``whole_characters`` what is left of a cut character goes as well.

    Strings are judged on the input: every byte in a string of ``length`` bytes that also starts elsewhere in the table,
    the same row included, goes. A null text is empty. Rows that are equal in id and text repeat each other. An
    empty table gives no rows.
    """
    gone = merged(removed_ranges(docs, length))
    d = _zipped(keyed(docs))
    full = d.join(gone, same_row(d, gone), "left").select(d["doc_id"], "zip", "rest", "lo", "hi")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard as z

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                out: list[tuple] = []
                held, start = 0, at
                while at < batch.num_rows and held < 1 << 22:
                    raw = batch.column(1)[at].as_py()
                    text = z.decompress(raw)
                    lo, hi = batch.column(3)[at].values, batch.column(4)[at].values
                    if lo is None or not len(lo):
                        out.append((len(text), 0, 0, text))
                    else:
                        edge = np.zeros(len(text) + 1, np.int32)
                        np.add.at(edge, lo.to_numpy(), 1)
                        np.add.at(edge, hi.to_numpy(), -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                        kept = kept.decode("utf-8", "ignore").encode() if whole_characters else kept
                        out.append((len(text), int(covered.sum()), len(runs(covered)), kept))
                    held += len(text)
                    at += 1
                cols = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *(pa.array(c, k) for c, k in cols), batch.column(2).slice(start, at - start)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    return full.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, rest {d.schema['rest'].dataType.simpleString()}")
