"""Operators 8 and 10: power-of-two packing, and Unigram encoding over a double-array trie."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, dense_index, staged

CACHE = 700_000  # words that a Python worker remembers at most

# --- operator 8 -------------------------------------------------------------------------------------------------------

#: The byte-to-character table of byte-level BPE keeps these ranges and moves the other bytes to U+0100 on.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_chars() -> dict[int, str]:
    moved = [b for b in range(256) if b not in set(_KEPT)]
    return {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordIds(dict):
    """Ids, as little-endian uint32 bytes, of a word without ASCII white space; new words go through the tokenizer.

    The vocabulary drops white space, never joins tokens across it, and none of its added tokens holds any, so a text's
    ids are its words' ids in a row. A string that is an added token's is that token, as the tokenizer has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.chars = _byte_chars()
        self.marks: dict[str, bytes] = {"": b""}

    def part(self, text: str) -> bytes:
        """Ids of one pre-token; printable ASCII stands for itself in byte-level BPE."""
        text = text if text.isascii() else "".join(map(self.chars.__getitem__, text.encode()))
        return array("I", [t.id for t in self.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(".,;:!?|")
        # one run of Latin letters, then one run of marks: two pre-tokens, unchanged by NFC, that need no regex
        if core.isalpha() and (core.isascii() or max(core) < "ɐ" and "İ" not in core and unicodedata.is_normalized("NFC", core)):
            tail = text[len(core) :]
            if tail not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[tail] = self.part(tail)
            out = self.part(core.lower()) + self.marks[tail]
        else:
            out = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE:
            self[word] = out
        return out


_WORDS: dict[str, WordIds] = {}


def piece_lengths(n: int, limit: int) -> list[int]:
    """``n`` as whole pieces of ``limit`` (a power of two) and the binary digits of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1) if rest >> k & 1]


def split_documents(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2) -> DataFrame:
    """Each document's ids (with ``end_id`` behind them) cut into pieces of power-of-two length, one row per piece.

    Returns doc_id, start, length, doc_tokens and ids (binary, little-endian uint32). The ids are those of the tokenizer
    with add_special_tokens=False: a string in the text that spells an added token is that token. A null or empty text
    has the end id alone. Rows that are equal in id and text, or in id alone, have each their own pieces, and so do rows
    without id. Other columns of ``docs`` are dropped; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])

            def out(rows):
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                ids = b"".join(map(words.__getitem__, raw.encode().split())) + end if raw else end
                n, at = len(ids) // 4, 0
                for k in piece_lengths(n, limit):
                    for column, value in zip(rows, (doc, at, k, n, ids[4 * at : 4 * (at + k)]), strict=True):
                        column.append(value)
                    at += k
                held += len(ids)
                if held > 1 << 23:
                    yield out(rows)
                    rows, held = ([], [], [], [], []), 0
            if rows[0]:
                yield out(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, keep_ids: bool = True, gapless: bool = True) -> DataFrame:
    """Power-of-two packing: every piece is a sequence of its own, and sequences of equal length form one bucket.

    Adds sequence_id, offset (always 0), bucket (log2 of the length) and ids_crc32 to ``split_documents``. No sequence
    crosses documents, and none is padded. sequence_id is gapless over all pieces, in order of bucket, for which the
    pieces are staged; else it is unique and follows the layout of the input. Pieces of equal rows tie in that order, and
    which of them comes first is of no account, for they are equal.
    """
    pieces = split_documents(docs, tokenizer, limit, end_id).withColumn("ids_crc32", F.crc32("ids"))
    pieces = pieces if keep_ids else pieces.drop("ids")
    bucket = F.log2(F.col("length")).cast("int")
    if not gapless:
        return pieces.withColumns({"bucket": bucket, "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = staged(pieces, "pieces")
    cells = 1 << 8
    cell = bucket * cells + F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int")
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    return dense_index(pieces.withColumn("bucket", bucket), cell, order, "sequence_id", cells * 64).withColumn("offset", F.lit(0).cast("long"))


# --- operator 10 ------------------------------------------------------------------------------------------------------

SPACE = "▁".encode()  # the white-space marker


class DoubleArray:
    """A double-array trie over byte strings: state s goes to base[s] + byte + 1 if check there is s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, v in keys.items():
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                at = children[at][b]
            ends[at] = v
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        first, stack = 1, [(0, 0)]
        while stack:
            node, slot = stack.pop()
            value[slot] = ends.get(node, -1)
            labels = sorted(children[node])
            if not labels:
                continue
            while used[first]:
                first += 1
            at = first
            while used[at] or any(used[at + c - labels[0]] for c in labels[1:]):
                at += 1
            base[slot] = at - labels[0] - 1
            for c in labels:
                t = base[slot] + c + 1
                used[t], check[t] = 1, slot
                stack.append((children[node][c], t))
        return cls(base, check, value)

    def find(self, key: bytes) -> int:
        s = 0
        for b in key:
            t = int(self.base[s]) + b + 1
            if not 0 <= t < len(self.check) or self.check[t] != s:
                return -1
            s = t
        return int(self.value[s])


class Unigram:
    """Pieces with log scores: best segmentation by Viterbi, byte fallback for characters that no piece covers."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int], penalty: float = 10.0):
        """``byte_ids`` holds the id of each byte's piece; pieces in ``skip`` (control, unknown, bytes) never match a text."""
        self.pieces, self.byte_ids = pieces, byte_ids
        keys = {p.encode(): i for i, p in enumerate(pieces) if i not in skip}
        self.trie = DoubleArray.build(keys)
        self.scores = np.array(scores)
        self.unknown = min(scores[i] for i in keys.values()) - penalty
        self.longest = max(map(len, keys))
        inner = {c for k in keys if len(k.decode()) > 1 for c in k.decode()}
        joined = any("▁" in k.decode().lstrip("▁") for k in keys)
        #: no piece goes on past a character, then a marker: texts may be cut before runs of markers
        self.cuts = not joined
        #: no longer piece holds this character: texts may be cut around it
        self.lone = "\n" if "\n" not in inner else None
        self.raw = [bytes([byte_ids.index(i)]) if i in set(byte_ids) else p.encode().replace(SPACE, b" ") for i, p in enumerate(pieces)]

    @classmethod
    def load(cls, path: str) -> Unigram:
        """Pieces of a SentencePiece model file, with the log scores that the file states."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        scores = [0.0 if i in skip else sp.get_score(i) for i in range(n)]
        return cls([sp.id_to_piece(i) for i in range(n)], scores, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], skip)

    def encode_many(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each marker-encoded chunk. All chunks advance together, one start byte at a time."""
        if not chunks:
            return []
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(chunks)
        i = 0
        while i < len(order):  # blocks of like length, of bounded size
            top, j = len(chunks[order[i]]), i
            while j < len(order) and (len(chunks[order[j]]) <= top + 4 and (j - i) * (top + 4) < 1 << 21 or j == i):
                j += 1
            block = order[i:j]
            for k, ids in zip(block, self._viterbi([chunks[k] for k in block]), strict=True):
                out[k] = ids
            i = j
        return out

    def _viterbi(self, chunks: list[bytes]) -> list[np.ndarray]:
        t, n = self.trie, len(chunks)
        lens = np.array([len(c) for c in chunks])
        width = int(lens.max(initial=0))
        text = np.zeros((n, width + 1), np.int32)
        for r, c in enumerate(chunks):
            text[r, : len(c)] = np.frombuffer(c, np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        step = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for at in range(width):
            rows = np.flatnonzero((at < lens) & (best[:, at] > -np.inf))
            if not len(rows):
                continue
            here = best[rows, at]
            lead = text[rows, at]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for k in range(1, min(self.longest, width - at) + 1):
                go = t.base[state] + text[rows[live], at + k - 1] + 1
                ok = (at + k <= lens[rows[live]]) & (go < len(t.check))
                ok[ok] = t.check[go[ok]] == state[ok]
                live, state = live[ok], go[ok]
                if not len(live):
                    break
                ended = t.value[state] >= 0
                hit, ids = live[ended], t.value[state[ended]]
                if not len(hit):
                    continue
                single[hit[size[hit] == k]] = True
                r, total = rows[hit], here[hit] + self.scores[ids]
                better = total > best[r, at + k]
                r, total, ids = r[better], total[better], ids[better]
                best[r, at + k], step[r, at + k], piece[r, at + k] = total, k, ids
            miss = np.flatnonzero(~single)  # the character itself is no piece: bytes, at the unknown score
            to, total = at + size[miss], here[miss] + self.unknown
            r = rows[miss]
            ok = to <= lens[r]
            r, to, total, sz = r[ok], to[ok], total[ok], size[miss][ok]
            better = total > best[r, to]
            best[r[better], to[better]], step[r[better], to[better]], piece[r[better], to[better]] = total[better], sz[better], -1
        out = []
        for r, c in enumerate(chunks):
            ids, at = [], len(c)
            s, p = step[r], piece[r]
            while at > 0:
                k = int(s[at])
                ids += [int(p[at])] if p[at] >= 0 else [self.byte_ids[b] for b in c[at - k : at][::-1]]
                at -= k
            out.append(np.array(ids[::-1], np.uint32))
        return out

    def chunks(self, text: str) -> list[bytes]:
        """The marker-encoded text, cut where no piece can cross. A marker is put in front, as SentencePiece does."""
        if not text:
            return []
        marked = SPACE + text.encode().replace(b" ", SPACE)
        if not self.cuts:
            return [marked]
        if b"\n" in marked and self.lone:
            marked = marked.replace(b"\n", b"\x00\n\x00") if b"\x00" not in marked else marked
        if SPACE + SPACE in marked or b"\x00" in marked:
            parts = [marked] if b"\x00" in text.encode() else [p for p in marked.split(b"\x00") if p]
            return [c for p in parts for c in _CHUNK.findall(p)]
        return [SPACE + w for w in marked.split(SPACE)[1:]]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces become bytes, markers become spaces, the leading one goes."""
        raw = b"".join(self.raw[i] for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CHUNK = re.compile(rb"(?:\xe2\x96\x81)+(?:(?!\xe2\x96\x81)[\x00-\xff])*|(?:(?!\xe2\x96\x81)[\x00-\xff])+")
_MODELS: dict[str, tuple[Unigram, dict]] = {}


def unigram_encode(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns doc_id, n_pieces, n_byte_pieces, ids_crc32 (of the little-endian uint32 ids), round_trip (the ids decode to
    the text) and, if asked for, ids. A null text has no ids and round_trip null, an empty one no ids and round_trip true. A
    text with the marker character itself decodes to spaces there, as in SentencePiece; round_trip then compares with that.
    Rows are apart: repeated rows and null ids give a row each, other columns take no part, and an empty table gives no rows.
    Chunks end at spaces, and line ends where these stand alone in the vocabulary; one chunk is one path in one task, linear in
    its length (about 4 s for 20,000 characters without a space), so a text of a megabyte without spaces takes minutes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if model not in _MODELS:
            _MODELS[model] = (Unigram.load(model), {})
        uni, known = _MODELS[model]
        low, high = min(uni.byte_ids), max(uni.byte_ids)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            ends = buffers(texts)[1]
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 22), "right")) - 1)
                part = texts.slice(at, to - at).to_pylist()
                cut = [uni.chunks(t) if t else [] for t in part]
                new = list({c for cs in cut for c in cs if c not in known})
                fresh = {c: (ids.astype("<u4").tobytes(), b"".join([uni.raw[i] for i in ids.tolist()]), int(((ids >= low) & (ids <= high)).sum())) for c, ids in zip(new, uni.encode_many(new), strict=True)}
                if len(known) + len(fresh) <= CACHE // 2:
                    known.update(fresh)
                    find = known.__getitem__
                else:
                    find = lambda c: known.get(c) or fresh[c]
                rows = []
                for text, cs in zip(part, cut, strict=True):
                    got = list(map(find, cs))
                    ids = b"".join([g[0] for g in got])
                    back = b"".join([g[1] for g in got])
                    rows.append((len(ids) // 4, sum([g[2] for g in got]), zlib.crc32(ids), None if text is None else back[1:] == text.encode().replace(SPACE, b" "), ids if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([docs_.slice(at, to - at), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True))], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip", "ids"])
                at = to

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean, ids binary")
    return out if keep_ids else out.drop("ids")
