"""SentencePiece encoding and decoding by suffix-array matching.

The different chunks of a batch (a space mark and what follows up to the next) are joined into one text; no piece of the
vocabulary crosses from a chunk into the next. A suffix array of that text, sorted to the length of the longest piece, is
binary-searched for every piece at once; each range of the array is all occurrences of a piece. The occurrences are edges
of a lattice over the text. They are sorted by position and relaxed from left to right, all chunks in step: a place's last
piece is the one that may follow the last piece of the place where it starts.

Two pieces may follow each other if encoding both together gives the two. For merges by rank, which this model kind does,
a sequence is the encoding exactly when all its neighbours may follow each other, so that piece is unique. Characters
that no piece has become byte pieces, or the unknown piece.

Encoded chunks are kept in a bounded table of the worker. Texts are encoded whole, in one narrow pass.

Defined results: null or empty text has no ids; the space mark itself in a text reads as a space after decoding, as in the
library; repeated rows and null ids give a row each; other columns are kept; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_END, _OTHER = 0, 1
#: Entries of each of a worker's two tables of chunks, and characters of a chunk that they keep. When the newer is full it
#: becomes the older, from which what is met again moves up.
TABLE_ENTRIES, CHUNK_CHARS = 250_000, 48


class Model:
    """A merge-by-rank SentencePiece model and its matcher."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in normal}
        self.rank = {self.piece[i]: -sp.get_score(i) for i in normal}
        self.unknown = sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(i != self.unknown for i in self.bytes)
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.has_bytes else {}
        self.is_byte = np.isin(np.arange(n), list(self.byte_of))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of this model cross chunks")
        letters = sorted({c for p in self.id for c in p})
        self.code = np.full(max(map(ord, letters)) + 2, _OTHER, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.longest = max(map(len, self.id))
        self.texts = sorted(self.id)
        width = self.longest
        keys = np.zeros((len(self.texts), width), np.uint32)
        for row, p in zip(keys, self.texts):
            row[: len(p)] = self.code[[ord(c) for c in p]]
        self.low = keys.copy().view(f"U{width}").ravel()
        self.size = np.array([len(p) for p in self.texts], np.int64)
        keys[np.arange(len(keys)), np.minimum(self.size, width - 1)] = np.where(self.size < width, 0x10FFFF, keys[:, -1])
        self.high = keys.view(f"U{width}").ravel()
        self.number = np.array([self.id[p] for p in self.texts], np.int64)
        self.follows: dict[int, bool] = {}
        self.stories: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def story(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How a piece comes about: the rank of each of its merges in turn (then infinity), and its first and last parts
        before each. Merges go by rank, leftmost first."""
        if piece not in self.stories:
            parts, ranks, firsts, lasts = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                rank, i = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                ranks.append(rank)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.stories[piece] = [*ranks, np.inf], firsts, lasts
        return self.stories[piece]

    def stay_apart(self, one: str, two: str) -> bool:
        """Whether merging both texts together never joins across their border."""
        (left, _, lasts), (right, firsts, _) = self.story(one), self.story(two)
        i = j = 0
        while True:
            across = self.rank.get(lasts[i] + firsts[j], np.inf)
            if across < left[i] and across <= right[j]:
                return False
            if left[i] == right[j] == np.inf:
                return True
            if left[i] <= right[j]:
                i += 1
            else:
                j += 1

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a, for each a * 2^32 + b; an unknown character goes with everything."""
        different, back = np.unique(pairs, return_inverse=True)
        told = different.tolist()
        if len(self.follows) > 600_000:
            self.follows.clear()
        for x in set(told).difference(self.follows):
            self.follows[x] = self.stay_apart(self.piece[x >> 32], self.piece[x & 0xFFFFFFFF])
        return np.array([*map(self.follows.__getitem__, told)], bool)[back]

    def _suffixes(self, codes: np.ndarray) -> np.ndarray:
        """The suffix array of the codes, by prefix doubling up to the longest piece, from as many codes as a key holds."""
        n, base, step = len(codes), int(self.code.max()) + 2, 1
        key = codes.copy()
        while step < self.longest and base ** (2 * step) < 1 << 62:
            second = np.zeros(n, np.int64)
            second[: max(0, n - step)] = key[step:]
            key, step = key * base**step + second, step * 2
        order = np.argsort(key)
        while step < self.longest:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            second = np.zeros(n, np.int64)
            second[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key)
            step *= 2
        return order

    def match(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as little-endian 32-bit integers."""
        joined = np.frombuffer("\0".join(chunks).encode("utf-32-le") + b"\0\0\0\0", np.uint32).astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        first = np.cumsum(size + 1) - size - 1
        codes = np.where(joined < len(self.code), self.code[np.minimum(joined, len(self.code) - 1)], _OTHER)
        codes[first + size] = _END
        n = len(codes)
        order = self._suffixes(codes)
        padded = np.append(codes, np.zeros(self.longest, np.int64)).astype(np.uint32)
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[:n][order]).view(f"U{self.longest}").ravel()
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        del keys, padded
        times = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(times)), times)
        place = order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        other = np.flatnonzero(codes == _OTHER)  # characters that no piece has: edges of their own
        start, end = np.append(place, other), np.append(place + self.size[which], other + 1)
        number = np.append(self.number[which], np.full(len(other), self.unknown))

        chunk = np.repeat(np.arange(len(chunks)), size + 1)
        step = end - first[chunk[start]]
        by = np.argsort(step * n + start)
        start, end, number, step = start[by], end[by], number[by], step[by]
        last = np.full(n + 1, -1, np.int64)  # the last piece of the text up to here; -2 at the start of a chunk
        last[first] = -2
        came = np.zeros(n + 1, np.int64)
        cuts = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            s, e, p = start[a:b], end[a:b], number[a:b]
            before = last[s]
            ok = before == -2
            ask = np.flatnonzero((before >= 0) & (before != self.unknown) & (p != self.unknown))
            ok[ask] = self.may_follow((before[ask] << 32) | p[ask])
            ok |= (before >= 0) & ((before == self.unknown) | (p == self.unknown))
            last[e[ok]], came[e[ok]] = p[ok], s[ok]
        # Back from the ends, all chunks in step.
        number_of, pieces, at, open_ = [], [], first + size, np.arange(len(chunks))
        while len(open_):
            piece = last[at]
            if (piece < 0).any():
                raise AssertionError("no piece ends here")
            number_of.append(open_)
            pieces.append(piece)
            at = came[at]
            go = at > first[open_]
            at, open_ = at[go], open_[go]
        which, ids = np.concatenate(number_of)[::-1], np.concatenate(pieces)[::-1]
        by = np.argsort(which * len(which) + np.arange(len(which)))
        ids = ids[by].astype("<u4")
        raw, ends = ids.tobytes(), (4 * np.cumsum(np.bincount(which, minlength=len(chunks)))).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if self.has_bytes:
            for i in np.unique(which[by][ids == self.unknown]).tolist():  # the bytes of each unknown character, in order
                strange = iter([c for c in chunks[i] if ord(c) >= len(self.code) or self.code[ord(c)] == _OTHER])
                out[i] = np.array([x for p in np.frombuffer(out[i], "<u4").tolist() for x in ([self.bytes[y] for y in next(strange).encode("utf-8", "surrogatepass")] if p == self.unknown else [p])], "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [_CHUNK.findall(self.library.normalize(t)) if t else [] for t in texts]
        if len(self.known) > TABLE_ENTRIES:
            self.known, self.older = {}, self.known
        new = set(chain.from_iterable(split)).difference(self.known)
        self.known.update((c, self.older[c]) for c in new.intersection(self.older))
        new.difference_update(self.older)
        fresh: dict[str, bytes] = {}
        block, chars = [], 0
        for c in [*new, None]:
            if block and (c is None or chars + len(c) > 400_000):
                fresh.update(zip(block, self.match(block)))
                block, chars = [], 0
            if c is not None:
                block.append(c)
                chars += len(c)
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= CHUNK_CHARS)
        long = {c: ids for c, ids in fresh.items() if len(c) > CHUNK_CHARS}
        return [b"".join([long[c] if c in long else self.known[c] for c in s]) if long else b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, as the library gives it."""
        if not len(ids):
            return ""
        if not self.is_byte[ids].any():
            text = "".join(map(self.piece.__getitem__, ids.tolist()))
        else:
            parts, raw = [], bytearray()
            for i in [*ids.tolist(), -1]:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                if i >= 0:
                    parts.append(self.piece[i])
            text = "".join(parts)
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each text, array<int>, and in decoded_col, if named, the text that these ids give back, in the
    same pass. model: path of the model file, readable on every executor. Null and empty texts have no ids and decode to
    empty; columns of docs under the names of the new ones are replaced; repeated rows each stay; empty input gives no rows."""
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    rows = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    docs = docs.drop(*new)
    rows = rows.drop(*new)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{ids_col}` array<int>", *(f"`{c}` string" for c in new[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = m.encode(part.column("__text").to_pylist())
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))]
                if decoded_col:
                    made.append(pa.array([m.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, *new])

    return rows.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids."""
    rows = rows.drop(text_col)
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(ids_col)
                flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                at = at - at[0]
                texts = pa.array([m.decode(flat[x:y]) for x, y in zip(at, at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), texts], names=[*names, text_col])

    return rows.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text encoded and decoded again in one pass: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit
    integers), n_chars and decoded_md5 of the decoded text, and round_trip (whether it is the text itself)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = ["doc_id", "n_ids", "ids_crc32", "n_chars", "decoded_md5", "round_trip"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for part in slices(batch, "text"):
                found: list[tuple] = []
                texts = part.column("text").to_pylist()
                for text, ids in zip(texts, m.encode(texts)):
                    decoded = m.decode(np.frombuffer(ids, "<u4"))
                    found.append((len(ids) // 4, zlib.crc32(ids), len(decoded), hashlib.md5(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == text))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*found), types))], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, n_chars long, decoded_md5 string, round_trip boolean")
