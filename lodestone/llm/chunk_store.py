"""A content-addressed store of token ids.

Texts are encoded; a rolling hash over the ids cuts each document's stream into chunks at places that depend on the
ids near by alone, so that equal passages give equal chunks. Each chunk is stored once, under the digest of its
bytes. A document is a recipe: its chunks' digests in order, with their Merkle root. Recipes are written in ascending
order of the documents' ids, in files that each have a Merkle manifest of their recipes' roots.

Layout below one folder, all Parquet:
  chunks/   digest, data (ids as little-endian unsigned 16- or 32-bit integers), ordered by digest in each file
  recipes/  row kind 0: a document's recipe with the ids before it in its file; row kind 1: the file's manifest; each
            with the bytes of an id (width)

What moves: each task drops the chunks that it has seen, then chunks are dealt by digest once; recipes, a few hundredths
of that, are dealt by range of id once. Reading back moves only digests, lengths and checksums: checksums of chunks
are combined to those of documents by polynomial arithmetic. No group is gathered in one task.

Reading verifies: each chunk's bytes by its digest, each recipe's digests by its root, each file's roots, in order and
all there, by its manifest.

Defined results: null text is the empty text, whose stream is the end id alone; rows with equal or null ids are all
kept, nulls first, equal ids in the order of their Merkle roots; repeated rows share all their chunks; texts of any
length are encoded whole; an empty table gives an empty store. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import byte_letters, spread, tokenizer_path
from lodestone.llm.common import distinct_spans, eight_bytes, map_columns, mix, table, unit_bounds
from lodestone.session import shared_path, ship

#: A cut follows where these bits of the rolling hash are 0: one in 512. No chunk but a document's last is shorter than LEAST; none is longer than MOST.
BITS, LEAST, MOST, WINDOW = 9, 128, 4096, 16
#: Characters of text encoded at a time, and units of text remembered by a worker (emptied when full).
BYTES, MEMORY = 2_000_000, 1_000_000
#: Spans looked up and pieces encoded at a time.
BLOCK = 16_384
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pieces of units in lines; a line's end is one by itself.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+|\n| ?[^ \n{_LETTER}{_NUMBER}]+")
#: White space that is neither a blank nor a line break: what str.isspace() knows, which is more than the splitting knows.
_RARE_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE = _RARE_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GEAR = mix(np.arange(1, 65537, dtype=np.uint64))
_ODD_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def all_cuts(ids: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of the streams of ids that lie end to end and stop at these places, from each stream's start."""
    h = _GEAR[ids & 0xFFFF]
    k = 1
    with np.errstate(over="ignore"):
        while k < WINDOW:  # sums over 2k ids from those over k
            h[k:] += h[:-k] << np.uint64(k)
            k *= 2
    # the sum's top bits depend on all of the window; where it reaches into the stream before, LEAST allows no cut
    found = np.flatnonzero((mix(h) >> np.uint64(64 - BITS)) == 0) + 1
    upto, found, out, begin, a = np.searchsorted(found, stops, "right").tolist(), found.tolist(), [], 0, 0
    for stop, b in zip(stops.tolist(), upto, strict=True):
        ends, last, n = [], 0, stop - begin
        for c in found[a:b]:
            c -= begin
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
        begin, a = stop, b
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests; a level's odd last one moves up; of none, the digest of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()[:16]
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest()[:16] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Roots:
    """A Merkle root over leaves that come one at a time; as merkle(), a level's odd last one moves up."""

    def __init__(self) -> None:
        self.done: list[tuple[int, bytes]] = []  # heights and roots of the subtrees that are complete

    def add(self, leaf: bytes) -> None:
        self.done.append((0, leaf))
        while len(self.done) > 1 and self.done[-1][0] == self.done[-2][0]:
            (h, b), (_, a) = self.done.pop(), self.done.pop()
            self.done.append((h + 1, hashlib.sha256(a + b).digest()[:16]))

    def root(self) -> bytes | None:
        """None without leaves."""
        if not self.done:
            return None
        root = self.done[-1][1]
        for _, left in self.done[-2::-1]:
            root = hashlib.sha256(left + root).digest()[:16]
        return root


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n entries."""
    if len(a) >= n:
        return a
    more = np.empty((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
    more[: len(a)] = a
    return more


class Units:
    """Numbers of byte spans, many looked up at a time: those of up to 16 bytes in an open table, longer ones in a dictionary.

    Bytes are compared, so hashes decide nothing; they are salted, so that no text is made to crowd the table.
    """

    def __init__(self) -> None:
        self.salt = np.uint64(secrets.randbits(64))
        self.n, self.key = 0, np.empty((1 << 12, 3), np.uint64)  # the bytes as two numbers, and how many they are
        self.slot, self.long = np.full(1 << 14, -1, np.int32), {}

    def _at(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix((key[:, 0] ^ mix(key[:, 1] + key[:, 2] * _ODD_FACTOR + self.salt)) * _ODD_FACTOR)
        return (h & np.uint64(len(self.slot) - 1)).astype(np.int64)

    @staticmethod
    def keys(u: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first 16 bytes of spans and their lengths; u: the eight bytes from each place on."""
        size, key = end - start, np.empty((len(start), 3), np.uint64)
        key[:, 0] = u[start] & _LOW[np.minimum(size, 8)]
        key[:, 1] = u[np.minimum(start + 8, len(u) - 1)] & _LOW[np.clip(size - 8, 0, 8)]
        key[:, 2] = size
        return key

    def find(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each span's number, -1 where it has none."""
        out, u = np.full(len(start), -1, np.int64), eight_bytes(np.frombuffer(data, np.uint8))
        for k in range(0, len(start), BLOCK):
            key = self.keys(u, start[k : k + BLOCK], end[k : k + BLOCK])
            row, live = out[k : k + BLOCK], np.flatnonzero(key[:, 2] <= 16)
            key = key[live]
            at = self._at(key)
            while len(live):
                r = self.slot[at]
                known = np.take(self.key, r, 0, mode="clip")
                same = (known[:, 0] == key[:, 0]) & (known[:, 1] == key[:, 1]) & (known[:, 2] == key[:, 2])
                row[live] = np.where(same, r, -1)
                more = ~same & (r >= 0)
                live, at, key = live[more], (at[more] + 1) & (len(self.slot) - 1), key[more]
        for k in np.flatnonzero(end - start > 16).tolist():
            out[k] = self.long.get(data[start[k] : end[k]], -1)
        return out

    def add(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers for spans that are distinct and have none."""
        rows = self.n + np.arange(len(start))
        self.n += len(rows)
        self.key = _grown(self.key, self.n)
        self.key[rows] = self.keys(eight_bytes(np.frombuffer(data, np.uint8)), start, end)
        for k in np.flatnonzero(end - start > 16).tolist():
            self.long[data[start[k] : end[k]]] = int(rows[k])
        if 2 * self.n > len(self.slot):
            self.slot = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(rows)
        return rows

    def _place(self, rows: np.ndarray) -> None:
        rows = rows[self.key[rows, 2] <= 16]
        at = self._at(self.key[rows])
        while len(rows):
            free = self.slot[at] < 0
            self.slot[at[free]] = rows[free]
            lost = self.slot[at] != rows
            rows, at = rows[lost], (at[lost] + 1) & (len(self.slot) - 1)


class Encoder:
    """The library's encoding of whole texts, through a memory of units.

    In the byte-level splitting no piece spans a place where a blank or a line break stands alone between other
    characters; there a text is taken apart into units, which the library encodes once. A text with other white
    space is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.letters = np.array([ord(c) for c in byte_letters()], "<u4")
        self.letters[10] = 10  # stands between pieces, and in none
        self.newline = np.array(self.lib.encode("\n", add_special_tokens=False).ids, np.uint32)
        self._forget()

    def _forget(self) -> None:
        """No unit is known: a unit's number r would give its ids, flat[at[r]:][:many[r]]."""
        self.units = Units()
        self.flat, self.used = self.newline.copy(), len(self.newline)
        self.at, self.many = np.zeros(1, np.int64), np.array([len(self.newline)])
        self.units.add(b"\n", np.zeros(1, np.int64), np.ones(1, np.int64))  # 0 is the line break

    @staticmethod
    def _plain(t: str) -> bool:
        if "  " in t or "\n" in t and ("\n\n" in t or " \n" in t or "\n " in t) or t[0].isspace() or t[-1].isspace():
            return False
        for c in _RARE_ASCII if t.isascii() else _RARE:
            if c in t:
                return False
        return True

    def _tokenize(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids end to end, and how many each has; a block at a time, for the library's tokens are large."""
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), BLOCK):
            tokens = list(map(self.lib.model.tokenize, pieces[at : at + BLOCK]))
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), np.uint32))
            count.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        return np.concatenate(ids), np.concatenate(count)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids end to end, and how many each has.

        Of units of Latin letters, digits and ASCII signs the pieces go to the library's model; it splits the others too.
        """
        lines = b"\n".join(units) + b"\n"
        b = np.frombuffer(lines, np.uint8)
        after = np.append(b[1:], np.uint8(0))
        odd = (b < 32) & (b != 10) | (b == 127) | (b >= 0xCA) | (b == 0xC9) & (after >= 0x90) | (b == 0xC2) & (after <= 0xA0) | (b == 60) & (after == 124)
        other = np.unique(np.searchsorted(np.flatnonzero(b == 10), np.flatnonzero(odd))).tolist()
        got: list = []
        if other:
            texts = [units[k].decode("utf-8", "surrogatepass") for k in other]
            got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
            lines = b"\n".join([b"" if k else u for k, u in zip(np.isin(np.arange(len(units)), other).tolist(), units, strict=True)]) + b"\n"
        pieces = _PIECE.findall(lines.decode())
        last = np.array([p == "\n" for p in pieces])
        letters = self.letters[np.frombuffer("\n".join([p for p in pieces if p != "\n"]).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids, count = self._tokenize(letters.split("\n") if letters else [])
        upto = np.concatenate([[0], np.cumsum(count)])[np.cumsum(~last)[last]]  # ids of the pieces before each line's end
        many = np.diff(upto, prepend=0)
        if other:
            at = np.cumsum(many)[other]
            size = np.array([len(x) for x in got], np.int64)
            ids = np.insert(ids, np.repeat(at, size), np.fromiter(chain.from_iterable(got), np.uint32, size.sum()))
            many[other] = size
        return ids, many

    def _by_units(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\r".join(parts)
        b = np.frombuffer(data, np.uint8)
        start, end = unit_bounds(b)
        before = b[np.maximum(start - 1, 0)]
        blank, line = (before == 32) & (start > 0), (before == 10) & (start > 0)
        begin = start - blank  # a blank before it is part of a unit
        row = self.units.find(data, begin, end)
        if len(new := np.flatnonzero(row < 0)):
            first, inverse = distinct_spans(b, begin[new], end[new])
            if self.units.n + len(first) > MEMORY:
                self._forget()
                new = np.arange(len(row))
                first, inverse = distinct_spans(b, begin, end)
            x, y = begin[new[first]], end[new[first]]
            got, many = self._encode_units([data[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)])
            made = self.units.add(data, x, y)
            self.at, self.many, self.flat = _grown(self.at, self.units.n), _grown(self.many, self.units.n), _grown(self.flat, self.used + len(got))
            self.at[made], self.many[made] = self.used + np.cumsum(many) - many, many
            self.flat[self.used : self.used + len(got)] = got
            self.used += len(got)
            row[new] = made[inverse]
        # a unit after a line break has the break's ids, in row 0, before it
        breaks = np.flatnonzero(line)
        words = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))
        words = words + np.searchsorted(breaks, words)
        row = np.insert(row, breaks, 0)
        many = self.many[row]
        ids = self.flat[spread(self.at[row], many)]
        upto = np.concatenate([[0], np.cumsum(many)])[words].tolist()
        return [ids[x:y] for x, y in zip([0, *upto], upto, strict=False)]

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        some, size = [], 0
        for k, t in enumerate(texts):
            if t and self._plain(t):
                some.append(k)
                size += len(t)
            elif t:
                out[k] = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32)
            if some and (size > BYTES or k + 1 == len(texts)):
                for i, ids in zip(some, self._by_units([texts[i] for i in some]), strict=True):
                    out[i] = ids
                some, size = [], 0
        return out


_LOADED: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


_STAGED = "key binary, data binary, doc_id {kind}, n_tokens long, digests binary, lengths array<int>, root binary, width int"


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows of chunks (data is set) and of recipes, from one pass over the texts; a task gives each chunk once."""
    ship(docs.sparkSession)
    schema = _STAGED.format(kind=dict(docs.dtypes)["doc_id"])
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, pack, row = loaded(tokenizer_path(vocabulary)), set(), TaskContext.get().partitionId(), 0
        width, closing = "<u2" if max(enc.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4", np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                out: list[tuple] = []
                streams = [y for x in enc.encode_texts(part.column(1).to_pylist()) for y in (x, closing)]
                stops = np.cumsum([len(x) for x in streams])[1::2]
                ids, begin, size = np.concatenate(streams), 0, int(width[2])
                data = ids.astype(width).tobytes()
                for doc, stop, ends in zip(part.column(0).to_pylist(), stops.tolist(), all_cuts(ids, stops), strict=True):
                    digests, last = [], 0
                    for e in ends:
                        x = data[(begin + last) * size : (begin + e) * size]
                        digests.append(d := hashlib.sha256(x).digest()[:16])
                        if d not in seen:
                            seen.add(d)
                            out.append((d, x, None, None, None, None, None, size))
                        last = e
                    row += 1
                    uid = hashlib.sha256(b"%d:%d" % (pack, row)).digest()[:16]
                    out.append((uid, None, doc, stop - begin, b"".join(digests), [e - a for a, e in zip([0, *ends], ends, strict=False)], merkle(digests), size))
                    begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _once(df: DataFrame) -> DataFrame:
    """Of rows ordered by key, the first of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key = batch.column(0).to_pylist()
            keep = [a != b for a, b in zip(key, [last, *key], strict=False)]
            last = key[-1] if key else last
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def _ordered(recipes: DataFrame) -> DataFrame:
    """Recipes in ascending order of id, each with the ids before it in its file, and each file's manifest at its end."""
    kind = dict(recipes.dtypes)["doc_id"]
    schema = f"kind int, file int, doc_id {kind}, uid binary, local_start long, n_tokens long, digests binary, lengths array<int>, root binary, width int"
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before, top, width = TaskContext.get().partitionId(), 0, Roots(), None

        def made(rows: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            r = batch.to_pydict()
            upto = before + np.cumsum(r["n_tokens"], dtype=np.int64)
            for root in r["root"]:
                top.add(root)
            n = batch.num_rows
            yield made(r | {"kind": [0] * n, "file": [file] * n, "uid": r["key"], "local_start": [before, *upto.tolist()[:-1]]} if n else {f.name: [] for f in arrow})
            before = int(upto[-1]) if n else before
            width = r["width"][0] if n else width
        if (root := top.root()) is not None:
            yield made({f.name: [None] for f in arrow} | {"kind": [1], "file": [file], "n_tokens": [before], "root": [root], "width": [width]})

    return recipes.sortWithinPartitions(F.asc_nulls_first("doc_id"), "root", "key").mapInArrow(run, schema)


def write_store(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode docs (doc_id, text; other columns are not looked at) and write the store below path."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = _encoded(docs, vocabulary, end_id)
    _once(staged.repartition(n, "key").sortWithinPartitions("key")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = spark.read.schema(staged.schema).parquet(f"{path}/chunks").filter("root IS NOT NULL").select("key", "doc_id", "n_tokens", "digests", "lengths", "root", "width")
    _ordered(recipes.repartitionByRange(n, F.asc_nulls_first("doc_id"))).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")


_CRC_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _CRC_POLY, np.uint32(0))
    return out


@cache
def _square(k: int) -> np.ndarray:
    """x^(8 * 2^k), which moves on by 2^k bytes."""
    return _times(_square(k - 1), _square(k - 1)) if k else np.array([0x80000000 >> 8], np.uint32)


@cache
def _moved_by(k: int) -> list[np.ndarray]:
    """For each of a number's four bytes the products of its values with x^(8 * 2^k)."""
    return [_times(np.repeat(_square(k), 256), np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)]


def crc_moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a chunk with this crc32 gives to the crc32 of a whole in which so many bytes follow it; a whole's is the xor of these."""
    out, n, k = crc.astype(np.uint32), after.astype(np.int64), 0
    while n.any():
        if len(some := np.flatnonzero(n & 1)):
            x, by = out[some], _moved_by(k)
            out[some] = by[0][x & 255] ^ by[1][x >> 8 & 255] ^ by[2][x >> 16 & 255] ^ by[3][x >> 24]
        n, k = n >> 1, k + 1
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc32 of the ids as unsigned 32-bit integers, and whether the stored bytes have that digest."""

    def run(c: dict) -> dict:
        big = [np.frombuffer(x, f"<u{w}", len(x) // w).astype("<u4") for x, w in zip(c["data"], c["width"], strict=True)]
        return {"digest": c["key"], "n": [len(x) for x in big], "crc": [zlib.crc32(x.tobytes()) for x in big], "sound": [hashlib.sha256(x).digest()[:16] == k for k, x in zip(c["key"], c["data"], strict=True)]}

    return map_columns(spark.read.parquet(f"{path}/chunks").filter("data IS NOT NULL").select("key", "data", "width"), run, "digest binary, n long, crc long, sound boolean")


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """file, whole: whether the recipes that are there, in order, have the root and the number of ids of the file's manifest."""
    schema = pa.schema([("file", pa.int32()), ("got", pa.binary()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, ids = None, Roots(), 0
        ended = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([top.root()], pa.binary()), pa.array([ids], pa.int64())], schema=schema)
        for batch in batches:
            for file, root, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != now:
                    if now is not None:
                        yield ended()
                    now, top, ids = file, Roots(), 0
                top.add(root)
                ids += n
        if now is not None:
            yield ended()

    rows = spark.read.parquet(f"{path}/recipes")
    ship(spark)
    # a file's recipes meet in one task, as they did in the one that wrote it
    got = rows.filter("kind = 0").select("file", "root", "n_tokens", "local_start").repartition("file").sortWithinPartitions("file", "local_start").select("file", "root", "n_tokens").mapInArrow(run, "file int, got binary, ids long")
    said = rows.filter("kind = 1").select("file", "root", "n_tokens")
    return said.join(got, "file", "left").select("file", F.coalesce((F.col("root") == F.col("got")) & (F.col("n_tokens") == F.col("ids")), F.lit(False)).alias("whole"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    verified: every chunk's stored bytes have its digest and length, the recipe's digests its Merkle root, and the file's
    recipes that of its manifest. A chunk that is gone leaves its documents unverified, without a checksum.
    """
    rows = spark.read.parquet(f"{path}/recipes")
    kind = dict(rows.dtypes)["doc_id"]
    files = rows.filter("kind = 1").select("file", "n_tokens").orderBy("file").collect()  # one row a file
    bases, before = [], 0
    for f in files:
        bases.append((f["file"], before))
        before += f["n_tokens"]
    base = spark.createDataFrame(bases, "file int, base long").join(checked_files(spark, path), "file")  # one row a file

    def parts(c: dict) -> dict:
        out: dict = {k: [] for k in ("uid", "doc_id", "start", "digest", "length", "after", "good")}
        for i, (d, ls) in enumerate(zip(c["digests"], c["lengths"], strict=True)):
            k, after = len(ls), np.cumsum(ls[::-1], dtype=np.int64)[::-1] - ls
            ds = [d[j : j + 16] for j in range(0, len(d), 16)]
            out["uid"] += [c["uid"][i]] * k
            out["doc_id"] += [c["doc_id"][i]] * k
            out["start"] += [c["start"][i]] * k
            out["digest"] += ds
            out["length"] += ls
            out["after"] += (4 * after).tolist()
            out["good"] += [c["whole"][i] and merkle(ds) == c["root"][i]] * k
        return out

    recipes = rows.filter("kind = 0").join(F.broadcast(base), "file").select("uid", "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "digests", "lengths", "root", "whole")
    pieces = map_columns(recipes, parts, f"uid binary, doc_id {kind}, start long, digest binary, length long, after long, good boolean")

    def moved(c: dict) -> dict:
        crc = np.array([x or 0 for x in c["crc"]], np.int64).astype(np.uint32)
        return c | {"part": crc_moved(crc, np.array(c["after"], np.int64)).astype(np.int64).tolist()}

    sound = F.col("good") & F.col("sound") & (F.col("n") == F.col("length"))
    joined = pieces.join(read_chunks(spark, path), "digest", "left").select("uid", "doc_id", "start", "length", "after", "crc", F.coalesce(sound, F.lit(False)).alias("good"))
    joined = map_columns(joined, moved, f"uid binary, doc_id {kind}, start long, length long, after long, crc long, good boolean, part long", rows=8192)
    return (
        joined.groupBy("uid", "doc_id", "start")
        .agg(F.sum("length").alias("n_tokens"), F.when(F.count("crc") == F.count(F.lit(1)), F.bit_xor("part")).alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks"), F.bool_and("good").alias("verified"))
        .select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves, put together from the chunks."""
    rows = spark.read.parquet(f"{path}/recipes").filter("kind = 0")
    pieces = rows.select("uid", "doc_id", F.expr("transform(sequence(0, size(lengths) - 1), i -> struct(i AS i, substring(digests, 16 * i + 1, 16) AS digest))").alias("c")).select("uid", "doc_id", F.explode("c").alias("c")).select("uid", "doc_id", "c.*")
    got = pieces.join(spark.read.parquet(f"{path}/chunks").filter("data IS NOT NULL").select(F.col("key").alias("digest"), "data", "width"), "digest")
    got = got.groupBy("uid", "doc_id").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("i", "data"))).alias("parts"))

    def run(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "ids": [np.frombuffer(b"".join(x["data"] for x in p), f"<u{w}").tolist() for p, w in zip(c["parts"], c["width"], strict=True)]}

    return map_columns(got.select("doc_id", "parts", "width"), run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def op5_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents written to a store and read back from it."""
    path = shared_path(spark, "chunk-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
