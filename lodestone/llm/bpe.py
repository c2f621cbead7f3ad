"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as one symbol a byte. The leaves of a segment tree hold, for each symbol, the rank of the
pair that it forms with its right neighbour, with the position below it, so that the root is the leftmost pair of
the lowest rank. That pair is merged, the two or three leaves concerned get new ranks and only their paths to the
root are computed again: a merge costs a logarithm of the piece's length. It ends when the root holds no pair.

Many pieces are worked on at a time: pieces of up to the same power of two of symbols share one array of trees, and
each step takes the root of every tree that still has a pair. A long piece has a tree of its own.

Defined results: null text is the empty text, which has no ids and decodes to the empty text; repeated rows give
repeated results; of equal ranks the leftmost pair is merged; an empty table gives no rows; other columns of the input
are not looked at. Whole texts are encoded, of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import distinct_spans, map_columns, table, unit_bounds

#: Pieces of more symbols than this have a tree of their own.
LONG = 256
#: Characters of text worked on at a time.
BYTES = 2_000_000
#: Entries of a worker's memory of encoded units (about 150 bytes each); it is emptied when full, which changes no result.
MEMORY = 300_000
_NONE = np.int64(1) << 62

_SIMPLE = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Merges:
    """Ranks of pairs of ids as a sorted table, and the id that each merge makes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        key = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), np.array(made, np.int64)
        self.plain = {k: r for r, k in enumerate(key.tolist())}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where it isn't mergeable or a side is missing (below 0)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NONE)


def merge_one(ids: list[int], m: Merges) -> list[int]:
    """One piece with a tree of its own."""
    n = len(ids)
    size = 1 << max(1, (n - 1).bit_length())
    none, get, made = 1 << 62, m.plain.get, m.made
    tree = [none] * (2 * size)
    ids, after, before = list(ids), list(range(1, n)) + [-1], list(range(-1, n - 1))
    for i in range(n - 1):
        r = get((ids[i] << 32) | ids[i + 1])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int) -> None:
        j = after[i]
        r = None if j < 0 else get((ids[i] << 32) | ids[j])
        x = none if r is None else r * size + i
        set_leaf(i, x)

    def set_leaf(i: int, x: int) -> None:
        i += size
        tree[i] = x
        i >>= 1
        while i:
            x = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == x:
                return
            tree[i] = x
            i >>= 1

    while tree[1] != none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i], after[i] = int(made[rank]), after[j]
        if after[j] >= 0:
            before[after[j]] = i
        ids[j] = -1
        set_leaf(j, none)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [x for x in ids if x >= 0]


def _merge_same(sym: np.ndarray, count: np.ndarray, m: Merges) -> np.ndarray:
    """Pieces of at most sym.shape[1] (a power of two) symbols, one a row; gone symbols are -1."""
    n, size = sym.shape
    levels = size.bit_length() - 1
    col = np.arange(size)
    after = np.where(col + 1 < count[:, None], col + 1, -1)
    before = np.where(col < count[:, None], col - 1, -1)
    right = np.full_like(sym, -1)
    right[:, :-1] = sym[:, 1:]
    tree = np.full((n, 2 * size), _NONE)
    r = m.ranks(sym, right)
    tree[:, size:] = np.where(r == _NONE, _NONE, r * size + col)
    for lv in range(levels - 1, -1, -1):
        lo = 1 << lv
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

    def leaf(rows: np.ndarray, i: np.ndarray, x: np.ndarray) -> None:
        i = i + size
        tree[rows, i] = x
        for _ in range(levels):
            i = i >> 1
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

    def rank(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[rows, i]
        r = m.ranks(sym[rows, i], np.where(j < 0, -1, sym[rows, j]))
        return np.where(r == _NONE, _NONE, r * size + i)

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        best = tree[rows, 1]
        i = best % size
        j = after[rows, i]
        sym[rows, i] = m.made[best // size]
        far = after[rows, j]
        after[rows, i] = far
        has = far >= 0
        before[rows[has], far[has]] = i[has]
        sym[rows, j] = -1
        leaf(rows, j, np.full(len(rows), _NONE))
        leaf(rows, i, rank(rows, i))
        p = before[rows, i]
        has = p >= 0
        if has.any():
            leaf(rows[has], p[has], rank(rows[has], p[has]))
        rows = rows[tree[rows, 1] != _NONE]
    return sym


def merge_flat(sym: np.ndarray, count: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Pieces laid end to end, count symbols each, after all merges: their ids end to end, and how many each has."""
    start = np.cumsum(count) - count
    kept, left = sym.copy(), count.copy()
    for k in np.flatnonzero(count > LONG).tolist():
        got = merge_one(sym[start[k] : start[k] + count[k]].tolist(), m)
        kept[start[k] : start[k] + count[k]] = got + [-1] * (int(count[k]) - len(got))
        left[k] = len(got)
    size = 2
    while size <= LONG:
        ks = np.flatnonzero((count > size // 2) & (count <= size) & (count > 1))
        for at in range(0, len(ks), most := max(1, 400_000 // size)):
            some = ks[at : at + most]
            here = np.arange(size) < count[some][:, None]
            where = (start[some][:, None] + np.arange(size))[here]
            rows = np.full((len(some), size), -1, np.int64)
            rows[here] = sym[where]
            rows = _merge_same(rows, count[some], m)
            kept[where] = rows[here]
            left[some] = (rows >= 0).sum(1)
        size *= 2
    return kept[kept >= 0], left


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1] and so on."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer file; encodes and decodes texts.

    The file's normalizer (NFC, white space to blanks, lower case) and its splitting are applied by an own fast path
    where a text holds only Latin letters, digits and ASCII signs, and by the library's parts for all others. The
    merges are always done here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.lib = Tokenizer.from_file(path)
        self.names = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[c + e] for c in letters], np.int64) for e in ("", end))
        self.of_letter = {c: b for b, c in enumerate(letters)}
        said = [(self.names.get(i, "") + " ").encode() for i in range(max(self.names) + 1)]
        self.said_len = np.array([len(x) for x in said], np.int64)
        self.said_at, self.said = np.cumsum(self.said_len) - self.said_len, np.frombuffer(b"".join(said), np.uint8)
        self._forget()

    def _forget(self) -> None:
        """No unit is known: row[a unit's bytes] would give its ids, flat[at[row]:][:many[row]]."""
        self.row: dict[bytes, int] = {}
        self.flat, self.at, self.many = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data, count = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        sym = self.inner[data]
        sym[np.cumsum(count) - 1] = self.last[data[np.cumsum(count) - 1]]
        return merge_flat(sym, count, self.merges)

    def _learn(self, units: list[bytes]) -> None:
        split = [_PIECE.findall(u.decode()) for u in units]
        ids, many = self._merged([p.encode() for ps in split for p in ps])
        of = np.repeat(np.arange(len(units)), [len(ps) for ps in split])
        many = np.bincount(of, many, len(units)).astype(np.int64)
        self.row.update(zip(units, range(len(self.at), len(self.at) + len(units)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(many) - many])
        self.many, self.flat = np.concatenate([self.many, many]), np.concatenate([self.flat, ids.astype(np.uint32)])

    def _simple(self, text: str) -> bool:
        return "<|" not in text and not _SIMPLE.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _by_parts(self, text: str) -> np.ndarray:
        ids: list[np.ndarray] = []
        for part in self.cut.split(text):
            if part in self.added:
                ids.append(np.array([self.added[part]]))
            elif part:
                norm = self.lib.normalizer.normalize_str(part)
                if found := [bytes([self.of_letter[c] for c in p]) for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]:
                    ids.append(self._merged(found)[0])
        return np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)

    def _by_units(self, texts: list[str]) -> list[np.ndarray]:
        """Texts of simple characters. No such character's lower case depends on what stands beside it."""
        parts = [t.lower().replace("\xa0", " ").encode() for t in texts]
        data = b"\n".join(parts)
        b = np.frombuffer(data, np.uint8)
        start, end = unit_bounds(b)
        first, inverse = distinct_spans(b, start, end)
        keys = [data[x:y] for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.row) + len(keys) > MEMORY:
            self._forget()
        row = np.array([self.row.get(k, -1) for k in keys], np.int64)
        if len(new := np.flatnonzero(row < 0)):
            row[new] = len(self.at) + np.arange(len(new))
            self._learn([keys[i] for i in new.tolist()])
        row = row[inverse]
        many = self.many[row]
        ids = self.flat[spread(self.at[row], many)]
        ends = np.cumsum([len(p) + 1 for p in parts])
        words = np.searchsorted(start, ends)  # words before each text's end
        upto = np.concatenate([[0], np.cumsum(many)])[words].tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        some, size = [], 0
        for k, t in enumerate(texts):
            if t and self._simple(t) and "İ" not in t:
                some.append(k)
                size += len(t)
            elif t:
                out[k] = self._by_parts(t)
            if some and (size > BYTES or k + 1 == len(texts)):
                for i, ids in zip(some, self._by_units([texts[i] for i in some]), strict=True):
                    out[i] = ids
                some, size = [], 0
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' tokens with blanks between, as the library decodes where a file names no decoder."""
        at = self.said_at[ids]
        return self.said[spread(at, self.said_len[ids])[:-1]].tobytes() if len(ids) else b""


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary of a file, kept by the worker from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode a column of texts: id_col, n_tokens, the digests and, if with_ids, ids and decoded.

    No shuffle. vocabulary: the name of a public tokenizer file, found by each worker on its own machine.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(c: dict) -> dict:
        bpe = loaded(tokenizer_path(vocabulary))
        got = bpe.encode_texts(c["text"])
        back = [bpe.decode(x) for x in got]
        out = {
            id_col: c[id_col],
            "n_tokens": [len(x) for x in got],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
        }
        if with_ids:
            out |= {"ids": [x.tolist() for x in got], "decoded": [x.decode() for x in back]}
        return out

    return map_columns(docs.select(docs[id_col], docs[text_col].alias("text")), run, schema, rows=2048)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and their decoding, as digests."""
    return bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)
