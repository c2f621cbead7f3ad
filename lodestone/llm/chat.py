"""Chat formatting with offset-aligned masks.

A conversation is rendered whole by a template of control strings, encoded once with offsets, and the loss mask is
found by intersecting the sorted spans of its turns with the sorted spans of its tokens by binary search: a token
counts where it lies in an assistant's text.

Control strings inside roles and texts are escaped: a backslash goes behind their first character, after those already
there; taking one away gives the text back. So no text can open or close a turn. The template's strings are special
tokens of the tokenizer, made in memory, at which it splits; tokens never span an end of a turn's text.

Rows are dealt by conversation and sorted by turn; a conversation is streamed, and only its digests and counts stay in
memory from block to block. A block is rendered and encoded at once: a whole conversation, or of one of over BLOCK
characters so many turns. Since the tokenizer splits at the control strings, a cut between turns changes no token.

Defined results: null text and null role are the empty text; rows of a conversation are ordered by turn, role and
text, nulls first, so ties and repeated rows have one order and all count; rows with a null conversation id form one
conversation; a conversation of any length is taken whole, in blocks; an empty table gives no rows (op2 still has its
extra conversation). Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import tokenizer_path
from lodestone.llm.common import table
from lodestone.session import ship

# The template's control strings, and others that a chat format may give meaning to.
START, BODY, END = "<|im_start|>", "<|im_body|>", "<|im_end|>"
_ESCAPED = re.compile(r"(<)(\\*)(?=\||/?s>)|(\[)(\\*)(?=/?INST\])|(<)(\\*)(?=</?SYS>>)")
_BACK = re.compile(r"(<\\*)\\(?=\||/?s>)|(\[\\*)\\(?=/?INST\])|(<\\*)\\(?=</?SYS>>)")
#: Characters after which a conversation's block is closed at a turn.
BLOCK = 1_000_000


def escape(text: str | None) -> str:
    """No control string is left, and unescape() gives the text back."""
    return _ESCAPED.sub(lambda m: m[0] + "\\", text) if text and ("<" in text or "[" in text) else text or ""


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1] or m[2] or m[3], text) if "\\" in text else text


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted text of (role, text) turns and each text's span in it, with whether it's an assistant's."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + BODY, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == "assistant"))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition(BODY)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


def mask(spans: list[tuple[int, int, bool]], offsets: np.ndarray) -> np.ndarray:
    """A flag a token: whether it lies in the text of an assistant's turn. Both lists are sorted: a binary search for each end."""
    marks = np.zeros(len(offsets) + 1, np.int64)
    if len(offsets):
        own = np.array([(a, b) for a, b, mine in spans if mine and b > a], np.int64).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 1], own[:, 0], "right")  # the first token that ends in the text
        last = np.searchsorted(offsets[:, 0], own[:, 1], "left")  # the first that starts after it
        np.add.at(marks, first, 1)
        np.add.at(marks, np.maximum(first, last), -1)
    return np.cumsum(marks[:-1]) > 0


def masked_texts(formatted: str, spans: list[tuple[int, int, bool]], offsets: np.ndarray, flags: np.ndarray) -> list[str]:
    """The text under the mask, a run of masked tokens at a time, unescaped."""
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(unescape(formatted[int(offsets[a, 0]) : int(offsets[b - 1, 1])]))
    return out


_LOADED: dict = {}


def loaded(path: str):
    """The tokenizer of a file with the control strings as special tokens."""
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, BODY, END)])
        _LOADED[path] = t
    return _LOADED[path]


class _Whole:
    """What is kept of a conversation from block to block."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.size = conv, [], 0
        self.out = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_tokens": 0, "loss_tokens": 0}
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.text, self.ids, self.flags = [], [], []

    def add(self, role: str | None, text: str | None) -> None:
        self.turns.append((role, text))
        self.size += len(text or "") + len(role or "")

    def close(self, lib, keep: bool) -> None:
        formatted, spans = render(self.turns)
        e = lib.encode(formatted, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        flags = mask(spans, offsets)
        for role, text in parse(formatted):
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.out["n_turns"] += 1
        for text in masked_texts(formatted, spans, offsets, flags):
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.out["loss_chars"] += len(text)
        self.out["formatted_chars"] += len(formatted)
        self.out["n_tokens"] += len(e.ids)
        self.out["loss_tokens"] += int(flags.sum())
        if keep:
            self.text.append(formatted)
            self.ids += e.ids
            self.flags += flags.tolist()
        self.turns, self.size = [], 0

    def row(self, keep: bool) -> dict:
        got = self.out | {"turns_sha256": self.all.hexdigest(), "loss_sha256": self.loss.hexdigest()}
        return got | ({"formatted": "".join(self.text), "ids": self.ids, "mask": self.flags} if keep else {})


def format_chats(turns: DataFrame, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text): counts and digests and, if with_ids, the formatted
    text, its ids and a flag an id for the loss. (A text, ids and mask of a conversation are one row; without them memory
    is bounded by a block.)
    """
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long" + ", formatted string, ids array<int>, mask array<boolean>" * with_ids
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, now, done = loaded(tokenizer_path(vocabulary)), None, []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pylist(done, schema=arrow)
            done.clear()
            return got

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        now.close(lib, with_ids)
                        done.append(now.row(with_ids))
                    now = _Whole(conv)
                elif now.size > BLOCK:
                    now.close(lib, with_ids)
                now.add(role, text)
                if len(done) >= 512:
                    yield flush()
        if now is not None:
            now.close(lib, with_ids)
            done.append(now.row(with_ids))
        if done:
            yield flush()

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")])
    return rows.select("conv_id", "role", "text").mapInArrow(run, schema)


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts hold another template's control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return format_chats(turns.unionByName(extra), with_ids=False)
