"""ISO media containers as columns: boxes are walked, sample tables decoded, payloads left alone.

to_container() stores bytes as a video track of raw 8-bit grey frames, 8 by 8, one byte a sample of the picture;
index_container() reads any container back: codec, duration and keyframe byte ranges follow from the moov box and its
tables, and the bytes of the samples are cut out by those tables where a caller asks for them.

Fragmented files are read too: a fragment's runs (trun) add samples to the track that its header (tfhd) names.

Defined results: a null or empty payload is stored as one frame of zeros by padded(); a container that is null, cut
short or without a track gives nulls and an empty list, never an error; boxes of unknown kinds, of 64-bit sizes and of
size 0 (to the end) are skipped or taken as the format says. Counts in tables are held to what the table's bytes, the
samples there are, or the container's own bytes allow, and boxes are walked DEEPEST levels down, so that no table asks
for more memory than some times the container. Rows are independent: no shuffle, one row in memory, of any length;
repeated rows give repeated results, an empty table none. index_container() replaces columns of the names that it
adds; all others come through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_columns, table

FRAME, GROUP, RATE = 64, 16, 25
#: Levels of boxes in boxes that are walked.
DEEPEST = 16
#: Samples of one stated size that are counted beyond those that the container has bytes for.
SPARE = 1 << 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's bytes: how many, and those with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % FRAME if data else FRAME)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def to_container(payload: bytes) -> bytes:
    """Frames of 64 bytes; every 16th is a keyframe and starts a chunk. Equal payloads give equal bytes: times are 0."""
    n = len(payload) // FRAME
    groups = -(-n // GROUP)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">HH", 40, 0xFFFF))
    rest = n - (groups - 1) * GROUP
    runs = [(1, GROUP, 1)] if rest == GROUP else ([(1, GROUP, 1)] if groups > 1 else []) + [(groups, rest, 1)]
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")

    def moov(first: int) -> bytes:
        offsets = first + FRAME * GROUP * np.arange(groups, dtype=np.int64)
        wide = int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", groups), (1 + GROUP * np.arange(groups)).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", groups), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _UNITY, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    at = len(head) + len(moov(0)) + 8 + 8 * (len(payload) + 16 >= 1 << 32)
    body = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if len(payload) + 16 >= 1 << 32 else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return head + moov(at) + body + payload


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()):
    """(path, start of the box, start and end of its body) of all boxes, parents first; stops at the first that doesn't fit."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield (*path, kind), start, start + head, start + size
        if kind in NESTED and len(path) < DEEPEST:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _numbers(data: memoryview, at: int, end: int, kind: str, n: int, width: int = 1) -> np.ndarray:
    item = int(kind[2])
    n = min(n, max(0, (end - at) // (item * width)))
    return np.frombuffer(data[at : at + n * width * item], kind).astype(np.int64).reshape(n, width)


def _sample_offsets(runs: np.ndarray, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the samples stand: chunks' offsets, and runs (first chunk from 1, samples a chunk). At most as many as sizes."""
    first = np.maximum.accumulate(np.clip(runs[:, 0] - 1, 0, len(chunks)))
    per = np.repeat(np.minimum(runs[:, 1], len(sizes)), np.diff(np.append(first, len(chunks))))
    upto = np.minimum(np.cumsum(per), len(sizes))
    per = np.diff(upto, prepend=0)
    skipped = first[0] if len(first) else 0  # chunks before the first run hold nothing
    of = np.repeat(np.arange(len(per)) + skipped, per)
    before = np.cumsum(sizes[: len(of)]) - sizes[: len(of)]
    starts = np.repeat(upto - per, per)
    return chunks[of] + before - before[starts]


#: Bits of flags: of a fragment's header and of a run, what fields follow; of a sample, that it is no keyframe.
_BASE, _ENTRY, _TIME, _SIZE, _FLAGS, _OWN_BASE = 1, 2, 8, 16, 32, 0x20000
_RUN_AT, _RUN_FIRST, _RUN_TIME, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT = 1, 4, 0x100, 0x200, 0x400, 0x800
_NO_KEY = 0x10000


class _Fields:
    """Big-endian 32- and 64-bit numbers of a box's body, one after another; zeros behind its end."""

    def __init__(self, view: memoryview, at: int, end: int):
        self.view, self.at, self.end = view, at, end

    def take(self, wide: bool = False) -> int:
        n = 8 if wide else 4
        self.at += n
        return int.from_bytes(self.view[self.at - n : self.at], "big") if self.at <= self.end else 0


def _fragment_run(f: _Fields, usual: dict, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a run of a fragment: the samples' offsets, sizes, whether each is a keyframe, and their time in all."""
    flags, n = f.take() & 0xFFFFFF, f.take()
    at = f.take() if flags & _RUN_AT else 0
    at -= (at & 0x80000000) << 1
    first = f.take() if flags & _RUN_FIRST else None
    kinds = [k for k in (_RUN_TIME, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT) if flags & k]
    if kinds:
        rows = _numbers(f.view, min(f.at, f.end), f.end, ">u4", n, len(kinds))
        n = len(rows)
    else:
        rows, n = np.zeros((0, 0), np.int64), min(n, len(f.view) // max(1, usual["size"]) + SPARE)
    column = lambda kind, name: rows[:, kinds.index(kind)] if kind in kinds else np.full(n, usual[name], np.int64)
    size, said = column(_RUN_SIZE, "size"), column(_RUN_FLAGS, "flags").copy()
    if first is not None and n:
        said[0] = first
    return base + at + np.cumsum(size) - size, size, (said & _NO_KEY) == 0, int(column(_RUN_TIME, "time").sum())


def _add_fragments(view: memoryview, boxes: list, tracks: dict[int, dict]) -> None:
    """Samples of the fragments' runs go to their tracks (by number), behind those of the tables."""
    usual: dict[int, dict] = {}
    runs: dict[int, list] = {n: [] for n in tracks}
    moof = base = end = 0
    now: tuple[int, dict] | None = None
    for path, box_at, a, b in boxes:
        f = _Fields(view, a, b)
        if path[-1] == b"trex":
            f.take()
            number, _, time, size, flags = (f.take() for _ in range(5))
            usual[number] = {"time": time, "size": size, "flags": flags}
        elif path[-1] == b"moof":
            moof = end = box_at
        elif path[-1] == b"tfhd":
            flags, number = f.take() & 0xFFFFFF, f.take()
            given = f.take(wide=True) if flags & _BASE else None
            if flags & _ENTRY:
                f.take()
            own = usual.get(number, {"time": 0, "size": 0, "flags": 0})
            now = number, {name: f.take() if flags & bit else own[name] for name, bit in (("time", _TIME), ("size", _SIZE), ("flags", _FLAGS))}
            base = end = given if given is not None else moof if flags & _OWN_BASE else end
        elif path[-1] == b"trun" and now and now[0] in tracks:
            placed = int.from_bytes(view[a : a + 4], "big") & _RUN_AT
            at, size, key, time = _fragment_run(f, now[1], base if placed else end)  # one without a place follows the run before
            runs[now[0]].append((at, size, key, time))
            end = int(at[-1] + size[-1]) if len(at) else end
    for number, some in runs.items():
        if some:
            t = tracks[number]
            at, size, key = (np.concatenate(x) for x in zip(*(r[:3] for r in some), strict=True))
            n = len(t["offsets"])
            before = np.arange(n) if t["key"] is None else t["key"]
            t |= {"key": np.concatenate([before, n + np.flatnonzero(key)]), "offsets": np.concatenate([t["offsets"], at]), "sizes": np.concatenate([t["sizes"], size])}
            t["duration"] = (t["duration"] or 0) + sum(r[3] for r in some)


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, handler, timescale, duration, sample sizes and offsets, keyframes; from the tables alone."""
    view = memoryview(data)
    boxes = list(walk(view, 0, len(view)))
    found: list[dict] = []
    for path, _, a, b in boxes:
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1][path[-1]] = (a, b)
    out, numbered = [], {}
    for kinds in found:

        def at(kind: bytes, kinds=kinds) -> tuple[int, int] | None:
            x = kinds.get(kind)
            return x if x and x[1] - x[0] >= 8 else None

        got: dict = {"codec": None, "handler": None, "timescale": None, "duration": None, "sizes": np.zeros(0, np.int64), "offsets": np.zeros(0, np.int64), "key": None}
        if (x := at(b"stsd")) and x[1] - x[0] >= 16:
            got["codec"] = bytes(view[x[0] + 12 : x[0] + 16]).decode("latin-1")
        if (x := at(b"hdlr")) and x[1] - x[0] >= 12:
            got["handler"] = bytes(view[x[0] + 8 : x[0] + 12]).decode("latin-1")
        if x := at(b"mdhd"):
            wide = view[x[0]] == 1
            if x[1] - x[0] >= (32 if wide else 20):
                got["timescale"], got["duration"] = struct.unpack_from(">IQ" if wide else ">II", view, x[0] + (20 if wide else 12))
        if (x := at(b"stsz")) and x[1] - x[0] >= 12:
            each, n = struct.unpack_from(">II", view, x[0] + 4)
            got["sizes"] = np.full(min(n, len(data) // each + SPARE), each, np.int64) if each else _numbers(view, x[0] + 12, x[1], ">u4", n)[:, 0]
        chunks = np.zeros(0, np.int64)
        for kind, how in ((b"stco", ">u4"), (b"co64", ">u8")):
            if x := at(kind):
                chunks = _numbers(view, x[0] + 8, x[1], how, struct.unpack_from(">I", view, x[0] + 4)[0])[:, 0]
        if (x := at(b"stsc")) and len(chunks) and len(got["sizes"]):
            runs = _numbers(view, x[0] + 8, x[1], ">u4", struct.unpack_from(">I", view, x[0] + 4)[0], 3)
            got["offsets"] = _sample_offsets(runs, chunks, got["sizes"])
        got["sizes"] = got["sizes"][: len(got["offsets"])]
        if x := at(b"stss"):
            got["key"] = _numbers(view, x[0] + 8, x[1], ">u4", struct.unpack_from(">I", view, x[0] + 4)[0])[:, 0] - 1
        if (x := at(b"tkhd")) and x[1] - x[0] >= 24:
            numbered[int.from_bytes(view[x[0] + (20 if view[x[0]] == 1 else 12) :][:4], "big")] = got
        out.append(got)
    if any(path[-1] == b"trun" for path, *_ in boxes):
        _add_fragments(view, boxes, numbered)
    return out


def keyframe_ranges(t: dict) -> list[tuple[int, int]]:
    """Byte ranges of the keyframes' samples; without a table of them every sample is one."""
    n = len(t["offsets"])
    key = np.arange(n) if t["key"] is None else t["key"][(t["key"] >= 0) & (t["key"] < n)]
    return list(zip(t["offsets"][key].tolist(), (t["offsets"][key] + t["sizes"][key]).tolist(), strict=True))


def samples(data: bytes, t: dict) -> bytes:
    """The samples' bytes in order, by the tables; samples that follow one another are cut out at once."""
    off, size = t["offsets"], t["sizes"]
    if not len(off):
        return b""
    new = np.flatnonzero(np.append(True, off[1:] != off[:-1] + size[:-1]))
    last = np.append(new[1:], len(off)) - 1
    return b"".join(data[max(a, 0) : max(b, 0)] for a, b in zip(off[new].tolist(), (off[last] + size[last]).tolist(), strict=True))


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container (media) of each text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(c: dict) -> dict:
        got = [padded(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [n for n, _ in got], "media": [to_container(p) for _, p in got]}

    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary", rows=128)


def index_container(df: DataFrame, media: str = "media") -> DataFrame:
    """df without media, with codec, handler, seconds, n_samples and keyframes (byte ranges) of the first track; columns of these names are replaced."""
    keep = [c for c in df.columns if c not in (media, "codec", "handler", "seconds", "n_samples", "keyframes")]
    names = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in keep)
    given = "media"
    while given in keep:
        given += "_"

    def run(c: dict) -> dict:
        got = [(tracks(m) if m else []) for m in c[given]]
        one = [g[0] if g else None for g in got]
        return {k: c[k] for k in keep} | {
            "codec": [t and t["codec"] for t in one],
            "handler": [t and t["handler"] for t in one],
            "seconds": [t["duration"] / t["timescale"] if t and t["timescale"] else None for t in one],
            "n_samples": [len(t["offsets"]) if t else None for t in one],
            "keyframes": [[{"start": a, "stop": b} for a, b in keyframe_ranges(t)] if t else [] for t in one],
        }

    return map_columns(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`").alias(given)), run, names + "codec string, handler string, seconds double, n_samples long, keyframes array<struct<start long, stop long>>", rows=128)


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a container; what the stored bytes' boxes and tables say, and the payload read back by the tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(c: dict) -> dict:
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_keyframes")}
        for text in c["text"]:
            n, payload = padded(text)
            m = to_container(payload)
            t = tracks(m)[0]
            p, ranges = samples(m, t), keyframe_ranges(t)
            seconds = t["duration"] / t["timescale"]
            out["n_bytes"].append(n)
            out["payload_bytes"].append(len(p))
            out["payload_sha256"].append(hashlib.sha256(p).hexdigest())
            out["tail_crc32"].append(zlib.crc32(p[-64:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            told = ",".join(f"{a}-{b}" for a, b in ranges)
            out["feature"].append(f"codec={t['codec'].strip()};seconds={seconds:.2f};samples={len(t['offsets'])};keyframes={len(ranges)};first={ranges[0][0]}-{ranges[0][1]};ranges={hashlib.sha256(told.encode()).hexdigest()[:16]}")
            out["codec"].append(t["codec"].strip())
            out["seconds"].append(seconds)
            out["n_keyframes"].append(len(ranges))
        return out | {"doc_id": c["doc_id"]}

    return map_columns(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_keyframes long", rows=128)
