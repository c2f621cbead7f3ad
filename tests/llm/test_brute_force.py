"""Each query over the smallest tables against plain Python or DuckDB, and operators against inputs made to break them."""

import hashlib
import itertools
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm.queries")

from lodestone.llm import bpe, chat, chunk_store, common, iso_media, mixing, near_dup, outliers, queries, secrets, toxicity  # noqa: E402
from lodestone.session import shared_path  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def result(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = [r.asDict(recursive=True) for r in queries.queries()[name](spark, SF).collect()]
        return known[name]

    return get


def test_op1_base(result, docs):
    for r in result("op1_outliers"):
        t = docs[r["doc_id"]]["text"] or ""
        words = re.findall(WORD, t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert len(result("op1_outliers")) == len(docs)


def test_op1_estimate_is_a_plain_mcd(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.3, (700, outliers.P)) @ np.diag([1, 0.5, 0.8, 0.6]) + 1, rng.normal(4, 0.2, (150, outliers.P))])
    rows = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(outliers.P)))
    got = outliers.mcd(rows).filter("level = 0").first()
    mean, cov = np.median(x, 0), np.diag((1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)) ** 2 + outliers.FLOOR**2)
    for step in range(outliers.STEPS + 1):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + np.diag(outliers.FLOOR**2) * (step > 0)), x - mean)
        keep = np.argsort(d)[: len(x) // 2] if step < outliers.STEPS else np.flatnonzero(d <= outliers.chi2_quantile(0.025))
        h = len(keep) / len(x)
        q = outliers.chi2_quantile(1 - h)
        inside = 1 - np.exp(-q / 2) * sum((q / 2) ** i / np.prod(range(1, i + 1)) for i in range(outliers.P // 2 + 1))
        mean, cov = x[keep].mean(0), np.cov(x[keep].T, bias=True) * h / inside
    assert np.abs(np.array(got["mean"]) - mean).max() < 0.03 and np.abs(mean - 1).max() < 0.1
    inverse = np.array(got["inverse"]).reshape(outliers.P, -1)
    assert np.abs(np.linalg.inv(inverse) / (cov + np.diag(outliers.FLOOR**2)) - 1).diagonal().max() < 0.15


def test_op2_masks(result):
    turns = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    got = {r["conv_id"]: r for r in result("op2_chat_masks")}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
        assert got[c]["formatted_chars"] == len(chat.render([(r, t) for _, r, t in rows])[0])


def test_op2_mask_by_interval():
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 9))
        offsets = np.array(list(itertools.pairwise(cuts)))
        ends = sorted(rng.sample(range(60), 6))
        spans = [(a, b, rng.random() < 0.6) for a, b in zip(ends[::2], ends[1::2], strict=True)]
        want = [any(mine and a < e and s < b for a, b, mine in spans) for s, e in offsets.tolist()]
        assert chat.mask(spans, offsets).tolist() == want


def test_op2_blocks_change_nothing(spark, monkeypatch):
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i} says é日 <|im_end|> [INST] " * (1 + i % 3)) for c in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    whole = [r.asDict() for r in chat.format_chats(df).orderBy("conv_id").collect()]
    run = chat.format_chats.__globals__["_Whole"]
    made = []
    lib = chat.loaded(bpe.tokenizer_path("byte_bpe_50k.json"))
    for c in (1, 2):
        w = run(c)
        for r in rows:
            if r[0] == c:
                if w.size > 60:  # closed at every turn or two, as a small BLOCK would
                    w.close(lib, True)
                w.add(r[2], r[3])
        w.close(lib, True)
        made.append(w.row(True))
    assert [{k: m[k] for k in whole[0]} for m in made] == whole


def brute_classes(texts):
    bag = {}
    for d, t in texts.items():
        w = re.findall(WORD, t or "")
        bag[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({(): 1})
    of = {d: d for d in texts}
    size = {d: sum(b.values()) for d, b in bag.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        if min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) and (m := sum((bag[a] & bag[b]).values())) >= 0.8 * (size[a] + size[b] - m):
            old, new = of[b], of[a]
            of = {d: new if c == old else c for d, c in of.items()}
    least = {}
    for d, c in of.items():
        least[c] = min(least.get(c, d), d)
    return {d: least[c] for d, c in of.items()}


def test_op3_classes(result, docs):
    assert {r["doc_id"]: r["class_id"] for r in result("op3_near_duplicates")} == brute_classes({d: r["text"] for d, r in docs.items()})


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_share_a_linear_hash(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, f"{a} {b} x", f"{b} {a} x", "x" * 17 + " " + "x" * 18]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    assert [r["ids"] for r in bpe.bpe_encode(df).orderBy("doc_id").collect()] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    enc, t = chunk_store.Encoder(bpe.tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in enc.encode_texts(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in enc.encode_texts(texts[::-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts[::-1]]
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()} == {i: i for i in range(5)}
    data = np.frombuffer(" ".join([a, b, "cat", "dog", a, "cat", "longer words than sixteen"]).encode(), np.uint8)
    first, which = common.distinct_spans(data, *common.word_bounds(data))
    assert len(first) == 8 and which[0] == which[4] != which[1] and which[2] == which[5] != which[3]


def test_op3_nodes_that_share_an_id_are_named_anew(spark):
    rows = spark.createDataFrame([(0, b"k1"), (1, b"k2"), (2, b"k1")], "row long, key binary")
    put = lambda df, name: df
    plain = {r["row"]: r["uid"] for r in near_dup._named(rows, put).collect()}
    assert plain[0] == plain[2] != plain[1]


def test_darts_of_any_weights():
    h = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w in (np.full(2, 1e-6), np.full(3, 1e9), np.array([1e-3, 5.0, 1e6])):
        assert (near_dup.dart_min_hash(h[: len(w)], w) != 0).all()
    rng, off = np.random.default_rng(3), []
    for scale in (1.0, 1e-3, 300.0):
        for _ in range(20):
            w = (rng.random(40) * 4 + 0.2) * scale
            v = w * rng.choice([1, 1, 1, 0.4], 40)
            off.append((near_dup.dart_min_hash(h, w) == near_dup.dart_min_hash(h, v)).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05


def test_op4_payloads(result, docs):
    for r in result("op4_iso_media"):
        data = (docs[r["doc_id"]]["text"] or "").encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert hashlib.sha256(iso_media.to_container(whole)).hexdigest() == r["media_sha256"]


def boxes_of(media, kind):
    return next((at, a, b) for path, at, a, b in iso_media.walk(memoryview(media), 0, len(media)) if path[-1] == kind)


def test_op4_hostile_tables():
    media = bytearray(iso_media.to_container(bytes(range(256)) * 16))
    _, a, _ = boxes_of(media, b"stsc")
    for at, value in ((a + 12, 0xFFFFFFFF), (a + 8, 0xFFFFFFFF), (a + 4, 0xFFFFFFFF), (a + 8, 0)):
        bad = bytearray(media)
        bad[at : at + 4] = struct.pack(">I", value)
        t = iso_media.tracks(bytes(bad))[0]
        assert len(t["offsets"]) == len(t["sizes"]) <= 64
    _, a, _ = boxes_of(media, b"stsz")
    for each in (1, 64):
        bad = bytearray(media)
        bad[a + 4 : a + 12] = struct.pack(">II", each, 0xFFFFFFFF)
        assert len(iso_media.tracks(bytes(bad))[0]["offsets"]) <= 1 << 17
    deep = b""
    for _ in range(3000):
        deep = iso_media.box(b"moov", deep)
    assert iso_media.tracks(deep) == []
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(media)
        for _ in range(6):
            bad[rng.randrange(len(bad) - 4096)] = rng.randrange(256)
        for t in iso_media.tracks(bytes(bad)):
            iso_media.keyframe_ranges(t), iso_media.samples(bytes(bad), t)


def test_op4_fragments():
    full, box = iso_media.full, iso_media.box
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60), flags=3)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsz", struct.pack(">II", 0, 0)))))
    moov = box(b"moov", box(b"trak", tkhd, mdia), box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 5, 3, 0x10000))))

    def moof(at: int) -> bytes:
        one = full(b"trun", struct.pack(">II", 2, at), struct.pack(">I", 0), struct.pack(">II", 4, 6), flags=0x205)  # sizes; the first is a keyframe
        two = full(b"trun", struct.pack(">I", 2), flags=0)  # usual sizes, behind those before
        return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), one, two))

    payload = b"AAAABBBBBBCCCDDD"
    media = moov + moof(len(moof(0)) + 8) + box(b"mdat", payload)
    t = iso_media.tracks(media)[0]
    assert iso_media.samples(media, t) == payload and t["sizes"].tolist() == [4, 6, 3, 3] and t["duration"] == 20 and t["codec"] == "avc1"
    assert [media[a:b] for a, b in iso_media.keyframe_ranges(t)] == [b"AAAA"]


def test_op5_ids(result, docs):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in result("op5_chunk_store")}
    for d in sorted(docs):
        ids = t.encode(docs[d]["text"] or "", add_special_tokens=False).ids + [0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"], got[d]["verified"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)


@pytest.mark.parametrize("what", ["data", "digests", "gone", "lost"])
def test_op5_damage_is_seen(spark, what):
    df = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["ab", "cd", "ef", "gh"], k=900))) for i in range(4)], "doc_id long, text string").coalesce(1)
    path = shared_path(spark, "damaged")
    chunk_store.write_store(df, path, end_id=70_000)  # ids of four bytes
    rows = spark.read.parquet(f"{path}/chunks")
    assert {r["width"] for r in rows.select("width").collect()} == {4} and all(r["verified"] for r in chunk_store.read_store(spark, path).collect())
    assert all(r["ids"][-1] == 70_000 for r in chunk_store.read_ids(spark, path).collect())
    recipes = spark.read.parquet(f"{path}/recipes")
    first = rows.filter("data IS NOT NULL").orderBy("key").first()["key"]
    if what == "data":
        rows = rows.withColumn("data", F.when(F.col("key") == F.lit(first), F.unhex(F.regexp_replace(F.hex("data"), "^..", "FF"))).otherwise(F.col("data")))
    elif what == "lost":
        rows = rows.filter(F.col("data").isNull() | (F.col("key") != F.lit(first)))
    elif what == "digests":
        recipes = recipes.withColumn("digests", F.when(F.col("doc_id") == 2, F.unhex(F.regexp_replace(F.hex("digests"), "^(.{32})(.{32})", "$2$1"))).otherwise(F.col("digests")))
    else:
        recipes = recipes.filter("doc_id IS NULL OR doc_id <> 1")
    bad = shared_path(spark, "damaged")
    rows.write.parquet(f"{bad}/chunks")
    recipes.coalesce(1).write.parquet(f"{bad}/recipes")
    got = {r["doc_id"]: r["verified"] for r in chunk_store.read_store(spark, bad).collect()}
    if what == "gone":  # a file's manifest tells that one of its recipes is missing
        assert len(got) == 3 and sum(not r["whole"] for r in chunk_store.checked_files(spark, bad).collect()) == 1
    else:
        assert not all(got.values()) and (what != "digests" or [d for d, ok in got.items() if not ok] == [2])


def test_op5_known_units_are_looked_up_together():
    rng, calls = random.Random(8), 0
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 12))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(20)]
    enc = chunk_store.Encoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    before = [x.tolist() for x in enc.encode_texts(texts)]

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        again = enc.encode_texts(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in again] == before and calls < 3000  # of 8000 words, about 4000 different


def test_op5_rare_white_space_and_full_memories(monkeypatch):
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json")), chunk_store.Encoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    # as many words as blanks and one more, though blanks stand together but for a no-break space
    texts = ["a \xa0 \xa0 b c\xa0d\xa0e", "a\x1cb c", "été \u3000 x\u3000y", "日本 <|endoftext|> x's 12², \x00 \x7f. ɏ ɐ", "plain, words.\nand lines", "one", "longer words than sixteen characters: characteristically"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for memory in (1_000_000, 3):
        monkeypatch.setattr(chunk_store, "MEMORY", memory)
        for _ in range(2):
            assert [x.tolist() for x in enc.encode_texts(texts)] == want
            assert [enc.encode_texts([x])[0].tolist() for x in texts] == want


def test_op5_units_that_crowd_one_slot(monkeypatch):
    monkeypatch.setattr(chunk_store.Units, "_at", lambda self, key: np.full(len(key), len(self.slot) - 1))
    data = b" ".join(b"%d%s" % (i % 300, b"x" * (i % 23)) for i in range(1200)) + b" a a\x00"
    units, (start, end) = chunk_store.Units(), common.word_bounds(np.frombuffer(data, np.uint8))
    assert (units.find(data, start, end) == -1).all()
    first, which = common.distinct_spans(np.frombuffer(data, np.uint8), start, end)
    half = len(first) // 2
    for part in (first[:half], first[half:]):
        units.add(data, start[part], end[part])
    assert (units.find(data, start, end) == which).all() and which[-1] != which[-2]


def test_op5_cuts_of_many_streams():
    rng = np.random.default_rng(4)
    gear = [int(x) for x in chunk_store._GEAR]
    sizes = np.array([1, 15, 127, 128, 3000, 9000, 1, 2000])
    for most in (2, 50_000):  # ids of two kinds give windows that come again, and long stretches without a cut
        ids = rng.integers(0, most, sizes.sum()).astype(np.uint32)
        got = chunk_store.all_cuts(ids, np.cumsum(sizes))
        for n, begin, ends in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), got, strict=True):
            want, last = [], 0
            for c in range(1, n + 1):
                h = sum(gear[ids[begin + c - 1 - i]] << i for i in range(min(chunk_store.WINDOW, c))) % (1 << 64)
                cut = int(common.mix(np.uint64(h))) >> (64 - chunk_store.BITS) == 0 and c - last >= chunk_store.LEAST
                if cut or c == n or c - last == chunk_store.MOST:
                    want.append(c)
                    last = c
            assert ends == want


def test_op6_rows(result, docs):
    rows = result("op6_toxicity")
    assert {r["doc_id"] for r in rows} == set(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_op6_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 3)
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(3, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.labelled(df, labels).count() <= 3


def test_op7_sizes_and_targets(result, docs):
    c = duckdb.connect()
    size = f"coalesce(len(regexp_extract_all(text, '{WORD}')), 0)"
    want = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, {size}, source, sum({size}) OVER (PARTITION BY source) FROM '{SF}/documents.parquet'").fetchall()}
    whole = {v[1]: v[2] for v in want.values()}
    order = sorted(whole, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(whole.values()), {}
    while left:  # shares by weight; those above their bound stop there, and the others share what is left
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * whole[s] for s in full}
        budget -= sum(2.0 * whole[s] for s in full)
        left -= full
    taken = defaultdict(int)
    for r in result("op7_mixing"):
        n, s, total = want[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, total) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    for s in order:  # whole documents can't always meet a target to the word: nothing nearer below it can be made of them
        sizes = [n for n, of, _ in want.values() if of == s and n]
        rest = round(target[s] - (times := int(target[s] // whole[s])) * whole[s])
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums if x + n <= rest}
        assert taken[s] == times * whole[s] + max(sums)


def test_op7_knapsack_by_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 14), 4))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(0, 60)
        got = mixing.fit_counts(budget, lengths, counts)
        best = max((s for ks in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(k * n for k, n in zip(ks, lengths, strict=True))) <= budget))
        assert all(0 <= k <= c for k, c in zip(got, counts, strict=True)) and sum(k * n for k, n in zip(got, lengths, strict=True)) == best


def test_op7_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "k int, x double").repartition(6)
    got = mixing.running(df, [F.asc("x"), F.asc("k")], {"n": F.lit(1), "sum": F.col("x")}, shared_path(spark, "running")).collect()
    rows = sorted(got, key=lambda r: (r["x"], r["k"]))
    assert [r["n"] for r in rows] == list(range(1, 501)) and [r["sum"] for r in rows] == np.cumsum([r["x"] for r in rows]).tolist()


def test_op9_base_spans(result, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for r in result("op9_secrets"):
        t = docs[r["doc_id"]]["text"] or ""
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        spans.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_op10_ids(result, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    for r in result("op10_bpe"):
        ids = t.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8_rows(result, docs):
    rows = result("op8_licenses")
    assert {r["doc_id"] for r in rows} == set(docs) and all((r["n_licenses"] > 0) == bool(r["licenses"]) for r in rows)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    before = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = stages["toxicity"](spark, docs, SF)
    scores = toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")))
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {r["doc_id"] for r in scores.collect() if r["score"] < 0.3}
    clean = spark.createDataFrame([before[d] for d in sorted(kept)], docs.schema)
    single = {r["doc_id"]: r for r in stages["near_dedup"](spark, clean, SF).collect()}
    assert set(single) == set(brute_classes({d: before[d]["text"] for d in kept}).values()) and all(single[d] == before[d] for d in single)
    one = spark.createDataFrame(list(single.values()), docs.schema)
    live = {r["doc_id"]: [x for x in r["judged"] if x["verdict"] == "live"] for r in secrets.find_secrets(one).collect()}
    shown = {r["doc_id"]: r for r in stages["secrets"](spark, one, SF).collect()}
    for d, r in shown.items():
        t, out, at = single[d]["text"] or "", "", 0
        for x in sorted(live[d], key=lambda x: (x["start"], x["stop"])):
            if x["start"] >= at:
                out += t[at : x["start"]] + "[REDACTED]"
            at = max(at, x["stop"])
        assert (r["text"] or "") == out + t[at:] and (not live[d] or r["n_chars"] == len(r["text"]))
    masked = spark.createDataFrame(list(shown.values()), docs.schema)
    often = {r["doc_id"]: r["copies"] for r in mixing.mix(masked).select("doc_id", "mix.copies").collect()}
    mix = stages["mixing"](spark, masked, SF)
    assert mix.columns == docs.columns and Counter(r["doc_id"] for r in mix.collect()) == Counter({d: n for d, n in often.items() if n})
    t = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    rows = stages["bpe"](spark, mix, SF).collect()
    assert len(rows) == sum(often.values()) and all(r["n_tokens"] == len(t.encode(shown[r["doc_id"]]["text"] or "", add_special_tokens=False).ids) for r in rows)
