"""Secret scans with corpus-wide ownership frequency.

Three base patterns and some of well-known key formats give candidates with their spans. A candidate's secret part is
hashed; over the whole corpus each hash is counted by distinct owners and distinct texts, near-duplicates being one text.
A secret that EXAMPLE_OWNERS owners or more hold, in as many texts or more, is a copied example; any other that looks
random is live-looking, in however many rows it stands: copies of one document, by one owner or many, prove nothing.
The method's spans (kind "live") mark the latter; base spans stay as they are.

What moves: a row for each candidate (a few words and the hash), and counts that each task has summed up first.
Counting is by (hash, owner), then hash, each a partial sum before it is dealt, so a secret that a third of all rows
hold is no hot group. Of texts, those that hold candidates are written beside them, and those that hold a secret of
EXAMPLE_OWNERS owners are compared.

Defined results: null or empty text has no spans; null owners count as one owner; repeated rows are one text and get
the same spans each; spans that start at one place stand in the kinds' order; texts of any length are searched whole,
one at a time; an empty table gives no rows. Only the columns named are looked at; redact() lets all others through,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_columns, table
from lodestone.llm.near_dup import near_duplicates
from lodestone.session import written

# The kinds and patterns of the base spans, in their order.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; runs are taken whole, so shorter ones can't hold a longer one
HEX = re.compile(r"[0-9a-f]{16,}")
# Well-known formats of keys beyond the base.
FORMATS = {
    "pat": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),  # pem_keys() takes the whole key
}
# The end of a private key, what parts the lines of one (also in string literals), header lines, and base64 lines.
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_PEM_GAP = r"""(?:\s|\\[nrt]|["'`+,;>#*|\\])"""
_PEM_HEAD = r"(?:(?:Proc-Type|DEK-Info|Comment|[A-Z][A-Za-z]*-[A-Za-z-]+):[^\n\\]*(?:\\?\n|\\n|\\r))"
_PEM_BODY = re.compile(rf"{_PEM_GAP}*(?:{_PEM_HEAD}{_PEM_GAP}*)*((?:[A-Za-z0-9+/]+={{0,2}}{_PEM_GAP}*)*)")
_PEM_RUN = re.compile(rf"{_PEM_GAP}*(?:{_PEM_HEAD}{_PEM_GAP}*)*((?:[A-Za-z0-9+/]{{16,}}={{0,2}}(?:{_PEM_GAP}+(?=[A-Za-z0-9+/]{{16}}))?)+(?:{_PEM_GAP}+(?:[A-Za-z0-9+/]{{1,15}}={{1,2}}|(?<=[\nnr])[A-Za-z0-9+/]{{1,15}}(?=\s*\n|\s*$)))?)")
_PEM_PARTS = re.compile(r"\\[nrt]|(?<![A-Za-z0-9+/=])\+(?![A-Za-z0-9+/=])|[^A-Za-z0-9+/=]+")
ORDER = {k: i for i, k in enumerate((*BASE, *FORMATS, "live"))}
#: A secret of this many owners or more, in this many texts or more, is a copied example.
EXAMPLE_OWNERS = 3
#: Bits a character that a live-looking secret has at least.
LIVE_BITS = 2.5


def bits(s: str) -> float:
    """Entropy of a string's characters, in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) in code points, by start and then kind."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, p in FORMATS.items():
        found += pem_keys(text) if kind == "pem" else [(kind, m.start(), m.end(), m[0]) for m in p.finditer(text)]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def pem_keys(text: str) -> list[tuple[str, int, int, str]]:
    """Private keys from BEGIN to END, or without an END to the end of the base64 run; the secret is the body, however it is broken into lines.

    A header with no body is a span of its own with an empty secret.
    """
    found = []
    for m in FORMATS["pem"].finditer(text):
        whole = _PEM_BODY.match(text, m.end())
        if end := _PEM_END.match(text, whole.end()):
            found.append(("pem", m.start(), end.end(), _PEM_PARTS.sub("", whole[1])))
        elif run := _PEM_RUN.match(text, m.end()):
            found.append(("pem", m.start(), run.end(), _PEM_PARTS.sub("", run[1])))
        else:
            found.append(("pem", m.start(), m.end(), ""))
    return found


def listed(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row a document: its id and owner, uid, base counts and digest, its candidates, and its text if it has any."""
    kind = dict(docs.dtypes)

    def run(c: dict) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found", "text")}
        for t in c["text"]:
            got = candidates(t)
            base = [x[:3] for x in got if x[0] in BASE]
            for k in BASE:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["text"].append(t if got else None)
            out["found"].append([{"kind": k, "start": a, "stop": b, "secret": hashlib.sha256(s.encode()).digest()[:16], "random": bits(s) >= LIVE_BITS} for k, a, b, s in got])
        return {k: c[k] for k in ("uid", "id", "owner")} | out

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].alias("id"), docs[owner].cast("string").alias("owner"), "text")
    schema = f"uid long, id {kind['doc_id']}, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind string, start long, stop long, secret binary, random boolean>>, text string"
    return map_columns(rows, run, schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """secret, owners, texts: distinct ones over the whole corpus; texts is null where fewer than EXAMPLE_OWNERS hold it. scanned: written."""
    each = scanned.select("uid", "owner", F.explode("found.secret").alias("secret"))
    owners = written(each.groupBy("secret", "owner").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count(F.lit(1)).alias("owners")), "secrets-owners")
    wide = owners.filter(F.col("owners") >= EXAMPLE_OWNERS).select("secret")
    wide = written(each.select("uid", "secret").distinct().join(wide, "secret"), "secrets-wide")
    if wide.isEmpty():
        return owners.withColumn("texts", F.lit(None).cast("long"))
    some = scanned.filter("text IS NOT NULL").select(F.col("uid").alias("doc_id"), "text").join(wide.select(F.col("uid").alias("doc_id")).distinct(), "doc_id")
    classes = near_duplicates(written(some, "secrets-texts")).select(F.col("doc_id").alias("uid"), F.col("class_id").alias("class"))
    texts = wide.join(classes, "uid").groupBy("secret", "class").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count(F.lit(1)).alias("texts"))
    return owners.join(texts, "secret", "left")


def is_example():
    return (F.col("owners") >= EXAMPLE_OWNERS) & (F.coalesce("texts", F.lit(0)) >= EXAMPLE_OWNERS)


def judged(scanned: DataFrame) -> DataFrame:
    """uid and its candidates with owners, texts and verdict (example, live, or unclear where it doesn't look random), for rows that have any."""
    each = scanned.select("uid", F.explode("found").alias("x")).select("uid", "x.*").join(ownership(scanned), "secret")
    each = each.withColumn("verdict", F.when(is_example(), "example").when(F.col("random"), "live").otherwise("unclear"))
    return each.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "owners", "texts", "verdict"))).alias("judged"))


def find_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, base counts and digest, spans (base, formats, live), and each candidate's verdict (judged)."""
    scanned = written(scan(docs, owner), "secrets")
    order = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    got = scanned.join(judged(scanned).withColumnRenamed("uid", "u"), F.col("uid") == F.col("u"), "left").withColumn("judged", F.coalesce("judged", F.array().cast("array<struct<start long, stop long, kind string, owners long, texts long, verdict string>>")))
    mark = lambda x, kind: F.struct(x["start"].alias("start"), order[kind].alias("order"), kind.alias("kind"), x["stop"].alias("stop"))
    base = F.transform("judged", lambda x: mark(x, x["kind"]))
    live = F.array_distinct(F.transform(F.filter("judged", lambda x: x["verdict"] == "live"), lambda x: mark(x, F.lit("live"))))
    spans = F.array_join(F.transform(F.sort_array(F.concat(base, live)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return got.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "judged")


def redact(docs: DataFrame, owner: str = "source", mark: str = "[REDACTED]") -> DataFrame:
    """docs with each live-looking secret of the texts replaced by mark; all rows stay, and n_chars follows where there is one.

    Texts don't move: the live-looking secrets' hashes are gathered and looked up in a second pass. Up to LIVE_ROWS
    of them are broadcast; beyond, rows are joined with the live-looking secrets of their texts by the texts' digests.
    """
    spark = docs.sparkSession
    scanned = written(scan(docs, owner), "secrets")
    own = ownership(scanned).filter(~is_example())
    random = scanned.select(F.explode("found").alias("x")).filter("x.random").select("x.secret").distinct()
    live = written(own.join(random, "secret").select("secret"), "secrets-live")
    fields, names = docs.schema, docs.columns

    def cut(t: str | None, hashes) -> str | None:
        if not t:
            return t
        spans = [(a, b) for _, a, b, s in candidates(t) if hashlib.sha256(s.encode()).digest()[:16] in hashes]
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join(out) + t[at:] if spans else t

    def filled(c: dict, of) -> dict:
        new = [cut(t, h) for t, h in zip(c["text"], of, strict=True)]
        if "n_chars" in c:
            c["n_chars"] = [n if a == b else len(b) for n, a, b in zip(c["n_chars"], c["text"], new, strict=True)]
        return {k: c[k] for k in names} | {"text": new}

    if live.limit(LIVE_ROWS + 1).count() <= LIVE_ROWS:
        known = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in live.collect()))
        return map_columns(docs, lambda c: filled(c, [known.value] * len(c["text"])), fields)
    of, has = "__of", "__live"
    while {of, has} & set(names):
        of, has = of + "_", has + "_"
    per = scanned.filter("text IS NOT NULL").select(F.sha2("text", 256).alias(of), F.explode("found.secret").alias("secret"))
    per = per.join(live, "secret").groupBy(of).agg(F.collect_set("secret").alias(has))
    rows = docs.withColumn(of, F.sha2("text", 256)).join(per, of, "left").drop(of)  # by what the text is: rows may be numbered otherwise now
    return map_columns(rows, lambda c: filled(c, [frozenset(x or ()) for x in c[has]]), fields)


#: Live-looking secrets (16 bytes each, about 100 in memory) up to which redact() broadcasts them.
LIVE_ROWS = 500_000


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and the live-looking ones by their ownership over all documents."""
    got = find_secrets(table(spark, sf_dir, "documents"))
    said = F.col("judged.verdict")
    n = lambda v: F.size(F.filter(said, lambda x: x == v)).cast("long")
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", n("live").alias("n_live"), n("example").alias("n_example"))
