"""Secret scan with corpus-wide ownership frequency.

A candidate's value is hashed; over the whole corpus each hash gets its numbers of distinct
owners and repositories. A value that many owners carry is an example that was copied around; one that stays with
one or two and looks random is taken for live, however many of their documents hold it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.shared import bound_batches, cut, join_spread, table

#: The order of kinds among spans with the same start.
KINDS = ("assign", "access", "hex", "vendor", "pem", "random")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Published prefixes of vendor keys and the frame of PEM private keys.
VENDOR = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+")
VENDOR_HINTS = ("gh", "xox", "sk_live_", "AIza", "eyJ")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: Words that only documentation puts into a credential.
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|sample|your[_-]|xxxx|12345678", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per code point."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """At least 3 bits a character and, in longer values, digits beside letters."""
    return entropy(value) >= 3.0 and not PLACEHOLDER.search(value) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate; base kinds exactly as the patterns say."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    base = [(s, e) for _, s, e, _ in found]
    extra = []
    if any(h in text for h in VENDOR_HINTS):
        extra += [("vendor", m.start(), m.end(), m.group()) for m in VENDOR.finditer(text)]
    if "-----BEGIN" in text:
        extra += [("pem", m.start(), m.end(), m.group()) for m in PEM.finditer(text)]
    taken = base + [(s, e) for _, s, e, _ in extra]
    for m in RANDOM.finditer(text):
        value = m.group()
        if not value.isalpha() and not any(s < m.end() and m.start() < e for s, e in taken) and entropy(value) >= 3.5 and looks_random(value):
            extra.append(("random", m.start(), m.end(), value))
    return found + extra


def spans_text(spans) -> str:
    """``kind:start:end`` by start, then kind in the order of KINDS, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


CAND = "array<struct<kind:string,start:long,end:long,value_hash:string,random:boolean>>"
SCANNED = f"owner string, repo string, doc bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, cands {CAND}"


def _scan(batches):
    cand_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.string()), ("random", pa.bool_())]))
    for batch in batches:
        counts, digests, cands = [], [], []
        for text in batch.column("text"):
            found = candidates(text.as_py() or "")
            counts.append([sum(k == kind for k, *_ in found) for kind in BASE])
            digests.append(hashlib.sha256(spans_text([x[:3] for x in found if x[0] in BASE]).encode()).hexdigest())
            cands.append([{"kind": k, "start": s, "end": e, "value_hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": k == "pem" or looks_random(v)} for k, s, e, v in found])
        arrays = [batch.column(c) for c in ("owner", "repo", "doc")]
        arrays += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        arrays += [pa.array(digests, pa.string()), pa.array(cands, cand_type)]
        yield pa.RecordBatch.from_arrays(arrays, ["owner", "repo", "doc", "n_assign", "n_access", "n_hex", "base_sha256", "cands"])


def ownership(cands: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos, times: distinct owners and distinct repositories, null as one of either, and rows.

    A repository is told by its owner and its own name, as two owners may use one name. Three aggregations with map-side combine, from
    repositories to owners to values; a value in a third of all rows is one partial row a task by the time its own key is shuffled.
    """
    repos = cands.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("times"))
    owners = repos.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"), F.sum("times").alias("times"))
    return owners.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("times").alias("times"))


def scan_secrets(df: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = 2, repository: str | None = None, max_repositories: int = 2) -> DataFrame:
    """One row for each row of ``df``: counts, the digest of the base spans and all spans.

    A candidate whose value has over ``max_owners`` owners in over ``max_repositories`` repositories is an example, whatever the
    number of its copies: in a single repository that many own it is no more than one credential. Of the others, those that
    look random are live, however many repositories of one owner hold them. Without a ``repository`` column each owner is one. Base spans stay whatever their
    class; spans of the other kinds are added where live.

    Null text counts as empty; null owners count as one owner; null or
    repeated ids keep their rows apart; an empty table gives no rows; other
    columns of ``df`` are not read.
    """
    bound_batches(df.sparkSession)
    picked = df.select(F.col(owner).cast("string").alias("owner"), F.col(repository or owner).cast("string").alias("repo"), F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    scanned = cut(picked.mapInArrow(_scan, SCANNED).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    flat = scanned.filter(F.size("cands") > 0).select("rid", "owner", "repo", F.explode("cands").alias("c")).select("rid", "owner", "repo", "c.*")
    owned = cut(ownership(flat), "secret-owners")
    judged = join_spread(flat, owned, ["value_hash"], "times", owned.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]).withColumn("example", (F.col("n_owners") > max_owners) & (F.col("n_repos") > max_repositories))
    judged = judged.withColumn("live", ~F.col("example") & F.col("random"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("label"))
    keep = F.col("kind").isin(*BASE) | F.col("live")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["label"]), ",")
    by_row = judged.groupBy("rid").agg(
        joined(F.collect_list(F.when(keep, span))).alias("spans"),
        joined(F.collect_list(F.when(F.col("live"), span))).alias("live_spans"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    out = scanned.drop("cands", "owner", "repo").join(by_row, "rid", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", blank("spans"), blank("live_spans"), zero("n_live"), zero("n_example"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its owner."""
    return scan_secrets(table(spark, sf_dir, "documents"))
