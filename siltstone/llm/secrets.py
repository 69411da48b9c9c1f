"""Secret scans with corpus-wide ownership: where else a candidate occurs tells examples from live credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, row_key, sliced, small, stage, tidy

#: Base detectors, in order: fixed values.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
BASE = ("assign", "access", "hex")

#: Further forms, each with a substring that must be there: their spans are added when ownership says they are live.
FORMS = {
    "forge": ("_", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{20,}")),
    "chat": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "cloud": ("AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{30,}")),
    "payment": ("k_live_", re.compile(r"\b[rsp]k_live_[A-Za-z0-9]{16,}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "random": ("", re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")),
}

#: A credential is live when this many owners and repositories hold it at most, and its characters have so many bits each at least.
LIVE_OWNERS = 1
LIVE_REPOSITORIES = 2
LIVE_BITS = 3.0

#: Words that show an example.
EXAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|(.)\1{7}|01234567|abcdefgh")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, by start and then kind; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def bits(value: str) -> float:
    """Entropy of the characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def lively(value: str) -> bool:
    return bits(value) >= LIVE_BITS and not EXAMPLE.search(value)


def further_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans of the further forms that touch no base span and none before them."""
    found: list[tuple[int, int, str, str]] = []
    held = Taken((s, e) for s, e, _, _ in taken)
    for kind, (needle, form) in FORMS.items():
        if needle not in text:
            continue
        for m in form.finditer(text):
            value = m[0]
            if kind == "random" and not (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
                continue
            if held.take(m.start(), m.end()):
                found.append((m.start(), m.end(), kind, value))
    return sorted(found)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


CANDIDATE = "struct<kind:string,start:int,end:int,hash:string,lively:boolean,base:boolean>"


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text, n_assign, n_access, n_hex, base_sha256 and candidates. Values leave the scan as SHA-256 only."""
    kept = df.drop(text_col)
    names = [*kept.columns, "n_assign", "n_access", "n_hex", "base_sha256", "candidates"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("lively", pa.bool_()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, found = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                base = base_spans(text)
                by_kind = Counter(x[2] for x in base)
                for k in BASE:
                    counts[k].append(by_kind[k])
                digests.append(hashlib.sha256(joined([x[:3] for x in base]).encode()).hexdigest())
                further = further_spans(text, base)
                found.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "lively": lively(v), "base": own} for own, spans in ((True, base), (False, further)) for s, e, k, v in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(found, kind)], names)

    return df.select(*kept.columns, text_col).mapInArrow(tidy(run), f"{fields}n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, candidates array<{CANDIDATE}>")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories, places: of each candidate, from rows (owner, repository, hash). Only partial sums are shuffled: no owner, repository or hash gathers rows."""
    repositories = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"))
    owners = repositories.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"))


def scan(df: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_other.

    Candidates of all texts are hashed and counted by distinct owners and repositories (a repository belongs to one owner).
    At most LIVE_OWNERS and LIVE_REPOSITORIES and a lively value make a credential live; several owners, or a value that
    looks made up, an example; the rest is other. Base spans always stay. Live candidates of further forms are added to
    spans, which go by start, then kind (base kinds first).
    Null texts are empty; null owners and repositories are an owner and a repository of their own. Rows that repeat give
    equal rows. An empty table gives none."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\0"))
    repository = F.concat_ws("\1", owner, *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository_cols))
    rows = df.select(F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), row_key(id_col, owner_col, *repository_cols, text_col).alias("key"), text_col)
    found = stage(candidates(rows, text_col), "found")
    each = found.select("key", "owner", "repository", F.explode("candidates").alias("c")).select("key", "owner", "repository", "c.*")
    spread = stage(ownership(each), "ownership")
    judged = each.drop("owner", "repository").join(small(spread), "hash")
    live = F.col("lively") & (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    example = ~F.col("lively") | (F.col("owners") > LIVE_OWNERS)
    verdict = F.when(live, "live").when(example, "example").otherwise("other")
    order = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(BASE)), F.lit(len(BASE)))
    judged = judged.select("key", "base", F.struct("start", order.alias("order"), "kind", "end").alias("span"), verdict.alias("verdict")).distinct()
    of_text = judged.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("base") | (F.col("verdict") == "live"), F.col("span")))).alias("spans"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example", "other")),
    )
    of_text = of_text.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","))
    out = found.drop("candidates", "owner", "repository").join(small(stage(of_text, "spans")), "key", "left")
    counts = [F.coalesce(f"n_{v}", F.lit(0)).alias(f"n_{v}") for v in ("live", "example", "other")]
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *counts)
