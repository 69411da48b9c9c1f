"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, tidy

#: Longer texts are cut before encoding.
CHUNK_CHARS = 1 << 16

#: Places that no match of the pattern crosses and behind which it goes on as from a start: before white space that follows
#: anything else (white space only begins a match), between a letter and a digit, and after either before a mark. Not after a
#: mark: it may begin a short form such as 's. Only characters whose kind all versions of Unicode share are named.
LETTER = "A-Za-z\u00e0-\u00f6\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
MARK = "!-/:-@\\[-`{-~\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
SAFE = re.compile(rf"(?<=\S)(?=[ \t\r\n])|(?<=[{LETTER}])(?=[0-9{MARK}])|(?<=[0-9])(?=[{LETTER}{MARK}])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Read once in each Python worker from the local rank file."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cuts a long text where no match of the pattern can cross; a text without such a place stays whole. For patterns that, like the given one, match words, numbers and marks apart, each with one space before it at most."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode(text: str, ranks_path: str, pattern: str) -> list[int]:
    enc = encoding(ranks_path, pattern)
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in cut(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, with no repair of incomplete characters."""
    return encoding(ranks_path, pattern).decode_bytes(ids)


def tokenize(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Adds to the kept columns: n_tokens, ids (little-endian unsigned 32-bit, as binary; with ids=True), their SHA-256, and the SHA-256 of the decoded bytes.

    Null texts count as empty: no ids, the digests of nothing. Repeated rows give repeated rows; an empty table gives none.
    Columns that aren't kept don't reach the scan. One pass, no shuffle; a batch of texts is in memory at a time."""
    kept = df.select(*keep)
    out = kept.schema
    names = [*keep, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_tokens bigint" + ", ids binary" * ids + ", ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, raw, of_ids, of_text = [], [], [], []
            for text in batch.column(len(keep)):
                found = encode(text.as_py() or "", ranks_path, pattern)
                packed = np.asarray(found, "<u4").tobytes()
                n.append(len(found))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(decode(found, ranks_path, pattern)).hexdigest())
                if ids:
                    raw.append(packed)
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), *([pa.array(raw, pa.binary())] if ids else []), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(tidy(run), fields)
