"""Best-fit packing of tokenized documents, with the bin count of each partition certified by dual feasible functions."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stage, tidy

CAPACITY = 4096
END_ID = 1

#: Pieces in a partition that is packed at once, and partitions whose loose sequences are packed again together.
GROUP_PIECES = 20_000
FAN_IN = 8

#: Bytes of words and ids that a Python worker remembers, and what an entry takes besides them.
MEMO_BYTES = 96 << 20
ENTRY_BYTES = 170

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Words that the tokenizer cuts into runs of letters, single digits and runs of marks, and doesn't change otherwise: small
#: letters of one code point, no apostrophe (which begins short forms).
SIMPLE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f0-9!-&(-/:-@\[-`{-~]+")
RUNS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

# --- fixed values: the steps before the model that the words below are made for ---
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# --- end of fixed values ---


def _fits(given: dict) -> bool:
    """Whether a tokenizer's file has these steps: NFC, white space as one space, small letters; runs of letters, single digits, runs of marks; bytes as letters; and no random merges."""
    norm, pre = given.get("normalizer") or {}, given.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}, {}]
    split, level = steps[0], steps[-1]
    runs = len(steps) == 2 and split.get("type") == "Split" and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
    return norm.get("normalizers") == NORMALIZERS and runs and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex") is False and not given["model"].get("dropout")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the next letters after them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class _Memo(dict):
    """Ids of words; one that isn't there is made, or taken over from the generation before."""

    def __init__(self, make: Callable[[bytes], bytes], before: dict[bytes, bytes]):
        self.make, self.before, self.bytes = make, before, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        self.bytes += len(word) + len(ids) + ENTRY_BYTES
        return ids


class WordIds:
    """Ids of texts by the tokenizers library, word by word with a memo bounded in bytes.

    Files with other steps before the model are refused (see _fits). These steps drop spaces, so that a space or line end
    separates tokens and takes no part in any, and ignore case: stretches between them are then encoded independently of
    each other. ASCII letters are lower-cased first,
    but not in words that may hold a special token's text: that has a case. Such a text is the special token, as the library
    has it; with special_as_text it is text like any other. The runs of simple words go to the library's model by
    themselves; all other words go through the whole tokenizer."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            if not _fits(json.load(file)):
                raise ValueError(f"{path}: only for tokenizers of lower-cased runs of letters, digits and marks")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memo = _Memo(self._made, {})

    def _piece(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _made(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # small ASCII letters only
            return self._piece(text)
        if b"<|" in word or not SIMPLE.fullmatch(text) or (not text.isascii() and text.lower() != text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        runs = RUNS.findall(text)
        if len(runs) > 1:
            return b"".join([self.memo[r.encode()] for r in runs])
        return self._piece(text if text.isascii() else word.decode("latin-1").translate(self.letters))

    @staticmethod
    def _split(text: str | None) -> list[bytes]:
        raw = (text or "").encode()
        if b"<|" in raw:
            return [w if b"<|" in w else w.lower() for w in raw.replace(b"\n", b" ").split(b" ")]
        return raw.lower().replace(b"\n", b" ").split(b" ")

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            # two generations: words that are met again stay, others go
            if self.memo.bytes > MEMO_BYTES // 2:
                self.memo.before = {}
                self.memo = _Memo(self._made, self.memo)
            yield b"".join(map(self.memo.__getitem__, self._split(text)))


@lru_cache(maxsize=1)
def _words(path: str, special_as_text: bool) -> WordIds:
    return WordIds(path, special_as_text)


def tokenized(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut every `capacity` tokens; the CRC-32 is of the piece's ids as little-endian unsigned 32-bit numbers. A null text has the end id alone. A special token's text becomes that token, as the library does by itself, or text with special_as_text."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in sliced(batches, 256):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), _words(tokenizer_path, special_as_text).of(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(run), PIECE)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items in the order of their sizes, each to the fullest bin that holds it."""
    bins = np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if an open bin has r left
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, used
            used += 1
        bins[i] = chosen
        if room > size:
            open_bins[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest bound of two families of dual feasible functions.

    The first drops items below a threshold and fills bins with those above its complement; the second rounds sizes to
    k-ths of the capacity."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(count), np.cumsum(count * x)
    a = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        # in k-ths of the capacity, times the capacity
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(np.sum(count * value)) // (k * capacity)))
    return best


def _pack(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one partition: bins, offsets, and whether the bin count is certified as the least."""
    pieces = pieces.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
    sizes = pieces["length"].to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    pieces["bin"] = bins
    pieces["certified"] = int(bins.max()) + 1 <= lower_bound(sizes, capacity)
    by_bin = pieces.groupby("bin")["length"]
    pieces["offset"] = by_bin.cumsum() - pieces["length"]
    pieces["fill"] = by_bin.transform("sum")
    return pieces


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity` tokens.

    Full pieces are sequences of their own. The others are dealt evenly to partitions of about group_pieces and packed there
    by best-fit decreasing. Dual-feasible-function bounds certify each partition's bin count. Partitions with a gap give up
    the pieces of their loosest bins (at most group_pieces / fan_in of them), certified ones their loosest bin, as each bound
    was rounded up alone; fan_in partitions exchange these and pack them again together. This goes on, with fewer partitions
    each time, until none gives up anything or one is left. No partition holds more than about group_pieces rows. Ties go by
    doc_id and piece; repeated rows are packed each."""
    pieces = stage(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    names = [x.split()[0] for x in PIECE.split(", ")]
    schema = f"{PIECE}, grp bigint, bin bigint, offset bigint, fill bigint, loose boolean, certified boolean"
    most = max(1, group_pieces // fan_in)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _pack(pdf, capacity)
        order = out[["bin", "fill"]].groupby("bin").agg(fill=("fill", "first"), n=("fill", "size")).sort_values("fill")
        bins = 1 if out["certified"].iloc[0] else len(order)
        given = order.index[(order["n"].cumsum() <= most) & (order["fill"] < capacity) & (np.arange(len(order)) < bins)]
        out["loose"] = out["bin"].isin(given)
        return out[[x.split()[0] for x in schema.split(", ")]]

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    done = []
    level = 0
    while True:
        packed = stage(dealt.groupBy("grp").applyInPandas(run, schema), f"packed{level}")
        last = groups == 1
        kept = packed if last else packed.where(~F.col("loose"))
        done.append(kept.select(*names, (F.lit(level * (1 << 56)) + F.col("grp") * (1 << 28) + F.col("bin")).alias("sequence_id"), "offset"))
        if last or packed.where("loose").isEmpty():
            break
        groups = -(-groups // fan_in)
        level += 1
        dealt = packed.where("loose").select(*names, F.expr(f"grp div {fan_in}").alias("grp"))
    out = full.select(*names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in done:
        out = out.unionByName(part)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document. An empty table gives none."""
    return pack(tokenized(df, tokenizer_path, id_col, text_col, capacity), capacity)
