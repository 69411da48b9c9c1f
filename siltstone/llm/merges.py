"""Token counts of byte-level BPE: pairs are merged on a linked list by a heap of ranks, and no ids are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import cut
from .common import sliced, tidy

#: Counts that a Python worker remembers of each kind, twice so many at most, and how long what they are of may be.
MEMO_COUNTS = 200_000
MEMO_CHARS = 48

#: Before white space that follows anything else: no word crosses this.
PIECE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def merged(word: str, ranks: dict[tuple[str, str], int]) -> int:
    """Tokens of a word: its symbols less the merges that the heap gives, least rank first and leftmost among equals."""
    size = len(word)
    symbols: list[str] = list(word)
    after, before = [*range(1, size), -1], [-1, *range(size - 1)]
    # the rank of the pair that begins at a symbol; an entry of the heap is a rank and a place as one number
    own = list(map(ranks.get, zip(word, word[1:], strict=False)))
    heap = [rank * size + k for k, rank in enumerate(own) if rank is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, left = divmod(heapq.heappop(heap), size)
        if own[left] != rank:  # that pair has gone
            continue
        right = after[left]
        symbols[left] += symbols[right]
        after[left] = end = after[right]
        if right < size - 1:
            own[right] = None
        own[left] = None
        if end >= 0:
            before[end] = left
            own[left] = rank = ranks.get((symbols[left], symbols[end]))
            if rank is not None:
                heapq.heappush(heap, rank * size + left)
        start = before[left]
        if start >= 0:
            own[start] = rank = ranks.get((symbols[start], symbols[left]))
            if rank is not None:
                heapq.heappush(heap, rank * size + start)
        merges += 1
    return size - merges


class Remembered(dict):
    """Counts by string, worked out where they aren't known. When it is full it becomes the old one, from which what is met again is taken over, and the older one goes."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count
        self.old: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        n = self.old.get(key) or self.count(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_COUNTS:
                self.old = dict(self)
                self.clear()
            self[key] = n
        return n


class Counting:
    """Counts of one tokenizer file, with a bounded memory of words and of pieces of text.

    The file must be byte-level BPE as counting by merges takes it: all 256 bytes in the vocabulary, one merge for each token,
    no normalizer, drop-out, prefix or suffix, and added tokens that match as they stand. Other files are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, split = given["model"], given["pre_tokenizer"] or {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        odd = given["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        odd = odd or model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        odd = odd or len({a + b for a, b in pairs}) < len(pairs) or sum(len(x) == 1 for x in model["vocab"]) < 256
        odd = odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in given["added_tokens"])
        if odd:
            raise ValueError(f"{path} isn't plain byte-level BPE")
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        added = sorted((t["content"] for t in given["added_tokens"] if t["content"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.words = Remembered(lambda word: merged(word, self.ranks))
        self.pieces = Remembered(lambda piece: sum(self.words[word] for part in cut(piece) for word, _ in self.split(part)))

    def count(self, text: str) -> int:
        """An added token is one; what stands between them is taken piece by piece, and a piece word by word as the file's rule cuts it."""
        spans = [m.span() for m in self.added.finditer(text)] if self.added else []
        n, start = len(spans), 0
        for a, b in (*spans, (len(text), len(text))):
            if a > start:
                n += sum(map(self.pieces.__getitem__, PIECE.split(text[start:a])))
            start = b
        return n


@lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    """Read once in each Python worker."""
    return Counting(path)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds to the kept columns: n_bytes (UTF-8), n_tokens as the tokenizer file counts them (added tokens inside texts as one each), over_limit.

    Null texts count as empty: none. Repeated rows give repeated rows; an empty table gives none. Other columns don't reach the
    scan. One pass, no shuffle; a slice of texts and the remembered counts are in memory at a time. A word of n bytes takes
    n log n steps, however long."""
    kept = df.select(*keep)
    names = [*keep, "n_bytes", "n_tokens", "over_limit"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counting(path).count
        for batch in sliced(batches):
            n = [count(text.as_py()) for text in batch.column(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text")).mapInArrow(tidy(run), fields)
