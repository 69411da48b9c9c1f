"""Removal of long strings that recur anywhere, by common prefixes on a Burrows-Wheeler transform.

All strings of `length` bytes that start at two places are wanted, over any number of texts. The corpus is dealt to blocks by
content: each string of that length has one anchor, the least hash of its 64-byte stretches, so that equal strings have equal
anchors. Neighbouring strings with one anchor are a neighbourhood, a stretch of text. Anchors that occur once need no look.
Neighbourhoods that are equal as a whole (by 128 bits of their bytes) recur whole, and one of each kind goes on to the others
of its anchor: they meet in blocks, all of an anchor in one, where a transform of the block gives the common prefixes. An
anchor with too many kinds for a block is narrowed first: counts of its single strings' hashes say which strings can't recur,
and what is left of each neighbourhood takes the same way again. If even then an anchor has too many kinds, its strings are
counted one by one, by 128 bits of their bytes.

Where shorter passages are wanted too, they are looked for first: a long string that recurs lies in a run of shorter ones that
do, so that only these runs are looked at for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Rolling, discard, signed, sliced, small, stage, text_bytes, tidy

LENGTH = 400
STRETCH = 64

#: Bytes of a string of a passage, its stretches, and words that a passage has more than.
PASSAGE = (200, 48)
PASSAGE_WORDS = 50

#: Starts of strings that are looked at together.
SEGMENT = 1 << 19

#: Strings in a neighbourhood at most; a longer one, as uniform text has it, is cut.
MOST_STARTS = 4096

#: Bytes in a block whose transform is built, and kinds of neighbourhoods of an anchor above which it is narrowed first.
BLOCK_BYTES = 1 << 18
BLOCK_NEIGHBOURS = 1500

#: Codes of neighbouring suffixes that are compared one by one before intervals are extended.
NEAR_CODES = 24

FOUND = "anchor bigint, places int, one bigint, two bigint, key bigint, first bigint, last bigint"


def anchors(data: np.ndarray, ends: np.ndarray, length: int, stretch: int) -> tuple[np.ndarray, ...]:
    """For texts one after the other (their ends in `ends`): each neighbourhood's anchor, at how many places it stands, and the
    first and last start of its strings. Equal strings have the anchor at equal places: a neighbourhood in which one recurs has two at least."""
    width = length - stretch + 1
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    every = np.arange(len(data) - stretch + 1)
    hashes = Rolling(data).of(slice(0, len(every)), slice(stretch, stretch + len(every)))
    # the upper bits of the hash, then the place: of equal hashes the leftmost is the least
    bits = np.uint64(max(1, int(len(every)).bit_length()))
    packed = (hashes >> bits << bits) | every.astype(np.uint64)
    least, span = packed, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.ones(n, bool)
    for end in ends[:-1]:
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    place = place[starts]
    anchor = hashes[place]
    apart = np.diff(starts) != 1
    new = np.r_[True, apart | (anchor[1:] != anchor[:-1])]
    # long ones are cut
    begin = np.flatnonzero(new)
    new[(np.arange(len(starts)) - np.repeat(begin, np.diff(np.r_[begin, len(starts)]))) % MOST_STARTS == 0] = True
    at = np.flatnonzero(new)
    places = np.add.reduceat(np.r_[True, apart | (np.diff(place) != 0)] | new, at)
    return anchor[at], places, starts[at], starts[np.r_[at[1:] - 1, len(starts) - 1]]


def _digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each stretch, as two columns."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of the bytes to look at: (start, end, ends of the texts in it). Long texts are cut with an overlap of length - 1."""
    pending, begin = [], None
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a > SEGMENT:
            if pending:
                yield begin, pending[-1], np.array(pending) - begin
                pending, begin = [], None
            for s in range(a, b - length + 1, SEGMENT):
                e = min(s + SEGMENT + length - 1, b)
                yield s, e, np.array([e - s])
            continue
        if begin is None or (pending and pending[-1] != a):
            if pending:
                yield begin, pending[-1], np.array(pending) - begin
            pending, begin = [], a
        pending.append(b)
        if b - begin > SEGMENT:
            yield begin, b, np.array(pending) - begin
            pending, begin = [], None
    if pending:
        yield begin, pending[-1], np.array(pending) - begin


def _find_anchors(df: DataFrame, length: int, stretch: int) -> DataFrame:
    """The neighbourhoods of all anchors; first and last are starts in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for a, b, ends in _segments(data, offsets, length):
                with np.errstate(over="ignore"):
                    anchor, places, first, last = anchors(data[a:b], ends, length, stretch)
                text = np.searchsorted(offsets, a + first, "right") - 1
                shift = a - offsets[text]
                whole = _digests(data[a:b], first, last + length)
                columns = [signed(anchor), pa.array(places.astype(np.int32)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(keys[text]), pa.array(first + shift), pa.array(last + shift)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return df.select("key", "text").mapInArrow(tidy(run), FOUND)


def suffix_array(codes: np.ndarray, separators: int, depth: int) -> np.ndarray:
    """Starts of the suffixes by their first `depth` codes at least. Codes below `separators` are separators, each of its own."""
    n = len(codes)
    byte = np.r_[np.maximum(codes - separators + 1, 0), np.zeros(6, np.int64)].astype(np.uint64)
    ended = np.r_[codes < separators, np.ones(6, bool)]
    packed, apart = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(6):
        apart |= ended[k : n + k]
        packed = packed << np.uint64(9) | np.where(apart, np.uint64(0), byte[k : n + k])
    # a stretch that meets a separator equals no other: behind the separator its place counts
    order = np.argsort(packed, kind="stable")
    value = packed[order]
    new = np.r_[True, (value[1:] != value[:-1]) | apart[order[1:]] | apart[order[:-1]]]
    # a suffix's rank is the place of the first that equals it so far; only those that equal others are sorted further
    rank, active = np.empty(n, np.int64), np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, active, 0))
    active = active[~(new & np.r_[new[1:], True])]
    span = 6
    while span < depth and len(active):
        at = order[active]
        key = rank[at] * n + rank[at + span]  # they agree for `span` codes, so that none ends there
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[active] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = active[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        active = active[~(new & np.r_[new[1:], True])]
        span *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it; `stop` where it is `stop` or more.

    Breadth first by length: an interval of suffixes that begin with a string is extended backward by each code before
    them. The end of an extended interval has the string's length as its value if it has none yet, and only then the
    interval stays in the queue. After `stop` rounds what has no value is longer. The first rounds, in which the queue holds
    nearly all suffixes, are left out: neighbours are compared for NEAR_CODES codes, and the queue begins with the intervals
    that those rounds would leave."""
    n = len(codes)
    out = np.full(n + 1, -1, np.int64)
    out[0] = out[n] = 0
    left, depth = np.arange(1, n), min(NEAR_CODES, stop)
    for value in range(depth):
        same = codes[order[left - 1] + value] == codes[order[left] + value]
        out[left[~same]] = value
        left = left[same]
    bounds = np.flatnonzero(out >= 0)
    low, high = bounds[:-1], bounds[1:]
    ended = out[high] == depth - 1
    low, high = low[ended], high[ended]
    before = codes[order - 1]  # the transform
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # where the suffix that is longer by one code stands
    span = np.int64(codes.max()) + 2
    for value in range(depth, stop):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        key = owner * span + before[at]
        by = np.argsort(key)
        key = key[by]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[begin, len(key)])
        # suffixes that agree beyond the depth they are sorted by may stand in any order
        child = np.minimum.reduceat(back[at[by]], begin)
        end = child + count
        fresh = out[end] < 0
        child, end = child[fresh], end[fresh]
        out[end] = value
        low, high = child, end
    out[out < 0] = stop
    return out[:n]


def recurring(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of its stretches of `length` bytes that start anywhere else in these strings too."""
    m = len(strings)
    sizes = np.array([len(x) for x in strings])
    flat = np.frombuffer(b"".join(x + b"\0" for x in strings), np.uint8).astype(np.int64) + m
    ends = np.cumsum(sizes + 1) - 1
    flat[ends] = np.arange(m)
    order = suffix_array(flat, m, length)
    prefix = common_prefixes(flat, order, length)
    same = prefix >= length
    starts = np.sort(order[same | np.r_[same[1:], False]])
    owner = np.searchsorted(ends, starts)
    begin = np.r_[0, ends[:-1] + 1]
    cut = np.searchsorted(owner, np.arange(m + 1))
    return [starts[a:b] - begin[k] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """What stretches with these sorted starts cover, as maximal runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + length).tolist(), strict=True))


def _slices(df: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, neighbours, key, first, bytes) of wanted neighbourhoods (key, pieces: anchor, first, last, neighbours)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "neighbours", "key", "first", "bytes"]
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for key, begin, cuts in zip(batch.column(0).to_pylist(), offsets[:-1], batch.column(2).to_pylist(), strict=True):
                rows += [(x["anchor"], x["neighbours"], key, x["first"], data[begin + x["first"] : begin + x["last"] + length].tobytes()) for x in cuts]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    lists = stage(wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last", "neighbours")).alias("cuts")), "cuts")
    return df.join(lists, "key").select("key", "text", "cuts").mapInArrow(tidy(run), "anchor bigint, neighbours bigint, key bigint, first bigint, bytes binary")


def _in_blocks(slices: DataFrame, length: int) -> DataFrame:
    """(key, start, end) of what recurs among neighbourhoods that meet in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = recurring(list(pdf["bytes"]), length)
        rows = [(k, f + a, f + b) for k, f, starts in zip(pdf["key"], pdf["first"], found, strict=True) for a, b in _runs(starts, length)]
        return pd.DataFrame(rows, columns=["key", "start", "end"], dtype="int64")

    total = slices.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return slices.withColumn("block", F.pmod("anchor", F.lit(blocks))).groupBy("block").applyInPandas(run, "key bigint, start bigint, end bigint")


def _narrowed(slices: DataFrame, length: int) -> DataFrame:
    """What may recur of neighbourhoods (anchor, key, first, bytes) whose anchors have too many kinds: the stretches in which each string's hash is that of another string of the anchor. Hashes are counted by partial sums; a string is left out only if its hash is there once, which is proof."""
    hashes = "anchor bigint, string bigint, key bigint, first bigint, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for anchor, key, first, data in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                values = np.frombuffer(data, np.uint8)
                n = len(values) - length + 1
                with np.errstate(over="ignore"):
                    own = Rolling(values).of(slice(0, n), slice(length, length + n)).view(np.int64)
                for column, x in zip(columns, (np.full(n, anchor), own, np.full(n, key), np.full(n, first), np.arange(n, dtype=np.int32)), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [x.split()[0] for x in hashes.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for anchor, key, first, data, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = np.array(starts)
                at = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
                a, b = starts[at], starts[np.r_[at[1:] - 1, len(starts) - 1]]
                whole = _digests(np.frombuffer(data, np.uint8), a, b + length)
                rows += zip([anchor] * len(a), [2] * len(a), whole[:, 0].tolist(), whole[:, 1].tolist(), [key] * len(a), (first + a).tolist(), (first + b).tolist(), strict=True)
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    strings = slices.mapInArrow(tidy(run), hashes)
    again = small(stage(strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "string"), "strings", release=True))
    left = strings.join(again, ["anchor", "string"], "left_semi").groupBy("anchor", "key", "first").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    rows = slices.select("anchor", "key", "first", "bytes").join(stage(left, "left", release=True), ["anchor", "key", "first"])
    return stage(rows.select("anchor", "key", "first", "bytes", "starts").mapInArrow(tidy(cut), FOUND), "narrowed", release=True)


def _one_by_one(slices: DataFrame, length: int) -> DataFrame:
    """(key, start, end) of what recurs among neighbourhoods (anchor, key, first, bytes), one of each kind, that no block can hold: each string is known by 128 bits of its bytes, as whole neighbourhoods are, and counted by partial sums. What recurs of a neighbourhood, which has a bounded number of strings, is put together as runs."""
    names = ["one", "two", "key", "first", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for key, first, data in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                starts = np.arange(len(data) - length + 1)
                whole = _digests(np.frombuffer(data, np.uint8), starts, starts + length)
                columns = (whole[:, 0], whole[:, 1], np.full(len(starts), key), np.full(len(starts), first), starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(key, first + a, first + b) for key, first, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b in _runs(np.array(starts), length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [[]] * 3], ["key", "start", "end"])

    strings = slices.select("anchor", "key", "first", "bytes").mapInArrow(tidy(run), ", ".join(f"{c} bigint" for c in names))
    again = small(stage(strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"), "alike", release=True))
    left = strings.join(again, ["one", "two"], "left_semi").groupBy("key", "first").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    return left.mapInArrow(tidy(cover), "key bigint, start bigint, end bigint")


def _recurring(found: DataFrame, df: DataFrame, length: int, again_narrowed: bool = False) -> DataFrame:
    """(key, start, end) of what recurs among neighbourhoods; found is staged and goes."""
    whole = F.struct("one", "two")
    often = found.groupBy("anchor").agg(F.sum("places").alias("p"), (F.count("*") > 1).alias("rows"), F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("p > 1")
    often = stage(often.select("anchor", (F.col("rows") & (F.col("lo") == F.col("hi"))).alias("same")), "often", release=True)
    again = stage(found.join(often, "anchor"), "again", release=True)
    discard(found, often)
    # a neighbourhood that recurs as a whole is settled; for the others' sake one of each kind still takes part
    kinds = stage(again.where("not same").groupBy("anchor", "one", "two").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("least")), "kinds")
    neighbours = kinds.groupBy("anchor").agg(F.count("*").alias("neighbours"))
    wanted = kinds.join(stage(neighbours, "neighbours"), "anchor").select("anchor", "least.*", "neighbours")
    repeated = kinds.where("n > 1").select("anchor", "one", "two")
    settled = again.where("not same").join(repeated, ["anchor", "one", "two"], "left_semi").unionByName(again.where("same"))
    settled = stage(settled.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end")), "settled", release=True)
    slices = stage(_slices(df, wanted, length), "slices", release=True)
    discard(again, kinds)
    out = settled.unionByName(_in_blocks(slices.where(F.col("neighbours") <= BLOCK_NEIGHBOURS), length))
    hot = slices.where(F.col("neighbours") > BLOCK_NEIGHBOURS)
    if hot.isEmpty():
        return out
    if again_narrowed:
        return out.unionByName(_one_by_one(hot, length))
    return out.unionByName(_recurring(_narrowed(hot, length), df, length, again_narrowed=True))


def recurring_spans(df: DataFrame, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """(key, start, end), overlapping still, of all bytes in strings of `length` bytes that start at two places in the texts of df (key, text)."""
    return _recurring(stage(_find_anchors(df, length, stretch), "anchors"), df, length)


def recurring_within(df: DataFrame, runs: DataFrame, length: int, stretch: int) -> DataFrame:
    """As recurring_spans, staged, for df (key, text) of whose strings of `length` bytes all that recur lie in the runs (key, spans: start, end; sorted, they may overlap): nothing else is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(1))
            rows = [(key, a, data[begin + a : begin + b].tobytes()) for key, begin, spans in zip(batch.column(0).to_pylist(), offsets[:-1], _maximal(batch.column(2)), strict=True) for a, b in spans if b - a >= length]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, kinds, strict=True)], ["of", "shift", "text"])

    cut = df.join(runs, "key").select("key", "text", "spans").mapInArrow(tidy(run), "of bigint, shift bigint, text binary")
    pieces = stage(cut.withColumn("key", F.monotonically_increasing_id()), "pieces", release=True)
    found = recurring_spans(pieces, length, stretch).join(pieces.select("key", "of", "shift"), "key")
    out = stage(found.select(F.col("of").alias("key"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end")), "within", release=True)
    discard(pieces)
    return out


def _maximal(lists: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Of each list of sorted spans the maximal runs; those that overlap or touch are one. Null lists have none."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(lists))]
    owner, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    if len(flat):
        start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
        base = owner * (end.max() + 1)
        upto = np.maximum.accumulate(base + end)
        at = np.flatnonzero(np.r_[True, (base + start)[1:] > upto[:-1]])
        last = np.r_[at[1:], len(upto)] - 1
        for k, a, b in zip(owner[at].tolist(), start[at].tolist(), (upto - base)[last].tolist(), strict=True):
            out[k].append((a, b))
    return out


def _words(text: bytes, start: int, end: int) -> int:
    """Words of a text that lie in a stretch of it as a whole."""
    cut = [k for k in (start, end) if 0 < k < len(text) and not text[k - 1 : k].isspace() and not text[k : k + 1].isspace()]
    return max(0, len(text[start:end].split()) - len(cut))


def _lists(spans: DataFrame, name: str) -> DataFrame:
    spans = spans.groupBy("key", "start").agg(F.max("end").alias("end"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))


def deduplicate(df: DataFrame, text_col: str = "text", length: int = LENGTH, stretch: int = STRETCH, replace: bool = False, passages: tuple[int, int] | None = None) -> DataFrame:
    """All columns, with n_bytes, n_removed, n_spans, kept (binary: the bytes that are left; null with replace) and kept_sha256 added or replaced.

    Every byte in a string of `length` bytes that also starts anywhere else goes, judged on the input; strings don't cross
    texts. With replace the text column gets what is left, without bytes of characters that were cut in two (nulls stay).
    Null texts are empty. Repeated rows are equal texts: each is a place of its own. An empty table gives none.

    With passages (bytes of a shorter string, its stretch) shorter strings that start anywhere else are found too, and stay:
    n_repeated has the bytes that they cover, n_passages their maximal runs with over PASSAGE_WORDS whole words."""
    names = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256") + (("n_repeated", "n_passages") if passages else ())
    # rows get their numbers once and are written with them: nothing rests on their content's hash or on their order
    keyed = stage(df.drop(*names).withColumn("__key", F.monotonically_increasing_id()), "rows")
    texts = keyed.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if passages:
        if passages[0] > length:
            raise ValueError("passages are shorter than what goes")
        short = stage(_lists(recurring_spans(texts, *passages), "spans"), "passages", release=True)
        spans = _lists(recurring_within(texts, short, length, stretch), "__spans")
        spans = short.withColumnRenamed("spans", "__short").join(spans, "key", "left")
    else:
        spans = _lists(recurring_spans(texts, length, stretch), "__spans")
    spans = stage(spans, "spans", release=True).withColumnRenamed("key", "__key")
    joined = keyed.join(spans, "__key", "left").drop("__key")
    at, own_columns = joined.columns.index(text_col), len(keyed.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(at))
            out = []
            shorter = _maximal(batch.column(own_columns)) if passages else [[]] * batch.num_rows
            for a, b, runs, found in zip(offsets[:-1], offsets[1:], _maximal(batch.column(batch.num_columns - 1)), shorter, strict=True):
                text, parts, done, removed = data[a:b].tobytes(), [], 0, 0
                for s, e in runs:
                    parts.append(text[done:s])
                    removed += e - s
                    done = e
                kept = b"".join(parts) + text[done:]
                row = (b - a, removed, len(runs), kept, hashlib.sha256(kept).hexdigest())
                if passages:
                    row += (sum(e - s for s, e in found), sum(_words(text, s, e) > PASSAGE_WORDS for s, e in found))
                out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())[: len(names)]
            own = batch.columns[:own_columns]
            if replace:
                null = batch.column(at).is_null().to_pylist()
                own[at] = pa.array([None if gone else k.decode("utf-8", "ignore") for gone, k in zip(null, columns[3], strict=True)], pa.string())
                columns[3] = [None] * len(null)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names[:own_columns], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:own_columns])
    more = ", n_repeated bigint, n_passages bigint" if passages else ""
    return joined.mapInArrow(tidy(run), f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string{more}")
