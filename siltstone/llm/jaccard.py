"""Size-aware join of word-shingle sets by Jaccard similarity: small sets by subsets, large sets by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Rolling, discard, mix, pieces, signed, sliced, small, stage, text_bytes, text_key, tidy
from .components import components

#: Sets that are compared at once in a task.
BLOCK_SETS = 256

#: Bits of the maps that large clusters are narrowed down by, maps that are compared at once, and in a block.
BITMAP_BITS = 1024
BITMAP_SETS = 384
BITMAP_BLOCK = 2048

#: Keys that a task sorts and deals at once, and elements of sets whose keys are worth a part.
KEYS_AT_ONCE = 1 << 21
PART_ELEMENTS = 1 << 21

#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """Sets link when den * |intersection| >= num * |union|."""

    words: int = 5
    num: int = 80
    den: int = 100

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def overlap(self, a: int, b: int) -> int:
        """Least number of common elements of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, a: int) -> int:
        """Size of the largest set that can link with a set of this size."""
        return self.den * a // self.num

    def smallest(self, a: int) -> int:
        return -(-self.num * a // self.den)


@lru_cache(maxsize=8)
class Plan:
    """Which keys a set of each size gets. Pairs whose larger set has at most `light` elements meet by subsets, others by lists.

    Subsets: a pair of sizes (a, b) shares a subset of overlap(a, b) elements; both sides enumerate theirs of that size.
    Lists: sizes are cut into ranges; a pair whose smaller set lies in a range differs by at most `errors` elements, so that
    of errors + 1 + spare classes of elements (by hash) at least 1 + spare hold the same elements on both sides. The lists
    are by class content; up to `spare` empty classes need no list."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.ranges: list[tuple[int, int, int, int, int]] = []  # first, last, largest partner, classes, spare
        size = 1
        while self.subset_cost(size) <= 2 * self._classes(rule.largest(size), self._errors(size))[0]:
            size += 1
        #: The boundary: the first size at which subsets cost more keys than lists.
        self.light = size - 1

    def _errors(self, last: int) -> int:
        """Most elements that only one of two linked sets has, the smaller of this size at most."""
        return (self.rule.den - self.rule.num) * last // self.rule.num

    @staticmethod
    def _classes(size: int, errors: int) -> tuple[int, int]:
        classes = errors + 1
        empty = classes * (1 - 1 / classes) ** size
        spare = int(empty + 5 * empty**0.5) + (errors > 0)
        return classes + spare, spare

    def subsets(self, n: int) -> list[tuple[int, int, int]]:
        """(a, b, subset size) of the pairs of sizes in which a set of size n takes part."""
        return [(n, b, self.rule.overlap(n, b)) for b in range(n, self.rule.largest(n) + 1)] + [(a, n, self.rule.overlap(a, n)) for a in range(self.rule.smallest(n), n)]

    def subset_cost(self, n: int) -> int:
        return sum(comb(n, k) for _, _, k in self.subsets(n))

    def lists(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(range, classes, spare) of the ranges in which a set of size n takes part: its own and those of smaller partners."""
        while not self.ranges or self.ranges[-1][0] <= n:
            first = self.ranges[-1][1] + 1 if self.ranges else max(1, self.rule.smallest(self.light + 1))
            last = max(first, self.rule.largest(first) - 1)
            self.ranges.append((first, last, self.rule.largest(last), *self._classes(first, self._errors(last))))
        k = int(np.searchsorted([r[0] for r in self.ranges], n, "right")) - 1
        while k >= 0 and self.ranges[k][2] >= n:
            yield k, *self.ranges[k][3:]
            k -= 1

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """The keys of a set of sorted distinct hashes; linked sets that differ share at least one."""
        n = len(elements)
        out = []
        if n <= self.light:
            for a, b, k in self.subsets(n):
                if b > self.light:
                    continue
                salt = np.uint64((a << 40) | (b << 20) | 1)
                picked = np.array(list(combinations(range(n), n - k)), np.int64).reshape(comb(n, k), n - k)
                every = np.sum(mix(elements ^ salt))
                out.append(mix(every - np.sum(mix(elements ^ salt)[picked], axis=1, dtype=np.uint64) + salt))
        heavy = self.rule.largest(n) > self.light
        spread = mix(elements) >> np.uint64(32) if heavy else elements
        for r, classes, spare in self.lists(n) if heavy else ():
            salt = np.uint64((r << 32) | 2)
            # the upper half of the hash tells the class: no division
            owner = ((spread * np.uint64(classes)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(classes, np.uint64)
            np.add.at(sums, owner, elements)
            named = np.bincount(owner, minlength=classes) > 0
            found = mix(mix(sums + salt) + np.arange(classes, dtype=np.uint64))
            out.append(found if classes - np.count_nonzero(named) > spare else found[named])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique of what isn't empty, by a sort: for arrays as short as a text's the library's hash table costs more."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its runs of `words` words, A-Z lower-cased."""
    base = int(offsets[0])
    data = _LOWER[data[base : int(offsets[-1])]]
    offsets = offsets - base
    inside = ~_SPACE[data]
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] if len(inside) else inside
    ends_at = offsets[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = Rolling(data).of(starts, ends) + (ends - starts).astype(np.uint64)
    first = np.searchsorted(starts, offsets)
    runs = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        runs[: len(hashes) - k] = mix(runs[: len(hashes) - k] + hashes[k:] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(_distinct(runs[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole * np.uint64(31) + h]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(elements: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxh3_128_digest(np.ascontiguousarray(elements))


def _sets(batch: pa.RecordBatch, column: int, words: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in pieces(offsets, PIECE_BYTES):
        with np.errstate(over="ignore"):
            yield from shingles(data, offsets[a : b + 1], words)


def digests_of(df: DataFrame, rule: Rule, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """The kept columns, n_shingles, digest (128 bits of the set, null where it is empty) and bits (see _bitmap)."""
    kept = df.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    names = [*keep, "n_shingles", "digest", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bits = [], [], []
            for elements in _sets(batch, len(keep), rule.words):
                n.append(len(elements))
                digests.append(set_digest(elements) if len(elements) else None)
                with np.errstate(over="ignore"):
                    bits.append(_bitmap(elements) if len(elements) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary())], names)

    return df.select(*keep, text_col).mapInArrow(tidy(run), f"{fields}, n_shingles bigint, digest binary, bits binary")


def _short(digest: bytes) -> np.uint64:
    """The first 64 bits of a digest."""
    return np.uint64(int.from_bytes(digest[:8], "big"))


def _firsts(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key in order the first set, and the edges (rows a, b, each once) from it to its others."""
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    first = owners[new][np.cumsum(new) - 1] if len(keys) else owners
    links = owners != first
    edges = np.unique(np.stack([owners[links], first[links]], axis=1), axis=0) if links.any() else np.zeros((0, 2), np.uint64)
    return keys[new], owners[new], edges


def _listed(df: DataFrame, rule: Rule, parts: int, text_col: str) -> DataFrame:
    """(part, keys, owners, edges): keys with the short of a set that has them, dealt to so many parts by key, as arrays of numbers; each set once in a task.

    What meets under a key already here gives its edges here, and one of it goes on: so a key that many sets have is few numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Plan(rule), set()
        bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

        def dealt(found: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
            keys, firsts, edges = _firsts(np.concatenate(found), np.concatenate(owners))
            at = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            spread = [0, *(len(edges) * k // parts for k in range(1, parts + 1))]
            cut = lambda x, ends: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), cut(keys, at), cut(firsts, at), cut(edges, spread)], ["part", "keys", "owners", "edges"])

        keys, owners, count = [], [], 0
        for batch in batches:
            for elements in _sets(batch, 0, rule.words):
                if not len(elements) or (own := set_digest(elements)) in seen:
                    continue
                seen.add(own)
                with np.errstate(over="ignore"):
                    found = plan.keys(elements)
                keys.append(found)
                owners.append(np.full(len(found), _short(own), np.uint64))
                count += len(found)
                if count > KEYS_AT_ONCE:
                    yield dealt(keys, owners)
                    keys, owners, count = [], [], 0
        if keys:
            yield dealt(keys, owners)

    return df.select(text_col).mapInArrow(tidy(run), "part int, keys binary, owners binary, edges binary")


def _edges(df: DataFrame, rule: Rule, parts: int, text_col: str) -> DataFrame:
    """Edges (a, b) from each key's first set to its others, by their shorts; a part at a time is held."""

    def run(table: pa.Table) -> pa.Table:
        numbers = lambda name: np.concatenate([np.frombuffer(x.as_py(), np.uint64) for chunk in table[name].chunks for x in chunk] or [np.zeros(0, np.uint64)])
        _, _, edges = _firsts(numbers("keys"), numbers("owners"))
        edges = np.unique(np.concatenate([edges, numbers("edges").reshape(-1, 2)]), axis=0)
        return pa.table([signed(edges[:, 0]), signed(edges[:, 1])], names=["a", "b"])

    return _listed(df, rule, parts, text_col).groupBy("part").applyInArrow(run, "a bigint, b bigint").distinct()


def _candidates(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges of shorts as edges of classes (numbers: short, class). Where two classes share a short both have its edges, and one to each other: candidates may be too many, never too few."""
    for side in ("a", "b"):
        edges = edges.withColumnRenamed(side, "short").join(numbers, "short").drop("short").withColumnRenamed("class", side)
    twins = numbers.join(numbers.groupBy("short").agg(F.min("class").alias("b"), F.count("*").alias("n")).where("n > 1"), "short")
    return edges.unionByName(twins.where("class <> b").select(F.col("class").alias("a"), "b"))


def links_within(sets: list[np.ndarray], rule: Rule, split: int | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Which of the sets link, as a symmetric table; with split, only those before it with those after it.

    With sizes, what is given of each set is its difference to one set that is common to all: two sets differ in as many
    elements as these differences do."""
    given = np.array([len(s) for s in sets])
    sizes = given if sizes is None else sizes
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one set only adds nothing to an intersection
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), given)
    pick = shared[column]
    row, column = row[pick], place[column[pick]]
    width = int(shared.sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, width, 16384):
        part = (column >= a) & (column < a + 16384)
        table = np.zeros((len(sets), min(16384, width - a)), np.float32)
        table[row[part], column[part] - a] = 1
        common += table @ table.T
    apart = given[:, None] + given[None, :] - 2 * common.astype(np.int64)
    fits = rule.links((sizes[:, None] + sizes[None, :] - apart) // 2, sizes[:, None], sizes[None, :])
    np.fill_diagonal(fits, False)
    if split is not None:
        fits[:split, :split] = False
        fits[split:, split:] = False
    return fits


def _roots(fits: np.ndarray) -> np.ndarray:
    """For each position the first one that it is joined with by links."""
    n = len(fits)
    root = np.arange(n)
    while True:
        near = np.minimum(root, np.where(fits, root[None, :], n).min(axis=1, initial=n))
        if (near == root).all():
            return root
        root = near


def _verify(sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n): class a has n links in a task, by which it is joined with class b. Sides 0 and 1 of a task are compared with each other, a task with side 0 only with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "side", "class"])
        out = []
        for _, task in pdf.groupby("task", sort=False):
            side, own = task["side"].to_numpy(), task["class"].to_numpy()
            split = int((side == 0).sum()) if (side > 0).any() else None
            fits = links_within([np.frombuffer(x, np.uint64) for x in task["elements"]], rule, split, task["n"].to_numpy(np.int64))
            n = fits.sum(axis=1)
            out.append(pd.DataFrame({"a": own, "b": own[_roots(fits)], "n": n})[n > 0])
        return pd.concat(out)

    return sets.groupBy("bin").applyInPandas(run, "a bigint, b bigint, n bigint")


def join(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), count_links: bool = True) -> DataFrame:
    """id, kept columns, n_shingles, class, class_id (its smallest id), n_links (linked classes), component_id: the smallest id that is reached by links, and component: a class that stands for all of them.

    1. Each text becomes a set of shingle hashes; texts with equal sets are one class.
    2. Each class gets keys (see Plan), which are sorted as arrays; those of a key give candidate edges to its first class.
    3. Components of the candidate edges are narrowed down by bitmaps, which bound how much two sets differ, and what is left
       is searched for links by the sets themselves: small components whole, many to a task; large ones are ordered by size
       and cut into blocks, and only blocks whose sizes can link are compared. Bitmaps come with the digests, sets from the
       texts again, one for each class that is still in question.
    4. Components of the links give the result. Each link is found and none that isn't one.
    Without count_links n_links is null, and of a large cluster only enough links are looked for to know what hangs together:
    a template with many variants then takes comparisons with one set, not of all pairs (see _zones).
    Null and empty texts have an empty set, no class and no link, and their own id as component. A null id is never the
    smallest. Repeated rows are a class of their own kind; an empty table gives none."""
    keyed = df.withColumn("of_text", text_key(F.col(text_col)))
    digests = stage(digests_of(keyed, rule, tuple(dict.fromkeys((id_col, *keep, "of_text"))), text_col), "digests")
    # a class is a number from here on, one for each digest
    numbers = digests.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits"), F.min("of_text").alias("of_text"))
    numbers = stage(numbers.withColumn("class", F.monotonically_increasing_id()), "numbers")
    found = stage(digests.drop("bits").join(numbers.select("digest", "class").hint("merge"), "digest", "left").drop("digest"), "classes")
    # a set has about as many keys as elements, with the short of its set twice as many numbers
    elements = numbers.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    edges = stage(_edges(df, rule, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-elements // PART_ELEMENTS)), text_col), "edges", release=True)
    first = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    candidates = stage(components(_candidates(edges, stage(numbers.select(first.alias("short"), "class"), "shorts"))), "clusters", release=True)
    discard(digests, edges)
    sizes = stage(candidates.groupBy("component").agg(F.count("*").alias("sets")), "clusters")
    wanted = stage(candidates.join(small(sizes), "component").select(F.col("node").alias("class"), F.col("component").alias("cluster"), "sets"), "wanted")

    # texts move once, and at every size alike: the classes in question grow with the table
    # just after a job its events still hold its plan, so that the edges' files may go only now
    chosen = stage(numbers.select("class", "of_text").join(wanted, "class"), "chosen", release=True)
    # copies of a text are dropped in the tasks that read them, so that none of their texts gathers under one key
    texts = keyed.select("of_text", F.col(text_col).alias("text")).dropDuplicates(["of_text"])
    rows = texts.join(chosen.hint("merge"), "of_text").select("class", "cluster", "sets", "text")
    whole = stage(rows.mapInArrow(tidy(_elements(rule)), ELEMENTS).dropDuplicates(["class"]), "elements", release=True)
    zones = None
    if not count_links:
        zones = stage(_zones(whole.where(F.col("sets") > BITMAP_SETS), rule), "zones", release=True)
        zones = None if zones.isEmpty() else zones
    bits = stage(numbers.select("class", "n", "bits").join(wanted, "class"), "bits")
    refined = _refined(bits, rule, zones)
    sets = stage(whole.select("class", "n", "elements").join(refined.hint("merge"), "class"), "sets", release=True)
    discard(whole, bits)
    links = stage(_links(sets, rule, zones), "links", release=True)
    discard(sets)
    if zones is not None:
        links = links.unionByName(zones.where("zone = 0 and class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"), F.lit(1).cast("long").alias("n")))

    linked = components(links.select("a", "b"))
    degree = links.groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "class")
    of_class = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(id_col).alias("first"))
    groups = of_class.join(linked.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left")
    groups = stage(groups.select("class", "first", F.coalesce("component", "class").alias("component"), (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("long")).alias("n_links")), "groups")
    least = stage(groups.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    of_class = stage(groups.join(small(least), "component").select("class", F.col("first").alias("class_id"), "component", "component_id", "n_links"), "result")
    found = found.drop("of_text")
    lone = found.where(F.col("class").isNull()).select("*", F.col(id_col).alias("class_id"), F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return found.where(F.col("class").isNotNull()).join(small(of_class), "class").select(*lone.columns).unionByName(lone)


def one_of_each(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of each component the row with the smallest id (null ids last, then by a hash of the text). Of rows that repeat one stays. Rows without a set all stay."""
    keyed = df.withColumn("__text", text_key(F.col(text_col)))
    joined = stage(join(keyed, rule, id_col, text_col, ("__text",), count_links=False), "joined")
    first = joined.where(F.col("class").isNotNull()).groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__text").alias("text"))).alias("one"))
    chosen = stage(first.select("one.id", "one.text"), "chosen")
    # rows with the id and text of a chosen one are that one again
    again = joined.where(F.col("class").isNotNull()).groupBy(id_col, "__text").count().where("count > 1")
    lone = joined.where(F.col("class").isNull()).select(F.col(id_col).alias("id"), F.col("__text").alias("text")).distinct()
    stay = stage(chosen.unionByName(lone), "stay")
    out = keyed.join(stay.hint("merge"), F.col(id_col).eqNullSafe(stay["id"]) & (F.col("__text") == stay["text"]), "left_semi")
    if not again.isEmpty():
        empty = F.coalesce(F.col(text_col), F.lit("")) == ""
        out = out.where(~empty).dropDuplicates([id_col, "__text"]).unionByName(out.where(empty))
    return out.drop("__text")


ELEMENTS = "class bigint, cluster bigint, sets bigint, n int, elements binary"


def _elements(rule: Rule):
    """A task's function: the sets of texts (class, cluster, sets, text), each class once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            new = [k for k, c in enumerate(own) if c not in seen and not seen.add(c)]
            for k in range(0, len(new), 500):
                part = batch.take(pa.array(new[k : k + 500], pa.int64()))
                sets = list(_sets(part, 3, rule.words))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], [x.split()[0] for x in ELEMENTS.split(", ")])

    return run


def _paired(rows: DataFrame, rule: Rule, block_sets: int, payload: str, zones: DataFrame | None = None) -> DataFrame:
    """class, n, payload, task, side of the rows of large clusters (class, cluster, n, payload): every two rows of a cluster whose sizes can link meet in one task of at most about two blocks.

    Blocks hold sets of like sizes, and of one zone; a size with more than a block's worth is dealt to blocks of its own. A
    block meets itself and the blocks that reach into its range of sizes, but zone 0 neither itself nor zone 2."""
    rows = rows.withColumn("zone", F.lit(1)) if zones is None else rows.join(small(zones.select("class", "zone")), "class", "left").withColumn("zone", F.coalesce("zone", F.lit(1)))
    by_size = rows.groupBy("cluster", "zone", "n").agg(F.count("*").alias("m"))
    earlier = F.coalesce(F.sum("m").over(Window.partitionBy("cluster", "zone").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.when(F.col("m") > block_sets, F.ceil(F.col("m") / block_sets)).otherwise(1).cast("int")
    by_size = stage(by_size.withColumn("parts", parts).withColumn("at", F.when(F.col("parts") > 1, -F.col("n")).otherwise((earlier / block_sets).cast("long"))), "sizes")
    blocks = by_size.select("cluster", "zone", "n", "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("cluster", "zone", "at", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = stage(blocks.withColumn("block", F.struct("lo", "hi", "part", "zone")), "blocks")
    a, b = blocks.select("cluster", F.col("block").alias("one")), blocks.select("cluster", F.col("block").alias("other"))
    apart = (F.col("one.zone") + F.col("other.zone") == 0) | ((F.col("one.zone") != F.col("other.zone")) & (F.col("one.zone") + F.col("other.zone") == 2))
    pairs = a.join(b, "cluster").where(~apart & (F.col("one") <= F.col("other")) & (F.lit(rule.num) * F.col("other.lo") <= F.lit(rule.den) * F.col("one.hi")))
    pairs = stage(pairs.withColumn("task", F.xxhash64("cluster", "one", "other")), "pairs")
    placed = rows.join(small(by_size), ["cluster", "zone", "n"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    placed = placed.join(small(blocks), ["cluster", "zone", "at", "part"]).select("class", "n", payload, "cluster", "block")
    left = placed.join(small(pairs.select("cluster", F.col("one").alias("block"), "task")), ["cluster", "block"]).select("class", "n", payload, "task", F.lit(0).alias("side"))
    right = placed.join(small(pairs.where("one <> other").select("cluster", F.col("other").alias("block"), "task")), ["cluster", "block"]).select("class", "n", payload, "task", F.lit(1).alias("side"))
    return left.unionByName(right)


def _bitmap(elements: np.ndarray) -> bytes:
    """For each of a number of classes of elements (by hash) whether it has an odd number of them. Two sets differ in at least as many elements as their bitmaps in bits. Larger sets get more bits, a power of two."""
    bits = BITMAP_BITS
    while bits < 1.6 * len(elements):
        bits *= 2
    return np.packbits(np.bincount((mix(elements ^ np.uint64(3)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _same_width(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, folded to the width of the smallest: classes modulo half the number are unions of two."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in maps])


def _near(n: np.ndarray, maps: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first one that it is joined with where sizes and bitmaps allow links, and whether it can link at all. Rows are compared with all others some at a time."""
    root, some = np.arange(len(n)), np.zeros(len(n), bool)
    for a in range(0, len(n), 256):
        part = slice(a, a + 256)
        apart = np.zeros((len(n[part]), len(n)), np.int32)
        for k in range(maps.shape[1]):
            apart += np.bitwise_count(maps[part, None, k] ^ maps[None, :, k])
        both = n[part, None] + n[None, :]
        fits = apart <= both - 2 * -(-rule.num * both // (rule.num + rule.den))
        fits[np.arange(len(fits)), a + np.arange(len(fits))] = False
        some[part] = fits.any(axis=1)
        for row in np.flatnonzero(some[part]):
            met = np.unique(np.r_[root[a + row], root[fits[row]]])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    return root, some


def _from_pivot(large: DataFrame) -> DataFrame:
    """Sets of large clusters as their differences to one set of the cluster, with its class and size (pivot, size): near copies then take few bytes."""
    first = stage(large.groupBy("cluster").agg(F.min("class").alias("pivot")), "first")
    pivots = large.join(small(first), ["cluster"]).where("class = pivot").select("cluster", "pivot", F.col("elements").alias("other"))
    pivots = small(stage(pivots, "pivots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint64)) for x, p in zip(batch.column(4), batch.column(5), strict=True)]
            made = [np.setxor1d(x, p, assume_unique=True).tobytes() for x, p in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(p) for _, p in pairs], pa.int32()), pa.array(made, pa.binary())], ["class", "cluster", "n", "pivot", "size", "elements"])

    rows = large.join(pivots, "cluster").select("class", "cluster", "n", "pivot", "elements", "other")
    return stage(rows.mapInArrow(tidy(run), "class bigint, cluster bigint, n int, pivot bigint, size int, elements binary"), "differences")


def _zones(large: DataFrame, rule: Rule) -> DataFrame:
    """class, pivot, zone of the sets of large clusters: 0 links with its cluster's pivot, and so with all others of this zone at one remove; 2 is so far from it that, by the triangle inequality of Jaccard distance, it links with none of zone 0; 1 is between."""
    near = _from_pivot(large)
    common = (F.col("n") + F.col("size") - F.octet_length("elements") / 8) / 2
    union = F.col("n") + F.col("size") - common
    zone = F.when(rule.den * common >= rule.num * union, 0).when(rule.den * common < (2 * rule.num - rule.den) * union, 2).otherwise(1)
    return near.select("class", "pivot", zone.alias("zone"))


def _refined(maps: DataFrame, rule: Rule, zones: DataFrame | None = None) -> DataFrame:
    """class, cluster, sets: candidate clusters made smaller. Within each (class, cluster, sets, n, bits) sets are joined only where sizes and bitmaps allow a link; those that can't link with any other go.

    Small clusters are compared whole, many to a task; of large ones blocks of bitmaps."""

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, task in pdf.sort_values(["task", "side", "class"]).groupby("task", sort=False):
            own = task["class"].to_numpy()
            root, some = _near(task["n"].to_numpy(np.int64), _same_width(list(task["bits"])), rule)
            out.append(pd.DataFrame({"a": own, "b": own[root]})[some])
        return pd.concat(out)

    few = maps.where(F.col("sets") <= BITMAP_SETS)
    n = max(1, few.count() // BITMAP_SETS)
    whole = few.select("class", "n", "bits", F.col("cluster").alias("task"), F.lit(0).alias("side"), F.pmod(F.xxhash64("cluster"), F.lit(n)).alias("bin"))
    edges = whole.groupBy("bin").applyInPandas(join_up, "a bigint, b bigint")
    large = maps.where(F.col("sets") > BITMAP_SETS)
    if not large.isEmpty():
        edges = edges.unionByName(_paired(large, rule, BITMAP_BLOCK, "bits", zones).groupBy("task").applyInPandas(join_up, "a bigint, b bigint"))
    found = stage(components(edges.where("a <> b")).withColumnsRenamed({"node": "class", "component": "cluster"}), "refined")
    sizes = stage(found.groupBy("cluster").agg(F.count("*").alias("sets")), "sizes")
    return stage(found.join(small(sizes), "cluster"), "refined", release=True)


def _links(sets: DataFrame, rule: Rule, zones: DataFrame | None = None) -> DataFrame:
    few = sets.where(F.col("sets") <= BLOCK_SETS)
    n = max(1, few.count() // BLOCK_SETS)
    # small clusters: whole, many to a bin
    out = _verify(few.select("class", "n", "elements", F.col("cluster").alias("task"), F.lit(0).alias("side"), F.pmod(F.xxhash64("cluster"), F.lit(n)).alias("bin")), rule)
    large = sets.where(F.col("sets") > BLOCK_SETS)
    if large.isEmpty():
        return out
    return out.unionByName(_verify(_paired(_from_pivot(large), rule, BLOCK_SETS, "elements", zones).withColumn("bin", F.col("task")), rule))
