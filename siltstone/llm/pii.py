"""Personal data: base detectors, and a character tagger for forms that they miss."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, sliced, tidy
from .tagger import Tagger, codes

#: Kinds in order, and base detectors: fixed values.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")

#: Windows of labelled spans that the tagger learns from, at most; those with the least hashes are taken.
TRAINING_WINDOWS = 1500
INVENTED_WINDOWS = 1500
STEPS = 320

WINDOW = 96
STRIDE = 48
MARGIN = 40

#: Windows that are decoded together; a text may have many more.
DECODED_WINDOWS = 4096

#: Only around these can the tagger find anything: every kind has a digit, an @ or a spelt-out one.
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.IGNORECASE | re.ASCII)

#: A spelt-out dot carries a domain on; the tagger looks around it too, but doesn't learn from it.
SEARCH = re.compile(TRIGGER.pattern + r"|[(\[{] ?dot ?[)\]}]", re.IGNORECASE | re.ASCII)

#: The sign of an address and the domain behind it.
AT_DOMAIN = re.compile(r"(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+)*", re.IGNORECASE | re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but without its squared time on long runs: from each @ leftward."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind, then start; code points, end exclusive."""
    found = [(a, b, "email") for a, b in _emails(text)]
    if not DIGITS.search(text):
        return found
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


def _plausible(kind: str, value: str) -> bool:
    """What the tagger marks must still have the make-up of its kind."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]+)+", value, re.IGNORECASE | re.ASCII))
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(map(_octet, parts)) and bool(re.fullmatch(r"[0-9]+(?:(?: ?\. ?|\[\.\])[0-9]+){3}", value))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[./  _-]{0,2}[0-9])+", value))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9][  ()./0-9-]+[0-9]", value)) and bool(re.search(r"[  ()./-]", value))


def _regions(text: str, trigger: re.Pattern = TRIGGER, whole: bool = False) -> list[tuple[int, int]]:
    """The surroundings of the triggers; with whole, on to where the run of characters of an address at their edges ends."""
    out: list[list[int]] = []
    for m in trigger.finditer(text):
        if whole and out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if whole:
            least = out[-1][1] if out else 0
            while a > least and text[a - 1] in LOCAL:
                a -= 1
            while b < len(text) and text[b] in LOCAL:
                b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _windows(a: int, b: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows of a region."""
    for start in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE):
        yield start, min(start + WINDOW, b)


class _Region:
    """A stretch of a text with the tags of its characters, three bytes for each, and how far from its window's edges each was tagged."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        self.tags, self.depth = np.zeros(b - a, np.int8), np.full(b - a, -1, np.int16)

    def put(self, s: int, e: int, tags: np.ndarray) -> None:
        # an edge of the region has nothing beyond it and is as good as a middle
        most = np.full(e - s, 1 << 14)
        left = np.arange(e - s) if s > self.a else most
        right = np.arange(e - s)[::-1] if e < self.b else most
        depth = np.minimum(left, right)
        part = slice(s - self.a, e - self.a)
        better = depth > self.depth[part]
        self.tags[part][better] = tags[better]
        self.depth[part][better] = depth[better]

    def spans(self, kinds: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
        start, tags = 0, self.tags
        inside = np.zeros(len(tags) + 1, bool)
        inside[1:-1] = (tags[1:] > 0) & (tags[1:] % 2 == 0) & (tags[:-1] > 0) & ((tags[1:] + 1) // 2 == (tags[:-1] + 1) // 2)
        for i in np.flatnonzero(~inside[1:]) + 1:
            if tags[start]:
                yield self.a + start, self.a + int(i), kinds[(int(tags[start]) - 1) // 2]
            start = int(i)


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger sees in each text. Windows of several texts are decoded together, a bounded number at a time; where
    windows overlap, each character has the tag from the window in whose middle it lies nearest; spans are then read over the
    whole region."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    pending: list[tuple[int, _Region, int, int, bool]] = []

    def decode() -> None:
        found = tagger.decode([codes(texts[k][s:e]) for k, _, s, e, _ in pending])
        for (k, region, s, e, last), tags in zip(pending, found, strict=True):
            region.put(s, e, tags)
            if last:
                out[k] += region.spans(tagger.kinds)
        pending.clear()

    for k, text in enumerate(texts):
        for a, b in _regions(text, SEARCH, whole=True):
            region = _Region(a, b)
            for s, e in _windows(a, b):
                pending.append((k, region, s, e, e == b))
                if len(pending) >= DECODED_WINDOWS:
                    decode()
    decode()
    return out


def _grown(text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged address to its ends: all of its local part, and all of its domain behind the sign."""
    m = AT_DOMAIN.search(text, a)
    if not m or m.start() >= b:
        return a, b
    while a > 0 and text[a - 1] in LOCAL:
        a -= 1
    return a, max(b, m.end())


def all_spans(text: str, base: list[tuple[int, int, str]], tagged: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans, and plausible tagged ones that touch none of them, addresses to their ends; by kind, then start."""
    added: list[tuple[int, int, str]] = []
    held = Taken((s, e) for s, e, _ in base)
    for a, b, kind in tagged:
        while b > a and text[b - 1] in " .,;:":
            b -= 1
        while a < b and text[a] in " ":
            a += 1
        for start, end in dict.fromkeys([_grown(text, a, b), (a, b)] if kind == "email" else [(a, b)]):
            if _plausible(kind, text[start:end]) and held.take(start, end):
                added.append((start, end, kind))
                break
    return sorted([*base, *added], key=lambda x: (KINDS.index(x[2]), x[0]))


def invented(count: int, seed: int, contexts: list[str]) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Labelled windows with forms beyond the base ones, in surroundings taken from the texts (or plain words where there are none)."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))

    def email() -> str:
        at = rng.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] "])
        dot = rng.choice([".", ".", ".", "[dot]", " (dot) "]) if at != "@" else "."
        return f"{word(2, 8)}{rng.choice(['', '.', '_', '-'])}{rng.choice([word(1, 6), digits(2)])}{at}{dot.join([word(3, 8), *(word(3, 7) for _ in range(rng.randint(0, 1))), rng.choice(['com', 'net', 'org', 'de', 'fr', 'es'])])}"

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice([14, 14, 14, 13, 11]))
        body += next(d for d in "0123456789" if luhn(body + d))
        by = rng.choice(["", " ", "-", ".", "/", "  ", "_"])
        return by.join(body[k : k + 4] for k in range(0, len(body), 4))

    def ip() -> str:
        return rng.choice([".", ".", " . ", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"00{rng.randint(10, 99)} {a} {b} {c}", f"0{a}/{b}{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"])

    def other() -> str:
        return rng.choice([digits(rng.randint(1, 8)), f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}", f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23)}:{digits(2)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"{digits(3)},{digits(3)}.{digits(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))), f"@{word(3, 9)}", "(at)", f"{word(4, 8)}={digits(4)}{word(3, 6)}", f"https://{word(3, 9)}.com/{digits(5)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, None: other}
    texts, spans = [], []
    for _ in range(count):
        text, own = "", []
        for _ in range(rng.randint(1, 2)):
            around = rng.choice(contexts) if contexts and rng.random() < 0.8 else " ".join(word(2, 8) for _ in range(8))
            cut = rng.randint(0, max(0, len(around) - 20))
            text += around[cut : cut + rng.randint(0, 30)]
            text += rng.choice([" ", " ", " ", ": ", "\n", " (", "<", ""]) if text else ""
            kind = rng.choice([*KINDS, "email", "phone", None, None])
            value = makers[kind]()
            if kind:
                own.append((len(text), len(text) + len(value), kind))
            text += value + rng.choice([" ", " ", ". ", ", ", "\n", ") "])
        around = rng.choice(contexts) if contexts else " ".join(word(2, 8) for _ in range(4))
        texts.append((text + around[:20])[:WINDOW])
        spans.append([x for x in own if x[1] <= len(texts[-1])])
    return texts, spans


def training_windows(df: DataFrame, text_col: str = "text", most: int = TRAINING_WINDOWS) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Windows of the corpus around characters that can belong to personal data, labelled by the base detectors; at most `most`, those with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a heap of the task's least hashes, largest first: it never holds more windows than are asked for
        rows: dict[str, str] = {}
        largest: list[tuple[int, str]] = []
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for a, b in _regions(text):
                    part = text[a : min(b, a + WINDOW)]
                    key = hashlib.md5(part.encode()).hexdigest()
                    if key in rows:
                        continue
                    rows[key] = part
                    heapq.heappush(largest, (-int(key, 16), key))
                    if len(rows) > most:
                        del rows[heapq.heappop(largest)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.string())], ["hash", "part"])

    windows = df.where(F.col(text_col).rlike("[0-9@]")).select(text_col).mapInArrow(run, "hash string, part string")
    parts = [r["part"] for r in windows.groupBy("hash").agg(F.first("part").alias("part")).orderBy("hash").limit(most).collect()]
    return parts, [base_spans(p) for p in parts]


def fit(df: DataFrame, text_col: str = "text", most: int = TRAINING_WINDOWS, steps: int = STEPS) -> Tagger:
    """Trains a tagger on a bounded sample of labelled windows of the corpus and on invented ones in its surroundings; the same corpus gives the same tagger."""
    texts, spans = training_windows(df, text_col, most)
    plain = [t for t, own in zip(texts, spans, strict=True) if not own and not DIGITS.search(t)] + [re.sub(r"\S*[0-9@]\S*", "", t) for t in texts[:300]]
    more, labels = invented(INVENTED_WINDOWS, 11, [t for t in plain if len(t) > 40])
    tagger = Tagger(KINDS)
    tagger.train(texts + more, spans + labels, steps)
    return tagger


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(df: DataFrame, tagger: Tagger, text_col: str = "text", mask: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added; with mask also `masked`, the text with each span replaced by its kind in angle brackets (of spans that overlap, the union by the first one's kind).

    Null texts are empty: no spans, and masked is null. Whole texts are searched. One pass, no shuffle. Columns of those
    names are replaced. Repeated rows give equal rows; an empty table gives none."""
    added = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *(["masked"] if mask else [])]
    kept = df.drop(*added)
    names = kept.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint" + ", masked string" * mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [all_spans(*x) for x in zip(texts, base, tagged_spans(texts, tagger), strict=True)]
            counts = [Counter(x[2] for x in own) for own in base]
            columns = [pa.array([c[kind] for c in counts], pa.int64()) for kind in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()))
            columns.append(pa.array([joined(x) for x in every], pa.string()))
            columns.append(pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64()))
            if mask:
                given = batch.column(at).is_null().to_pylist()
                columns.append(pa.array([None if null else masked(t, x) for null, t, x in zip(given, texts, every, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added])

    return kept.mapInArrow(tidy(run), fields)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]
