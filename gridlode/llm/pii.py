"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds spans the patterns miss.

The tagger is trained in numpy from labelled spans: windows of a bounded sample of whole documents with the base
patterns' spans, windows in which such spans are written in other ways (other separators, no country code,
spaces around the at sign), and windows around other signs and digits. A text is cut into overlapping windows; each is decoded, and the spans of all windows of
a text are reconciled globally: of those that overlap, the set with the largest total of length times confidence
stays. A found span must hold an at sign (email), four numbers up to 255 (ip), or a fitting number of digits (others;
those of a card pass Luhn's test); so windows with neither
sign nor digit can give no span and aren't decoded, which leaves the result the same. Model spans that touch a base
span are dropped: base spans always stay.

Defined results: null and empty texts have no spans; positions are code points; the four counts and base_sha256 are
of the base spans; repeated rows are searched alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from heapq import nsmallest
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .common import checkpoint
from .hashing import column, pieces
from .tagger import KINDS

WINDOW, OVERLAP = 128, 48
#: The bound on the documents that training windows are taken from, and on the windows: a third for each group of them.
SAMPLE_DOCS, SAMPLE_WINDOWS = 800, 1800
#: Windows around synthetic spans, besides.
SYNTHETIC = 1200
#: Updates of the weights in training, each from a batch of windows.
UPDATES, BATCH = 320, 64
SURE = 0.6

# The base patterns.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = {"card": (13, 19), "phone": (7, 15)}
SIGN = "[0-9@]"
#: Letters about as often as in names.
LETTERS = "eeeetaaaoooiiinnnsssrrrhlldcumfpgwybvkxjqz"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping local@domain.part spans, in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start, then by kind as listed."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def window_starts(text: str, every: bool = False) -> list[int]:
    """Starts of the windows of a text; only of those with a sign or digit unless `every`."""
    step = WINDOW - OVERLAP
    last = max(0, -(-(len(text) - WINDOW) // step))
    if every:
        return [k * step for k in range(last + 1)]
    wanted = set()
    for m in re.finditer(SIGN, text):
        p = m.start()
        wanted.update(range(max(0, -(-(p - WINDOW + 1) // step)), min(last, p // step) + 1))
    return [k * step for k in sorted(wanted)]


def _fits(kind: str, text: str) -> bool:
    if kind == "email":
        return "@" in text
    numbers = re.findall("[0-9]+", text)
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    digits = "".join(numbers)
    low, high = DIGITS[kind]
    return low <= len(digits) <= high and (kind != "card" or luhn(digits))


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, str, int]]:
    """(start, end, kind, confidence) of all windows of a text -> the best set without overlaps, by start."""
    best: dict[tuple, float] = {}
    for s, e, k, p in found:
        best[s, e, k] = max(p, best.get((s, e, k), 0))
    spans = sorted(((e, s, k, p) for (s, e, k), p in best.items()))
    ends = [x[0] for x in spans]
    value, take = [0.0], []
    for i, (e, s, k, p) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], s, side="right"))
        gain = value[before] + (e - s) * p
        take.append((gain > value[i], before))
        value.append(max(gain, value[i]))
    out, i = [], len(spans)
    while i:
        used, before = take[i - 1]
        if used:
            e, s, k, _ = spans[i - 1]
            out.append((s, k, e))
        i = before if used else i - 1
    return out[::-1]


def model_spans(w: dict, texts: list[str], every: bool = False) -> list[list[tuple[int, str, int]]]:
    """The reconciled spans of the tagger in each text."""
    where = [(i, s) for i, t in enumerate(texts) for s in window_starts(t, every)]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(where), 256):
        part = where[at : at + 256]
        ids = np.zeros((len(part), WINDOW), np.int16)
        for row, (i, s) in zip(ids, part):
            x = tagger.symbols(texts[i][s : s + WINDOW])
            row[: len(x)] = x
        e = tagger.emissions(w, ids)
        tags = tagger.viterbi(w, e)
        hit = np.flatnonzero(tags.any(axis=1))
        if not len(hit):
            continue
        marginal = np.exp(tagger.forward_backward(w, e[:, hit])[1])
        for row, j in enumerate(hit):
            i, s = part[j]
            for k, a, b in tagger.spans_of(tags[j]):
                b = min(b, len(texts[i]) - s)
                text = texts[i][s + a : s + b]
                a, b = a + len(text) - len(text.lstrip()), b - len(text) + len(text.rstrip())
                if a >= b or not _fits(KINDS[k], text):
                    continue
                p = float(marginal[np.arange(a, b), row, tags[j, a:b]].min())
                if p >= SURE:
                    found[i].append((s + a, s + b, KINDS[k], p))
    return [reconcile(f) for f in found]


def all_spans(base: list, added: list) -> list:
    """Base spans (by start), and those added that touch none of them, by start, then by kind."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    touched = lambda s, e: (n := bisect_left(starts, e)) and reach[n - 1] > s
    free = [x for x in added if not touched(x[0], x[2])]
    return sorted([*base, *free], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def variants(kind: str, text: str, r: np.random.Generator) -> str:
    """Another way to write a span, which the base patterns miss or cut short."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        name, _, host = text.partition("@")
        return f"{name}{pick(' @ ', '@ ', ' @', '(@)', '[@]', ' (@) ')}{host}"
    if kind == "ip":
        return pick(" . ", ". ", "[.]", " .", "(.)").join(text.split("."))
    if kind == "card":
        size = pick(4, 4, 4, 5)
        return pick("-", " ", ".", " - ", " . ", "/").join(digits[i : i + size] for i in range(0, len(digits), size))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b} {c}", f"{a} {b} {c}", f"{a}/{b}-{c}")


def synthetic(kind: str, r: np.random.Generator) -> str:
    """A span of a kind, for samples that hold few."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda n: "".join(LETTERS[int(x)] for x in r.integers(0, len(LETTERS), n))
    if kind == "email":
        name = word(r.integers(2, 10)) + pick("", "", number(2), pick(".", "_", "-") + word(r.integers(2, 9)), "." + number(2))
        return f"{name}@{pick('', '', 'mail.', word(3) + '.')}{word(r.integers(3, 10))}.{pick('com', 'org', 'net', 'de', 'edu', 'info')}"
    if kind == "ip":
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        body = number(pick(15, 15, 15, 14, 18))
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{r.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}"


def windows_of(text: str):
    """(group, window, spans in it) of a whole text: around base spans, around rewritten ones, around each other sign."""
    r = np.random.default_rng(zlib.crc32(text.encode()))
    spans = base_spans(text)
    starts, free = [s for s, _, _ in spans], np.ones(len(text) + 3, bool)

    def inside(lo):
        own = spans[bisect_left(starts, lo) : bisect_left(starts, lo + WINDOW)]
        return text[lo : lo + WINDOW], [(a - lo, q, b - lo) for a, q, b in own if b <= lo + WINDOW]

    for s, k, e in spans:
        free[max(0, s - 2) : e + 3] = False
        yield 0, *inside(max(0, s - int(r.integers(0, WINDOW - min(WINDOW - 1, e - s)))))
        new = variants(k, text[s:e], r)
        left, right = text[max(0, s - int(r.integers(8, 60))) : s], text[e : e + WINDOW]
        if not base_spans(left):
            yield 1, (left + new + right)[:WINDOW], [(len(left), k, len(left) + len(new))]
    for m in re.finditer(SIGN, text):
        if free[m.start()]:
            yield 2, *inside(max(0, m.start() - int(r.integers(10, 90))))


def _drawn_windows(batches):
    """The windows of all texts, of each group those with the least draws; a task keeps SAMPLE_WINDOWS of them at most."""
    kept: list[list] = [[], [], []]
    for part in pieces(batches):
        for text in column(part, "text").to_pylist():
            for i, (group, window, spans) in enumerate(windows_of(text)):
                kept[group].append((zlib.crc32(f"{i} {window}".encode()), window, joined(spans)))
                if len(kept[group]) > 2 * SAMPLE_WINDOWS:
                    kept[group] = nsmallest(SAMPLE_WINDOWS, kept[group])
    for group, rows in enumerate(kept):
        rows = nsmallest(SAMPLE_WINDOWS, rows)
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(rows), pa.int32()), *(pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["g", "draw", "window", "spans"])


def training_windows(rows: list[tuple[str, str]], seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: those drawn (window, spans as text), and windows around synthetic spans, most of them rewritten."""
    r = np.random.default_rng(seed)
    plain = [re.sub(SIGN, "", w) for w, _ in rows] or ["some plain words of a text with a few numbers in it"]
    pairs = [(w, [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]) for w, spans in rows]
    for i in range(SYNTHETIC):
        k = KINDS[i % 4]
        t = plain[int(r.integers(len(plain)))]
        at = int(r.integers(0, len(t) + 1))
        left, right = t[max(0, at - int(r.integers(8, 60))) : at].rstrip() + " ", " " + t[at:].lstrip()
        new = synthetic(k, r)
        new = variants(k, new, r) if i % 16 >= 4 else new
        pairs.append(((left + new + right)[:WINDOW], [(len(left), k, len(left) + len(new))]))
    pairs = [pairs[i] for i in r.permutation(len(pairs))]
    ids, tags = np.zeros((len(pairs), WINDOW), np.int16), np.zeros((len(pairs), WINDOW), np.int64)
    for x, y, (t, spans) in zip(ids, tags, pairs):
        s = tagger.symbols(t)
        x[: len(s)] = s
        for a, k, b in spans:
            if b <= len(t):
                y[a:b] = 2 + 2 * KINDS.index(k)
                y[a] -= 1
    return ids, tags


def fit(docs: DataFrame) -> dict:
    """Weights trained on windows of a bounded sample: at most SAMPLE_DOCS different texts with a sign or digit, taken whole.

    Tasks cut their windows; the driver gets SAMPLE_WINDOWS of them at most.
    """
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    share = min(1.0, (1.5 * SAMPLE_DOCS + 100) / max(docs.count(), 1))
    near = docs.select("text", draw.alias("d")).where(F.col("d") < int(share * (1 << 30)) + 1).where(F.col("text").rlike(SIGN))
    last = near.select("d").distinct().orderBy("d").limit(SAMPLE_DOCS).agg(F.max("d")).head()[0] or 0
    texts = near.where(F.col("d") <= last).groupBy("d").agg(F.min("text").alias("text"))
    found = checkpoint(texts.select("text").mapInArrow(_drawn_windows, "g int, draw long, window string, spans string"))
    rows = []
    for g in range(3):
        rows += found.where(F.col("g") == g).orderBy("draw", "window").limit(SAMPLE_WINDOWS // 3).collect()
    ids, tags = training_windows([(r["window"], r["spans"]) for r in rows])
    return tagger.train(ids, tags, -(-UPDATES * BATCH // len(ids)), BATCH)


def find(docs: DataFrame, weights: dict) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        w = shared.value
        for part in pieces(batches, most=8 << 20):
            n = len(part)
            counts, digest, spans, more = np.zeros((5, n), np.int64), [nothing] * n, [""] * n, 0
            text = column(part, "text").fill_null("")
            at = np.flatnonzero(pc.match_substring_regex(text, SIGN).to_numpy(zero_copy_only=False))
            texts = text.take(pa.array(at)).to_pylist()
            for i, t, added in zip(at, texts, model_spans(w, texts)):
                base = base_spans(t)
                for _, k, _ in base:
                    counts[KINDS.index(k), i] += 1
                both = all_spans(base, added)
                counts[4, i] = len(both) - len(base)
                digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(both)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), *(pa.array(c) for c in counts[:4]), pa.array(digest), pa.array(spans), pa.array(counts[4])], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Trains the tagger on docs (doc_id, text) and finds the spans of every row."""
    return find(docs, fit(docs))
