"""GeoJSON files of any size and shape, split into features by their structure.

Whether a brace ends a feature depends on the depth of brackets and on whether it stands in a string. Ranges are cut at
closing braces and summed up for both states in which they may begin, outside and inside of a string: where they end,
how much deeper, and which keys they pass at which depth. Composed in order, this gives each range's true state, with
which its features are cut out. Nothing is asked of the order of keys, of line breaks or of what strings hold.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import cut_records, read_pieces, start_states

_COLON = re.compile(rb"\s*:")
_FEATURES = b'"features"'
#: Outside of strings, at depth 0, of a root unknown, not in "features", which hasn't come.
FIRST = (False, 0, b"", False, False)

_DEEPER = np.zeros(256, np.int8)
_DEEPER[list(b"{[")], _DEEPER[list(b"}]")] = 1, -1


class Marks:
    """The quotes and brackets of some bytes that end with a brace, so that no escape and no key runs on behind them."""

    def __init__(self, data: bytes):
        self.data, a = data, np.frombuffer(data, np.uint8)
        self.bytes = a
        quotes = np.flatnonzero(a == ord('"'))
        slashes = np.flatnonzero(a == ord("\\"))
        if len(slashes):
            last = np.flatnonzero(np.diff(slashes, append=-1) != 1)  # of each run
            after = slashes[last[np.diff(last, prepend=-1) % 2 == 1]] + 1
            escaped = np.zeros(len(a) + 1, bool)
            escaped[after] = True
            quotes = quotes[~escaped[quotes]]
        self.quotes = quotes
        at = np.flatnonzero(_DEEPER[a])
        self.all, self.before = at, np.searchsorted(quotes, at)

    def read(self, in_string: bool):
        """(places of brackets outside of strings, how much deeper each leads, keys' places, whether each is "features", whether the end is in a string)."""
        at = self.all[self.before % 2 == in_string]
        opens, closes = self.quotes[in_string::2], self.quotes[1 - in_string :: 2]
        if in_string:  # the first string began before
            opens = np.concatenate([np.array([-1]), opens])
        opens = opens[: len(closes)]
        after = self.bytes[closes + 1]
        key = after == ord(":")
        for i in np.flatnonzero((after == 32) | ((after >= 9) & (after <= 13))):
            key[i] = _COLON.match(self.data, closes[i] + 1) is not None
        begin, end = opens[key], closes[key]
        found = (end - begin == len(_FEATURES) - 1) & (begin >= 0)
        for i in np.flatnonzero(found):
            found[i] = self.data[begin[i] : end[i] + 1] == _FEATURES
        return at, _DEEPER[self.bytes[at]].astype(np.int64), end, found, bool((len(self.quotes) + in_string) % 2)


class Guess:
    """What a range is if it begins outside, or inside, of a string."""

    def __init__(self, in_string: bool):
        self.in_string, self.depth, self.root, self.keys, self.seen = in_string, 0, b"", {}, set()

    def push(self, marks: Marks) -> None:
        at, deeper, keys, found, self.in_string = marks.read(self.in_string)
        if not self.root:
            first = at[deeper > 0][:1]
            self.root = b"".join(marks.data[i : i + 1] for i in first)
        depths = np.concatenate([[self.depth], self.depth + np.cumsum(deeper)])
        if len(keys):
            there = depths[np.searchsorted(at, keys)]
            low = there.min()
            last = np.zeros(there.max() - low + 1, np.int64) - 1
            last[there - low] = np.arange(len(there))  # of a depth's keys the last one stays
            self.keys.update((int(low + d), bool(found[i])) for d, i in enumerate(last) if i >= 0)
            self.seen.update(there[found].tolist())
        self.depth = int(depths[-1])


class Summary:
    def __init__(self, start: int):
        self.guesses = [Guess(False), Guess(True) if start else None]

    def push(self, piece: bytes) -> None:
        self.push_all([piece])

    def push_all(self, pieces: list[bytes]) -> None:
        marks = Marks(b"}".join(pieces) + b"}")
        for guess in self.guesses:
            if guess is not None:
                guess.push(marks)

    def plain(self):
        return [guess and (guess.in_string, guess.depth, guess.root, guess.keys, guess.seen) for guess in self.guesses]


def step(state, guesses):
    in_string, depth, root, features, seen = state
    ends_in_string, deeper, first, keys, features_at = guesses[in_string]
    root = root or first
    top = 1 - depth  # the root's keys stand at depth 1
    return ends_in_string, depth + deeper, root, keys.get(top, features), seen or (root == b"{" and top in features_at)


class Elements:
    """Cuts out the objects of a root array, those in the root's "features", or, where it has none, the root itself."""

    def __init__(self, state, last):
        self.in_string, self.depth, root, self.features, _ = state
        root = last[2]
        self.level = 1 if root == b"[" else 2 if last[4] else 0
        self.held = []
        self.inside = self.depth > self.level and (self.level != 2 or self.features)

    def push(self, piece: bytes) -> list[bytes]:
        return self.push_all([piece])

    def push_all(self, pieces: list[bytes]) -> list[bytes]:
        data = b"}".join(pieces) + b"}"
        marks = Marks(data)
        at, deeper, keys, found, self.in_string = marks.read(self.in_string)
        after = self.depth + np.cumsum(deeper)
        before = after - deeper
        kind = marks.bytes[at]
        begins = at[(kind == ord("{")) & (before == self.level)]
        ends = at[(kind == ord("}")) & (after == self.level)]
        wanted = np.ones(len(begins), bool)
        if self.level == 2:  # whether the last key of the root is "features"
            depths = np.concatenate([[self.depth], after])
            top = depths[np.searchsorted(at, keys)] == 1
            keys, found = keys[top], np.concatenate([[self.features], found[top]])
            wanted = found[np.searchsorted(keys, begins)]
            self.features = bool(found[-1])
        if len(after):
            self.depth = int(after[-1])
        out = []
        if self.inside:
            end = int(ends[0]) + 1 if len(ends) else len(data)
            self.held.append(data[:end])
            if not len(ends):
                return []
            out.append(b"".join(self.held))
            self.held, self.inside = [], False
        # each object ends with the first end behind its begin
        close = np.searchsorted(ends, begins)
        whole = wanted & (close < len(ends))
        out.extend(data[i:j] for i, j in zip(begins[whole].tolist(), (ends[close[whole]] + 1).tolist()))
        open_ = begins[wanted & (close == len(ends))]
        if len(open_):
            self.inside = True
            self.held = [data[int(open_[0]) :]]
        return out

    def rest(self) -> bytes:
        return b"".join(self.held)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the JSON of each feature of GeoJSON files; of a file that is one feature or a bare shape, that."""
    pieces = read_pieces(spark, path, b"}")
    states = start_states(pieces, Summary, step, FIRST)
    return cut_records(pieces, states, Elements, FIRST).select("file", F.decode("raw", "UTF-8").alias("value"))
