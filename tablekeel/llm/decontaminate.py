"""Benchmark decontamination: a generalised suffix automaton of the test items.

Training words stream through the automaton, which tracks the longest match that ends at each
word. Matches of a window's length or more are hits; short items must occur as a whole.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import settle, table

#: Byte table: A-Z lower-cased; ASCII that is no letter or digit becomes a blank; the rest stays.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Words of items in one automaton, and automata that a pass over the documents takes along; further items take further passes.
BLOCK_WORDS, PER_PASS = 500_000, 4


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


@dataclass
class Automaton:
    """States of a generalised suffix automaton, in arrays, with what it takes to name windows and items."""

    vocab: dict[bytes, int]
    keys: array  # state * words + word of every transition, sorted
    targets: array
    link: array
    length: array
    window: int
    least: int  # words of the shortest window
    ends: array  # states in which a window of full length ends, sorted
    holders: list[frozenset[str]]  # items that hold these windows
    short: dict[int, list[tuple[int, str]]]  # state -> (words, item) of the short items that end in it or in its links

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
        vocab: dict[bytes, int] = {}
        steps: list[dict[int, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])

        def extend(last: int, c: int) -> int:
            if c in steps[last]:
                q = steps[last][c]
                return q if length[q] == length[last] + 1 else clone(last, c, q)
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                link[new] = q if length[q] == length[p] + 1 else clone(p, c, q)
            return new

        def clone(p: int, c: int, q: int) -> int:
            new = len(steps)
            steps.append(dict(steps[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = new
            while p >= 0 and steps[p].get(c) == q:
                steps[p][c] = new
                p = link[p]
            return new

        ids = [(item, [vocab.setdefault(w, len(vocab)) for w in ws]) for item, ws in items if ws]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = extend(last, c)
        moves = sorted((state * len(vocab) + c, to) for state, found in enumerate(steps) for c, to in found.items())
        steps.clear()
        self = cls(vocab, array("q", (k for k, _ in moves)), array("i", (t for _, t in moves)), link, length, window, min((min(len(s), window) for _, s in ids), default=1), array("i"), [], {})
        windows: dict[int, frozenset[str]] = {}
        same: dict[frozenset[str], frozenset[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for item, seq in ids:
            state, n = 0, 0
            for c in seq:
                state, n = self.step(state, n, c)
                if n >= window:
                    at = self.of_length(state, window)
                    held = windows.get(at, frozenset()) | {item}
                    windows[at] = same.setdefault(held, held)
            if len(seq) < window:
                ends.setdefault(state, []).append((len(seq), item))
        self.ends = array("i", sorted(windows))
        self.holders = [windows[at] for at in self.ends]
        if ends:
            for state in sorted(range(len(length)), key=length.__getitem__):
                if found := ends.get(state, []) + self.short.get(link[state], []):
                    self.short[state] = found
        return self

    def of_length(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def move(self, state: int, c: int) -> int:
        """The state that word ``c`` leads to, or -1."""
        key = state * len(self.vocab) + c
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        to = self.move(state, c)
        while to < 0 and state:
            state = self.link[state]
            n = self.length[state]
            to = self.move(state, c)
        return (0, 0) if to < 0 else (to, n + 1)

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of hit words, merged, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not text:
            return spans, found
        ids = np.array([self.vocab.get(w, -1) for w in text])
        # only stretches of item words that are as long as the shortest window can hold a match
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                state, n = self.step(state, n, c)
                hit = 0
                if n >= self.window:
                    hit = n
                    found |= self.holders[bisect_left(self.ends, self.of_length(state, self.window))]
                for m, item in self.short.get(state, ()):
                    if m <= n:
                        hit = max(hit, m)
                        found.add(item)
                if hit:
                    at = i - hit
                    while spans and spans[-1][1] >= at:
                        at = min(at, spans.pop()[0])
                    spans.append((at, i))
        return spans, found


def scan_all(automata: list[Automaton], text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of hit words, merged, and items over all automata."""
    parts = [a.scan(text) for a in automata]
    return merged([s for spans, _ in parts for s in spans]), {i for _, found in parts for i in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata over the items, each of about ``block_words`` words; the driver holds one block of texts at a time.

    A longer item is cut into pieces that overlap by a window less one word, so that every window
    is whole in one of them.
    """
    held: list[tuple[str, list[bytes]]] = []
    n = 0
    size = max(block_words, 2 * window)
    for r in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ws = words(r[1]) if r[0] is not None else []
        for at in range(0, max(1, len(ws) - window + 1), size - window + 1):
            if piece := ws[at : at + size]:
                held.append((r[0], piece))
                n += len(piece)
                if n >= block_words:
                    yield Automaton.build(held, window)
                    held, n = [], 0
    if held:
        yield Automaton.build(held, window)


def passes(items: DataFrame, window: int, block_words: int, per_pass: int) -> Iterator[tuple[list[Automaton], bool]]:
    """The automata of each pass over the documents, and whether it is the last; without items one pass without automata."""
    found = blocks(items, window, block_words)
    held = list(islice(found, per_pass))
    while following := list(islice(found, per_pass)):
        yield held, False
        held = following
    yield held, True


SPANS = "array<struct<a:int,b:int>>"
FOUND = f"doc_id string, text string, n_words long, spans {SPANS}, items array<string>"


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, block_words: int = BLOCK_WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """Return per row ``doc_id, n_words, spans`` (merged, of word numbers), ``items`` (sorted) and, with ``keep_text``, ``text``.

    Words are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z
    lower-cased. A window is ``window`` consecutive words of an item; an item of fewer words is one
    window. Hit words are those inside any occurrence of a window. Null and empty texts have no
    words. Items without an id or without words are passed over; rows that repeat an id are
    handled each by itself. Other columns are ignored. An empty table of documents gives an empty
    table, and without items nothing is hit. Items of more than ``block_words * per_pass`` words
    take several passes.
    """
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for automata, last in passes(items, window, block_words, per_pass):
        rows = rows.mapInPandas(scan_with(docs.sparkSession, automata, keep_text or not last), FOUND)
        rows = rows if last else settle(rows, "leaks")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", *["text"] * keep_text, "n_words", "spans", "items")


def scan_with(spark: SparkSession, automata: list[Automaton], keep_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One pass over rows of ``FOUND``: spans and items of these automata join those of the passes before."""
    sent = spark.sparkContext.broadcast(automata)  # bounded by the words of a block and the automata of a pass

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, before, names in zip(batch.doc_id, batch.text, batch.spans, batch["items"], strict=True):
                ws = words(text)
                spans, found = scan_all(sent.value, ws)
                spans = merged([*spans, *((s["a"], s["b"]) for s in before)])
                out.append((doc_id, text if keep_text else None, len(ws), [{"a": x, "b": y} for x, y in spans], sorted(found.union(names))))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_words", "spans", "items"])

    return scan


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words, a newline in place of each."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(TO_WORDS))]
    kept, last = [], 0
    for x, y in spans:
        kept.append(raw[last : at[x][0]])
        last = at[y - 1][1]
    return b"\n".join([*kept, raw[last:]]).decode()  # words end where characters do


def cut_out(text: str, automata: list[Automaton]) -> tuple[str, float]:
    """The text without its hit spans, and the share of its words that were hit at first."""
    covered = None
    while True:
        ws = words(text)
        spans = scan_all(automata, ws)[0]
        if covered is None:
            covered = sum(y - x for x, y in spans) / max(1, len(ws))
        if not spans:
            return text, covered
        text = without(text, spans)


def cleaner(spark: SparkSession, automata: list[Automaton]) -> Callable[[Column], Column]:
    sent = spark.sparkContext.broadcast(automata)  # bounded by the words of a block and the automata of a pass

    @F.pandas_udf("text string, covered double")
    def clean(texts: pd.Series) -> pd.DataFrame:
        out = [(t, 0.0) if t is None else cut_out(t, sent.value) for t in texts]
        return pd.DataFrame(out, columns=["text", "covered"])

    return clean.asNondeterministic()  # else the filter on its result would run it a second time


def marker(spark: SparkSession, automata: list[Automaton]) -> Callable[[Column, Column], Column]:
    sent = spark.sparkContext.broadcast(automata)  # bounded by the words of a block and the automata of a pass

    @F.pandas_udf(SPANS)
    def mark(texts: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([[{"a": x, "b": y} for x, y in merged([*scan_all(sent.value, words(t))[0], *((s["a"], s["b"]) for s in found)])] for t, found in zip(texts, before, strict=True)])

    return mark


def cutter() -> Callable[[Column, Column], Column]:
    @F.pandas_udf("text string, covered double")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [(without(t, [(s["a"], s["b"]) for s in found]), sum(s["b"] - s["a"] for s in found) / len(words(t))) for t, found in zip(texts, spans, strict=True)]
        return pd.DataFrame(out, columns=["text", "covered"])

    return cut.asNondeterministic()


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = 10, max_covered: float = 0.5, text_col: str = "text", block_words: int = BLOCK_WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """The rows with the spans of hit words removed from their texts, all other columns as they were.

    What comes together where a span was removed is searched again until nothing is hit. Rows of
    whose words more than ``max_covered`` are hit at first go altogether. Items of more than
    ``block_words * per_pass`` words take several passes: all of them mark what they hit before
    anything is cut, and rows that were cut are searched again.

    Null and empty texts stay as they are, and so do rows that repeat an id. Items without an id or
    without words are passed over. An empty table gives an empty table.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    spark, back = docs.sparkSession, [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    automata, last = next(passes(items, window, block_words, per_pass))
    if last:
        done = rows.select("row", cleaner(spark, automata)(F.col("text")).alias("clean")).where(F.col("clean.covered") <= max_covered)
        return done.select("row", "clean.text").select(*back)
    clean, most = [], max_covered
    while True:
        rows = rows.withColumn("spans", F.array().cast(SPANS))
        for automata, _ in passes(items, window, block_words, per_pass):
            rows = settle(rows.withColumn("spans", marker(spark, automata)("text", "spans")), "marked")
        clean.append(rows.where(F.size("spans") == 0).select(*back))
        hit = rows.where(F.size("spans") > 0).select("row", cutter()("text", "spans").alias("clean"))
        rows = settle(hit.where(F.col("clean.covered") <= most).select("row", "clean.text"), "cut")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, clean)
        most = 1.0


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in all documents; nulls, repeats, long texts and empty tables go as in ``find_leaks``."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
