"""Best-fit packing: a configuration linear program over the histogram of lengths.

The program is solved by multiplicative weights, priced by a knapsack dynamic program, and
rounded; what rounding leaves is packed best fit first. All of that works on counts by length, of
which there are at most as many as tokens in a sequence. Rows are placed by their rank among the
rows of their length, so the number of documents never reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablekeel.llm.common import rank_within, salts_for, settle, table

#: Characters that neither normal form C nor a special rule of lower-casing changes, and that hold no white space but these four.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ‐-‧‰-⁞]*")
#: The vocabulary file's own pattern for its words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Memory(dict):
    """What ``make`` gives for a key, made once; what was not used between two calls of ``forget`` goes."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.former = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.former.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def forget(self) -> None:
        self.former = dict(self)
        self.clear()


class Words:
    """Ids (little-endian unsigned 32 bits) of texts; their distinct words are tokenised once."""

    def __init__(self, path: str, remembered: int = 300_000) -> None:
        """``remembered``: distinct words that a Python worker collects before it forgets those unused since it last did."""
        self.whole, self.remembered = Tokenizer.from_file(path), remembered
        self.control = [t.content for t in self.whole.get_added_tokens_decoder().values()]  # these strings in a text have ids of their own
        self.model, self.words = self.whole.model, Memory(self.word)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.as_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def word(self, word: str) -> bytes:
        if not word.isalpha():  # letters alone are one part
            parts = WORD.findall(word)
            if parts != [word]:
                return b"".join(map(self.words.__getitem__, parts))
        seen = word if word.isascii() else "".join(map(self.as_chars.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(x in text for x in self.control)

    def each(self, texts: pa.Array, at_once: int = 1 << 22) -> Iterator[bytes]:
        """Ids of each text, null as empty. Texts that begin within the same ``at_once`` bytes are taken together."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // at_once
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield from self.together(texts.slice(lo, hi - lo))

    def together(self, texts: pa.Array) -> Iterator[bytes]:
        """Each distinct word of these texts is looked up once, then its ids are put at all its places."""
        whole = texts.to_pylist()
        plain = np.array([self.plain(t) for t in whole], bool)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(plain), texts, "")))
        words = lists.flatten().dictionary_encode()
        if len(self.words) > self.remembered:
            self.words.forget()
        found = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // 4
        known, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n_ids) - n_ids
        word = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(n_ids[word])])
        ids = known[np.repeat(first[word] - ends[:-1], n_ids[word]) + np.arange(ends[-1])]
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])].tolist()
        for k, text in enumerate(whole):
            yield ids[at[k] : at[k + 1]].tobytes() if plain[k] else np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return next(self.each(pa.array([text])))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_words: dict[str, Words] = {}  # kept by a Python worker from task to task


def tokenised(docs: DataFrame, path: str, size: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per piece of at most ``size`` tokens ``doc_id, piece, start, length, ids_crc32``.

    Null text is empty; every text ends with ``end_id``. Rows that repeat an id or a text are
    tokenised each by itself, long texts whole; an empty table gives an empty one.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words.get(path) or _words.setdefault(path, Words(path))
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.each(batch.column("text")), strict=True):
                ids += end
                out += [(doc_id, k, at // 4, min(4 * size, len(ids) - at) // 4, zlib.crc32(ids[at : at + 4 * size])) for k, at in enumerate(range(0, len(ids), 4 * size))]
            columns = zip(*out, strict=True) if out else [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((index of a length, how often), ...), copies


def knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth of any multiset of lengths within each capacity, and the length it takes first (-1: none)."""
    best, first = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(lengths[0]), size + 1):
        fit = np.searchsorted(lengths, room, side="right")
        values = best[room - lengths[:fit]] + worth[:fit]
        k = int(values.argmax())
        if values[k] > best[room - 1]:
            best[room], first[room] = values[k], k
        else:
            best[room], first[room] = best[room - 1], first[room - 1] if first[room - 1] < 0 else -2
    return best, first


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = 16, rate: float = 4.0) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional copies of configurations that cover ``counts``, never more than that.

    Each round prices lengths by what they take up, times a weight that falls exponentially with
    the share covered so far. The knapsack's table then gives, for every length, the best
    configuration that holds it; near-optimal ones advance until one of their lengths has its
    share of this round.
    """
    copies: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    for r in range(1, rounds + 1):
        worth = lengths / size * np.exp(-rate * (covered / counts - (r - 1) / rounds))
        best, first = knapsack(lengths, worth, size)
        value = best[size - lengths] + worth
        for i in np.argsort(-value, kind="stable").tolist():
            if covered[i] >= counts[i] * r / rounds:
                continue
            held, room = defaultdict(int, {i: 1}), size - int(lengths[i])
            while room >= lengths[0] and first[room] != -1:
                if first[room] == -2:  # no better than with one token less
                    room -= 1
                    continue
                k = int(first[room])
                held[k] += 1
                room -= int(lengths[k])
            step = min((counts[k] * r / rounds - covered[k]) / n for k, n in held.items())
            if step <= 0:
                continue
            copies[tuple(sorted(held.items()))] += step
            for k, n in held.items():
                covered[k] += step * n
    return copies


def pack_counts(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[Pattern]:
    """Whole copies of configurations that hold each length exactly as often as it occurs."""
    left, out = counts.copy(), []

    def take(held: tuple[tuple[int, int], ...], most: int) -> None:
        n = min(most, *(int(left[k]) // a for k, a in held)) if len(held) > 1 else min(most, int(left[held[0][0]]) // held[0][1])
        if n > 0:
            for k, a in held:
                left[k] -= n * a
            out.append((held, n))

    part = lengths < size
    if part.any():
        at = np.flatnonzero(part)
        for held, x in sorted(solve(lengths[at], counts[at], size).items(), key=lambda c: (-c[1], c[0])):
            if x >= 1:
                take(tuple((int(at[k]), a) for k, a in held), int(x))
    # what rounding leaves: the longest first, each time the longest that still fits
    rest = [k for k in range(len(lengths)) if left[k]]
    while rest:
        held, room, used = [], size, {}
        hi = len(rest)
        while hi and room:
            hi = bisect_right(rest, room, 0, hi, key=lambda k: int(lengths[k]))
            if not hi:
                break
            k = rest[hi - 1]
            n = min(room // int(lengths[k]), int(left[k]))
            held.append((k, n))
            used[k] = n
            room -= n * int(lengths[k])
            hi -= 1
        take(tuple(held), int(min(left[k] // n for k, n in used.items())))
        rest = [k for k in rest if left[k]] if any(not left[k] for k in used) else rest
    return out


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``; sequences are gapless from offset 0.

    Rows of equal length are interchangeable, so repeated rows and ties take any of their places.
    An empty table gives an empty one.
    """
    histogram = sorted((r["length"], r["count"]) for r in pieces.groupBy("length").count().collect())  # at most ``size`` rows
    lengths, counts = (np.array([h[i] for h in histogram], np.int64) for i in range(2))
    before = np.zeros(size + 1, np.int64)  # rows of shorter lengths
    if len(lengths):
        before[lengths] = np.cumsum(counts) - counts
    spans, used, sequence = [], np.zeros(len(lengths), np.int64), 0
    for held, copies in pack_counts(lengths, counts, size) if len(lengths) else []:
        at = 0
        for k, n in held:
            spans.append((before[lengths[k]] + used[k], n, sequence, at))
            used[k] += n * copies
            at += n * int(lengths[k])
        sequence += copies
    spans.sort()
    starts, each, first, place = (np.array([s[i] for s in spans], np.int64) for i in range(4))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b.length.to_numpy(np.int64)
            rank = before[length] + b["rank"].to_numpy(np.int64)
            span = np.searchsorted(starts, rank, side="right") - 1
            nth = rank - starts[span]
            yield b.drop(columns="rank").assign(sequence_id=first[span] + nth // each[span], offset=place[span] + nth % each[span] * length)

    ranked = rank_within(pieces, "length", [], ["doc_id", "piece", "start", "ids_crc32"], salts=salts_for(max((h[1] for h in histogram), default=0))).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make a column with nulls inexact
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(assign, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack documents: one row a piece, ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is a vocabulary file of the ``tokenizers`` library with the layout of
    ``word_bpe_49k.json``, its default. Only texts of more than ``size`` tokens are cut. Null text
    is empty: one token. Rows that repeat an id are packed each by itself. Other columns are
    ignored. An empty table gives an empty table.
    """
    pieces = tokenised(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), size, 1, id_col, text_col)
    return pack(settle(pieces, "pieces"), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; nulls, repeats, long texts and empty tables go as in ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
