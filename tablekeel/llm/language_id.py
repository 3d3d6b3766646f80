"""Language ID by compression: the language whose zstandard dictionary shortens a text most.

For every language a raw-content dictionary is made of slices of a bounded sample of labelled
texts. A whole text's letters are encoded in blocks with each dictionary; the smallest total wins.
A narrow margin to the second is rejected, and so is a text that its own language's dictionary
shortens much less than labelled texts of that language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import table

NO_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).strip().encode() if text and any(map(str.isalpha, text)) else b""


@dataclass
class Dictionaries:
    """``contents``: language -> dictionary, the most frequent language first: it wins ties.

    ``usual``: language -> encoded bytes a byte of its labelled texts. A text of n bytes of letters
    is rejected if its margin is below ``min_margin * (n - spare_margin)`` bytes, or its encoded
    size above ``unlike * usual * n + spare`` bytes: one rule for all lengths, which leaves the
    shortest texts, that can't show either, with the most frequent language.
    """

    contents: dict[str, bytes]
    usual: dict[str, float] = field(default_factory=dict)
    level: int = 6
    block: int = 1000
    min_margin: float = 0.0005
    spare_margin: int = 100
    unlike: float = 1.3
    spare: int = 20

    @cached_property
    def encoders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.contents.values():
            how = zstandard.ZstdCompressionParameters.from_level(self.level, min_match=3, dict_size=len(content), source_size=self.block, write_content_size=0)
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=known))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "encoders"}

    def sizes(self, said: bytes) -> np.ndarray:
        """Encoded bytes with each dictionary, without what a block of nothing takes."""
        blocks = [said[a : a + self.block] for a in range(0, len(said), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.encoders], float) - len(blocks) * len(self.encoders[0].compress(b""))

    def best(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, the margin to the second in bytes per byte of letters, and whether the text is rejected."""
        said = letters(text)
        if not said or not self.contents:
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(said)
        k = int(sizes.argmin())
        lang = list(self.contents)[k]
        rest = np.delete(sizes, k) - sizes[k]
        score = 1 / (1 + float(np.exp(-np.minimum(rest, 500) / 4).sum()))
        margin = float(rest.min()) if len(rest) else float(len(said))
        narrow = margin < self.min_margin * (len(said) - self.spare_margin)
        unlike = float(sizes[k]) > self.unlike * self.usual.get(lang, 1.0) * len(said) + self.spare
        return lang, score, margin / len(said), narrow or unlike


def slices(text: str, chars: int, seed: int) -> list[str]:
    """Slices of ``chars`` characters from anywhere in the whole text: one, and one more each time that the text is twice as long."""
    n = 1 + max(0, (len(text) // chars).bit_length() - 1)
    starts = np.random.default_rng(seed).integers(0, max(1, len(text) - chars + 1), n)
    return [text[a : a + chars] for a in sorted(starts.tolist())]


def learn(labelled: DataFrame, sample: int = 400, chars: int = 500) -> Dictionaries:
    """Dictionaries from rows of ``doc_id, text, lang``.

    For each language, about ``2 * sample`` rows with the lowest hashes of id and text are taken
    (rows that repeat count once), and of each the slices that ``slices`` gives: more of a longer
    text, as many as the logarithm of its length. Those of the first ``sample`` rows (four fifths,
    if there are few) are the dictionary, the others show how it usually encodes texts of its
    language. That is all the driver holds. Rows without a language or without letters are passed
    over; an empty table gives no dictionary.
    """
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31))
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", hashed)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Dictionaries({})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1, 2 * sample / n) * 2**31))]), F.col("lang"))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([slices(t, chars, h) for t, h in zip(texts, hashes, strict=True)])

    found = defaultdict(list)
    for r in rows.where(F.col("_h") < share).select("lang", "_h", cut("text", "_h").alias("parts")).dropDuplicates(["lang", "_h"]).collect():
        if said := b" ".join(filter(None, map(letters, r["parts"]))):
            found[r["lang"]].append((r["_h"], said))
    kept = {lang: [said for _, said in sorted(found[lang])] for lang in sorted(counts, key=lambda k: (-counts[k], k)) if found[lang]}
    first = {lang: min(sample, len(parts) - len(parts) // 5) for lang, parts in kept.items()}
    known = Dictionaries({lang: b" ".join(parts[: first[lang]]) for lang, parts in kept.items()})
    for k, (lang, parts) in enumerate(kept.items()):
        if rest := parts[first[lang] :]:
            known.usual[lang] = float(np.median([known.sizes(said)[k] / len(said) for said in rest]))
    return known


def language_of(text: Column, known: Dictionaries) -> Column:
    """A struct of ``lang_pred, score, margin, rejected`` for whole texts.

    ``lang_pred`` is ``und`` for null texts and texts without a letter, which are rejected. Ties go
    to the language with more labelled texts.
    """
    sent = SparkSession.active().sparkContext.broadcast(known)  # bounded by the sample that ``learn`` takes

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.best(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return judge(text)


def identify(docs: DataFrame, known: Dictionaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id, lang_pred, score, margin, rejected``. Rows that repeat an id are judged each by itself; other columns are ignored. An empty table gives an empty table."""
    return docs.select(F.col(id_col).alias("doc_id"), language_of(F.col(text_col), known).alias("said")).select("doc_id", "said.*")


def keep_identified(docs: DataFrame, known: Dictionaries, text_col: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with all their columns.

    Null texts and texts without a letter go; rows that repeat are judged each by itself. An empty
    table gives an empty table.
    """
    return docs.select(F.struct("*").alias("row"), language_of(F.col(text_col), known).alias("said")).where(~F.col("said.rejected")).select("row.*")


def fold(doc_id: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id falls in part 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def learn_from_folds(docs: DataFrame) -> Dictionaries:
    """Dictionaries from the two thirds of ``documents`` that are not held out."""
    return learn(docs.where(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; null, odd and repeated rows and empty tables go as in ``language_of`` and ``identify``, long texts are encoded whole."""
    docs = table(spark, sf_dir, "documents")
    known = learn_from_folds(docs)
    return identify(docs, known).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
