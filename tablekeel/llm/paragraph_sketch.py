"""Document fingerprints [native]: an invertible Bloom lookup sketch of a text's paragraphs.

Each paragraph's 64-bit digest goes into one cell of each of three tables; a cell holds a count,
the XOR of its digests and the XOR of their checksums. Sketches of two versions subtract cell by
cell. Peeling then recovers the digests that differ: a cell of count 1 or -1 whose checksum fits
gives one, which is taken out of its other cells, and so on.

A fingerprint is a small sketch. Pairs of versions whose difference it can't give are tried again
with larger sketches and other hash functions. A cell is a row, and filling, subtracting and
peeling are sums and XORs by document and cell. Documents are dealt into ranges of ids once, to
bring neighbours together; their digests are stored bucketed by range, so that all of the rest
happens where they are, without another shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablekeel.core import scratch
from tablekeel.llm.common import settle, table

#: A paragraph is a sentence of a line; where no sentence ends for so many characters, it ends at the next blank, or after as many again.
LONG = 200
#: Cells in each of the three tables of a fingerprint.
SMALL = 8
#: Rounds of peeling: each goes over the three tables once. Sizes of sketches that are tried, the fingerprint's not counted.
ROUNDS, TRIES = 6, 4
#: Cells in each table of a larger sketch, at least: with fewer, small differences would often be tried again.
LEAST = 32
#: Buckets of the stored digests for each shuffle partition, since a row grows to many cells; ranges of ids for each bucket.
BUCKETS, RANGES = 4, 8


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text; an empty text has none."""
    cut = F.regexp_replace(text, "([.!?]+(?= )|[。！？]) ?", "$1\n")
    # anchored at line starts and former ends, so that it goes over a text once
    cut = F.regexp_replace(cut, rf"(?md)(?:^|\G)[^\n]{{{LONG}}}[^\n ]{{0,{LONG}}}", "$0\n")
    kept = F.filter(F.split(cut, "\n"), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))


# Expressions that are built many times over are SQL texts: a plan of them is made by one call each.


def _checksum(digest: str) -> str:
    return f"hash({digest}, 1)"


def _cell(digest: str, table_no: int, salt: str, width: str) -> str:
    return f"CAST(pmod(xxhash64({digest}, {salt}, {table_no}), {width}) + {width} * {table_no} AS INT)"


ROW = ["range", "rid"]
#: ``at`` holds row, pair, width and salt of a sketch. With plain keys each of the aggregates that follow each other within a task would claim a page of memory from the start.
KEYS = ["range", "at"]
CELL = ["n", "digest", "checksum"]


def _sum_up(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "cell").agg(F.expr("sum(n) AS n"), F.expr("bit_xor(digest) AS digest"), F.expr("bit_xor(checksum) AS checksum"))


def fill(digests: DataFrame, *keys: str) -> DataFrame:
    """Sketches of rows ``*keys, n (1 or -1), digest``: their cells, as rows ``*keys, cell, n, digest, checksum``."""
    cells = ", ".join(_cell("digest", i, "at.salt", "at.width") for i in range(3))
    return _sum_up(digests.selectExpr(*keys, "n", "digest", f"{_checksum('digest')} AS checksum", f"explode(array({cells})) AS cell"), *keys)


def peel(cells: DataFrame, rounds: int) -> DataFrame:
    """Take out what single cells give, table after table; cell -1 counts the digests recovered so far.

    Digests that come from one table are different ones, so none is taken out twice.
    """
    filled = "cell < 0 OR n <> 0 OR digest <> 0 OR checksum <> 0"
    found, same = "named_struct('cell', -1, 'n', 1L, 'digest', 0L, 'checksum', 0)", "struct(cell, n, digest, checksum)"
    cells = cells.where(filled)
    for i in [0, 1, 2] * rounds:
        single = f"cell >= 0 AND floor(cell / at.width) = {i} AND abs(n) = 1 AND {_checksum('digest')} = checksum"
        others = ", ".join(f"named_struct('cell', {_cell('digest', j, 'at.salt', 'at.width')}, 'n', -n, 'digest', digest, 'checksum', checksum)" for j in range(3) if j != i)
        moved = cells.selectExpr(*KEYS, f"inline(CASE WHEN {single} THEN array({found}, {others}) ELSE array({same}) END)")
        cells = _sum_up(moved, *KEYS).where(filled)
    return cells


def outcome(peeled: DataFrame) -> DataFrame:
    """Rows ``range, rid, pair, differing``: null where cells of all sketches of the pair were left over. Pairs without a difference have no row."""
    by = peeled.groupBy(*KEYS).agg(F.max("cell").alias("last"), F.sum(F.when(F.col("cell") < 0, F.col("n"))).alias("n"))
    by = by.select("range", "at.rid", "at.pair", F.when(F.col("last") < 0, F.col("n")).alias("n"))
    return by.groupBy(*ROW, "pair").agg(F.max("n").alias("differing"))


def _sides(pair: int, width: Column, salt: int) -> list[Column]:
    """Both versions of a pair, to be filled into one sketch: the second with opposite signs, which subtracts its cells."""
    at = F.struct("rid", F.lit(pair).alias("pair"), width.cast("long").alias("width"), F.lit(salt).alias("salt"))
    return [F.struct(at.alias("at"), F.lit(n).cast("long").alias("n"), F.col(d).alias("ds")) for n, d in ((1, "d0"), (-1, f"d{pair}"))]


def _room(pair: int, attempt: int) -> Column:
    """Cells of a table with room for all digests of both versions, twice as many with each further try."""
    return F.greatest(F.ceil((F.size("d0") + F.size(f"d{pair}")) / 1.5), F.lit(LEAST)) * 2 ** (attempt - 1)


def _try(rows: DataFrame, sides: Column) -> DataFrame:
    digests = rows.select("range", F.explode(sides).alias("side")).select("range", "side.*")
    return outcome(peel(fill(digests.select(*KEYS, "n", F.explode("ds").alias("digest")), *KEYS), ROUNDS))


def compare(held: DataFrame) -> DataFrame:
    """For rows ``range, rid, d0, d1, d2``: ``range, rid, pair, differing`` digests of (0, 1) and (0, 2).

    The fingerprints and the first larger sketches are filled in one pass; the larger one counts
    where the fingerprint can't be peeled. What fails again is tried with sketches twice as large,
    and a set difference settles what is left after ``TRIES``.
    """
    held = held.select(*ROW, "d0", "d1", "d2")
    both = [x for p in (1, 2) for w, salt in ((F.lit(SMALL), 0), (_room(p, 1), 1)) for x in _sides(p, w, salt)]
    results = [settle(_try(held, F.array(*both)), "peeled")]
    # settled by themselves, failures are as small to the planner as they are, at every size of the whole
    failed = settle(results[-1].where("differing IS NULL").select(*ROW, "pair"), "failed")
    for attempt in range(2, TRIES + 1):
        if failed.isEmpty():
            break
        again = held.join(failed, ROW)
        results.append(settle(_try(again, F.when(F.col("pair") == 1, F.array(*_sides(1, _room(1, attempt), attempt))).otherwise(F.array(*_sides(2, _room(2, attempt), attempt)))), "peeled"))
        failed = settle(results[-1].where("differing IS NULL").select(*ROW, "pair"), "failed")
    last = held.join(failed, ROW)
    other = F.when(F.col("pair") == 1, F.col("d1")).otherwise(F.col("d2"))
    exact = last.select(*ROW, "pair", (F.size(F.array_except("d0", other)) + F.size(F.array_except(other, F.col("d0")))).cast("long").alias("differing"))
    return reduce(DataFrame.unionByName, [r.where("differing IS NOT NULL") for r in results], exact)


def fingerprint(digests: str) -> Column:
    """The filled cells of the small sketch of a column of digests as text, in order: number, count, XOR of digests, XOR of checksums."""
    places = ", ".join(f"'c{i}', {_cell('x', i, '0', f'{SMALL}L')}" for i in range(3))
    named = f"transform({digests}, x -> named_struct('digest', x, 'checksum', {_checksum('x')}, {places}))"

    def cell(c: int) -> str:
        xor = f"aggregate(filter(sketch, d -> d.c{c // SMALL} = {c}), named_struct('n', 0L, 'd', 0L, 'k', 0), (s, d) -> named_struct('n', s.n + 1, 'd', s.d ^ d.digest, 'k', s.k ^ d.checksum))"
        return f"transform(array({xor}), x -> CASE WHEN x.n > 0 THEN concat_ws('.', hex({c}), hex(x.n), hex(x.d), hex(x.k)) END)[0]"

    return F.expr(f"transform(array({named}), sketch -> array_join(array({', '.join(map(cell, range(3 * SMALL)))}), '-'))[0]")  # named once


def buckets_of(spark: SparkSession) -> int:
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _passed(test: Callable[[Column], Column], size: int) -> Column:
    """How many of the falling ``bounds`` pass, which are the first ones: a binary search."""
    here = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        up = test(F.element_at("bounds", here(s) + 1))
        return F.when(s["low"] >= s["high"], s).when(up, F.struct((here(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), here(s).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length() + 1)), F.struct(F.lit(0).alias("low"), F.lit(size).alias("high")), halve, lambda s: s["low"])


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``next_text`` to rows of ``id, text``, the text of the row with the next smaller id (after the last, the first's), and ``range, rid``, which name a row.

    Rows are dealt into ranges of ids whose bounds are quantiles, so one shuffle brings neighbours
    together and no task sees all rows. Rows that share an id follow each other by a hash of the
    text; where they fill several ranges, that hash deals them. The last row of a range takes the
    first text of the next range that has rows; there is one such text a range.
    """
    parts = parts or RANGES * buckets_of(docs.sparkSession)
    cuts = sorted({int(c) for c in docs.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / max(10_000, 4 * parts))}, reverse=True) if parts > 1 else []
    docs = docs.withColumn("hash", F.xxhash64("text"))
    if cuts:
        # range 0 holds the largest ids; the bounds, 8 bytes a range, are a column of one row that is sent to all tasks
        bounds = docs.sparkSession.createDataFrame([(cuts,)], "bounds array<long>")
        docs = docs.crossJoin(F.broadcast(bounds))
        above, upto = _passed(lambda c: c > F.col("id"), len(cuts)), _passed(lambda c: c >= F.col("id"), len(cuts))
        share = F.col("hash").cast("double") / 2.0**64 + 0.5
        number = above + F.least(F.floor((upto - above + 1) * share), upto - above).cast("int")
    else:
        number = F.lit(0)
    ranged = docs.withColumn("range", number).drop("bounds")
    order = [F.desc("id"), F.asc("hash"), F.asc("text")]
    tops = ranged.groupBy("range").agg(F.min(F.struct(F.bitwise_not("id").alias("below"), "hash")).alias("top")).select("range", F.bitwise_not("top.below").alias("id"), F.col("top.hash").alias("hash"))
    tops = settle(tops, "tops")  # a row a range
    following = tops.select("range", F.lead("range").over(Window.orderBy("range")).alias("after"))
    following = following.withColumn("after", F.coalesce("after", F.lit(tops.agg(F.min("range")).first()[0])))
    heads = ranged.join(tops, ["range", "id", "hash"]).groupBy("range").agg(F.min("text").alias("head"))
    following = settle(following.join(heads.withColumnRenamed("range", "after"), "after").select("range", "head"), "heads")
    along = Window.partitionBy("range").orderBy(*order)
    led = ranged.withColumn("next", F.lead("text").over(along)).withColumn("rid", F.row_number().over(along))
    return led.join(following, "range", "left").withColumn("next_text", F.coalesce("next", "head")).drop("next", "head", "hash")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written into the shared folder in buckets of ``key``: what groups or joins by it needs no shuffle. The table is an external one of the session's catalogue."""
    spark, name = df.sparkSession, f"tablekeel_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets_of(spark), key).option("path", scratch(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last half of the characters replaced by as many of the next document's
    first, in descending order of ids (see ``with_next``). ``near_*`` are shares of common among
    all paragraphs, 1 if there are none. A fingerprint's text lists its filled cells. Null text is
    empty. Rows that repeat an id follow each other by a hash of the text; a null id comes last.
    Other columns are ignored. A document that is alone is its own next. An empty table gives an
    empty table.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(rows).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.substring("next_text", F.lit(1), half)))
    held = rows.select(
        *ROW, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *[paragraph_digests(F.col(c)).alias(f"d{i}") for i, c in enumerate(("text", "edited", "next_text"))],
    )
    held = bucketed(held, "range")
    differing = compare(held)
    lost = differing.groupBy(*ROW).agg(*[F.max(F.when(F.col("pair") == p, F.col("differing"))).alias(f"lost{p}") for p in (1, 2)])
    whole = held.select(*ROW, "doc_id", "n_chars", "edited_sha256", "d0", "d1", *[F.size(f"d{i}").alias(f"size{i}") for i in range(3)]).join(lost.hint("shuffle_hash"), ROW, "left")

    def near(p: int) -> Column:
        both, d = F.col("size0") + F.col(f"size{p}"), F.coalesce(f"lost{p}", F.lit(0))
        return F.when(both == 0, 1.0).otherwise((both - d) / (both + d))

    return whole.select("doc_id", "n_chars", "edited_sha256", fingerprint("d0").alias("fingerprint"), fingerprint("d1").alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; nulls, repeats, long texts and empty tables go as in ``fingerprint_documents``."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
