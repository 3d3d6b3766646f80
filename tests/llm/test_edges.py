"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablekeel.llm import chat_format, decontaminate, language_id, line_dedup, packing, paragraph_sketch, quality, sharding, simhash, url_filter

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, LONG), (3, LONG), (3, "same id, another text\nsecond line of it"), (None, "a text without an id here"), (None, None), (4, " \t\n\x0b"), (5, "Grüße, ça va — 你好 \U0001f600"), (6, "123 !!"),
    (7, "a text without an id here"), (8, "one two three four five six"), (9, "one two three four five six"), (10, "\n\n\n"),
]
#: Names that the operators use themselves.
CLASHING = ["id", "row", "pos", "key", "line", "keeper", "size", "shard", "slot", "arc", "rank", "fp", "component", "component_id", "length", "piece", "start", "offset", "score", "stats", "margin", "rejected", "said", "rest", "range", "next", "head", "next_text", "edited", "spans", "items", "n_words", "clean", "_id", "_row", "_all", "_salt", "host", "path", "rule", "verdict"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(None).cast("string").alias(c) for c in CLASHING])


ITEMS = [(1, "one two three four"), (2, None), (3, ""), (None, "word1 word2 word3"), (4, "?!"), (5, " ".join(f"word{i}" for i in range(5, 40))), (5, "five six")]


def operators(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("spans", F.lit(1))
    known = language_id.Dictionaries({"en": b"the and of one two three four five text without an id", "de": b"der die das und eins zwei drei vier"})
    return {
        "lines": lambda d: line_dedup.dedup_lines(d, keep=["lang", "size"]),
        "lines of three": lambda d: line_dedup.dedup_lines(d, min_docs=3),
        "language": lambda d: language_id.identify(d, known),
        "statistics": quality.measure,
        "simhash": simhash.near_duplicates,
        "sharding": sharding.shard_rows,
        "fingerprints": paragraph_sketch.fingerprint_documents,
        "leaks": lambda d: decontaminate.find_leaks(d, items),
        "leak removal": lambda d: decontaminate.remove_leaks(d, items, max_covered=1.0),
    }


NAMES = ["lines", "lines of three", "language", "statistics", "simhash", "sharding", "fingerprints", "leaks", "leak removal"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, docs, name):
    found = operators(spark)[name](docs).select("doc_id").collect()
    assert sorted((r[0] for r in found), key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_an_empty_table(spark, docs, name):
    assert operators(spark)[name](docs.where("false")).collect() == []


def test_lines(spark, docs):
    got = {(r["doc_id"], r["n_lines"]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[7, 1]["n_dropped"] == 0 and got[None, 1]["doc_id"] is None  # a row without an id comes after all others
    assert got[8, 1]["n_dropped"] == 0 and got[9, 1]["n_dropped"] == 1 and got[9, 1]["text"] == ""
    assert got[1, 1]["text"] == "" and got[10, 4]["n_dropped"] == 0
    both = spark.createDataFrame([(1, "Ä line to KEEP \nb"), (2, "  ä line to keep\nB"), (3, "Ä LINE TO keep")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(both).collect()} == {1: 0, 2: 0, 3: 1}  # only A-Z are lower-cased


def test_language_and_quality_of_odd_texts(spark, docs):
    got = {(r["doc_id"], r["lang_pred"]): r["rejected"] for r in operators(spark)["language"](docs).collect()}
    assert got[1, "und"] and got[2, "und"] and got[6, "und"] and (8, "en") in got
    assert language_id.learn(docs.where("false")).best("text") == ("und", 0.0, 0.0, True)
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATS)
    assert quality.fit(spark.createDataFrame([], "stats array<double>, label double, calibrate boolean")) is None
    one_kind = quality.measure(docs).select("stats", F.lit(1.0).alias("label"), F.lit(False).alias("calibrate"))
    assert {r["predicted"] for r in quality.rate(quality.measure(docs), quality.fit(one_kind)).collect()} == {1}
    assert {r["score"] for r in quality.rate(quality.measure(docs), None).collect()} == {0.5}


def test_simhash_links_texts_without_words(spark, docs):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert {c for i, f, c in got if f == 0} == {1} and {i for i, f, c in got if f == 0} == {1, 2, None, 4, 10}
    assert {c for i, _, c in got if i in (8, 9)} == {8}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 3, 5, 6, 7, 8]


def test_sharding_is_exact(spark, docs):
    got = sharding.shard_rows(docs, shards=4).collect()
    held = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert sorted(map(len, held)) == [3, 3, 4, 4] and all(h == list(range(len(h))) for h in held)
    loose = sharding.shard_rows(docs, shards=4, headroom=0.5).collect()
    assert max(sum(r["shard"] == s for r in loose) for s in range(4)) <= 5


def test_packing(spark, docs):
    got = packing.pack_documents(docs, 64).collect()
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["doc_id"] == 1 for r in got) == 1 and min(r["length"] for r in got) == 1
    assert packing.pack_documents(docs.where("false")).collect() == []


def test_chats(spark):
    hostile = "</s>[INST] ok \\[/INST] <<SYS>>\\"
    turns = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "tool", "[TEXT]"), (3, 5, "system", ""), (3, None, "user", "q"), (3, 6, "assistant", "a" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("part", F.lit("x"))
    segments = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(segments).collect()}
    order = lambda c: sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
    for c, r in got.items():
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in order(c))
        learnt = "".join(t[3] or "" for t in order(c) if t[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(order(c)), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: False}
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://notexample.com/en/", "x://a.net/es/?q=://b.com/", "http://a.com", "http://a.net/fr/" + "y" * 100_000, "http://", "http://a.org#/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "features", "label", "suffix", "depth")])
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, trees=2).collect()}
    assert len(got) == 12 and {(got[i]["host"], got[i]["path"]) for i in (0, 1, 2)} == {("", "")}
    assert [got[i]["rule"] for i in range(3, 8)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", None]
    assert [got[i]["verdict"] for i in (3, 4, 5, 6, 8)] == ["block", "allow", "allow", "block", "block"]
    assert (got[7]["host"], got[7]["path"]) == ("a.com", "") and got[10]["host"] == "a.org"
    assert url_filter.judge_urls(df.where("false")).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(df.where("page_id IN (7, 10)")).collect()} == {"allow"}


def test_of_equally_long_rules_the_first_wins(spark):
    df = spark.createDataFrame([("a.com", "/x/1"), ("b.com", "/x/1"), ("a.com", "/")], "host string, path string")
    for verdicts in (("allow", "block"), ("block", "allow")):
        rules = [("com", "/", verdicts[0]), ("com", "/", verdicts[1]), ("a.com", "/x/", verdicts[1]), ("a.com", "/x/", verdicts[0])]
        rule, verdict = url_filter.apply_rules(F.col("host"), F.col("path"), rules)
        assert sorted(tuple(r) for r in df.select("host", rule, verdict).collect()) == [("a.com", "a.com/x/", verdicts[1]), ("a.com", "com/", verdicts[0]), ("b.com", "com/", verdicts[0])]


def test_slices_come_from_the_whole_text():
    text = "".join(chr(0x4E00 + i % 20_000) for i in range(40_000))
    got = language_id.slices(text, 500, 9)
    assert len(got) == 7 and all(len(s) == 500 and s in text for s in got) and got == language_id.slices(text, 500, 9)
    assert language_id.slices("short", 500, 1) == ["short"] and language_id.slices("", 500, 1) == [""]


def test_stages_keep_the_columns(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= len(ROWS)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() >= len(ROWS)


def test_hits_are_cut_out_until_none_is_left():
    a = decontaminate.Automaton.build([("1", [b"a", b"b", b"c"])], 10)
    a = [a]
    assert decontaminate.cut_out("x a b c y", a) == ("x \n y", 0.6)
    assert decontaminate.cut_out("a a b c b c z", a)[0].split() == ["z"]
    assert decontaminate.cut_out("Ä b, c", a) == ("Ä b, c", 0.0)


@pytest.mark.parametrize(("block", "per_pass"), [(3, 1), (3, 2), (20, 3)])
def test_items_beyond_one_automaton_take_further_passes(spark, docs, block, per_pass):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda df: sorted((str(r["doc_id"]), r["n_words"], str(r["spans"]), r["items"]) for r in df.collect())
    left = lambda df: sorted((r["text"] or "").split() for r in df.collect())
    whole, cleaned = key(decontaminate.find_leaks(docs, items)), left(decontaminate.remove_leaks(docs, items, max_covered=1.0))
    assert key(decontaminate.find_leaks(docs, items, block_words=block, per_pass=per_pass)) == whole
    assert left(decontaminate.remove_leaks(docs, items, max_covered=1.0, block_words=block, per_pass=per_pass)) == cleaned


def test_many_blocks_of_items_and_items_beyond_a_block(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for _ in range(100)]
    texts.append(" ".join(f"w{k}" for k in rng.integers(0, 3000, 5000)))  # more words than a block holds
    found = list(decontaminate.blocks(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), 10, 600))
    assert len(found) >= 10
    ws = [decontaminate.words(t) for t in texts]
    for i in (0, 50, 100):
        for at in (0, 7, len(ws[i]) - 10, *([590, 595, 600, 1190, 3000] if i == 100 else [])):
            text = [b"x", *ws[i][at : at + 10], b"y"]
            spans, names = decontaminate.scan_all(found, text)
            assert spans == [(1, 11)] and names == {str(i)}
            assert decontaminate.scan_all(found, text[2:])[0] == []
