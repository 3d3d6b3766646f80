"""Tables that Spark sizes too low, as after an explode, are not sent to the driver."""

import re

import numpy as np

import corpus_pipeline
from tablekeel.llm.simhash import near_duplicates


def executions(spark):
    """Spark's store of SQL executions, and the ids it has."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return store, {found.apply(i).executionId() for i in range(found.size())}


def exploded_broadcasts(plan):
    """How many broadcasts in a plan hold an explode that no shuffle, whose rows are measured, lies above."""
    found, above = 0, []  # indents and kinds of the nodes above a line
    for line in plan.split("\n\n")[0].splitlines():
        at = re.search(r"\w", line)
        if not at:
            continue
        while above and above[-1][0] >= at.start():
            above.pop()
        kind = line[at.start() :].split()[0]
        shuffles = [k for _, k in above if k in ("Exchange", "BroadcastExchange")]
        found += kind == "Generate" and shuffles[-1:] == ["BroadcastExchange"]
        above.append((at.start(), kind))
    return found


def plans_since(spark, before):
    store, now = executions(spark)
    return [store.execution(i).get().physicalPlanDescription() for i in sorted(now - before)]


def texts_with_copies(n):
    """Texts of 200 words of 500, and for every tenth one with another last word."""
    rng, texts = np.random.default_rng(4), []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 500, 200)]
        texts += [" ".join(words)] + [" ".join([*words[:-1], "other"])] * (i % 10 == 0)
    return texts


def test_broadcast_explodes_are_seen(spark):
    """What the other tests look for is there where nothing prevents it, and not above a shuffle."""
    _, before = executions(spark)
    wide = spark.range(100).selectExpr("id % 7 AS k", "explode(sequence(0, 9)) AS x")
    rows = spark.range(20000).selectExpr("id % 11 AS k", "id")
    rows.join(wide.hint("broadcast"), "k").count()
    rows.join(wide.groupBy("k").count().hint("broadcast"), "k").count()
    assert [exploded_broadcasts(p) > 0 for p in plans_since(spark, before)] == [True, False]


def test_near_copies_broadcast_no_cells(spark):
    docs = spark.createDataFrame(list(enumerate(texts_with_copies(200))), "doc_id long, text string")
    _, before = executions(spark)
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 200
    plans = plans_since(spark, before)
    assert any("Generate" in p for p in plans)
    assert [exploded_broadcasts(p) for p in plans] == [0] * len(plans)


def test_fingerprints_broadcast_no_cells(spark):
    docs = spark.createDataFrame(list(enumerate(texts_with_copies(200))), "doc_id long, text string")
    _, before = executions(spark)
    found = near_duplicates(docs).select("component").distinct().count()
    assert 200 <= found < 220
    plans = plans_since(spark, before)
    assert any("Generate" in p for p in plans)
    assert [exploded_broadcasts(p) for p in plans] == [0] * len(plans)
