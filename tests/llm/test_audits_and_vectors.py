"""Vector codes, the filter audit and the embedding graph against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekeel.core import Refused
from tablekeel.llm import embedding_graph, filter_audit, vector_codes
from tablekeel.llm.queries import QUERIES


# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Whole rescans in Python's own numbers; ``rows`` are (id, vector, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: r[0])
    w = len(rows[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for c in cut:
            for p in range(parts):
                held[p, nearest(p, c[p])[1]].append(c[p])
        for (p, k), xs in held.items():
            books[p][k] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    out = {}
    for (i, _, label), c in zip(rows, cut, strict=True):
        found = [nearest(p, c[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label)
    totals = Counter()
    for _, e, label in out.values():
        totals[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (code, e, totals[label], digest) for i, (code, e, label) in out.items()}


def test_vector_codes_are_those_of_whole_rescans(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in QUERIES["op11_vector_codes"](spark, sf_dir).collect()}
    assert got == plain_codes(rows)


def test_moved_entries_alone_decide_as_whole_rescans_do():
    rng = np.random.default_rng(3)
    for spread in (2, 9, 2**29):  # small numbers: many ties; large ones: beyond doubles
        vectors = rng.integers(-spread, spread, (300, 8))
        old = vector_codes.Codebooks(rng.integers(-spread, spread, (4, 7, 2)), np.ones((4, 7), bool))
        codes, dists = vector_codes.assign(vectors, old, None, None)
        moved = rng.random((4, 7)) < 0.4
        new = vector_codes.Codebooks(np.where(moved[:, :, None], rng.integers(-spread, spread, (4, 7, 2)), old.entries), moved)
        some, whole = vector_codes.assign(vectors, new, codes, dists), vector_codes.assign(vectors, new, None, None)
        assert (some[0] == whole[0]).all() and (some[1] == whole[1]).all()


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 32, 1), (5, [0.25] * 32, None), (1, None, 1), (2, [None] * 32, 1), (3, [nan] * 32, 1), (4, [1.0] * 31 + [inf], 1), (6, [], 1), (None, [-0.75] * 32, None), (7, [0.5] * 32, 1), (8, [1.0] * 32, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(0).alias(c) for c in ("id", "kept", "codes", "dists", "ints", "part", "code")])
    coded, books = vector_codes.encode(df, entries=3, keep=["label"])
    got = sorted(((r["id"], r["kept"]["label"], r["codes"], r["dists"]) for r in coded.collect()), key=str)
    assert [g[0] for g in got] == [5, 5, 7, 8, None] and books.entries.shape == (16, 3, 2)
    assert books.entries[0].tolist() == [[64, 64], [128, 128], [128, 128]] or books.entries[0, 0].tolist() != books.entries[0, 1].tolist()
    alike = [g for g in got if g[1] == 1]
    assert alike[0][2] == alike[1][2]  # equal vectors, equal codes: the lower of equal entries
    back = {r["id"]: r["ints"] for r in vector_codes.decode(coded.where("id = 8"), books).collect()}
    assert sum((a - 256) ** 2 for a in back[8]) == sum(next(g for g in got if g[0] == 8)[3])
    empty, none = vector_codes.encode(df.where("false"))
    assert none is None and empty.collect() == []
    assert vector_codes.encode(df.where("vec_id = 1"))[1] is None
    for odd in ([(1, [0.5] * 32, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 10, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Refused):
            vector_codes.encode(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int"))


# --- filter audit


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(1, 9), st.integers(0, 3)), max_size=12))
def test_gray_code_walk_is_the_sum_over_every_subset(cells):
    masks = np.array(sorted(cells), np.int64)
    counts = np.array([cells[m] for m in sorted(cells)], np.int64).reshape(len(masks), 2)
    states = filter_audit.survivors(masks, counts, 5)
    for subset in range(32):
        assert states[subset].tolist() == counts[(masks & subset) == 0].sum(axis=0).tolist()
    removed = sum(r[3] for r in filter_audit.steps(masks, counts, "ABCDE") if r[0] == "ABCDE")
    assert removed == counts[masks > 0, 0].sum()


def plain_mask(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))
    return sum(2**i for i, f in enumerate(fails) if f)


@given(st.text(alphabet="ab AÄ\n\x0b\x1c é$#", max_size=60))
def test_masks_of_texts(text):
    assert filter_audit.text_mask(text) == plain_mask(text)
    assert filter_audit.text_mask(text * 150) == plain_mask(text * 150)


def test_filter_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    huge = " ".join(f"w{i}" for i in range(600_000))  # some 4 MB
    rows = [(3, long, "en"), (3, long, "en"), (4, long, None), (None, long, ""), (None, "only here", None), (1, None, "de"), (2, "", "de"), (7, huge, "en"), (8, huge + "$", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("x").alias(c) for c in ("id", "part", "mask", "one", "two", "n", "_id", "first")])
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (2, None, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    masks = filter_audit.repeats(filter_audit.masked(docs), 4)
    got = sorted(((r["id"], r["part"], r["mask"]) for r in masks.collect()), key=str)
    want = [(1, "de", 1), (2, "de", 1 + 16), (3, "en", 0), (3, "en", 0), (4, "", 16), (7, "en", 0), (8, "en", 8), (None, "", 1), (None, "", 16)]
    assert got == sorted(want, key=str)
    marks = {"good": F.col("quality") == 1, "bad": F.col("toxic") == 1}
    steps = filter_audit.audit(filter_audit.cells(masks, labels, marks), lost=("good", "bad")).collect()
    assert len(steps) == 3 * 120 * 5
    last = {(r["part"], r["filter_order"]): r for r in steps if r["step"] == 5}
    assert {k[0]: r["kept"] for k, r in last.items()} == {"de": 0, "en": 3, "": 0}
    for r in steps:
        assert r["removed"] + r["redundant"] >= r["unique_fails"] >= 0
    assert sum(r["bad"] for r in steps if (r["part"], r["filter_order"]) == ("de", "EDCBA")) == 1
    assert filter_audit.audit(filter_audit.cells(masks.where("false"), labels, marks), lost=("good", "bad")).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(filter_audit.cells(masks, labels, marks), letters="ABCDEFGH")


# --- embedding graph


def plain_links(rows, least=0.93):
    """``rows`` are (id, vector, label): links and components over all pairs."""
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    units = {k: np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in ok}
    units = {k: v / np.linalg.norm(v) for k, v in units.items()}
    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= least:
            links[a] += 1
            links[b] += 1
            up[top(a)] = top(b)
    least_of = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least_of[top(k)] = min(i, least_of.get(top(k), i))
    return sorted(((i, links[k], least_of.get(top(k))) for k, (i, *_) in enumerate(rows)), key=str)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def test_embedding_links_of_a_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(QUERIES["op13_embedding_dedup"](spark, sf_dir)) == plain_links(rows)


def test_embedding_links_across_many_shards(spark):
    """Groups of near copies, a group that is larger than a shard and a chain of links, dealt into shards of 40 vectors."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows, i = [], 0
    for label in (1, 2):
        for size in [1] * 150 + [2] * 20 + [9] * 4 + [120]:
            centre = unit(rng.normal(size=24))
            for _ in range(size):
                rows.append((i, (unit(centre + rng.normal(size=24) * 0.04) * rng.uniform(0.1, 40)).tolist(), label))
                i += 1
        a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
        for step in range(8):  # neighbours link, others don't
            rows.append((i, (np.cos(step * 0.3) * a + np.sin(step * 0.3) * b).tolist(), label))
            i += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, recall = embedding_graph.near_duplicates(df, size=40)
    want, have = plain_links(rows), found(got)
    lost = sum(w[1] for w in want) - sum(h[1] for h in have)
    assert recall >= 0.99 and 0 <= lost <= 0.005 * sum(w[1] for w in want)
    assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True))
    assert sum(h == w for h, w in zip(have, want, strict=True)) >= 0.98 * len(want)


def test_embedding_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, -3.0, 0.5], [-2.0, 1.0, 0.0, 4.0]
    rows = [(1, None, 1), (2, [0.0] * 4, 1), (3, [nan, 1.0, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], 1), (5, [None, 1.0, 1.0, 1.0], 1), (6, v, None), (7, v, None), (8, v, 1), (9, v, 1), (9, v, 1), (9, w, 1), (10, [2 * x for x in v], 1), (None, v, 2), (None, v, 2), (None, w, 3), (11, w, 3), (12, [], 1), (13, v[:3], 1), (14, v, 3), (15, [x * 1e300 for x in w], 3), (16, [x * 1e-300 for x in w], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(0).alias(c) for c in ("node", "home", "n", "field", "copies", "one", "kept", "component_id")])
    got, recall = embedding_graph.near_duplicates(df)
    assert recall == 1.0 and found(got) == plain_links(rows)
    assert embedding_graph.near_duplicates(df.where("false"))[0].collect() == []


def test_pruning_keeps_near_neighbours_and_bounds_the_degree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    breadth = embedding_graph.Breadth()
    lists = embedding_graph.neighbours(x, breadth)
    nearest = np.argsort(-(x @ x.T), axis=1)[:, 1]
    assert all(n in lists[p] for p, n in enumerate(nearest)) and all(p not in lists[p] for p in range(300))
    assert np.mean([len(n) for n in lists]) <= 2 * (breadth.near + breadth.far)
