"""The near-copies stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

import corpus_pipeline


def shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_only_texts_of_similarity_four_fifths_are_dropped(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 400, 200)]
        texts.append(" ".join(words))
        for edits in (1, 3, 4, 5, 7, 12):  # similarities from 0.95 to 0.5, on both sides of 0.8
            changed = list(words)
            for at in rng.choice(200, edits, replace=False):
                changed[at] = f"v{rng.integers(0, 400)}"
            texts.append(" ".join(changed))
    texts += [texts[0], "", " \n", "one two", "One  two", "one two three"]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {i for i, m in enumerate(least) if i == m}
    assert len(texts) / 3 < len(kept) < len(texts) * 2 / 3


def test_most_of_many_near_copies_are_found(spark):
    """Pairs at 0.8 to 0.85, the hardest: single words that differ, or one passage."""
    rng, texts, want = np.random.default_rng(8), [], 0
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 2000, 240)]
        other = list(words)
        if i % 4:
            for at in rng.choice(240, 5, replace=False):
                other[at] = f"v{rng.integers(0, 2000)}"
        else:
            at = int(rng.integers(0, 220))
            other[at : at + 16] = [f"v{k}" for k in rng.integers(0, 2000, 16)]
        texts += [" ".join(words), " ".join(other)]
        want += 0.8 <= similarity(texts[-2], texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    lost = {i for i in range(len(texts)) if i not in kept}
    assert all(i % 2 and similarity(texts[i], texts[i - 1]) >= 0.8 for i in lost)  # no false link
    assert want > 500 and len(lost) >= 0.95 * want
