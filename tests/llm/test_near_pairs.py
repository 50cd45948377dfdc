"""Candidates and components of the near-duplicate operator against brute force."""

from __future__ import annotations

import random

import pytest

from pairlens.llm import minhash_dedup
from pairlens.llm.components import components

SIZE, PERCENT = 4, 80


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w)} if len(w) < SIZE else {tuple(w[i:i + SIZE]) for i in range(len(w) - SIZE + 1)}


@pytest.fixture(scope="module")
def templates() -> list[tuple[int, str]]:
    """Groups of edited copies around the similarity, short texts and repeated ones."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(rng.randint(8, 60))]
        for k in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(60)}"
            rows.append((g * 100 + k, " ".join(words[:len(words) - rng.randint(0, 3)])))
    return rows + [(900 + i, t) for i, t in enumerate(["a", "a b", "a b c", "a b c d", "a b c d", "x"])]


def similar(rows: list[tuple[int, str]]) -> set:
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= PERCENT * len(sets[a] | sets[b])}


def test_rare_shingles_miss_no_pair(spark, templates):
    texts = spark.createDataFrame(templates, "__id long, __text string")
    held = texts.selectExpr("__id AS rep", "__id AS c1")
    found = {tuple(r) for r in minhash_dedup._by_rare_shingles(texts, held, SIZE, PERCENT).collect()}
    true = similar(templates)
    assert true and true <= found
    assert len(found) < 2 * len(true)


def test_components_of_templates(spark, templates):
    docs = spark.createDataFrame(templates, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, shingle=SIZE).collect()}
    least = {i: i for i, _ in templates}
    for _ in templates:
        for a, b in similar(templates):
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in similar(templates)):
            break
    assert got == least


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (1, 3)], [(1, 3), (2, 3)], [(i, i + 1) for i in range(40)], [(5, 4), (4, 5), (9, 7)]])
def test_components_stop_at_stars(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {v: v for a, b in edges if a != b for v in (a, b)}
    for _ in range(len(edges) + 1):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
