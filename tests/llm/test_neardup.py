"""Near duplicates against all pairs, register estimates against true similarities, components against union-find."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from obsframe.llm import neardup, shingles
from obsframe.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, kept int"


def brute_set(text: str | None, k: int) -> frozenset:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows: list[tuple], k: int = 2) -> dict[int, tuple[int, int]]:
    sets = {i: brute_set(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 20, 60, 200]))]
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 3])):  # chains of edits: links that only the middle ones hold together
            text = list(text)
            for _ in range(max(1, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(text)
    rows += [rows[3]] * 3
    texts = [" ".join(r) for r in rows]
    texts += [None, "", " \t\n", "One", "one", "ONE  ", "É", "é", "a b", "A\tb", "b a", "x " * 5000, "x " * 4000 + "y"]
    return [(i * 7 + 3, t, "mine", 9) for i, t in enumerate(texts)]


def test_groups_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == brute(rows)


def test_five_words(spark):
    rows = corpus(3)
    p = neardup.NearDupParams(words=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), p).collect()}
    assert got == brute(rows, 5)


def test_a_group_whose_first_member_is_linked_with_none(spark):
    """Members meet each other also where the bucket's ends are not linked with them."""
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(30):
        text = list(base)
        start = (i * 4) % 100
        text[start : start + 4] = [f"z{i}a", f"z{i}b", f"z{i}c", f"z{i}d"]
        rows.append((i, " ".join(text), "", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_null_and_repeated(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "p q r", "", 0), (5, "p q r", "", 0), (5, "p q r", "", 0), (6, None, "", 0), (None, "", "", 0), (5, "other words here", "", 0)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(
        [("None", 2, "5", False), ("5", 2, "5", True), ("5", 2, "5", True), ("6", 0, "6", True), ("None", 0, "None", True), ("5", 2, "5", True)]
    )
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("5", "p q r"), ("6", "None"), ("None", ""), ("5", "other words here")]
    )


def test_estimates_follow_similarity():
    rng = np.random.default_rng(5)
    p = neardup.NearDupParams()
    m = neardup._multipliers(p.registers)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n = int(rng.integers(5, 3000))
            both = rng.integers(0, 2**64, max(1, int(n * share)), dtype=np.uint64)
            rest = rng.integers(0, 2**64, (2, max(1, int(n * (1 - share) / 2))), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, r])) for r in rest]
            true = len(both) / (len(both) + rest.size)
            sketches = [neardup.registers(s, m, p.mantissa_bits)[None] for s in sets]
            found = neardup.estimate(*sketches, np.array([len(sets[0])]), np.array([len(sets[1])]), p.mantissa_bits)[0]
            errors.append(found - true)
        assert abs(np.mean(errors)) < 0.02
        assert np.max(np.abs(errors)) < 0.16


def test_registers_hold_leading_zeros_and_mantissa():
    one = np.array([np.uint64(0b1011) << np.uint64(32)])
    reg = int(neardup.registers(one, np.array([1], np.uint32), 10)[0])
    assert reg >> 10 == 28 and reg & 1023 == 0b0110000000


def test_shingle_sets_match_words():
    ids = shingles.WordIds(limit=3)  # forgetting must not change a hash
    for text in ("a b c a b", "A B c", "solo", "", " ", "é É a", "x y " * 50):
        got = shingles.shingle_set(text.encode(), 2, ids)
        assert len(got) == len(brute_set(text, 2))
    assert (shingles.shingle_set(b"a b c", 2, ids) == shingles.shingle_set(b"A  B\tC", 2, ids)).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(600, 640)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long").filter(F.lit(True))).collect() == []
