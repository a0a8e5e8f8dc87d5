from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from obsframe.llm import phrases
from obsframe.llm.phrases import PhraseParams

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, p):
    counts, words_in = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            words_in[lang] += len(words)
            for k in range(1, p.longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {w: n for w, n in f.items() if n >= p.least}
        scored = []
        for w, a in held.items():
            if len(w) < 2:
                continue
            longer = [n for v, n in held.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if any(100 * n >= p.cover_percent * a for n in longer):
                continue
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (s, a, w, left, right) in enumerate(sorted(scored)[: p.top], 1):
            out.append((lang, rank, w.decode(), -a, left, right, words_in[lang], -s))
    return sorted(out)


def found(spark, rows, p):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(docs, p).collect())


def corpus(rng, n):
    words = ["the", "Of", "é", "É", "x y", "in", "big", "data", "a", "b", "\x1c"]
    fixed = ["in the big data", "of the", "A a a a a", "data of é"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice([". ", ",", "\n", " ", "\t\t", "  ", "\r\n", "!?"]).join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t ", "fr"), ("...", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("p", [PhraseParams(least=3), PhraseParams(least=2, top=7, block_words=4), PhraseParams(least=4, longest=3, block_words=13)])
def test_like_brute_force(spark, p):
    rows = corpus(random.Random(p.least), 70)
    got = found(spark, rows, p)
    assert got == brute(rows, p) and len(got) > 10


def test_long_pieces_cross_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_SLICE", 11)
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(["up", "down", "left", "longest-word-of-them-all"], k=300)), "en")]
    p = PhraseParams(least=3, block_words=17)
    assert found(spark, rows, p) == brute(rows, p)


def test_empty_table_and_extra_columns(spark):
    assert found(spark, [], PhraseParams()) == []
    docs = spark.createDataFrame([("to be or. to be", "en", 1, "q")] * 15, "text string, lang string, phrase int, words string")
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert got == [("en", 1, "to be", 30, 30, 30, 75, 1_000_000)]
    with pytest.raises(ValueError):
        PhraseParams(longest=1)
