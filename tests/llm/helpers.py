"""Fixtures of texts and plain versions of the word rules."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, a long, text_x string, n long, h string, bin_id string, gone string"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def vocabulary(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéßfghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def text_of(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def frame(spark, rows):
    """Documents (id, text, lang) with extra columns whose names clash with internal ones."""
    full = [(i, t, *(rest or ["en"]), 1, "x", 2, "h", "b", "g") for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)
