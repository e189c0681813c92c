"""Operator 11 against cuts by a plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import TEXTS, awkward, empty
from pyspark.sql import functions as F

from wavelead.llm.fim import SkipList, Towers, fill_in_middle, restore, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"


def check(rows):
    for row in rows:
        n, form, prefix, middle, output = expected(row["doc_id"], row["text"])
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, prefix, middle)
        assert row["output"] == output and row["restored"] == (row["text"] or "")
    return {row["form"] for row in rows}


def transformed(docs):
    made = fill_in_middle(docs.select("doc_id", "text")).withColumn("restored", restore(F.col("output"), F.col("form")))
    return made.join(docs.select("doc_id", "text").distinct(), "doc_id").collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 63, 64, 65, 1000, 5000])
def test_every_rank_is_reached(n):
    ends = np.cumsum(np.random.default_rng(n).integers(1, 9, n))
    units = SkipList(ends, Towers())
    assert len(units) == n
    for rank in {*range(min(n, 70) + 1), n, n // 2}:
        assert units.code_points(rank) == (ends[rank - 1] if rank else 0)
    with pytest.raises(IndexError):
        units.code_points(n + 1)


def test_descents_are_short():
    towers = Towers()
    units = SkipList(np.arange(1, 100_001), towers)
    steps = 0

    class Counting(list):
        def __getitem__(self, k):
            nonlocal steps
            steps += 1
            return super().__getitem__(k)

    units.units = [Counting(u.tolist()) for u in units.units]
    chance = random.Random(1)
    for _ in range(200):
        units.code_points(chance.randrange(100_001))
    assert steps / 200 < 100
    assert sum(map(len, units.units)) < 1.5 * 100_000  # the lanes above add a third


def test_units_are_those_of_the_pattern():
    chance = random.Random(4)
    for k in range(500):
        text = "".join(chance.choice(" \t\n\x0b\x1c\x85\xa0a🙂é<") for _ in range(chance.randrange(30)))
        assert unit_ends(text).tolist() == np.cumsum([len(u) for u in UNIT.findall(text)]).astype(int).tolist()


def test_awkward_tables(spark):
    docs = awkward(spark)
    rows = fill_in_middle(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    for row in rows:
        assert tuple(row[1:]) == expected(row["doc_id"], texts[row["doc_id"]])
    assert fill_in_middle(empty(spark)).count() == 0


def test_texts_come_back(spark):
    chance = random.Random(2)
    signs = ["a", " ", "\n", "<", ">", "P", "S", "M", "é", "🙂", "<P", "S>"]
    texts = ["".join(chance.choice(signs) for _ in range(chance.randrange(40))) for _ in range(800)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert check(transformed(docs)) == {"plain", "spm", "psm"}


def test_marks_that_may_arise_are_refused():
    with pytest.raises(ValueError):
        restore(F.lit(""), F.lit("psm"), ("aa", "ab", "ac"))
