"""Operator 3: what a layout has to satisfy."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import TEXTS, awkward, empty

from wavelead.llm.queries import op3_sharding
from wavelead.llm.sharding import assign

SF = "/root/testdata/sf0.01"


def check(rows, texts, shards=40):
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return np.array([sizes[k] for k in range(shards)])


def homes(rows, texts):
    found = defaultdict(set)
    for r in rows:
        found[texts[r["doc_id"]]].add(r["shard"])
    return found


def test_op3(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op3_sharding(spark, SF).collect()
    assert len(rows) == len(texts)
    sizes = check(rows, texts)
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()
    counts = Counter(texts.values())
    assert all(len(h) == 1 for t, h in homes(rows, texts).items() if counts[t] < 4)


def test_many_blocks_and_a_hot_group(spark):
    """A third of all rows are copies of one text; the others are packed in many blocks."""
    chance = np.random.default_rng(3)
    texts = {k: "t" * int(n) + str(k) for k, n in enumerate(chance.lognormal(5, 1, 6000))}
    texts |= {k: "copy " * 60 for k in range(6000, 9000)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = assign(frame, shards=8, block=300).collect()
    assert len(rows) == 9000
    sizes = check(rows, texts, 8)
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()
    found = homes(rows, texts)
    assert all(len(h) == 1 for t, h in found.items() if t != texts[8000])
    tokens = Counter()
    for r in rows:
        tokens[r["shard"]] += 1
    assert max(tokens.values()) < 1.6 * min(tokens.values())


def test_awkward_tables(spark):
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    rows = assign(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    check(rows, texts)
    assert assign(empty(spark)).count() == 0
