"""Operator 12 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import TEXTS, awkward, empty
from tokenizers import Tokenizer

from wavelead.llm import bpe_tree
from wavelead.llm.bpe_tree import NONE, PairTree, TreeBpe
from wavelead.llm.queries import op12_segment_tree_bpe, vocabulary

SF = "/root/testdata/sf0.001"
SIGNS = "aB'sétß 9́ \x1c\xa0\x85İΣς½<s><|endoftext|>▁ \n\t&ﬁ漢🙂٣ÀŸ\x00"


def random_texts(n):
    chance = random.Random(11)
    texts = ["".join(chance.choice(SIGNS) for _ in range(chance.randrange(40))) for _ in range(n)]
    words = ["the", "thing's", "an<|endoftext|>other", "été", "ŒUVRE", "a" * 70, "<|startoftext|>", "x9y"]
    return texts + [" ".join(chance.choice(words) for _ in range(12)) for _ in range(n // 10)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [0, 400_000])
def test_ids_and_texts_equal_the_library(name, limit):
    library, bpe = Tokenizer.from_str(vocabulary(name)), TreeBpe(vocabulary(name), limit)
    texts = [*random_texts(800), *[t or "" for t in TEXTS], "ab" * 3000]
    for some in (texts[:300], texts[300:], []):
        ids = bpe.encode(pa.array(some, pa.string()))
        decoded = bpe.decode(ids).to_pylist()
        assert len(ids) == len(decoded) == len(some)
        for text, found, back in zip(some, ids.to_pylist(), decoded):
            assert found == library.encode(text, add_special_tokens=False).ids
            assert back == library.decode(found, skip_special_tokens=False)


def test_the_tree_gives_the_leftmost_of_the_lowest():
    chance = random.Random(3)
    for _ in range(300):
        ranks = [chance.choice([NONE, *range(5)]) for _ in range(chance.randrange(1, 20))]
        tree = PairTree(list(ranks))
        for _ in range(20):
            lowest = min(ranks)
            assert tree.first() == (-1 if lowest == NONE else ranks.index(lowest))
            k = chance.randrange(len(ranks))
            ranks[k] = chance.choice([NONE, *range(5)])
            tree.set(k, ranks[k])


def plain_merge(bpe, ids):
    ids = list(ids)
    while True:
        ranks = [bpe.ranks.get(p, NONE) for p in zip(ids, ids[1:])]
        if not ranks or min(ranks) == NONE:
            return ids
        k = ranks.index(min(ranks))
        ids[k : k + 2] = [bpe.merged[min(ranks)]]


def test_merges_one_by_one_and_together_equal_a_plain_search():
    bpe, chance = TreeBpe(vocabulary()), random.Random(5)
    letters = [int(i) for i in bpe.inside[97:101]]
    for width in (2, 3, 5, 9, 33, 64):
        rows = [[chance.choice(letters) for _ in range(chance.randrange(1, width + 1))] for _ in range(40)]
        many = np.full((len(rows), width), bpe.none)
        for k, row in enumerate(rows):
            many[k, : len(row)] = row
            assert bpe.merge(row) == plain_merge(bpe, row)
        bpe.merge_many(many)
        for k, row in enumerate(rows):
            assert many[k][many[k] != bpe.none].tolist() == plain_merge(bpe, row)


def test_ids_beyond_the_vocabulary_are_left_out():
    library, bpe = Tokenizer.from_str(vocabulary()), TreeBpe(vocabulary())
    ids = [[320, 49407, 49408, 10**6, 5], None, []]
    texts = bpe.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert texts == [library.decode(i or [], skip_special_tokens=False) for i in ids]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        TreeBpe(vocabulary().replace('"unk_token":null', '"unk_token":"x"').replace('"unk_token": null', '"unk_token": "x"'))


def check(rows, texts):
    library = Tokenizer.from_str(vocabulary())
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_awkward_tables(spark):
    library = Tokenizer.from_str(vocabulary())
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    rows = bpe_tree.decode_documents(bpe_tree.encode_documents(awkward(spark), vocabulary()), vocabulary()).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        assert row["ids"] == library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["decoded"] == library.decode(row["ids"], skip_special_tokens=False)
    assert bpe_tree.decode_documents(bpe_tree.encode_documents(empty(spark), vocabulary()), vocabulary()).count() == 0


def test_op12(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op12_segment_tree_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
