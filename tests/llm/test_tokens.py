"""Operators 1, 2 and 10 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import TEXTS, awkward, empty
from tokenizers import Tokenizer

from wavelead.llm.bpe import WordBpe
from wavelead.llm.bpe_tree import shared_bpe
from wavelead.llm.packing import SIZE, first_fit_decreasing, pack_documents
from wavelead.llm.pieces import CharacterMap, PieceModel, encode_documents
from wavelead.llm.queries import op1_sentencepiece, op2_token_files, op10_packing, piece_model, vocabulary
from wavelead.llm.token_files import decode_ranks, encode_ranks, token_files

SF = "/root/testdata/sf0.001"
SIGNS = "aB'sétß 9́ \x1c\xa0\x85İΣς½<s><|endoftext|>▁ \n\t&ﬁ漢🙂٣ÀŸ\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(vocabulary())


@pytest.fixture(scope="module")
def pieces_library():
    return sentencepiece.SentencePieceProcessor(model_proto=piece_model())


def random_texts(n):
    chance = random.Random(7)
    return ["".join(chance.choice(SIGNS) for _ in range(chance.randrange(40))) for _ in range(n)]


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_ids_equal_library(library):
    bpe = WordBpe(vocabulary(), limit=50)
    assert bpe.by_stretch
    for text in [*random_texts(1500), *[t or "" for t in TEXTS]]:
        assert bpe.encode(text) == ids_of(library, text, 0)[:-1].tobytes()


def test_pieces_equal_library(pieces_library):
    model = PieceModel(piece_model(), limit=60)
    texts = [*random_texts(1500), *[t or "" for t in TEXTS]]
    for text, (ids, starts, ends) in zip(texts, model.encode(texts)):
        assert ids.tolist() == pieces_library.encode(text)
        assert model.decode(ids.tolist()) == pieces_library.decode(ids.tolist())
        source = text.encode()
        assert not len(ids) or (starts[0] == 0 and ends[-1] == len(source))
        for a, b in zip(starts.tolist(), ends.tolist()):
            source[a:b].decode()  # no span cuts a character


def test_spans_hold_the_pieces():
    model = PieceModel(piece_model())
    text = "Hello  wörld 漢!"
    (ids, starts, ends), = model.encode([text])
    shown = [model.surfaces[i].decode("utf-8", "replace").lstrip() for i in ids.tolist()]
    for piece, a, b in zip(shown, starts.tolist(), ends.tolist()):
        if "�" not in piece:
            assert text.encode()[a:b].decode().lstrip() == piece


def test_broken_bytes_decode_like_library(pieces_library):
    model = PieceModel(piece_model())
    chance = random.Random(3)
    for _ in range(300):
        ids = [chance.choice([*range(3, 259), 400, 1000]) for _ in range(6)]
        assert model.decode(ids) == pieces_library.decode(ids)


def test_character_map_takes_the_longest_prefix():
    # A trie of "a" -> "x" and "ab" -> "yz": units by hand, in the format of the compiled map.
    def unit(label, offset, leaf=False):
        return label | offset << 10 | leaf << 8

    units = [0] * 512
    units[0] = unit(0, 1)
    a = 1 ^ ord("a")
    units[a] = unit(ord("a"), a ^ 256, True)
    units[256] = 0x80000000 | 0
    b = 256 ^ ord("b")
    units[b] = unit(ord("b"), b ^ 300, True)
    units[300] = 0x80000000 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    table = CharacterMap(blob)
    assert table.longest(b"ac", 0) == (1, b"x")
    assert table.longest(b"zabc", 1) == (2, b"yz")
    assert table.longest(b"c", 0) is None


def test_normalisation_records_the_source():
    model = PieceModel(piece_model())
    model.trim, model.splits = True, True
    normal, origin = model.normalize("  a   b ")
    assert normal.decode() == "▁a▁b"
    assert origin.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]


def test_encoding_of_awkward_tables(spark, pieces_library):
    rows = encode_documents(awkward(spark), piece_model()).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    for row in rows:
        ids = pieces_library.encode(texts[row["doc_id"]] or "")
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["n_bytes"] == len((texts[row["doc_id"]] or "").encode())
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(pieces_library.decode(ids).encode()).hexdigest()
    assert encode_documents(empty(spark), piece_model()).count() == 0


def test_op1(spark, pieces_library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op1_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = pieces_library.encode(texts[row["doc_id"]])
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(pieces_library.decode(ids).encode()).hexdigest()


def test_rank_code_round_trip():
    chance = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        ranks = (2 ** chance.uniform(0, 32, n)).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (decode_ranks(control, data)[:n] == ranks).all()


def check_token_files(rows, texts, library):
    start = 0
    rows = sorted(rows, key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"]) for r in rows]
    assert all(a[0] <= b[0] and (not a[0] or a <= b) for a, b in zip(keys, keys[1:]))
    for row in rows:
        ids = ids_of(library, texts[row["doc_id"]], 1)
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_files(spark, library):
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    rows = token_files(awkward(spark), vocabulary()).collect()
    assert len(rows) == len(TEXTS) + 2
    check_token_files(rows, texts, library)
    for row in rows:
        assert row["ids"] == ids_of(library, texts[row["doc_id"]], 1).tolist()
    assert token_files(empty(spark), vocabulary()).count() == 0


def test_op2(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op2_token_files(spark, SF).collect()
    assert len(rows) == len(texts)
    check_token_files(rows, texts, library)


def test_tasks_of_a_worker_share_what_they_met(library):
    texts = [*random_texts(300), "Größe ÀÉ größe's plain", "ascii only"]
    for _ in range(2):
        bpe = shared_bpe(vocabulary())
        assert [i.as_py() for i in bpe.encode(pa.array(texts))] == [ids_of(library, t, 0)[:-1].tolist() for t in texts]
    assert bpe is shared_bpe(vocabulary())
    assert bpe.stretches and bpe.parts


def check_packing(rows, texts, library, copies=1):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SIZE
    for doc_id, pieces in documents.items():
        ids = ids_of(library, texts[doc_id], 2)
        covered = sorted((p["start"], p["length"]) for p in pieces)
        assert sum(n for _, n in covered) % len(ids) == 0
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    return sum(n for parts in sequences.values() for _, n in parts) / (SIZE * len(sequences))


def test_op10(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op10_packing(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(library, t, 2)) for t in texts.values())
    assert check_packing(rows, texts, library) > 0.97


def test_packing_of_awkward_tables(spark, library):
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    rows = pack_documents(awkward(spark), vocabulary()).collect()
    check_packing(rows, texts, library)
    total = sum(len(ids_of(library, t, 2)) for t in [*TEXTS, TEXTS[5], TEXTS[5]])
    assert sum(r["length"] for r in rows) == total
    assert pack_documents(empty(spark), vocabulary()).count() == 0


def test_first_fit_equals_a_plain_search():
    chance = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 200):
        lengths = chance.integers(1, 100, n)
        bins, offsets = first_fit_decreasing(lengths, 100)
        room = []
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            b = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= lengths[k]
