"""Byte pair encoding with a segment tree over the ranks of neighbouring pairs, and decoding.

The leaves of the tree are the ranks of the pairs of neighbours in one part of a
text. Its root is the lowest rank; going down to the left child wherever that
has it leads to the leftmost such pair. A merge changes three leaves at most, so
a part of n bytes takes O(n log n) steps however long it is. Merges stop when no
pair is in the vocabulary.

What comes before the merges (normalisation, cutting into parts, bytes as
characters) is done by the tokenizers library's own steps from the file. Under
the steps of ``bpe.STEPS`` no part reaches over white space, so the ids of a
stretch are remembered; other files have whole texts cut at once.

A null text is an empty one and has no ids. Rows that repeat are encoded as
often as they occur, a null id is an id like any other, and empty tables give
none. Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavelead.llm.bpe import STEPS, byte_characters
from wavelead.llm.text import in_parts

NONE = (1 << 31) - 1  # the rank of a pair that is not in the vocabulary
# Parts of more symbols are merged one by one, and so many cells at once otherwise.
WIDEST = 64
CELLS = 1 << 20


class PairTree:
    """Lowest rank of neighbouring pairs, and where it stands first."""

    def __init__(self, ranks: list[int]):
        self.leaves = 1 << max(len(ranks) - 1, 0).bit_length()
        tree = self.tree = [NONE] * self.leaves + ranks + [NONE] * (self.leaves - len(ranks))
        for node in range(self.leaves - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

    def first(self) -> int:
        """Leaf of the leftmost pair with the lowest rank; -1 if there is none."""
        tree, node = self.tree, 1
        lowest = tree[1]
        if lowest == NONE:
            return -1
        while node < self.leaves:
            node *= 2
            if tree[node] != lowest:
                node += 1
        return node - self.leaves

    def set(self, leaf: int, rank: int) -> None:
        tree, node = self.tree, leaf + self.leaves
        tree[node] = rank
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            lowest = left if left <= right else right
            if tree[node] == lowest:
                return
            tree[node] = lowest


class TreeBpe:
    """Ids of texts under a vocabulary file of the tokenizers library, and texts of ids.

    What was met before is remembered, parts and stretches, until there are
    more than ``limit`` of them at the end of a batch. New parts of a batch are
    merged together, each in a segment tree of its own.
    """

    def __init__(self, vocabulary: str, limit: int = 400_000):
        spec = json.loads(vocabulary)
        model = spec["model"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in options):
            raise ValueError("not a plain BPE vocabulary")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens have to stand for themselves")
        self.decoder = (spec.get("decoder") or {"type": None})["type"]
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {self.decoder}")
        library = Tokenizer.from_str(vocabulary)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Rank of a pair of ids, and the id that it becomes.
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("|".join(re.escape(t) for t in longest_first) or "(?!)")
        known = ids | self.added
        self.tokens = [None] * (max(known.values(), default=-1) + 1)
        for token, id_ in known.items():
            self.tokens[id_] = token
        self.token_array = pa.array([*self.tokens, None], pa.string())
        # Ids of single characters, inside a part and at its end; -1 where there is none.
        suffix = model.get("end_of_word_suffix") or ""
        characters = {t: i for t, i in ids.items() if len(t) == 1}
        ends = {t[0]: i for t, i in ids.items() if len(t) == 1 + len(suffix) and t.endswith(suffix)}
        top = max(map(ord, characters | ends), default=0) + 2
        self.inside, self.at_end = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for table, entries in ((self.inside, characters), (self.at_end, ends)):
            for character, id_ in entries.items():
                table[ord(character)] = id_
        # The pairs as sorted numbers, for many at once. ``none`` is an id that no pair has.
        self.none = len(self.tokens)
        keys = np.array([a * (self.none + 1) + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.key_ranks = np.append(np.array(list(self.ranks.values()), np.int32)[order], NONE).astype(np.int32)
        self.merged_array = np.array([*self.merged, self.none], np.int64)
        self.by_stretch = all(spec[k] == v for k, v in STEPS.items()) and not any(
            c.isspace() for t in self.added for c in t
        )
        self.limit = limit
        self.parts: dict[str | int, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours, always the leftmost pair of lowest rank, until none is left."""
        n, ranks = len(ids), self.ranks
        tree = PairTree([ranks.get(pair, NONE) for pair in zip(ids, ids[1:])])
        ids, before, after = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        while (at := tree.first()) >= 0:
            ids[at] = self.merged[tree.tree[1]]
            gone = after[at]
            behind = after[at] = after[gone]
            if gone < n - 1:
                tree.set(gone, NONE)
            if behind < n:
                before[behind] = at
                tree.set(at, ranks.get((ids[at], ids[behind]), NONE))
            else:
                tree.set(at, NONE)
            if (left := before[at]) >= 0:
                tree.set(left, ranks.get((ids[left], ids[at]), NONE))
        merged, at = [], 0
        while at < n:
            merged.append(ids[at])
            at = after[at]
        return merged

    def merge_many(self, ids: np.ndarray) -> None:
        """``merge`` of every row at once, in place; ``none`` fills the rows up and takes the place of what goes.

        One array holds a segment tree for each row. In every round each row that
        still has a mergeable pair goes down its tree to it and updates three leaves.
        """
        rows, width = ids.shape
        leaves = 1 << max(width - 2, 0).bit_length()
        levels = leaves.bit_length() - 1
        tree = np.full((rows, 2 * leaves), NONE, np.int32)
        tree[:, leaves : leaves + width - 1] = self._rank(ids[:, :-1], ids[:, 1:])
        for level in range(levels - 1, -1, -1):
            a = 1 << level
            np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
        # Neighbours of every place; one place more on either side stands for no neighbour.
        after = np.tile(np.arange(1, width + 2), (rows, 1)).ravel()
        before = np.tile(np.arange(-1, width), (rows, 1)).ravel()
        flat, nodes = np.hstack([ids, np.full((rows, 1), self.none)]).ravel(), tree.ravel()
        width += 1

        def update(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray | int) -> None:
            base = row * (2 * leaves)
            node = leaf + leaves
            nodes[base + node] = rank
            for _ in range(levels):
                node = node >> 1
                two = base + 2 * node
                nodes[base + node] = np.minimum(nodes[two], nodes[two + 1])

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            base = row * (2 * leaves)
            lowest = nodes[base + 1]
            node = np.ones(len(row), np.int64)
            for _ in range(levels):
                node *= 2
                node += nodes[base + node] != lowest
            place = row * width + node - leaves
            gone = row * width + after[place]
            behind = after[gone]
            flat[place] = self.merged_array[lowest]
            flat[gone] = self.none
            after[place] = behind
            before[row * width + behind] = node - leaves
            last = after[place] >= width - 1
            # The pair that the merged place's right half began is no more.
            inner = np.flatnonzero(gone - row * width < width - 2)
            update(row[inner], (gone - row * width)[inner], NONE)
            rank = self._rank(flat[place], flat[row * width + behind])
            update(row, node - leaves, np.where(last, NONE, rank))
            left = before[place]
            with_left = np.flatnonzero(left >= 0)
            first = row[with_left] * width + left[with_left]
            update(row[with_left], left[with_left], self._rank(flat[first], flat[place[with_left]]))
            row = row[nodes[base + 1] != NONE]
        ids[:] = flat.reshape(rows, width)[:, :-1]

    def merge_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of every part, as little-endian 32-bit integers."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.minimum(np.frombuffer("".join(parts).encode("utf-32-le"), "<u4"), len(self.inside) - 1)
        symbols = self.inside[points]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.at_end[points[ends - 1]]
        # A symbol without an id goes, as the file names no token for unknown ones.
        has = symbols >= 0
        owner = np.repeat(np.arange(len(parts)), size)[has]
        symbols = symbols[has]
        size = np.bincount(owner, minlength=len(parts))
        starts = np.cumsum(size) - size
        merged = [b""] * len(parts)
        for k in np.flatnonzero(size > WIDEST).tolist():
            ids = symbols[starts[k] : starts[k] + size[k]].tolist()
            merged[k] = np.array(self.merge(ids), "<i4").tobytes()
        width = 1
        while width < WIDEST:
            narrower, width = width, 2 * width if width > 1 else 2
            found = np.flatnonzero((size > (narrower if narrower > 1 else 0)) & (size <= width))
            for some in np.array_split(found, -(-len(found) * width // CELLS)) if len(found) else []:
                column = np.arange(width)
                inside = column < size[some, None]
                ids = np.where(inside, symbols[np.minimum(starts[some, None] + column, len(symbols) - 1)], self.none)
                self.merge_many(ids)
                left = ids != self.none
                packed = ids[left].astype("<i4").tobytes()
                stops = (4 * np.cumsum(left.sum(1))).tolist()
                for k, a, b in zip(some.tolist(), [0, *stops], stops):
                    merged[k] = packed[a:b]
        return merged

    def _cut(self, text: str) -> list[str | int]:
        """Parts of a text, by the steps of the file; added tokens as their ids."""
        parts, at = [], 0
        for match in [*self.added_pattern.finditer(text), None]:
            between = text[at : match.start() if match else len(text)]
            if between and self.normalizer:
                between = self.normalizer.normalize_str(between)
            if between:
                cut = self.cutter.pre_tokenize_str(between) if self.cutter else [(between, None)]
                parts += [p for p, _ in cut if p]
            if match:
                parts.append(self.added[match.group()])
                at = match.end()
        return parts

    def _cut_many(self, stretches: list[str]) -> list[str | int | None]:
        """Parts of all stretches, one after another, each stretch closed by ``None``."""
        joined = "\n".join(stretches)
        if not self.by_stretch or not _PLAIN.fullmatch(joined) or self.added_pattern.search(joined):
            plain = [self.by_stretch and _PLAIN.fullmatch(s) and not self.added_pattern.search(s) for s in stretches]
            if not any(plain):
                return [p for s in stretches for p in (*self._cut(s), None)]
            easy = iter(self._cut_many([s for s, p in zip(stretches, plain) if p]))
            parts = []
            for stretch, p in zip(stretches, plain):
                parts += [*iter(easy.__next__, None), None] if p else [*self._cut(stretch), None]
            return parts
        parts = _PARTS.findall(joined.lower() + "\n")
        # ASCII stands for itself.
        if others := [] if joined.isascii() else [k for k, p in enumerate(parts) if not p.isascii()]:
            mapped = "\x00".join([parts[k] for k in others]).encode().decode("latin-1").translate(_CHARACTERS)
            for k, part in zip(others, mapped.split("\x00")):
                parts[k] = part
        return [None if p == "\n" else p for p in parts]

    def _learn(self, stretches: list[str]) -> None:
        """Remember the ids of stretches not met before."""
        cut = self._cut_many(stretches)
        new = [p for p in dict.fromkeys(cut) if p not in self.parts]
        words = [p for p in new if isinstance(p, str)]
        self.parts.update(zip(words, self.merge_parts(words)))
        self.parts.update((p, np.array([p], "<i4").tobytes()) for p in new if isinstance(p, int))
        self.parts[None] = b""
        found = [self.parts[p] for p in cut]
        size = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        ends = size[[k for k, p in enumerate(cut) if p is None]].tolist()
        joined = b"".join(found)
        self.stretches.update(zip(stretches, [joined[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text; those of a null are the empty list."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.by_stretch:
            split = pc.ascii_split_whitespace(texts)
            stretches, offsets = split.flatten().dictionary_encode(), np.asarray(split.offsets) - split.offsets[0].as_py()
        else:
            stretches, offsets = texts.dictionary_encode(), np.arange(len(texts) + 1)
        distinct = stretches.dictionary.to_pylist()
        if new := [s for s in distinct if s not in self.stretches]:
            self._learn(new)
        found = [self.stretches[s] for s in distinct]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(size) - size
        ids, which = np.frombuffer(b"".join(found), "<i4"), np.asarray(stretches.indices)
        ends = np.cumsum(size[which])
        before = np.append(0, ends)
        pieces = []
        for a in range(0, len(which), CELLS):
            some = which[a : a + CELLS]
            shift = np.repeat(starts[some] - before[a : a + len(some)], size[some])
            pieces.append(ids[shift + np.arange(before[a], before[a] + len(shift))])
        for memory in (self.stretches, self.parts):
            if len(memory) > self.limit or not self.by_stretch:
                memory.clear()
        values = pa.array(np.concatenate(pieces) if pieces else ids[:0], pa.int32())
        return pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), values)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of every list of ids; ids that are not in the vocabulary are left out, a null gives an empty text."""
        flat = ids.flatten()
        if self.decoder is None and not flat.null_count:
            known = self.token_array.take(pc.if_else(pc.less(flat, len(self.tokens)), flat, len(self.tokens)))
            if not known.null_count:
                ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), known)
                return pc.binary_join(lists, " ")
        return pa.array([self._text(row or []) for row in ids.to_pylist()], pa.string())

    def _text(self, ids: list[int | None]) -> str:
        found = [t for t in (self.tokens[i] if i is not None and 0 <= i < len(self.tokens) else None for i in ids) if t]
        if self.decoder is None:
            return " ".join(found)
        # A token that is not written in byte characters stands for itself.
        return b"".join(
            bytes(map(_BYTES.__getitem__, t)) if all(c in _BYTES for c in t) else t.encode() for t in found
        ).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def shared_bpe(vocabulary: str) -> TreeBpe:
    """One ``TreeBpe`` for all tasks of a Python worker, which start with what the ones before have met."""
    return TreeBpe(vocabulary)


# Stretches that no normalisation but lower case changes (one to a line), and the pattern of STEPS for them.
_PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|\n|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
_CHARACTERS = {b: c for b, c in byte_characters().items() if b not in b"\n\x00"}
_BYTES = {character: byte for byte, character in byte_characters().items()}


def encode_documents(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """doc_id and the ids of the whole text; with ``decoded`` also the text that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(shared.value)
        for whole in batches:
            for batch in in_parts(whole, 1):
                ids = bpe.encode(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, *[bpe.decode(ids)] * decoded], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, ids array<int>" + ", decoded string" * decoded
    )


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text of the ids, ``decoded``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), bpe.decode(batch.column(1))], names=["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")
