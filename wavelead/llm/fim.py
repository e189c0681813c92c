"""Fill-in-middle: a document is cut at two of its units and put together in another order.

A unit is a word with the white space before it, or white space at the end of
the text. The units of a text stand in an indexable skip list: every link of
every lane carries the number of units and the number of code points that it
passes, so a descent that adds up the units arrives at a rank and knows the code
point it stands at. Nothing but the lanes of one document is held at a time.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` the text as it is. Cuts and forms follow from a hash of the seed and
the id alone, so they are the same in every run and on any cluster.

A null text is an empty one; empty texts and texts that hold a mark stay plain.
A null id is hashed as an empty string. Rows that repeat an id are cut at the
same ranks, each in its own text. Empty tables give none. Only the id and text
columns are read; others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.llm.text import mix

# One unit in so many stands in the lane above as well.
FAN = 4
MARKS = ("<P>", "<S>", "<M>")
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Towers:
    """How high the tower of every rank is: the same for all lists, as it follows from a hash of the rank.

    ``ranks[k]`` are the ranks that stand in lane ``k``, the head (rank 0)
    first; ``below[k]`` their places in the lane under it. Grown by doubling.
    """

    def __init__(self):
        self.size = 0
        self.grow(1024)

    def grow(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = max(size, 2 * self.size)
        ranks = np.arange(self.size + 1, dtype=np.int64)
        self.ranks, self.below = [ranks], [np.zeros(0, np.int64)]
        chance = mix(ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        while len(ranks) > FAN:
            higher = (chance % np.uint64(FAN) == 0) | (ranks == 0)
            self.below.append(np.flatnonzero(higher))
            ranks, chance = ranks[higher], chance[higher] // np.uint64(FAN)
            self.ranks.append(ranks)


class SkipList:
    """Units of one text, from the code points at which they end.

    Lane ``k`` is two arrays, ``units[k][j]`` and ``points[k][j]``: what the link
    from the lane's node ``j`` to its node ``j + 1`` passes.
    """

    def __init__(self, ends: np.ndarray, towers: Towers):
        towers.grow(len(ends))
        at = np.concatenate([np.zeros(1, np.int64), ends])
        self.units, self.points, self.below = [], [], towers.below
        for ranks in towers.ranks:
            ranks = ranks[: np.searchsorted(ranks, len(ends), "right")]
            if self.units and len(ranks) == 1:
                break
            self.units.append(np.diff(ranks))
            self.points.append(np.diff(at[ranks]))

    def __len__(self) -> int:
        return len(self.units[0])

    def code_points(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        units = points = node = 0
        for lane in range(len(self.units) - 1, -1, -1):
            widths, lengths = self.units[lane], self.points[lane]
            while node < len(widths) and units + widths[node] <= rank:
                units += int(widths[node])
                points += int(lengths[node])
                node += 1
            if lane:
                node = int(self.below[lane][node])
        if units != rank:
            raise IndexError(f"{rank} of {len(self)} units")
        return points


def unit_ends(text: str) -> np.ndarray:
    """The code point at which each unit ends: where a word does, and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (points == 32) | (points - np.uint32(9) < 5)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(points)) if len(points) else ends


def hashed(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit words of the SHA-256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row per document: its units, its form, the code points of prefix and middle, the new text.

    ``rate`` percent of the documents are transformed, ``spm_rate`` percent of
    these to ``spm``. The lengths are null for plain documents.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towers = Towers()
        before, after, middle = marks
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                units = SkipList(unit_ends(text), towers)
                n = len(units)
                h1, h2, h3, h4 = hashed(seed, doc_id)
                if not text or any(m in text for m in marks) or h3 % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = units.code_points(first), units.code_points(second)
                if h4 % 100 < spm_rate:
                    form, output = "spm", f"{after}{text[b:]}{before}{text[:a]}{middle}{text[a:b]}"
                else:
                    form, output = "psm", f"{before}{text[:a]}{after}{text[b:]}{middle}{text[a:b]}"
                rows.append((doc_id, n, form, a, b - a, output))
            columns = zip(*rows) if rows else [()] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(transform, TRANSFORMED)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The original text, from the transformed text and its form alone.

    No transformed text held a mark before, and marks begin with a sign that
    occurs nowhere else in them, so none can arise where two parts meet.
    """
    if any(not m or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1:
        raise ValueError("marks have to begin with one sign that they hold only there")
    parts = F.split(output, "|".join(re.escape(m) for m in marks))  # nothing, then the three parts
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )
