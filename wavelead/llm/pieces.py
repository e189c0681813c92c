"""SentencePiece encoding that knows the bytes of the text behind every piece, and decoding.

The text is normalised by the longest prefixes of the model's compiled
character map; next to the normalised bytes stands, for each of them, the source
byte where its replacement begins. Pieces are found in the normalised text, and
their ends looked up in that alignment give spans of the original text. The
merges are the library's: a processor made from the same model, with its
normaliser turned off, cuts the normalised text.

No piece of a model reaches from a sign into the blank after it, so the
normalised text is cut before its blanks and each stretch looked up among those
met before. (``PieceModel`` checks the pieces; if one did, texts would be cut as
a whole.)

A null text is an empty one and has no pieces. A piece of an unknown character's
bytes spans that character. Blanks that the model adds or drops span no bytes.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
# Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def message_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


def _field(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]
        # Without a map every character stands for itself.
        self.empty = not self.units

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``source[at:]`` in the map, and what replaces it."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        unit = units[0]
        node ^= _offset(unit)
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        length, start = best
        return length, self.replacements[start : self.replacements.index(b"\0", start)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceModel:
    def __init__(self, model: bytes, limit: int = 400_000):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in message_fields(model):
            if number == 1:
                fields = dict(message_fields(value))
                pieces.append((fields[1].decode(), fields.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(message_fields(value))
            elif number == 3:
                normalizer |= dict(message_fields(value))
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.blank = BLANK.encode() if normalizer.get(5, 1) else b" "
        self.suffix = bool(trainer.get(24, 0))
        self.unknown = next((k for k, p in enumerate(pieces) if p[1] == UNKNOWN), 0)
        self.defined = sorted((p.encode() for p, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.bytes = np.array([kind == BYTE for _, kind in pieces])
        # Stretches may be cut before a blank if no piece holds one after another sign.
        self.splits = not self.suffix and not any(
            BLANK in p.lstrip(BLANK) for p, kind in pieces if kind in (NORMAL, USER_DEFINED)
        )
        # The same pieces under a normaliser that changes nothing.
        plain = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model + _field(3, plain))
        self.surfaces = [self._surface(p, kind, trainer) for p, kind in pieces]
        self.widths = [1 if kind == BYTE else len(s.replace(b" ", self.blank)) for s, (_, kind) in zip(self.surfaces, pieces)]
        self.special = {k for k, (_, kind) in enumerate(pieces) if kind in (BYTE, UNKNOWN, CONTROL)}
        self.numbers = [str(k) for k in range(len(pieces))]
        codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        self.limit = limit
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    @staticmethod
    def _surface(piece: str, kind: int, trainer: dict) -> bytes:
        """What decoding makes of a piece."""
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return trainer.get(44, b" \xe2\x81\x87 ")
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and their end the byte of the source.

        Replacements and blanks follow the model's settings: blanks written as
        its sign, runs of them shortened and ends trimmed, one added in front.
        """
        source = text.encode()
        if self.map.empty and not self.trim and not self.defined:
            return self._copied(source)
        out, origin, at = bytearray(), [], 0

        def step(at: int) -> tuple[int, bytes]:
            for word in self.defined:
                if source.startswith(word, at):
                    return len(word), word
            if found := self.map.longest(source, at):
                return found
            size = _width(source[at])
            return size, source[at : at + size]

        if self.trim:
            while at < len(source) and (found := step(at))[1] in (b" ", b""):
                at += found[0]
        if at == len(source):
            return b"", np.zeros(1, np.int64)
        spaced = self.trim
        if self.dummy_prefix and not self.suffix:
            out += self.blank
            origin += [at] * len(self.blank)
        while at < len(source):
            size, value = step(at)
            while spaced and value.startswith(b" "):
                value = value[1:]
            if value:
                written = value.replace(b" ", self.blank)
                out += written
                origin += [at] * len(written)
                spaced = value.endswith(b" ")
            if not self.trim:
                spaced = False
            at += size
        if self.trim:
            while out.endswith(self.blank):
                del out[-len(self.blank) :]
                end = origin[len(out)]
                del origin[len(out) :]
                at = end
        if self.dummy_prefix and self.suffix:
            out += self.blank
            origin += [at] * len(self.blank)
        return bytes(out), np.array([*origin, at], np.int64)

    def _copied(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """``normalize`` for a map without entries: only blanks change."""
        if not source:
            return b"", np.zeros(1, np.int64)
        lead = b" " if self.dummy_prefix and not self.suffix else b""
        tail = b" " if self.dummy_prefix and self.suffix else b""
        whole = np.frombuffer(lead + source + tail, np.uint8)
        widths = np.where(whole == 32, len(self.blank), 1)
        places = np.clip(np.arange(len(whole)) - len(lead), 0, len(source))
        # Continuation bytes belong to the character that they end.
        starts = np.maximum.accumulate(np.where((whole & 0xC0) != 0x80, np.arange(len(whole)), 0))
        origin = np.append(np.repeat(places[starts], widths), len(source))
        return (lead + source + tail).replace(b" ", self.blank), origin

    def _cut(self, stretches: list[str]) -> None:
        """Look up stretches of normalised text: ids, and the bytes of it that each piece ends at."""
        if len(self.known) + len(stretches) > self.limit:
            self.known.clear()
        encoded = self.cutter.encode(stretches, num_threads=1)
        for stretch, ids in zip(stretches, encoded):
            if self.special.isdisjoint(ids):
                ends = list(accumulate(map(self.widths.__getitem__, ids)))
            else:
                ends = self._ends(stretch.encode(), ids)
            self.known[stretch] = (array("i", ids).tobytes(), array("i", ends).tobytes(), ends[-1] if ends else 0)

    def _ends(self, raw: bytes, ids: list[int]) -> list[int]:
        """Ends of the pieces of a stretch that has unknown characters, as bytes or as one piece each."""
        ends, at, run = [], 0, 0
        for k, piece in enumerate(ids):
            if self.bytes[piece]:
                # All bytes of a character end where the character does.
                size, run = _width(raw[at]), run + 1
                ends.append(at + size)
                if run == size:
                    at, run = at + size, 0
                continue
            if piece == self.unknown:
                others = [self.widths[p] for p in ids[k + 1 :] if p != self.unknown]
                alone = len(others) == len(ids) - k - 1
                at = len(raw) - sum(others) if alone else at + _width(raw[at])
            else:
                at += self.widths[piece]
            ends.append(at)
        return ends

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every text the ids, and the first byte and the end of the source behind each piece."""
        prepared = []
        wanted: set[str] = set()
        for text in texts:
            normal, origin = self.normalize(text)
            stretches = self._stretches(normal.decode())
            prepared.append((stretches, origin))
            wanted |= set(stretches).difference(self.known)
        held = {}
        # Look the new ones up together; what is needed stays at hand if the memory is emptied.
        if wanted and len(self.known) + len(wanted) > self.limit:
            held = {s: self.known[s] for ss, _ in prepared for s in ss if s in self.known}
        if wanted:
            self._cut(list(wanted))
            self.known.update(held)
        return [self._join(stretches, origin) for stretches, origin in prepared]

    def _stretches(self, normal: str) -> list[str]:
        """Cut before the blanks that follow another sign."""
        if not normal:
            return []
        if not self.splits:
            return [normal]
        blank = self.blank.decode()
        parts = normal.split(blank)
        if "" not in parts[1:]:
            return parts[: bool(parts[0])] + [blank + part for part in parts[1:]]
        out, lead = [], ""
        for k, part in enumerate(parts):
            if part or k == len(parts) - 1:
                if lead + part:
                    out.append(lead + part)
                lead = blank
            else:
                lead += blank
        return out

    def _join(self, stretches: list[str], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not stretches:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        ids_of, ends_of, sizes_of = zip(*map(self.known.__getitem__, stretches))
        sizes, counts = np.array(sizes_of), np.array(list(map(len, ids_of))) // 4
        ids = np.frombuffer(b"".join(ids_of), np.int32).astype(np.int64)
        ends = np.frombuffer(b"".join(ends_of), np.int32) + np.repeat(np.cumsum(sizes) - sizes, counts)
        starts = np.concatenate([[0], ends[:-1]])
        # The bytes of one unknown character end at the same place; so do they begin.
        same = np.flatnonzero(starts == ends)
        for k in same.tolist():
            starts[k] = starts[k - 1]
        return ids, origin[starts], origin[ends]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: surfaces joined; invalid bytes become U+FFFD, one for each."""
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        if raw.startswith(b" ") and (self.dummy_prefix or self.trim):
            first = next(k for k in ids if self.surfaces[k])
            if not self.bytes[first]:
                raw = raw[1:]
        return raw.decode("utf-8", "each-byte")


def _width(lead: int) -> int:
    """Bytes of the character that begins with ``lead``."""
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def encode_documents(docs: DataFrame, model: bytes, spans: bool = True, digests: bool = True) -> DataFrame:
    """doc_id and n_tokens of every document; ids with their spans, and digests of ids and decoded text.

    ``n_bytes`` is the number of source bytes that the spans of the pieces cover.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, n_bytes long"
    schema += ", ids array<long>, starts array<long>, ends array<long>" * spans
    schema += ", ids_sha256 string, decoded_sha256 string" * digests
    names = [part.split()[0] for part in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = pieces.encode([t or "" for t in batch.column(1).to_pylist()])
                columns = [
                    batch.column(0),
                    pa.array([len(i) for i, _, _ in found], pa.int64()),
                    pa.array([covered(s, e) for _, s, e in found], pa.int64()),
                ]
                if spans:
                    columns += [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(3)]
                if digests:
                    lists = [i.tolist() for i, _, _ in found]
                    written = [",".join(map(pieces.numbers.__getitem__, i)).encode() for i in lists]
                    decoded = [pieces.decode(i).encode() for i in lists]
                    for values in (written, decoded):
                        columns.append(pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def covered(starts: np.ndarray, ends: np.ndarray) -> int:
    """Bytes under ordered spans; equal spans count once."""
    if not len(starts):
        return 0
    new = np.append(True, (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1]))
    return int((ends - starts)[new].sum())
