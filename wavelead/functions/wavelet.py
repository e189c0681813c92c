"""Wavelet transform of array columns.

The numeric helpers below work on a NumPy block holding one lead per row; the
Arrow UDFs group an Arrow batch by lead length so that every block is a plain
matrix and no Python loop runs over samples or over leads of equal length.

Only one wavelet (biorthogonal 6.8) with half-sample symmetric extension is
offered, which is what the preparation of the recordings needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WAVELET = "bior6.8"
LEVEL = 4

# Published taps of the biorthogonal 6.8 filter pair.
DEC_LO = np.array(
    [
        0.0,
        0.0019088317364812906,
        -0.0019142861290887667,
        -0.016990639867602342,
        0.01193456527972926,
        0.04973290349094079,
        -0.07726317316720414,
        -0.09405920349573646,
        0.4207962846098268,
        0.8259229974584023,
        0.4207962846098268,
        -0.09405920349573646,
        -0.07726317316720414,
        0.04973290349094079,
        0.01193456527972926,
        -0.016990639867602342,
        -0.0019142861290887667,
        0.0019088317364812906,
    ]
)
REC_LO = np.array(
    [
        0.0,
        0.0,
        0.0,
        0.014426282505624435,
        0.014467504896790148,
        -0.07872200106262882,
        -0.04036797903033992,
        0.41784910915027457,
        0.7589077294536541,
        0.41784910915027457,
        -0.04036797903033992,
        -0.07872200106262882,
        0.014467504896790148,
        0.014426282505624435,
        0.0,
        0.0,
        0.0,
        0.0,
    ]
)
# Fixed value: median absolute deviation of a standard normal variable.
MAD_SCALE = 0.6745

TAPS = len(DEC_LO)
# The high-pass filters are the mirrored low-pass ones with alternating signs.
_SIGNS = (-1.0) ** np.arange(TAPS)
DEC_HI = -_SIGNS * REC_LO
REC_HI = _SIGNS * DEC_LO

# Element types a denoised lead can have.
_NUMPY_TYPES = {"double": np.float64, "float": np.float32}

# Samples handled in one NumPy block; larger blocks fall out of the processor cache.
_BLOCK_SAMPLES = 250_000


def check_wavelet(wavelet: str, level: int) -> None:
    if wavelet != WAVELET:
        raise ValueError(f"unsupported wavelet {wavelet!r}; only {WAVELET!r} is available")
    if level < 1:
        raise ValueError(f"level must be at least 1, got {level}")


def analysis_step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the forward transform along the last axis: (approximation, detail)."""
    n = x.shape[1]
    n_out = (n + TAPS - 1) // 2
    # Half-sample symmetric extension; the modulo form also serves signals
    # that are shorter than the filter. Even and odd positions are kept apart,
    # so that every tap reads a contiguous stretch.
    m = np.arange(2 - TAPS, 2 * n_out) % (2 * n)
    m = np.where(m < n, m, 2 * n - 1 - m)
    phases = x[:, m[0::2]], x[:, m[1::2]]
    low = np.zeros((x.shape[0], n_out))
    high = np.zeros((x.shape[0], n_out))
    product = np.empty_like(low)
    for j in range(TAPS):
        first = TAPS - 1 - j
        tap = phases[first % 2][:, first // 2 : first // 2 + n_out]
        for taps, band in ((DEC_LO, low), (DEC_HI, high)):
            if taps[j]:
                band += np.multiply(tap, taps[j], out=product)
    return low, high


def synthesis_step(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One level of the inverse transform; the output has 2 * N - 16 samples."""
    half = low.shape[1] - TAPS // 2 + 1
    out = np.empty((low.shape[0], 2 * half))
    product = np.empty((low.shape[0], half))
    for phase in (0, 1):
        part = np.zeros((low.shape[0], half))
        for q in range(TAPS // 2):
            tap = TAPS - 2 + phase - 2 * q
            for taps, band in ((REC_LO, low), (REC_HI, high)):
                if taps[tap]:
                    part += np.multiply(band[:, q : q + half], taps[tap], out=product)
        out[:, phase::2] = part
    return out


def decompose(x: np.ndarray, level: int = LEVEL) -> list[np.ndarray]:
    """Bands ``[approximation, coarsest detail, ..., finest detail]`` of every row."""
    details = []
    for _ in range(level):
        x, high = analysis_step(x)
        details.append(high)
    return [x, *reversed(details)]


def recompose(bands: list[np.ndarray], n: int) -> np.ndarray:
    """Inverse of :func:`decompose`, trimmed to ``n`` samples."""
    x = bands[0]
    for high in bands[1:]:
        x = synthesis_step(x[:, : high.shape[1]], high)
    return x[:, :n]


def shrink(values: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Soft threshold; a flat signal gives zeros, never 0/0."""
    return np.sign(values) * np.maximum(np.abs(values) - threshold, 0.0)


def noise_level(finest: np.ndarray) -> np.ndarray:
    return np.median(np.abs(finest), axis=1) / MAD_SCALE


def denoise_block(
    x: np.ndarray, level: int = LEVEL, threshold: np.ndarray | None = None
) -> np.ndarray:
    """Denoise every row; ``threshold`` (one per row) replaces the universal one."""
    bands = decompose(x, level)
    if threshold is None:
        threshold = noise_level(bands[-1]) * np.sqrt(2.0 * np.log(x.shape[1]))
    t = np.asarray(threshold, dtype=float)[:, None]
    return recompose([bands[0], *(shrink(b, t) for b in bands[1:])], x.shape[1])


# -- Arrow lists to NumPy blocks and back -----------------------------------


def list_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values (null samples as NaN), start of every row, length of every row (-1 for null)."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, -1)
    return values, offsets[:-1], lengths


def list_column(values, lengths: np.ndarray) -> pa.ListArray:
    """List array with the given row lengths; rows of length -1 become null."""
    missing = lengths < 0
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
    mask = np.append(missing, False) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets, mask=mask), values)


def blocks(lengths: np.ndarray):
    """(length, row numbers) of equally long rows, in blocks of bounded size."""
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        step = max(1, _BLOCK_SAMPLES // n)
        for first in range(0, len(rows), step):
            yield n, rows[first : first + step]


def map_lists(
    column: pa.ListArray, block_fn, out_length=lambda n: n, dtype: str = "double"
) -> pa.ListArray:
    """Apply ``block_fn(matrix, row numbers)`` to a list column, one lead length at a time."""
    values, starts, lengths = list_values(column)
    sizes = {n: out_length(n) for n in np.unique(lengths[lengths > 0]).tolist()}
    out_lengths = np.array([sizes.get(n, n) for n in lengths.tolist()], dtype=np.int64)
    ends = np.cumsum(np.maximum(out_lengths, 0))
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=_NUMPY_TYPES[dtype])
    for n, rows in blocks(lengths):
        result = block_fn(values[starts[rows, None] + np.arange(n)], rows)
        flat[(ends[rows, None] - sizes[n]) + np.arange(sizes[n])] = result
    return list_column(pa.array(flat), out_lengths)


def band_lengths(n: int, level: int) -> list[int]:
    lengths = []
    for _ in range(level):
        n = (n + TAPS - 1) // 2
        lengths.append(n)
    return [lengths[-1], *reversed(lengths)]


# -- Column functions -------------------------------------------------------


def denoise(
    signal: Column, wavelet: str = WAVELET, level: int = LEVEL, dtype: str = "double"
) -> Column:
    """Wavelet soft-threshold denoising of a whole lead, same length as the input.

    A null lead stays null, a null or NaN sample spreads through its lead. The
    transform works on doubles; ``dtype="float"`` rounds the result, which
    halves what goes back to the JVM when floats are wanted in the end.
    """
    check_wavelet(wavelet, level)

    @F.arrow_udf(f"array<{dtype}>")
    def run(column: pa.Array) -> pa.Array:
        return map_lists(column, lambda x, _: denoise_block(x, level), dtype=dtype)

    return run(signal)


def denoise_all(
    signals: Column, wavelet: str = WAVELET, level: int = LEVEL, dtype: str = "double"
) -> Column:
    """:func:`denoise` for every lead of a recording held as an array of leads."""
    check_wavelet(wavelet, level)

    @F.arrow_udf(f"array<array<{dtype}>>")
    def run(column: pa.Array) -> pa.Array:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        counts = np.where(valid, np.diff(column.offsets.to_numpy(zero_copy_only=False)), -1)
        leads = map_lists(column.flatten(), lambda x, _: denoise_block(x, level), dtype=dtype)
        return list_column(leads, counts)

    return run(signals)


def denoise_with(
    signal: Column, threshold: Column, wavelet: str = WAVELET, level: int = LEVEL
) -> Column:
    """As :func:`denoise`, with the threshold given per row instead of estimated."""
    check_wavelet(wavelet, level)

    @F.arrow_udf("array<double>")
    def run(column: pa.Array, limits: pa.Array) -> pa.Array:
        t = limits.to_numpy(zero_copy_only=False).astype(float)
        return map_lists(column, lambda x, rows: denoise_block(x, level, t[rows]))

    return run(signal, threshold)


def finest_detail(signal: Column) -> Column:
    """The finest detail band of a lead, the one the noise is estimated from."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return map_lists(
            column, lambda x, _: analysis_step(x)[1], lambda n: (n + TAPS - 1) // 2
        )

    return run(signal)


def from_bits(bits: Column) -> Column:
    """The double with the given bit pattern, a LONG."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(column.fill_null(0).to_numpy(zero_copy_only=False).view(np.float64))

    return run(bits)


def wavedec(signal: Column, wavelet: str = WAVELET, level: int = LEVEL) -> Column:
    """Bands of every lead, ``[approximation, coarsest detail, ..., finest detail]``."""
    check_wavelet(wavelet, level)

    @F.arrow_udf("array<array<double>>")
    def run(column: pa.Array) -> pa.Array:
        joined = map_lists(
            column,
            lambda x, _: np.hstack(decompose(x, level)),
            lambda n: sum(band_lengths(n, level)),
        )
        _, _, lengths = list_values(column)
        inner = [band_lengths(n, level) for n in lengths.tolist() if n > 0]
        return list_column(
            list_column(joined.values, np.array(inner, dtype=np.int64).ravel()),
            np.where(lengths > 0, level + 1, lengths),
        )

    return run(signal)


def waverec(bands: Column, n: Column, wavelet: str = WAVELET) -> Column:
    """Inverse of :func:`wavedec`; ``n`` is the length of the original lead."""
    check_wavelet(wavelet, LEVEL)

    @F.arrow_udf("array<double>")
    def run(column: pa.Array, lengths: pa.Array) -> pa.Array:
        offsets = column.offsets.to_numpy(zero_copy_only=False)
        values, starts, sizes = list_values(column.values)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        n_out = np.where(valid, lengths.fill_null(-1).to_numpy(zero_copy_only=False), -1)
        depth = np.diff(offsets) - 1
        # Band lengths follow from n and the number of bands, so rows that agree
        # in both form one block.
        ends = np.cumsum(np.maximum(n_out, 0))
        flat = np.empty(int(ends[-1]) if len(ends) else 0)
        for level in np.unique(depth[n_out > 0]).tolist():
            for length, rows in blocks(np.where(depth == level, n_out, -1)):
                parts = []
                for b, size in enumerate(band_lengths(length, level)):
                    at = offsets[rows] + b
                    if (sizes[at] != size).any():
                        raise ValueError(f"bands do not fit a lead of {length} samples")
                    parts.append(values[starts[at, None] + np.arange(size)])
                flat[(ends[rows, None] - length) + np.arange(length)] = recompose(parts, length)
        return list_column(pa.array(flat), n_out)

    return run(bands, n)
