"""Column expressions that need nothing but Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelead.functions.wavelet import MAD_SCALE


def bind(use: Callable[..., Column], *values: Column) -> Column:
    """``use(*values)`` with every value computed once.

    Catalyst merges projections, so an expression used inside a lambda over an
    array would be computed again for every element (and a Python function
    could not be computed there at all). The lambda over a one-element array
    holds on to the values instead.
    """
    names = [f"v{n}" for n in range(len(values))]
    packed = F.struct(*[value.alias(name) for value, name in zip(values, names)])
    return F.get(F.transform(F.array(packed), lambda p: use(*[p[name] for name in names])), 0)


def binarize_label(label: Column) -> Column:
    """1 for a positive label, else 0; null and NaN count as 0."""
    return F.when(F.nanvl(label.cast("double"), F.lit(0.0)) > 0, 1).otherwise(0)


def to_float(samples: Column) -> Column:
    return samples.cast("array<float>")


def window_size(fs, duration: float = 3) -> Column:
    """Samples per window, ``int(duration * fs)``; null where that is not at least one.

    ``fs`` is a column or a constant; a constant that gives no window is an error.
    """
    if not isinstance(fs, Column):
        if int(duration * fs) < 1:
            raise ValueError(f"no window fits duration={duration} at fs={fs}")
        return F.lit(int(duration * fs))
    # A rate that is no number, or too large for a count, gives null as well.
    size = (fs.cast("double") * F.lit(float(duration))).try_cast("int")
    return F.when(size >= 1, size)


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer division, exact for any LONG."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def count_windows(signal: Column, size: Column) -> Column:
    """Number of full windows of a lead; the short tail does not count."""
    return F.coalesce(whole_div(F.size(signal), size).cast("int"), F.lit(0))


def window_numbers(n: Column) -> Column:
    """0 .. n - 1; null for n = 0, where a sequence would run down to -1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1))


def window(signal: Column, k: Column, size: Column) -> Column:
    """Window ``k`` of a lead as floats.

    Meant for a plain projection over exploded window numbers: there the slice
    is compiled and touches the window only, whereas inside an array lambda it
    would box the whole lead for every window.
    """
    return to_float(F.slice(signal, k * size + 1, size))


def median(values: Column) -> Column:
    """Median of an array; null for an empty one, NaN if any value is NaN."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        low = F.get(ordered, whole_div(n - 1, 2).cast("int"))
        high = F.get(ordered, whole_div(n, 2).cast("int"))
        # NaN sorts last, so one look at the largest value is enough.
        largest = F.get(ordered, n - 1)
        return F.when(F.isnan(largest), largest).otherwise((low + high) / 2)

    return bind(middle, F.sort_array(values))


def noise_sigma(finest: Column) -> Column:
    """Robust noise level from the finest detail band: median(|d|) / 0.6745."""
    return median(F.transform(finest, lambda v: F.abs(v))) / MAD_SCALE


def universal_threshold(sigma: Column, n: Column) -> Column:
    """sigma * sqrt(2 ln n) for a lead of n samples."""
    return sigma * F.sqrt(2 * F.ln(n))


def soft_threshold(values: Column, threshold: Column) -> Column:
    """Shrink every value of an array towards zero by the threshold."""
    # The threshold is repeated so that it is computed once, not per value.
    return F.zip_with(
        values,
        F.array_repeat(threshold, F.size(values)),
        lambda v, t: F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0)),
    )


def threshold_bands(bands: Column, threshold: Column) -> Column:
    """Soft-threshold every detail band and keep the approximation (the first band)."""
    details = F.slice(bands, 2, F.greatest(F.size(bands), F.lit(1)))
    shrunk = F.zip_with(
        details, F.array_repeat(threshold, F.size(bands) - 1), lambda band, t: soft_threshold(band, t)
    )
    return F.concat(F.slice(bands, 1, 1), shrunk)


def sample_major(x: Column) -> Column:
    """Turn a lead-major matrix (leads x samples) into a sample-major one."""

    def turn(leads: Column) -> Column:
        return F.transform(
            window_numbers(F.size(F.get(leads, 0))),
            lambda k: F.transform(leads, lambda lead: F.get(lead, k)),
        )

    return bind(turn, x)


def is_junk(path: Column) -> Column:
    """Files left behind by an archive: ``._*``, ``.DS_Store`` or anything in ``__MACOSX``.

    Spark's file sources leave these out already; this is for path columns
    that come from elsewhere, such as a manifest.
    """
    return path.rlike(r"(^|/)(\._[^/]*|\.DS_Store)$|(^|/)__MACOSX(/|$)")
