"""Small numeric and bit expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once for all its uses, inside lambdas as well."""
    return F.get(F.transform(F.array(value), use), 0)


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, rounded half up; zero when there is nothing."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def hash_from_hex(hex_text: Column) -> Column:
    """64-bit perceptual hash from unsigned hex, kept as a signed bigint."""
    return F.conv(hex_text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(flags: Column) -> Column:
    """Array of at most 64 booleans to a bigint; element ``i`` sets bit ``i``."""
    bits = F.transform(
        flags,
        lambda flag, i: F.when(flag, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
            F.lit(0).cast("long")
        ),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(bit))


def median_fingerprint(coefficients: Column) -> Column:
    """Bit ``i`` is set when coefficient ``i`` lies above the median (mean of the two middle values)."""
    n = F.size(coefficients)

    def median(ordered: Column) -> Column:
        low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        high = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
        return (low.cast("double") + high.cast("double")) / 2

    middle = bound(F.array_sort(coefficients), median)
    return bound(middle, lambda m: pack_bits(F.transform(coefficients, lambda x: x.cast("double") > m)))


def gradient_fingerprint(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Bit set where a pixel is brighter than its right neighbour, row by row."""
    cells = F.array(*[F.lit(r * width + c + 1) for r in range(height) for c in range(width - 1)])
    return pack_bits(F.transform(cells, lambda i: F.element_at(pixels, i) > F.element_at(pixels, i + 1)))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when a norm is zero, an error on unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def request_size(chars: Column, largest: int) -> Column:
    """Request size step for a text: about four characters per token and 1,024 tokens of headroom."""
    from dayweave.functions.vocab import CONTEXT_SIZES

    needed = F.ceil(chars / 4) + 1024
    size = F.lit(largest)
    for step in reversed(CONTEXT_SIZES):
        size = F.when(needed <= step, F.lit(min(step, largest))).otherwise(size)
    return size.cast("long")
