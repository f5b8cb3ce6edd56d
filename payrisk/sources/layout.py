"""Tables laid out so that look-ups by any of several columns read few files."""

from __future__ import annotations

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a file; ranges that each clustering column is cut into are a power of two.
FILE_ROWS = 1_000_000
MAX_BITS = 10
# Files of fewer rows than FILE_ROWS: at most so many. Smaller pieces are pages of the files, which are skipped alike.
SMALL_FILES = 1024
PAGE_ROWS = 20_000
# Accuracy of the range bounds, in ranges.
BOUNDS_ACCURACY = 100
BLOOM_FALSE_POSITIVES = 0.01


def interleaved(buckets: list[Column], bits: int) -> Column:
    """Bits of several small numbers in turn, highest first: near places on this curve are near in every number."""
    z = F.lit(0).cast("bigint")
    for bit in range(bits):
        for k, bucket in enumerate(buckets):
            one = F.shiftright(bucket, bit).bitwiseAND(F.lit(1).cast("bigint"))
            z = z.bitwiseOR(F.shiftleft(one, bit * len(buckets) + len(buckets) - 1 - k))
    return z


def hilbert(a: Column, b: Column, bits: int) -> Column:
    """Place of two small numbers on the Hilbert curve, which makes no jumps: runs of places cover compact boxes.

    From the highest bit down, the pair of bits names a quarter; the quarter's place along the curve depends on whether the curve is
    swapped or turned there, which is a state from 0 to 3 (swapped counts 1, turned 2) that the quarters passed so far decide.
    """
    digits, following = [], []
    for state in range(4):
        swapped, turned = state & 1, state >> 1
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            x, y = (y ^ turned, x ^ turned) if swapped else (x ^ turned, y ^ turned)
            digits.append((3 * x) ^ y)
            following.append(state if y else (swapped ^ 1) | (turned ^ x) << 1)
    one = F.lit(1).cast("bigint")
    place, state = F.lit(0).cast("bigint"), F.lit(0)
    for bit in reversed(range(bits)):
        quarter = F.shiftright(a, bit).bitwiseAND(one) * 2 + F.shiftright(b, bit).bitwiseAND(one)
        at = (state * 4 + quarter).cast("int")
        place = place * 4 + F.get(F.lit(digits), at)
        state = F.get(F.lit(following), at)
    return place


def range_bounds(df: DataFrame, columns: list[str], ranges: int) -> dict[str, list[float]]:
    """Values that cut each column into ranges of about as many rows; a heavy value is a range of its own."""
    fractions = ", ".join(f"{k / ranges}D" for k in range(1, ranges))
    accuracy = ranges * BOUNDS_ACCURACY
    found = df.agg(
        *[F.expr(f"percentile_approx(double(`{c}`), array({fractions}), {accuracy})").alias(c) for c in columns]
    ).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def write_clustered(
    df: DataFrame, path: str, columns: list[str], identifier: str, *, file_rows: int = FILE_ROWS
) -> DataFrame:
    """Write ``df`` in place of what was at ``path``, clustered by several numeric columns, and read it back.

    Each column is cut into ranges of about as many rows. Rows are sorted and cut into files along a space-filling curve through the
    ranges: the Hilbert curve for two columns, interleaved bits for any other number. So a file covers a small box of all columns, and a filter on any one of them
    skips the files beside it by their minimum and maximum: about rows^(1/columns) of them are left. Missing values
    have a range of their own. Files have Bloom filters on ``identifier``, which skips most of them for one id although ids lie anywhere.
    ``df`` is read twice (the bounds, then the rows): give a stored table.

    Where files of ``file_rows`` would be more than ``SMALL_FILES``, each file holds several such pieces of the curve, up to ``FILE_ROWS`` rows, as
    pages with a minimum and maximum of their own: filters on the clustering columns still skip what lies beside a piece, and the number of
    files, which each writer, listing and look-up pays for, does not grow with the rows before files are full.

    A value of one column with very many rows fills several files; they are cut by the other columns and the id.
    """
    n_rows = df.count()
    n_pieces = max(1, ceil(n_rows / file_rows))
    n_files = min(n_pieces, max(SMALL_FILES, ceil(n_rows / FILE_ROWS)))
    bits = min(MAX_BITS, max(1, ceil((n_pieces - 1).bit_length() / len(columns)) + 1))
    bounds = range_bounds(df, columns, 1 << bits)
    splits = [[float("-inf"), *(bounds[c] or [0.0]), float("inf")] for c in columns]
    names = [f"_range_{k}" for k in range(len(columns))]
    numbers = [f"_number_{k}" for k in range(len(columns))]
    numbered = df.withColumns({n: F.col(c).cast("double") for n, c in zip(numbers, columns)})
    # A missing value gets the range after the last.
    ranged = Bucketizer(splitsArray=splits, inputCols=numbers, outputCols=names, handleInvalid="keep").transform(numbered)
    ranges = [F.col(n).cast("bigint") for n in names]
    place = hilbert(*ranges, bits + 1) if len(ranges) == 2 else interleaved(ranges, bits + 1)
    placed = ranged.withColumn("_place", place).drop(*names, *numbers)
    keys = ["_place", *columns, identifier]
    laid = placed.repartitionByRange(n_files, *keys).sortWithinPartitions(*keys).drop("_place")
    options = {
        f"parquet.bloom.filter.enabled#{identifier}": "true",
        f"parquet.bloom.filter.fpp#{identifier}": str(BLOOM_FALSE_POSITIVES),
        f"parquet.bloom.filter.expected.ndv#{identifier}": str(min(max(file_rows, ceil(n_rows / n_files)), FILE_ROWS)),
        "parquet.page.row.count.limit": str(min(file_rows, PAGE_ROWS)),
    }
    laid.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
