"""Scalar and array functions on columns: letters, lists, coordinates, flags, alignment strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG_NAMES = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")


def let(value: Column, f) -> Column:
    """f of a value that is worked out once; within a higher-order function each mention of a column is worked out by itself."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- letters -------------------------------------------------------------------------------


def dna(text: Column) -> Column:
    """Lower-case letters a c g t; anything else is a."""
    return F.regexp_replace(F.lower(text), "[^acgt]", "a")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def dna_pack(seq: Column) -> Column:
    """Up to 31 letters as base-4 digits of one number, the first letter highest."""
    return F.conv(F.translate(seq, "acgt", "0123"), 4, 10).cast("long")


def dna_unpack(number: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), length, F.lit("0")), "0123", "acgt")


def dna_numbers(seq: Column) -> Column:
    """Letters as an array of 0 to 3."""
    return F.transform(F.split(F.translate(seq, "acgtACGT", "01230123"), ""), lambda x: x.cast("int"))


def swap_case(text: Column) -> Column:
    return F.translate(text, "acgtnACGTN", "ACGTNacgtn")


def iupac(nibble: Column) -> Column:
    """The letter of a 4-bit base code."""
    return F.substring(F.lit("=acmgrsvtwyhkdbn"), F.pmod(nibble, F.lit(16)) + 1, F.lit(1))


def quality_text(values: Column, shift: int = 33) -> Column:
    """Phred numbers as letters; null where the first one is 255."""
    return F.when(F.get(values, F.lit(0)) == 255, None).otherwise(F.array_join(F.transform(values, lambda q: F.chr(q + shift)), ""))


def pulse_cap(values: Column) -> Column:
    """Pulse widths as digits of at most 4."""
    return F.array_join(F.transform(values, lambda x: F.least(x, F.lit(4)).cast("string")), "")


def pulse_numbers(text: Column) -> Column:
    """Letters 1 to 4 as 0 to 3, others 3."""
    return F.transform(F.split(text, ""), lambda c: F.when(c.isin("1", "2", "3"), c.cast("int") - 1).otherwise(3))


# --- lists ---------------------------------------------------------------------------------


def delta(values: Column) -> Column:
    """The first value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def cumulative(values: Column) -> Column:
    """Running sums; the inverse of delta()."""
    zero = F.array().cast("array<bigint>")
    return F.aggregate(values, zero, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))


def byte_width(values: Column) -> Column:
    """Bytes, 1 to 8, that hold every value with its sign."""
    most = F.array_max(F.transform(values, lambda x: F.when(x >= 0, x).otherwise(-(x + 1))))
    return reduce(lambda out, n: F.when(most < F.lit(1 << 8 * n - 1), n).otherwise(out), range(7, 0, -1), F.lit(8))


def product(*factors: Column) -> Column:
    """The product of whole numbers; null where it leaves 64 bits, whatever the order of the factors, or a factor is null."""
    longs = [f.cast("long") for f in factors]
    about = F.abs(reduce(lambda a, f: a * f.cast("double"), longs, F.lit(1.0)))  # which rows leave 64 bits, but for those near the border
    zero = reduce(Column.__or__, [f == 0 for f in longs]) & reduce(Column.__and__, [f.isNotNull() for f in longs])
    whole = F.when(about < 9.2e18, reduce(Column.__mul__, longs)).when(about < 9.3e18, reduce(F.try_multiply, longs))
    return F.when(zero, F.lit(0).cast("long")).otherwise(whole)


def varint_bytes(value: Column) -> Column:
    """Bytes of the variable-length integer code: 6 bits in one, 13 in two if not negative, then 1 + 2 to 8; 9 also for what product() finds too long."""
    size = F.when(value >= 0, value).otherwise(-(value + 1))
    longer = reduce(lambda out, n: F.when(size < F.lit(1 << 8 * n), n + 1).otherwise(out), range(7, 1, -1), F.lit(9))
    return F.when(size < 64, 1).when((value >= 0) & (value < 1 << 13), 2).otherwise(longer)


def every_other(values: Column, start: int) -> Column:
    return F.filter(values, lambda _, i: i % 2 == start)


def trace_points(as_: Column, ae: Column, spacing: Column) -> Column:
    """The multiples of the spacing that lie strictly between."""
    first, last = F.floor(as_ / spacing) + 1, F.ceil(ae / spacing) - 1
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k * spacing).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def trace_length(as_: Column, ae: Column, spacing: Column) -> Column:
    """Length of a trace of (differences, advance) pairs over a spacing."""
    return (2 * (F.ceil(ae / spacing) - F.floor(as_ / spacing))).cast("long")


def substitutions(span: Column, matches: Column, diffs: Column) -> Column:
    return span - (diffs + matches)


def indels(span: Column, matches: Column, diffs: Column) -> Column:
    return 2 * (matches + diffs) - span


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def fragments(sites: Column) -> Column:
    """Lengths between successive sites; the last site is the end of the molecule."""
    return delta(sites)


# --- flags and alignment strings -----------------------------------------------------------


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def primary(flag: Column) -> Column:
    return ~has_flag(flag, 0x900)


def first_of_pair(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(0xC0)) == 0x40


def flag_names(flag: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(has_flag(flag, 1 << i), n) for i, n in enumerate(FLAG_NAMES)])), ",")


def flag_number(names: Column) -> Column:
    parts = F.split(names, ",")
    return sum([F.when(F.array_contains(parts, n), 1 << i).otherwise(0) for i, n in enumerate(FLAG_NAMES)], F.lit(0))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of an alignment string."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(2))
    return F.transform(F.arrays_zip(n.alias("n"), op.alias("op")), lambda x: F.struct(x["n"].cast("long").alias("n"), x["op"].alias("op")))


def _length(cigar: Column, ops: str) -> Column:
    """Sum of the numbers before these operations: one expression, one fold."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))


def query_length(cigar: Column) -> Column:
    return _length(cigar, "MIS=X")


def reference_length(cigar: Column) -> Column:
    return _length(cigar, "MDN=X")


def end_position(pos: Column, cigar: Column, flag: Column) -> Column:
    """First position after the alignment (positions from 0); one on where there is none."""
    n = reference_length(cigar)
    return pos + F.when(has_flag(flag, 0x4) | (n == 0), 1).otherwise(n)


def plausible_cigar(cigar: Column) -> Column:
    return cigar.rlike(r"^(?:\*|(?:\d+[MIDNSHP=XB])+)$")


def printable(name: Column) -> Column:
    return name.rlike(r"^[!-~]+$")


# --- names ---------------------------------------------------------------------------------


def root_name(path: Column, suffix: str = "") -> Column:
    """The last part of a path without the suffix."""
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(last, suffix.replace(".", r"\.") + "$", "") if suffix else last


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")
