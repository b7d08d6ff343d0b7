"""Unix mode bits, directory entry types, and little-endian numbers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type bits of a unix mode, directory entry types.
S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0o170000, 0o100000, 0o040000, 0o120000
FT_REG, FT_DIR, FT_SYMLINK = 1, 2, 7


def file_type(mode: Column) -> Column:
    """Type bits of a unix mode."""
    return mode.bitwiseAND(S_IFMT)


def with_type(permissions: Column, is_dir: Column, is_link: Column) -> Column:
    """Permission bits with the bits of a directory, a link or else a regular file."""
    kind = F.when(is_dir, F.lit(S_IFDIR)).when(is_link, F.lit(S_IFLNK)).otherwise(F.lit(S_IFREG))
    return permissions.bitwiseAND(0o7777).bitwiseOR(kind)


def default_type(mode: Column) -> Column:
    """A mode, a regular file's where no type bit is set."""
    return F.when(file_type(mode) == 0, mode.bitwiseOR(S_IFREG)).otherwise(mode)


def unix_seconds(mod_time_ns: Column) -> Column:
    """Whole seconds of a modification time in nanoseconds."""
    return ((mod_time_ns - F.pmod(mod_time_ns, F.lit(1_000_000_000).cast("long"))) / 1_000_000_000).cast("long")


def dirent_type(mode: Column) -> Column:
    kind = file_type(mode)
    return F.when(kind == S_IFDIR, FT_DIR).when(kind == S_IFLNK, FT_SYMLINK).otherwise(FT_REG)


def read_le(data: Column, offset: int | Column, width: int) -> Column:
    """An unsigned little-endian number of up to 8 bytes at a byte offset, as a long.

    Null where the data ends before; 8-byte numbers from 2**63 on are null too."""
    start = (F.lit(offset) if isinstance(offset, int) else offset).cast("int")
    byte = lambda k: F.hex(F.substr(data, start + k + 1, F.lit(1)))
    number = F.conv(F.concat(*[byte(k) for k in reversed(range(width))]), 16, 10).cast("decimal(20,0)")
    return F.when(F.length(data) >= start + width, number.try_cast("long"))


def write_le(number: Column, width: int) -> Column:
    """A number as ``width`` little-endian bytes; an error where it does not fit."""
    digits = F.lpad(F.hex(number.cast("long")), width * 2, "0")
    swapped = F.concat(*[F.substr(digits, F.lit(2 * (width - k) - 1), F.lit(2)) for k in range(width)])
    fits = (number >= 0) & (F.length(F.hex(number.cast("long"))) <= width * 2)
    return F.when(fits, F.unhex(swapped)).otherwise(F.raise_error(F.concat(F.lit(f"does not fit {width} bytes: "), number.cast("string"))).cast("binary"))
