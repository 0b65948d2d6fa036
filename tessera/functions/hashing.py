"""Stable hashes as column expressions, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = (1 << 32) - 1
# The multipliers of the 32-bit document hash.
DOC_FACTOR, SEED_FACTOR = 2654435761, 2246822507
FIRST_FACTOR, SECOND_FACTOR = 2146121005, 2221713035


def times32(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for x under 2**32, in two halves that do not overflow a long."""
    high, low = factor >> 16, factor & 0xFFFF
    return (((x * high).bitwiseAND(F.lit(0xFFFF))) * 65536 + x * low).bitwiseAND(F.lit(LOW32))


def split_hash(doc: Column, seed: int) -> Column:
    """A number in [0, 1) for a document's ordinal."""
    x = (times32(doc.cast("long").bitwiseAND(F.lit(LOW32)), DOC_FACTOR) + seed * SEED_FACTOR % (1 << 32)).bitwiseAND(F.lit(LOW32))
    for shift, factor in ((16, FIRST_FACTOR), (15, SECOND_FACTOR), (16, None)):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
        x = times32(x, factor) if factor else x
    return x / F.lit(4294967296.0)


def content_bucket(text: Column, seed: int, buckets: int = 1_000_000) -> Column:
    """sha1(seed NUL text), a 160-bit number, modulo `buckets`: by Horner over five hex digits each."""
    digits = F.sha1(F.concat(F.lit(f"{seed}\x00"), text))
    value = F.lit(0).cast("long")
    for k in range(8):
        value = (value * 1048576 + F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("long")) % buckets
    return value


def content_order(text: Column, seed: int) -> Column:
    """The first 64 bits of sha1(seed 0x01 text) in hex, whose order is that of the number."""
    return F.substring(F.sha1(F.concat(F.lit(f"{seed}\x01"), text)), 1, 16)


def draw_key(*parts) -> Column:
    """A hex string that orders rows at random, by their own columns and a seed."""
    return F.sha1(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_number(*parts) -> Column:
    """32 random bits as a long."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("long")


def cache_key(text: Column, model: str, input_type: str, output_dim: int | None) -> Column:
    return F.sha1(F.concat(F.lit(f"{model}|{input_type}|{output_dim or 'full'}\x00"), text))


def config_key(corpus: Column, model: str, input_type: str, dim: int | None, max_len: int, instruction: str, backend: str = "transformers") -> Column:
    """Sixteen hex digits; the backend counts only if it is not the default one."""
    head = "|".join([model, input_type, str(dim or "full"), str(max_len), instruction] + ([backend] if backend != "transformers" else []))
    return F.substring(F.sha1(F.concat(F.lit(head + "\x00"), corpus)), 1, 16)
