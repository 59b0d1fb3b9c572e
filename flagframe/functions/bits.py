"""Flag sets and bit expressions. Everything here returns plain Spark columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64
MANY_FLAGS = 32


def to_signed(mask: int) -> int:
    """Two's-complement view of an unsigned 64-bit mask (Spark has no unsigned type)."""
    return mask - (1 << WORD_BITS) if mask >= 1 << (WORD_BITS - 1) else mask


def mask_type(n_flags: int) -> str:
    """Smallest Spark type that holds ``n_flags`` without using its sign bit.

    The 64th flag does use the sign bit of a BIGINT; beyond that the mask is an
    array of 64-bit words.
    """
    if n_flags <= 8:
        return "smallint"
    if n_flags <= 16:
        return "int"
    if n_flags <= WORD_BITS:
        return "bigint"
    return "array<bigint>"


def flag_width(n: Column) -> Column:
    """Bits of the smallest unsigned integer that holds ``n`` flags (8, 16, 32 or 64)."""
    return (
        F.when(n <= 8, F.lit(8)).when(n <= 16, F.lit(16)).when(n <= 32, F.lit(32)).otherwise(F.lit(64))
    )


@dataclass(frozen=True)
class FlagSet:
    """Ordered flag names; flag ``i`` owns bit ``first_bit + i``."""

    names: tuple[str, ...]
    first_bit: int = 0

    def __init__(self, names: Iterable[str], first_bit: int = 0):
        object.__setattr__(self, "names", tuple(names))
        object.__setattr__(self, "first_bit", first_bit)
        if len(set(self.names)) != len(self.names):
            raise ValueError("flag names must be distinct")

    @property
    def size(self) -> int:
        return self.first_bit + len(self.names)

    @property
    def spark_type(self) -> str:
        return mask_type(self.size)

    @property
    def is_wide(self) -> bool:
        return self.size > WORD_BITS

    def position(self, name: str) -> int:
        try:
            return self.first_bit + self.names.index(name)
        except ValueError:
            raise KeyError(f"unknown flag {name!r}") from None

    def value(self, *names: str) -> int:
        """Signed mask with the bits of ``names`` set; only for sets of one word."""
        if self.is_wide:
            raise ValueError("a set of more than 64 flags has no single mask value")
        return to_signed(sum(1 << self.position(n) for n in dict.fromkeys(names)))

    def words(self, names: Iterable[str]) -> dict[int, int]:
        """Signed mask per word for ``names``."""
        out: dict[int, int] = {}
        for name in dict.fromkeys(names):
            word, bit = divmod(self.position(name), WORD_BITS)
            out[word] = out.get(word, 0) | 1 << bit
        return {word: to_signed(mask) for word, mask in out.items()}


def as_column(expr: Column | str) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


def or_all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns)


def _fold_word(conditions: Sequence[tuple[int, Column]], dtype: str) -> Column:
    zero = F.lit(0).cast(dtype)
    parts = [
        F.when(F.coalesce(cond, F.lit(False)), F.lit(to_signed(1 << bit)).cast(dtype)).otherwise(zero)
        for bit, cond in conditions
    ]
    if len(parts) > MANY_FLAGS:
        # With a lambda Spark leaves whole-stage code, whose one method of this length the JVM would never
        # compile, and generates the other conditions in methods of their own, whatever the session's settings.
        parts[-1] = F.aggregate(F.array(parts[-1]), zero, lambda a, b: a.bitwiseOR(b))
    return or_all(parts) if parts else zero


def pack(flags: FlagSet, conditions: Mapping[str, Column | str]) -> Column:
    """Fold boolean columns into one mask; NULL counts as false."""
    placed = [(flags.position(n), as_column(c)) for n, c in conditions.items()]
    if not flags.is_wide:
        wide = "bigint" if flags.spark_type == "bigint" else "int"
        return _fold_word(placed, wide).cast(flags.spark_type)
    n_words = -(-flags.size // WORD_BITS)
    return F.array(
        *[
            _fold_word([(p % WORD_BITS, c) for p, c in placed if p // WORD_BITS == w], "bigint")
            for w in range(n_words)
        ]
    )


def _word(mask: Column, flags: FlagSet, word: int) -> Column:
    return F.element_at(mask, word + 1) if flags.is_wide else mask


def _tested(mask: Column, flags: FlagSet, names: Iterable[str]) -> list[tuple[Column, Column]]:
    """Per word: the masked value and the wanted bits, both as columns."""
    dtype = "bigint" if flags.is_wide else flags.spark_type
    return [
        (_word(mask, flags, w).bitwiseAND(F.lit(m).cast(dtype)), F.lit(m).cast(dtype))
        for w, m in flags.words(names).items()
    ]


def has_all(mask: Column, flags: FlagSet, names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [got == want for got, want in _tested(mask, flags, names)], F.lit(True))


def has_any(mask: Column, flags: FlagSet, names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [got != 0 for got, _ in _tested(mask, flags, names)], F.lit(False))


def has_none(mask: Column, flags: FlagSet, names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [got == 0 for got, _ in _tested(mask, flags, names)], F.lit(True))


def words_of(mask: Column, n_words: int) -> list[Column]:
    """The words of a wide mask, lowest first."""
    return [F.element_at(mask, w + 1) for w in range(n_words)]


def n_words(flags: FlagSet) -> int:
    return -(-flags.size // WORD_BITS)


def apply_wide_update(mask: Column, n: int, operands: Mapping[str, Column]) -> Column:
    """``apply_update`` on arrays of ``n`` words; the required bits are tested in all words together."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), n)
    given = {k: words_of(F.coalesce(v, zero), n) for k, v in operands.items()}
    own = words_of(mask, n)
    require = given.pop("require_mask", None)
    new = F.array(*[apply_update(word, **{k: v[i] for k, v in given.items()}) for i, word in enumerate(own)])
    if require is None:
        return new
    ready = reduce(lambda a, b: a & b, [word.bitwiseAND(r) == r for word, r in zip(own, require)])
    return F.when(ready, new).otherwise(mask)


def apply_update(
    mask: Column,
    set_mask: Column | int = 0,
    clear_mask: Column | int = 0,
    toggle_mask: Column | int = 0,
    require_mask: Column | int = 0,
) -> Column:
    """Clear, then set, then toggle, but only where every ``require`` bit is present."""

    def operand(value: Column | int) -> Column:
        return F.coalesce(value, F.lit(0)) if isinstance(value, Column) else F.lit(value)

    set_c, clear_c, toggle_c, require_c = map(operand, (set_mask, clear_mask, toggle_mask, require_mask))
    updated = mask.bitwiseAND(F.bitwise_not(clear_c)).bitwiseOR(set_c).bitwiseXOR(toggle_c)
    return F.when(mask.bitwiseAND(require_c) == require_c, updated).otherwise(mask)


def _joined_names(mask: Column, flags: FlagSet, sep: str) -> Column:
    """The names of the set bits in the order of the bits: every four bits look up their names in a list of 16."""
    nibbles: dict[int, dict[int, str]] = {}
    for name in flags.names:
        at, bit = divmod(flags.position(name), 4)
        nibbles.setdefault(at, {})[bit] = name
    parts = []
    for at, named in nibbles.items():
        word, place = divmod(4 * at, WORD_BITS)
        sets = [[n for bit, n in named.items() if value >> bit & 1] for value in range(16)]
        listed = F.array(*[F.lit(sep.join(names) if names else None).cast("string") for names in sets])
        parts.append(F.get(listed, F.shiftright(_word(mask, flags, word), place).bitwiseAND(F.lit(15)).cast("int")))
    return F.concat_ws(sep, *parts)


def decode(mask: Column, flags: FlagSet, by_name: bool = False, unknown: str = "hex", sep: str = "|") -> Column:
    """Mask to ``a|b``: ``none`` for 0, unknown bits beside known ones are dropped.

    With only unknown bits the result is ``unknown(0xHEX)``, or ``none`` when
    ``unknown="none"``. The order is fixed while the plan is built, not per row.
    """
    names = sorted(flags.names) if by_name else list(flags.names)
    if len(names) > MANY_FLAGS and not by_name:
        parts = _joined_names(mask, flags, sep)
    else:
        parts = F.concat_ws(sep, *[F.when(has_all(mask, flags, [n]), F.lit(n)) for n in names])
    if unknown != "hex":
        fallback = F.lit("none")
    else:
        if flags.is_wide:
            words = words_of(mask, n_words(flags))[::-1]
            digits = F.ltrim(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]), F.lit("0"))
            empty = digits == ""
        else:
            digits, empty = F.hex(mask), mask == 0
        fallback = F.when(empty, F.lit("none")).otherwise(F.concat(F.lit("unknown(0x"), digits, F.lit(")")))
    # The test comes first so that the names are put together once.
    return F.when(has_any(mask, flags, names), parts).when(mask.isNotNull(), fallback)


def from_map(map_col: Column, flags: FlagSet, aliases: Mapping[str, str]) -> Column:
    """``map<string,boolean>`` to mask; several map keys may stand for one flag."""
    by_flag: dict[str, list[str]] = {}
    for key, flag in aliases.items():
        by_flag.setdefault(flag, []).append(key)
    conditions = {
        flag: reduce(
            lambda a, b: a | b,
            [F.coalesce(F.try_element_at(map_col, F.lit(k)), F.lit(False)) for k in keys],
        )
        for flag, keys in by_flag.items()
    }
    return pack(flags, conditions)


def lowest_case(mask: Column, cases: Sequence[tuple[int, str]], wide: bool = False) -> Column:
    """Action of the first listed bit that is set in ``mask``; NULL when none is."""
    out: Column | None = None
    for bit, action in cases:
        word, place = divmod(bit, WORD_BITS)
        value = F.element_at(mask, word + 1) if wide else mask
        cond = value.bitwiseAND(F.lit(to_signed(1 << (place if wide else bit)))) != 0
        out = F.when(cond, F.lit(action)) if out is None else out.when(cond, F.lit(action))
    return F.lit(None).cast("string") if out is None else out


def hex_to_bigint(text: Column) -> Column:
    """``0x...`` text to the BIGINT with the same 64 bits; NULL for anything else."""
    is_hex = text.rlike(r"^0[xX][0-9A-Fa-f]{1,16}\z")
    unsigned = F.conv(F.when(is_hex, F.substring(text, 3, 16)), 16, 10).cast("decimal(20,0)")
    half, full = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    return F.when(unsigned >= half, unsigned - full).otherwise(unsigned).cast("bigint")
