"""Text expressions: literal masking, token classes, small formatters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flagframe.functions.bits import FlagSet, pack

# Words and the byte length that are never masked.
STOP_WORDS = ("main", "func", "package", "import", "var", "const", "if", "else", "for", "range")
MIN_MASKED_BYTES = 4

# Name parts that mark access-control code, in matching order.
AUTH_KEYWORDS = ("auth", "login", "check", "verify", "validate", "permission")

# First path parts of the standard library, which are never rebased.
STANDARD_ROOTS = (
    "fmt", "os", "io", "log", "errors", "strings", "strconv", "time", "context", "sync", "path", "runtime", "reflect", "unsafe",
    "sort", "math", "bytes", "net", "http", "encoding", "json", "xml", "base64", "crypto", "md5", "sha1", "sha256", "syscall",
    "signal", "testing", "embed", "flag", "regexp", "unicode", "bufio", "image", "html", "text", "mime", "plugin", "go", "debug",
    "hash", "index", "database",
)

# The white space of Unicode, trimmed from lines.
_BLANKS = (
    " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_BYTE_LIST = r"^[A-Za-z_][A-Za-z0-9_.]*\(\[\]byte\{([0-9, ]*)\}\)$"


def is_maskable(text: Column) -> Column:
    return (F.octet_length(text) >= MIN_MASKED_BYTES) & ~text.isin(*STOP_WORDS)


def byte_list(text: Column) -> Column:
    """Decimal UTF-8 bytes of ``text`` joined by ``", "``.

    Read back as Latin-1, every byte is one character whose code is the byte.
    """
    one_per_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.array_join(F.transform(F.split(one_per_byte, ""), lambda c: F.ascii(c).cast("string")), ", ")


def mask_literal(text: Column, type_name: Column | str = "string") -> Column:
    kind = F.lit(type_name) if isinstance(type_name, str) else type_name
    masked = F.concat(kind, F.lit("([]byte{"), byte_list(text), F.lit("})"))
    return F.when(is_maskable(text), masked).otherwise(text)


def unmask_literal(text: Column) -> Column:
    digits = F.regexp_extract_all(F.regexp_extract(text, _BYTE_LIST, 1), F.lit(r"(\d+)"), F.lit(1))
    numbers = F.transform(digits, lambda d: d.try_cast("int"))
    are_bytes = F.forall(numbers, lambda n: F.coalesce(n.between(0, 255), F.lit(False)))
    pairs = F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0"))
    decoded = F.try_validate_utf8(F.unhex(F.array_join(pairs, "")).cast("string"))
    # What is no list of bytes of a UTF-8 text stays as it is.
    return F.when(text.rlike(_BYTE_LIST) & are_bytes, F.coalesce(decoded, text)).otherwise(text)


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """First of ``keywords`` (in the given order) contained in the lower-cased text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords])


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def trim_line(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def is_all_caps(token: Column) -> Column:
    """At least one letter, and every letter is upper case."""
    return token.rlike(r"\p{L}") & ~token.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_all_lower(token: Column) -> Column:
    return token.rlike(r"\p{L}") & ~token.rlike(r"[\p{L}&&[^\p{Ll}]]")


def is_constant_like(token: Column) -> Column:
    return token.rlike(r"^[\p{L}\p{Nd}_$]+\z")


def is_identifier(token: Column) -> Column:
    return token.rlike(r"^\p{L}[\p{L}\p{Nd}_$]*\z")


def is_valid_ident(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z0-9_$]+\z")


TOKEN_CLASSES = FlagSet(("all_caps", "all_lower", "constant_like", "identifier", "valid_ident"))


def token_classes(token: Column) -> Column:
    """Mask of the classes a token belongs to; plain ASCII words need a single test."""
    word = ("constant_like", "identifier", "valid_ident")
    return (
        F.when(token.rlike(r"^[a-z]+\z"), F.lit(TOKEN_CLASSES.value("all_lower", *word)))
        .when(token.rlike(r"^[A-Z]+\z"), F.lit(TOKEN_CLASSES.value("all_caps", *word)))
        .when(token.rlike(r"^[A-Za-z]+\z"), F.lit(TOKEN_CLASSES.value(*word)))
        .otherwise(
            pack(
                TOKEN_CLASSES,
                {
                    "all_caps": is_all_caps(token),
                    "all_lower": is_all_lower(token),
                    "constant_like": is_constant_like(token),
                    "identifier": is_identifier(token),
                    "valid_ident": is_valid_ident(token),
                },
            ).cast("int")
        )
    )


def one_decimal(value: Column) -> Column:
    """``%.1f`` of a double as the C family rounds: the exact binary value decides, ties go to even.

    The fraction is taken as a whole number of 2^-58 and compared in integers; what lies below
    that belongs to fractions far from any tie.
    """
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(1 << 58))
    units = F.floor(scaled)
    doubled = units * 20 + F.lit(1 << 58)
    up = F.shiftright(doubled, 59)
    tie = (doubled.bitwiseAND(F.lit((1 << 59) - 1)) == 0) & (scaled == units)
    tenths = whole * 10 + up - F.when(tie & (up % 2 == 1), 1).otherwise(0)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.concat(sign, ((tenths - tenths % 10) / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    # From 2^49 on the spacing of doubles is coarse enough for the plain formatter.
    return F.when(size < float(1 << 49), digits).otherwise(F.format_string("%.1f", value))


def percent(part: Column, whole: Column) -> Column:
    share = part.cast("double") / F.when(whole > 0, whole) * F.lit(100.0)
    return F.concat(one_decimal(F.coalesce(share, F.lit(0.0))), F.lit("%"))


def human_size(n_bytes: Column) -> Column:
    size = n_bytes.cast("double")
    return F.when(
        n_bytes > 1024 * 1024, F.concat(one_decimal(size / 1024 / 1024), F.lit("MB"))
    ).otherwise(F.concat(one_decimal(size / 1024), F.lit("KB")))
