"""Check-digit kernels as column expressions; all take the compact number as a text and stay inside code generation or JVM lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digit(c: Column, k: int) -> Column:
    """The digit at 1-based place k, as a number."""
    return F.try_to_number(F.substring(c, k, 1), F.lit("9")).cast("int")


def value(c: Column, k: int, alphabet: str = ALPHABET) -> Column:
    """The place in alphabet of the character at k, from 0; -1 if it isn't there."""
    return F.instr(F.lit(alphabet), F.substring(c, k, 1)) - 1


def weighted(c: Column, weights: list[int], alphabet: str | None = None) -> Column:
    get = (lambda k: digit(c, k)) if alphabet is None else (lambda k: value(c, k, alphabet))
    total = F.lit(0)
    for k, w in enumerate(weights, 1):
        total = total + w * get(k)
    return total


def digits_sum(c: Column) -> Column:
    return F.aggregate(F.split(c, ""), F.lit(0), lambda acc, d: acc + F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def luhn_alnum(c: Column) -> Column:
    """Luhn over a text whose letters count as two digits, A as 10."""
    return F.call_function("luhn_check", expanded(c))


def expanded(c: Column) -> Column:
    """Letters as the numbers 10..35."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


def remainder(c: Column, n: int) -> Column:
    """A decimal text of any length modulo n."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda acc, d: F.when(d == "", acc).otherwise((acc * 10 + F.coalesce(F.try_to_number(d, F.lit("9")).cast("long"), F.lit(0))) % n))


def mod97(c: Column) -> Column:
    """ISO 7064 mod 97-10 over digits and letters."""
    return remainder(expanded(c), 97) == 1


def iban(c: Column) -> Column:
    return mod97(F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4)))


def mod11_10(c: Column) -> Column:
    """ISO 7064 mod 11,10 over digits."""
    last = F.aggregate(F.split(c, ""), F.lit(5), lambda acc, d: F.when(d == "", acc).otherwise((F.when(acc == 0, 10).otherwise(acc) * 2 % 11 + d.cast("int")) % 10))
    return last == 1


def mod37_36(c: Column) -> Column:
    last = F.aggregate(F.split(c, ""), F.lit(18), lambda acc, d: F.when(d == "", acc).otherwise((F.when(acc == 0, 36).otherwise(acc) * 2 % 37 + F.instr(F.lit(ALPHABET), d) - 1) % 36))
    return last == 1


def mod11_2(c: Column) -> Column:
    """ISO 7064 mod 11-2, X for 10 in the last place."""
    total = F.aggregate(F.split(c, ""), F.lit(0), lambda acc, d: F.when(d == "", acc).otherwise((acc * 2 + F.when(d == "X", 10).otherwise(d.cast("int"))) % 11))
    return total == 1


def ean(c: Column) -> Column:
    """EAN of any length: weights 1 and 3 from the right."""
    n = F.char_length(c)
    total = F.aggregate(F.transform(F.split(c, ""), lambda d, k: F.when(d == "", 0).otherwise(d.cast("int") * F.when((n - k) % 2 == 1, 1).otherwise(3))), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


#: Multiplication and permutation tables of the dihedral group of order 10.
VERHOEFF_D = [
    "0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210",
]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def verhoeff(c: Column) -> Column:
    d, p = F.lit("".join(VERHOEFF_D)), F.lit("".join(VERHOEFF_P))
    at = lambda table, row, col: F.substring(table, row * 10 + col + 1, F.lit(1)).cast("int")
    return F.aggregate(F.transform(F.split(F.reverse(c), ""), lambda x, k: F.when(x == "", F.lit(None)).otherwise(at(p, k % 8, x.cast("int")))), F.lit(0), lambda acc, x: F.when(x.isNull(), acc).otherwise(at(d, acc, x))) == 0


def date(y: Column, m: Column, d: Column) -> Column:
    """The date of three numbers or texts, null if there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
