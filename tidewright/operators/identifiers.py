"""Identifier cleaners and validators, declared by a compact form, a format and a check kernel from the public specifications.

Each entry gives: the characters dropped to make a number compact, a pattern of the compact number, a check over it and the standard format.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.nulls import is_null

Check = Callable[[Column], Column]


class Identifier(NamedTuple):
    drop: str
    pattern: str
    check: Check | None = None
    groups: str = ""  # the standard format: # for a character, others as they are
    prefix: str = ""  # dropped from the front of a compact number


def _mod(weights: list[int], n: int, want: int = 0) -> Check:
    """The weighted sum over the first digits, modulo n, is want."""
    return lambda c: K.weighted(c, weights) % n == want


def _comp(weights: list[int], n: int = 11, at: int | None = None, over: dict[int, int] | None = None) -> Check:
    """The digit after the weighted ones (or at at) is n minus the sum modulo n; over maps results beyond digits, and what isn't mapped is invalid."""

    def check(c: Column) -> Column:
        r = (n - K.weighted(c, weights) % n) % n
        for a, b in (over or {}).items():
            r = F.when(r == a, b).otherwise(r)
        return r == K.digit(c, at or len(weights) + 1)

    return check


def _rest(weights: list[int], n: int = 11, at: int | None = None, over: dict[int, int] | None = None) -> Check:
    """The digit after the weighted ones is the sum modulo n."""

    def check(c: Column) -> Column:
        r = K.weighted(c, weights) % n
        for a, b in (over or {}).items():
            r = F.when(r == a, b).otherwise(r)
        return r == K.digit(c, at or len(weights) + 1)

    return check


def _two(first: list[int], second: list[int], n: int, start: int = 1) -> Check:
    """Two rounds: the sum modulo 11, and with other weights if that is 10; then 10 counts as 0."""

    def check(c: Column) -> Column:
        a, b = K.weighted(c, first) % 11, K.weighted(c, second) % 11
        return F.when(a < 10, a).otherwise(b % 10) == K.digit(c, n)

    return check


def _both(*checks: Check) -> Check:
    def check(c: Column) -> Column:
        out = F.lit(True)
        for k in checks:
            out = out & k(c)
        return out

    return check


def _any(*checks: Check) -> Check:
    def check(c: Column) -> Column:
        out = F.lit(False)
        for k in checks:
            out = out | F.coalesce(k(c), F.lit(False))
        return out

    return check


def _part(start: int, length: int, check: Check) -> Check:
    return lambda c: check(F.substring(c, start, length))


def _born(y: int, m: int, d: int, century: str = "19") -> Check:
    """Two-digit year, month and day at these places make a date."""
    return lambda c: K.date(F.concat(F.lit(century), F.substring(c, y, 2)), F.substring(c, m, 2), F.substring(c, d, 2)).isNotNull()


def _letter(alphabet: str, n: int, digits: int) -> Check:
    """The letter after digits is that of alphabet at the number modulo n."""
    return lambda c: F.substring(F.lit(alphabet), (F.substring(c, 1, digits).cast("long") % n + 1).cast("int"), F.lit(1)) == F.substring(c, digits + 1, 1)


def _br(weights: list[int], at: int) -> Check:
    return lambda c: (lambda r: F.when(r < 2, 0).otherwise(11 - r) == K.digit(c, at))(K.weighted(c, weights) % 11)


def _be(c: Column) -> Column:
    return (97 - F.substring(c, 1, 8).cast("long") % 97) == F.substring(c, 9, 2).cast("long")


def _fr_tva(c: Column) -> Column:
    return K.luhn(F.substring(c, 3, 9)) & ((F.substring(c, 3, 9).cast("long") * 100 + 12) % 97 == F.substring(c, 1, 2).cast("long"))


def _gb_vat(c: Column) -> Column:
    r = K.weighted(c, [8, 7, 6, 5, 4, 3, 2, 10, 1]) % 97
    return (r == 0) | (r == 42)


def _au_abn(c: Column) -> Column:
    return (K.weighted(c, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0


def _at_uid(c: Column) -> Column:
    total = F.lit(4)
    for k in range(1, 8):
        d = K.digit(c, k + 1)
        total = total + (d if k % 2 else F.floor(d / 5) + d * 2 % 10)
    return (10 - total % 10) % 10 == K.digit(c, 9)


def _kr_rrn(c: Column) -> Column:
    return (11 - K.weighted(c, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == K.digit(c, 13)


def _cl(c: Column) -> Column:
    d = F.lpad(c, 9, "0")
    r = (11 - K.weighted(d, [3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return F.when(r == 10, "K").otherwise(r.cast("string")) == F.substring(d, 9, 1)


def _isbn10(c: Column) -> Column:
    last = F.when(F.substring(c, 10, 1) == "X", 10).otherwise(K.digit(c, 10))
    return (K.weighted(c, [10, 9, 8, 7, 6, 5, 4, 3, 2]) + last) % 11 == 0


def _issn(c: Column) -> Column:
    last = F.when(F.substring(c, 8, 1) == "X", 10).otherwise(K.digit(c, 8))
    return (K.weighted(c, [8, 7, 6, 5, 4, 3, 2]) + last) % 11 == 0


def _cas(c: Column) -> Column:
    total = F.aggregate(F.transform(F.split(F.reverse(c), ""), lambda d, k: F.when(d == "", 0).otherwise(d.cast("int") * k)), F.lit(0), lambda a, x: a + x)
    return total % 10 == F.right(c, F.lit(1)).cast("int")


def _sedol(c: Column) -> Column:
    return (10 - K.weighted(c, [1, 3, 1, 7, 3, 9], K.ALPHABET) % 10) % 10 == K.digit(c, 7)


def _cusip(c: Column) -> Column:
    total = F.lit(0)
    for k in range(1, 9):
        v = K.value(c, k, K.ALPHABET + "*@#") * (2 if k % 2 == 0 else 1)
        total = total + F.floor(v / 10) + v % 10
    return (10 - total % 10) % 10 == K.digit(c, 9)


def _uscc(c: Column) -> Column:
    alphabet = "0123456789ABCDEFGHJKLMNPQRTUWXY"
    total = K.weighted(c, [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28], alphabet)
    return (31 - total % 31) % 31 == K.value(c, 18, alphabet)


def _nie(c: Column) -> Column:
    return _DNI(F.concat(F.translate(F.substring(c, 1, 1), "XYZ", "012"), F.substring(c, 2, 8)))


_DNI = _letter("TRWAGMYFPDXBNJZSQVHLCKE", 23, 8)


def _cif(c: Column) -> Column:
    total = F.lit(0)
    for k in range(1, 8):
        d = K.digit(c, k + 1) * (2 if k % 2 else 1)
        total = total + F.floor(d / 10) + d % 10
    r = ((10 - total % 10) % 10).cast("int")
    last = F.substring(c, 9, 1)
    return (last == r.cast("string")) | (last == F.substring(F.lit("JABCDEFGHI"), r + 1, F.lit(1)))


def _nir(c: Column) -> Column:
    return 97 - F.substring(c, 1, 13).cast("long") % 97 == F.substring(c, 14, 2).cast("long")


def _pps(c: Column) -> Column:
    total = K.weighted(c, [8, 7, 6, 5, 4, 3, 2]) + F.when(F.char_length(c) == 9, 9 * K.value(c, 9, "WABCDEFGHIJKLMNOPQRSTUV")).otherwise(0)
    return F.substring(F.lit("WABCDEFGHIJKLMNOPQRSTUV"), (total % 23 + 1).cast("int"), F.lit(1)) == F.substring(c, 8, 1)


def _gr_vat(c: Column) -> Column:
    return K.weighted(c, [256, 128, 64, 32, 16, 8, 4, 2]) % 11 % 10 == K.digit(c, 9)


def _imo(c: Column) -> Column:
    return K.weighted(c, [7, 6, 5, 4, 3, 2]) % 10 == K.digit(c, 7)


_BSN = lambda c: K.weighted(c, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0
_NO = _comp([3, 2, 7, 6, 5, 4, 3, 2])
_RC = r" ./-"
#: The alphabet of the Mexican check digit, the Mexican states, the Italian month letters, the digits' stand-ins and the values of characters in odd places.
CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
CURP_STATES = "AS BC BS CC CH CL CM CS DF DG GR GT HG JC MC MN MS NE NL NT OC PL QR QT SL SP SR TC TL TS VZ YN ZS"
FISCAL_MONTHS, FISCAL_DIGITS = "ABCDEHLMPRST", "LMNPQRSTUV"
FISCAL_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def _mx_curp(c: Column) -> Column:
    """A birth date (a digit in place 17 means before 2000), a state, and weights 18 to 2 modulo 10."""
    year = F.concat(F.when(F.substring(c, 17, 1).rlike(r"\d"), "19").otherwise("20"), F.substring(c, 5, 2))
    born = K.date(year, F.substring(c, 7, 2), F.substring(c, 9, 2)).isNotNull()
    return born & F.substring(c, 12, 2).isin(CURP_STATES.split()) & ((10 - K.weighted(c, list(range(18, 1, -1)), CURP_ALPHABET) % 10) % 10 == K.digit(c, 18))


def _it_codicefiscale(c: Column) -> Column:
    """Eleven digits as a VAT number; else a birth date (day plus 40 for women) and a letter from odd and even places modulo 26."""
    plain = F.translate(F.concat(F.substring(c, 7, 2), F.substring(c, 10, 2)), FISCAL_DIGITS, "0123456789")
    yy, day = F.substring(plain, 1, 2).cast("int"), F.substring(plain, 3, 2).cast("int")
    day = F.when(day > 40, day - 40).otherwise(day)
    born = K.date(F.when(yy < 20, 2000 + yy).otherwise(1900 + yy), F.instr(F.lit(FISCAL_MONTHS), F.substring(c, 9, 1)), day).isNotNull()
    odd = F.array(*[F.lit(x) for x in FISCAL_ODD])
    place = lambda k: F.when(F.substring(c, k, 1).rlike(r"\d"), F.substring(c, k, 1).try_cast("int")).otherwise(F.ascii(F.substring(c, k, 1)) - 65)
    total = F.lit(0)
    for k in range(1, 16):
        total = total + (F.get(odd, place(k)) if k % 2 else place(k))
    return F.when(F.char_length(c) == 11, K.luhn(c)).otherwise(born & (total % 26 == F.ascii(F.substring(c, 16, 1)) - 65))


_SEP = r" \-./"

#: The registry, by name.
IDENTIFIERS: dict[str, Identifier] = {
    "ad_nrt": Identifier(_SEP, r"[ACDEFGLOPU]\d{6}[A-Z]", None, "#-######-#"),
    "al_nipt": Identifier(_SEP, r"[A-M]\d{8}[A-Z]", None, prefix="AL"),
    "ar_cbu": Identifier(_SEP, r"\d{22}", _both(_comp([7, 1, 3, 9, 7, 1, 3], 10), _part(9, 14, _comp([3, 9, 7, 1, 3, 9, 7, 1, 3, 9, 7, 1, 3], 10))), "######## ##############"),
    "ar_cuit": Identifier(_SEP, r"(20|23|24|27|30|33|34|50|51|55)\d{9}", _comp([5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 11, None, {10: 9}), "##-########-#"),
    "ar_dni": Identifier(_SEP, r"\d{7,8}"),
    "at_uid": Identifier(_SEP, r"U\d{8}", _at_uid, prefix="AT"),
    "at_vnr": Identifier(_SEP, r"[1-9]\d{9}", lambda c: K.weighted(c, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6]) % 11 == K.digit(c, 4)),
    "au_abn": Identifier(_SEP, r"\d{11}", _au_abn, "## ### ### ###"),
    "au_acn": Identifier(_SEP, r"\d{9}", _comp([8, 7, 6, 5, 4, 3, 2, 1], 10), "### ### ###"),
    "au_tfn": Identifier(_SEP, r"\d{8,9}", lambda c: F.when(F.char_length(c) == 9, K.weighted(c, [1, 4, 3, 7, 5, 8, 6, 9, 10])).otherwise(K.weighted(c, [10, 7, 8, 4, 6, 3, 5, 1])) % 11 == 0, "### ### ###"),
    "be_iban": Identifier(_SEP, r"BE\d{14}", _both(K.iban, lambda c: F.when(F.substring(c, 5, 10).cast("long") % 97 == 0, 97).otherwise(F.substring(c, 5, 10).cast("long") % 97) == F.substring(c, 15, 2).cast("long")), "#### #### #### ####"),
    "be_vat": Identifier(_SEP, r"[01]\d{9}", _be, prefix="BE"),
    "bg_egn": Identifier(_SEP, r"\d{10}", _rest([2, 4, 8, 5, 10, 9, 7, 3, 6], 11, None, {10: 0})),
    "bg_pnf": Identifier(_SEP, r"\d{10}", _rest([21, 19, 17, 13, 11, 9, 7, 3, 1], 10)),
    "bg_vat": Identifier(_SEP, r"\d{9}", _two([1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 10], 9), prefix="BG"),
    "bic": Identifier(_SEP, r"[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?"),
    "br_cnpj": Identifier(_SEP, r"\d{14}", _both(_br([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 13), _br([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 14)), "##.###.###/####-##"),
    "br_cpf": Identifier(_SEP, r"\d{11}", _both(_br([10, 9, 8, 7, 6, 5, 4, 3, 2], 10), _br([11, 10, 9, 8, 7, 6, 5, 4, 3, 2], 11)), "###.###.###-##"),
    "ca_bn": Identifier(_SEP, r"\d{9}([A-Z]{2}\d{4})?", _part(1, 9, K.luhn)),
    "ca_sin": Identifier(_SEP, r"[1-79]\d{8}", K.luhn, "###-###-###"),
    "casrn": Identifier(_SEP, r"\d{5,10}", _cas),
    "ch_ssn": Identifier(_SEP, r"756\d{10}", K.ean, "###.####.####.##"),
    "ch_uid": Identifier(_SEP, r"CHE\d{9}", _part(4, 9, _comp([5, 4, 3, 2, 7, 6, 5, 4])), "###-###.###.###"),
    "ch_vat": Identifier(_SEP, r"CHE\d{9}(MWST|TVA|IVA|TPV)", _part(4, 9, _comp([5, 4, 3, 2, 7, 6, 5, 4]))),
    "cl_rut": Identifier(_SEP, r"\d{7,8}[0-9K]", _cl, prefix="CL"),
    "cn_ric": Identifier(_SEP, r"\d{17}[0-9X]", _both(K.mod11_2, lambda c: F.try_to_date(F.substring(c, 7, 8), "yyyyMMdd").isNotNull())),
    "cn_uscc": Identifier(_SEP, r"[0-9A-HJ-NP-RTUWXY]{18}", _uscc),
    "cr_cpf": Identifier(_SEP, r"0\d{9}", None, "##-####-####"),
    "cr_cpj": Identifier(_SEP, r"[2-5]\d{9}", None, "#-###-######"),
    "cr_cr": Identifier(_SEP, r"1\d{10,11}"),
    "cu_ni": Identifier(_SEP, r"\d{11}", _born(1, 3, 5)),
    "cusip": Identifier(_SEP, r"[0-9A-Z*@#]{8}\d", _cusip),
    "cz_rc": Identifier(_RC, r"\d{9,10}", lambda c: (F.char_length(c) == 9) | (c.cast("long") % 11 == 0), "######/####"),
    "de_idnr": Identifier(_SEP, r"[1-9]\d{10}", K.mod11_10, "## ### ### ###"),
    "de_vat": Identifier(_SEP, r"[1-9]\d{8}", K.mod11_10, prefix="DE"),
    "de_wkn": Identifier(_SEP, r"[0-9A-HJ-NP-Z]{6}"),
    "dk_cpr": Identifier(_SEP, r"\d{10}", lambda c: K.date(F.concat(F.lit("20"), F.substring(c, 5, 2)), F.substring(c, 3, 2), F.substring(c, 1, 2)).isNotNull(), "######-####"),
    "dk_cvr": Identifier(_SEP, r"[1-9]\d{7}", _mod([2, 7, 6, 5, 4, 3, 2, 1], 11), prefix="DK"),
    "do_cedula": Identifier(_SEP, r"\d{11}", K.luhn, "###-#######-#"),
    "do_ncf": Identifier(_SEP, r"(E\d{12}|B\d{10}|[AP]\d{18})"),
    "do_rnc": Identifier(_SEP, r"\d{9}", lambda c: (10 - K.weighted(c, [7, 9, 8, 6, 5, 4, 3, 2]) % 11) % 9 + 1 == K.digit(c, 9), "#-##-#####-#"),
    "ean": Identifier(_SEP, r"(\d{14}|\d{13}|\d{12}|\d{8})", K.ean),
    "ec_ci": Identifier(_SEP, r"(0[1-9]|1\d|2[0-4]|30|50)[0-6]\d{7}", K.luhn),
    "ee_ik": Identifier(_SEP, r"[1-8]\d{10}", _two([1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3], 11)),
    "ee_kmkr": Identifier(_SEP, r"\d{9}", _comp([3, 7, 1, 3, 7, 1, 3, 7], 10), prefix="EE"),
    "ee_registrikood": Identifier(_SEP, r"[1789]\d{7}", _two([1, 2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7, 8, 9], 8)),
    "es_ccc": Identifier(_SEP, r"\d{20}", _both(lambda c: (lambda r: F.when(r == 10, 1).otherwise(r) == K.digit(c, 9))((11 - K.weighted(c, [4, 8, 5, 10, 9, 7, 3, 6]) % 11) % 11), lambda c: (lambda r: F.when(r == 10, 1).otherwise(r) == K.digit(c, 10))((11 - K.weighted(F.substring(c, 11, 10), [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]) % 11) % 11)), "#### #### ## ##########"),
    "es_cif": Identifier(_SEP, r"[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]", _cif, prefix="ES"),
    "es_dni": Identifier(_SEP, r"\d{8}[A-Z]", _DNI, prefix="ES"),
    "es_iban": Identifier(_SEP, r"ES\d{22}", K.iban, "#### #### #### #### #### ####"),
    "es_nie": Identifier(_SEP, r"[XYZ]\d{7}[A-Z]", _nie, prefix="ES"),
    "es_nif": Identifier(_SEP, r"(\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J])", lambda c: F.when(c.rlike("^[0-9]"), _DNI(c)).when(c.rlike("^[XYZ]"), _nie(c)).otherwise(_cif(c)), prefix="ES"),
    "eu_at_02": Identifier(_SEP, r"[A-Z]{2}\d{2}[0-9A-Z]{3}[0-9A-Z]+", lambda c: K.mod97(F.concat(F.substring(c, 8, 64), F.substring(c, 1, 4)))),
    "eu_banknote": Identifier(_SEP, r"[A-Z]{1,2}\d{10,11}", lambda c: (K.digits_sum(c) + F.aggregate(F.split(c, ""), F.lit(0), lambda a, x: a + F.when(x.rlike("[A-Z]"), F.ascii(x) - 64).otherwise(0))) % 9 == 8),
    "fi_alv": Identifier(_SEP, r"\d{8}", _mod([7, 9, 10, 5, 8, 4, 2, 1], 11), prefix="FI"),
    "fi_associationid": Identifier(_SEP, r"\d{1,6}"),
    "fi_hetu": Identifier(r" ", r"\d{6}[-+A]\d{3}[0-9A-Y]", lambda c: F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (F.concat(F.substring(c, 1, 6), F.substring(c, 8, 3)).cast("long") % 31 + 1).cast("int"), F.lit(1)) == F.substring(c, 11, 1)),
    "fi_veronumero": Identifier(_SEP, r"\d{12}"),
    "fi_ytunnus": Identifier(_SEP, r"\d{8}", _mod([7, 9, 10, 5, 8, 4, 2, 1], 11), "#######-#"),
    "figi": Identifier(_SEP, r"[B-DF-HJ-NP-TV-Z]{2}G[0-9B-DF-HJ-NP-TV-Z]{8}\d", None),
    "fr_nif": Identifier(_SEP, r"[0-3]\d{12}", lambda c: F.substring(c, 1, 10).cast("long") % 511 == F.substring(c, 11, 3).cast("long"), "## ## ### ### ###"),
    "fr_nir": Identifier(_SEP, r"[12]\d{14}", _nir, "# ## ## ## ### ### ##"),
    "fr_siren": Identifier(_SEP, r"\d{9}", K.luhn),
    "fr_siret": Identifier(_SEP, r"\d{14}", _both(K.luhn, _part(1, 9, K.luhn)), "### ### ### #####"),
    "fr_tva": Identifier(_SEP, r"\d{11}", _fr_tva, prefix="FR"),
    "gb_nhs": Identifier(_SEP, r"\d{10}", _comp([10, 9, 8, 7, 6, 5, 4, 3, 2]), "### ### ####"),
    "gb_sedol": Identifier(_SEP, r"[0-9B-DF-HJ-NP-TV-Z]{6}\d", _sedol),
    "gb_utr": Identifier(_SEP + "K", r"\d{10}", lambda c: F.substring(F.lit("21987654321"), (K.weighted(F.substring(c, 2, 9), [6, 7, 8, 9, 10, 5, 4, 3, 2]) % 11 + 1).cast("int"), F.lit(1)) == F.substring(c, 1, 1)),
    "gb_vat": Identifier(_SEP, r"\d{9}(\d{3})?", _gb_vat, "### #### ##", "GB"),
    "gr_amka": Identifier(_SEP, r"\d{11}", K.luhn),
    "gr_vat": Identifier(_SEP, r"\d{9}", _gr_vat, prefix="EL"),
    "grid": Identifier(_SEP, r"[0-9A-Z]{18}", K.mod37_36, "##-#####-##########-#"),
    "hr_oib": Identifier(_SEP, r"\d{11}", K.mod11_10, prefix="HR"),
    "hu_anum": Identifier(_SEP, r"\d{8}", _mod([9, 7, 3, 1, 9, 7, 3, 1], 10), prefix="HU"),
    "iban": Identifier(_SEP, r"[A-Z]{2}\d{2}[0-9A-Z]{11,30}", K.iban),
    "id_npwp": Identifier(_SEP, r"\d{15}", _part(1, 9, K.luhn), "##.###.###.#-###.###"),
    "ie_pps": Identifier(_SEP, r"\d{7}[A-W][ABHTWX]?", _pps),
    "ie_vat": Identifier(_SEP, r"\d{7}[A-W][A-I]?", _pps, prefix="IE"),
    "il_hp": Identifier(_SEP, r"5\d{8}", K.luhn),
    "il_idnr": Identifier(_SEP, r"\d{9}", K.luhn, "########-#"),
    "imei": Identifier(_SEP, r"\d{15}", K.luhn, "##-######-######-#"),
    "imo": Identifier(_SEP + "IMO", r"\d{7}", _imo),
    "imsi": Identifier(_SEP, r"\d{14,15}"),
    "in_aadhaar": Identifier(_SEP, r"[2-9]\d{11}", K.verhoeff, "#### #### ####"),
    "in_pan": Identifier(_SEP, r"[A-Z]{3}[ABCFGHJKLPT][A-Z]\d{4}[A-Z]"),
    "is_kennitala": Identifier(_SEP, r"\d{10}", _comp([3, 2, 7, 6, 5, 4, 3, 2], 11), "######-####"),
    "is_vsk": Identifier(_SEP, r"\d{5,6}", prefix="IS"),
    "isbn": Identifier(_SEP, r"(97[89]\d{10}|\d{9}[0-9X])", lambda c: F.when(F.char_length(c) == 13, K.ean(c)).otherwise(_isbn10(c))),
    "isin": Identifier(_SEP, r"[A-Z]{2}[0-9A-Z]{9}\d", K.luhn_alnum),
    "ismn": Identifier(_SEP, r"9790\d{9}", K.ean),
    "issn": Identifier(_SEP, r"\d{7}[0-9X]", _issn, "####-####"),
    "it_aic": Identifier(_SEP, r"0\d{8}", lambda c: (K.digit(c, 1) + K.digit(c, 3) + K.digit(c, 5) + K.digit(c, 7) + sum((F.floor(K.digit(c, k) * 2 / 10) + K.digit(c, k) * 2 % 10 for k in (2, 4, 6, 8)), F.lit(0))) % 10 == K.digit(c, 9)),
    "it_iva": Identifier(_SEP, r"\d{11}", K.luhn, prefix="IT"),
    "jp_cn": Identifier(_SEP, r"[1-9]\d{12}", lambda c: 9 - K.weighted(c, [0, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1]) % 9 == K.digit(c, 1), "#-####-####-####"),
    "kr_brn": Identifier(_SEP, r"\d{10}", lambda c: (10 - (K.weighted(c, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(K.digit(c, 9) * 5 / 10)) % 10) % 10 == K.digit(c, 10), "###-##-#####"),
    "kr_rrn": Identifier(_SEP, r"\d{13}", _kr_rrn, "######-#######"),
    "lei": Identifier(_SEP, r"[0-9A-Z]{18}\d{2}", K.mod97),
    "li_peid": Identifier(_SEP, r"\d{4,12}"),
    "lt_asmens": Identifier(_SEP, r"[1-6]\d{10}", _two([1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3], 11)),
    "lt_pvm": Identifier(_SEP, r"\d{9}", _two([1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 1], 9), prefix="LT"),
    "lu_tva": Identifier(_SEP, r"\d{8}", lambda c: F.substring(c, 1, 6).cast("long") % 89 == F.substring(c, 7, 2).cast("long"), prefix="LU"),
    "mc_tva": Identifier(_SEP, r"\d{2}000\d{6}", None, prefix="FR"),
    "md_idno": Identifier(_SEP, r"1\d{12}", _rest([7, 3, 1, 7, 3, 1, 7, 3, 1, 7, 3, 1], 10)),
    "me_iban": Identifier(_SEP, r"ME\d{20}", _both(K.iban, lambda c: K.remainder(F.substring(c, 5, 18), 97) == 1)),
    "mt_vat": Identifier(_SEP, r"[1-9]\d{7}", lambda c: (K.weighted(c, [3, 4, 6, 7, 8, 9]) + F.substring(c, 7, 2).cast("int")) % 37 == 0, prefix="MT"),
    "my_nric": Identifier(_SEP, r"\d{12}", _born(1, 3, 5), "######-##-####"),
    "nl_brin": Identifier(_SEP, r"\d{2}[A-Z]{2}(\d{2})?"),
    "nl_bsn": Identifier(_SEP, r"\d{9}", _BSN),
    "nl_btw": Identifier(_SEP, r"\d{9}B\d{2}", lambda c: _BSN(c) | K.mod97(F.concat(F.lit("NL"), c)), prefix="NL"),
    "nl_onderwijsnummer": Identifier(_SEP, r"10\d{7}", lambda c: K.weighted(c, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 5),
    "nl_postcode": Identifier(_SEP, r"[1-9]\d{3}(?!SA|SD|SS)[A-Z]{2}", None, "#### ##"),
    "no_fodselsnummer": Identifier(_SEP, r"\d{11}", _both(_comp([3, 7, 6, 1, 8, 9, 4, 5, 2]), _comp([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])), "###### #####"),
    "no_iban": Identifier(_SEP, r"NO\d{13}", K.iban, "#### #### #### ###"),
    "no_kontonr": Identifier(_SEP, r"\d{11}", _comp([5, 4, 3, 2, 7, 6, 5, 4, 3, 2]), "####.##.#####"),
    "no_mva": Identifier(_SEP, r"\d{9}MVA", _NO, "### ### ### ###", "NO"),
    "no_orgnr": Identifier(_SEP, r"\d{9}", _NO, "### ### ###"),
    "nz_ird": Identifier(_SEP, r"\d{8,9}", lambda c: (lambda d: (lambda a, b: F.when(a < 10, a).otherwise(b) == K.digit(d, 9))((11 - K.weighted(d, [3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11, (11 - K.weighted(d, [7, 4, 3, 2, 5, 2, 7, 6]) % 11) % 11))(F.lpad(c, 9, "0")), "##-###-###"),
    "pe_ruc": Identifier(_SEP, r"(10|15|17|20)\d{9}", lambda c: (11 - K.weighted(c, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 10 == K.digit(c, 11)),
    "pl_nip": Identifier(_SEP, r"\d{10}", _rest([6, 5, 7, 2, 3, 4, 5, 6, 7]), "###-###-##-##", "PL"),
    "pl_pesel": Identifier(_SEP, r"\d{11}", _comp([1, 3, 7, 9, 1, 3, 7, 9, 1, 3], 10)),
    "pl_regon": Identifier(_SEP, r"\d{9}", _rest([8, 9, 2, 3, 4, 5, 6, 7], 11, None, {10: 0})),
    "pt_nif": Identifier(_SEP, r"[1-9]\d{8}", _comp([9, 8, 7, 6, 5, 4, 3, 2], 11, None, {10: 0}), prefix="PT"),
    "ro_cnp": Identifier(_SEP, r"[1-9]\d{12}", _rest([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9], 11, None, {10: 1})),
    "ro_cui": Identifier(_SEP, r"[1-9]\d{1,9}", lambda c: (lambda d: K.weighted(d, [7, 5, 3, 2, 1, 7, 5, 3, 2]) * 10 % 11 % 10 == K.digit(d, 10))(F.lpad(c, 10, "0")), prefix="RO"),
    "ro_onrc": Identifier(r" ", r"[JFC]\d{1,2}/\d{1,8}/\d{4}"),
}


def _nit(c: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in (0, 3, 7, 13, 17, 19, 23, 29, 37, 41, 43, 47, 53, 59, 67, 71)])
    total = F.aggregate(F.transform(F.split(F.reverse(c), ""), lambda d, k: F.when(d == "", 0).otherwise(d.cast("int") * F.get(weights, k))), F.lit(0), lambda a, x: a + x)
    return F.substring(F.lit("01987654321"), (total % 11 + 1).cast("int"), F.lit(1)) == F.right(c, F.lit(1))


IDENTIFIERS["it_codicefiscale"] = Identifier(r" \-:", r"[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]|\d{11}", _it_codicefiscale)
IDENTIFIERS["mx_curp"] = Identifier(r" \-", r"[A-Z]{4}\d{6}[HM][A-Z]{5}[0-9A-Z]\d", _mx_curp)
IDENTIFIERS["co_nit"] = Identifier(_SEP, r"\d{8,16}", _nit)


def compact(name: str, c: Column) -> Column:
    spec = IDENTIFIERS[name]
    out = F.upper(F.regexp_replace(c.cast("string"), f"[{spec.drop}]", ""))
    return F.regexp_replace(out, f"^{spec.prefix}", "") if spec.prefix else out


def validate(name: str, c: Column) -> Column:
    """Whether a text is a valid identifier; null and null-like texts aren't."""
    spec, n = IDENTIFIERS[name], compact(name, c)
    ok = n.rlike(f"^(?:{spec.pattern})$")
    if spec.check is not None:
        ok = F.when(ok, F.coalesce(spec.check(n), F.lit(False))).otherwise(F.lit(False))
    return F.coalesce(~is_null(c) & ok, F.lit(False))


def formatted(name: str, c: Column) -> Column:
    spec, n = IDENTIFIERS[name], compact(name, c)
    if not spec.groups:
        return n
    parts, k = [], 1
    for ch in spec.groups:
        if ch == "#":
            parts.append(F.substring(n, k, 1))
            k += 1
        else:
            parts.append(F.when(F.char_length(n) >= k, F.lit(ch)).otherwise(F.lit("")))
    return F.when(F.char_length(n) == spec.groups.count("#"), F.concat(*parts)).otherwise(n)


def clean(df: DataFrame, column: str, name: str, output_format: str = "standard", inplace: bool = False, errors: str = "coerce") -> DataFrame:
    """Adds column_clean (or replaces column): valid identifiers in the format, others null, kept or an error by errors."""
    c = F.col(f"`{column}`")
    value = compact(name, c) if output_format == "compact" else formatted(name, c)
    other = {"coerce": F.lit(None), "ignore": c.cast("string"), "raise": F.when(is_null(c), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"not a valid {name}: "), c.cast("string"))))}[errors]
    out = df.withColumn(f"{column}_clean", F.when(validate(name, c), value).otherwise(other))
    return out.drop(column) if inplace else out
