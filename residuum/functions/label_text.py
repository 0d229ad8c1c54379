"""Names, codes and numbers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 standard residues, three letters to one.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def one_letter(name: Column, unknown: str | None = None) -> Column:
    """One-letter code of a residue name; ``unknown`` (or null) for others."""
    return F.coalesce(F.try_element_at(_map(THREE_TO_ONE), name), F.lit(unknown).cast("string"))


def three_letters(code: Column, unknown: str | None = "UNK") -> Column:
    return F.coalesce(F.try_element_at(_map({b: a for a, b in THREE_TO_ONE.items()}), code), F.lit(unknown).cast("string"))


def atom_name(name: Column) -> Column:
    """Leading digit to the end, deuterium as hydrogen."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"^(\d)(.*)$", "$2$1"), "^D", "H")


def residue_name(name: Column) -> Column:
    """Names of more than three letters lose the first (an alternate-location mark)."""
    return F.when(F.length(name) > 3, F.substring(name, 2, 1 << 30)).otherwise(name)


def nearest_number(line: Column, keyword: str, default: float) -> Column:
    """The number in ``line`` that starts nearest to ``keyword``, the first of equals; the default if there is none.

    Decimals are candidates before whole numbers of one or two digits between spaces.
    """
    decimals = F.regexp_extract_all(line, F.lit(r"(\d+\.\d+)"), F.lit(1))
    wholes = F.regexp_extract_all(line, F.lit(r" (\d{1,2}) "), F.lit(1))
    numbers = F.concat(decimals, wholes)
    at = F.instr(line, keyword)
    away = F.transform(numbers, lambda n, i: F.struct(F.abs(F.position(n, line) - at).alias("away"), i.alias("i"), n.alias("n")))
    best = F.array_min(away)["n"].try_cast("double")
    return F.when(at > 0, F.coalesce(best, F.lit(default))).otherwise(default)


def resolution(line: Column) -> Column:
    """Resolution in angstroms of a header line, null if it states none."""
    found = F.regexp_extract(line, r"RESOLUTION\..*?(\d+\.\d+) *ANGSTROMS\.", 1)
    return found.try_cast("double")


#: The first number that ``hybrid36`` can't write, by width.
HYBRID36_END = {w: 10**w + 52 * 36 ** (w - 1) for w in (4, 5)}


def hybrid36(number: Column, width: int) -> Column:
    """A whole number in ``width`` characters: as such where it fits, then from A000... in capitals and from a000... in small letters to base 36; null beyond."""
    first, many = 10**width, 26 * 36 ** (width - 1)
    based = lambda n: F.conv((n + 10 * 36 ** (width - 1)).cast("string"), 10, 36)
    n = number.cast("long")
    plain = (n < first) & (n > -(10 ** (width - 1)))
    return F.when(plain, F.lpad(n.cast("string"), width, " ")).when((n >= first) & (n < first + many), based(n - first)).when((n >= first + many) & (n < first + 2 * many), F.lower(based(n - first - many)))


def from_hybrid36(text: Column, width: int) -> Column:
    """The number that ``hybrid36`` wrote, null for other text."""
    first, many = 10**width, 26 * 36 ** (width - 1)
    value = F.conv(text, 36, 10).cast("long") - 10 * 36 ** (width - 1) + first
    rest = f"{{{width - 1}}}$"
    return F.when(text.rlike(f"^[A-Z][0-9A-Z]{rest}"), value).when(text.rlike(f"^[a-z][0-9a-z]{rest}"), value + many).otherwise(text.try_cast("long"))
