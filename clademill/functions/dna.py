"""Scalar and array functions on aligned nucleotide texts, as Column expressions. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clademill.functions.arrays import bound, running_totals

# The ambiguity code of each set of bases, bases in alphabetical order.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}
# The standard genetic code, codons in the order TCAG of each position.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Columns that one long holds.
CHUNK = 60


def mask_ambiguous(seq: Column) -> Column:
    """Upper case, ``N`` as ``-``."""
    return F.translate(F.upper(seq), "N", "-")


def without(seq: Column, letters: str) -> Column:
    """The text without any of ``letters``."""
    return F.translate(seq, letters, "")


def n_bases(seq: Column) -> Column:
    """The number of letters other than gap and unknown."""
    return F.length(without(seq, "Nn-"))


def kmers(seq: Column, k: int) -> Column:
    """Array of ``(pos, kmer)``; the last k-mer of a text is left out, as positions run up to length minus k."""
    size = F.length(seq) - k
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))


def similarity(a: Column, b: Column) -> Column:
    """The number of positions at which two texts have the same letter and no gap."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & (x != "-")).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def acid(codon: Column) -> Column:
    """The amino acid of three letters in upper case; anything but three of ACGT is ``X``."""
    one, two, three = (F.position(F.substring(codon, i, 1), F.lit("TCAG")) for i in (1, 2, 3))
    known = (F.length(codon) == 3) & (one * two * three > 0)
    return F.when(known, F.substring(F.lit(AMINO), 16 * (one - 1) + 4 * (two - 1) + three, F.lit(1))).otherwise("X")


def translate_codons(seq: Column, frame: int = 0) -> Column:
    """The amino acids of the whole codons of a frame; a codon with anything but ACGT is ``X``."""
    codons = F.regexp_extract_all(F.substring(F.upper(seq), frame + 1, 1 << 30), F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, acid), "")


def iupac(bases: Column) -> Column:
    """The ambiguity code of an array of bases ACGT; exact sets only, null for an empty one."""
    code = F.create_map(*[F.lit(v) for p in IUPAC.items() for v in p])
    return F.element_at(code, F.array_join(F.array_sort(F.array_distinct(bases)), ""))


def runs(seq: Column, inside: str, outside: str) -> Column:
    """Array of ``(start, end)`` of the maximal runs of letters ``inside`` (a character class); ends are exclusive.

    Computed within the row: the text is cut into runs, whose lengths add up to positions.
    """
    parts = F.regexp_extract_all(seq, F.lit(f"({inside}+|{outside}+)"), F.lit(1))
    place = lambda p, end: F.struct((end - F.length(p)).alias("start"), end.alias("end"), p.rlike(f"^{inside}").alias("keep"))
    placed = bound(parts, lambda found: F.zip_with(found, running_totals(F.transform(found, F.length)), place))
    return F.transform(F.filter(placed, lambda r: r["keep"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def ungapped_runs(seq: Column) -> Column:
    """Maximal runs free of ``-``, ``N`` and ``n``."""
    return runs(seq, "[^Nn-]", "[Nn-]")


def marked(seq: Column, letters: str) -> Column:
    """``1`` for each letter that is one of ``letters`` in either case, ``0`` for any other."""
    return F.translate(F.regexp_replace(F.upper(seq), f"[^{letters}]", "0"), letters, "1" * len(letters))


def bits(seq: Column, letters: str) -> Column:
    """One bit per column, set where the text has one of ``letters``, in longs of ``CHUNK`` columns."""
    parts = F.regexp_extract_all(marked(seq, letters), F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    return F.transform(parts, lambda x: F.conv(x, 2, 10).cast("long"))


#: Letters that one long holds in five bits each.
PACKED = 12
LETTERS = "ACGTNRYSWKMBDHVU"


def packed(seq: Column, gap: str) -> Column:
    """A text of at most ``PACKED`` upper-case letters as one long, five bits a letter; ``gap`` is the digit of ``-``."""
    return F.conv(F.translate(seq, LETTERS + "-", "0123456789abcdef" + gap), 32, 10).cast("long")


def packed_similarity(a: Column, b: Column, k: int) -> Column:
    """``similarity`` of two packed texts of ``k`` letters whose gaps were given different digits."""
    x = a.bitwiseXOR(b)
    spread = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseOR(F.shiftright(x, 4))
    ones = sum(1 << (5 * i) for i in range(k))
    return k - F.bit_count(spread.bitwiseAND(F.lit(ones)))


def common_bits(a: Column, b: Column) -> Column:
    """The number of columns set in both of two bit arrays."""
    both = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def p_distance(n: Column, match: Column) -> Column:
    """Uncorrected differences per site; null if nothing was compared."""
    return F.when(n > 0, (n - match) / n)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def jukes_cantor(p: Column) -> Column:
    """Distance per 100 sites with equal rates; null where saturated."""
    return -75.0 * _log(1 - p * 4 / 3)


def kimura(ts: Column, tv: Column) -> Column:
    """Distance per 100 sites with transition share ``ts`` and transversion share ``tv``."""
    return -50.0 * _log(1 - 2 * ts - tv) - 25.0 * _log(1 - 2 * tv)


def tamura(ts: Column, tv: Column, gc_a: Column, gc_b: Column) -> Column:
    """As ``kimura``, with the GC shares of both records."""
    c = gc_a + gc_b - 2 * gc_a * gc_b
    return F.when(c > 0, 100.0 * (-c * _log(1 - ts / c - tv) - 0.5 * (1 - c) * _log(1 - 2 * tv)))


def jin_nei(ts: Column, tv: Column, shape: float = 1.0) -> Column:
    """Kimura's distance with rates that vary by a gamma law of this shape."""
    x, y = 1 - 2 * ts - tv, 1 - 2 * tv
    return F.when((x > 0) & (y > 0), 50.0 * shape * (F.pow(x, F.lit(-1 / shape)) + 0.5 * F.pow(y, F.lit(-1 / shape)) - 1.5))


def tajima_nei(p: Column, freqs: list[Column], mixed: Column) -> Column:
    """Equal-input distance per 100 sites; ``freqs`` are the base shares of the pair, ``mixed`` the sum over pairs of
    different bases of their squared share over twice the product of the base shares."""
    same = sum((f * f for f in freqs), F.lit(0.0))
    b = (1 - same + F.when(mixed > 0, p * p / mixed).otherwise(0.0)) / 2
    return F.when(p == 0, F.lit(0.0)).otherwise(F.when(b > 0, -100.0 * b * _log(1 - p / b)))
