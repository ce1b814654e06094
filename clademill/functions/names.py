"""Record names ``taxon|contig[_allele_0|_allele_1]``: canonical spelling and parts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters, as the inside of a character class.
WHITE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Names that are canonical already; most are, and skip the general path.
PLAIN = r"^(?!_r_)[a-z0-9_.]+\|(?!_r_)[a-z0-9_.:-]+\z"


def canonical_taxon(name: Column) -> Column:
    """The part before the bar: lower case, no leading ``_r_``, trimmed, ``_`` for inner white space."""
    part = F.regexp_extract(F.lower(name), rf"^[{WHITE}]*(?:_r_[{WHITE}]*)*([^|]*?)[{WHITE}]*(?:\||\z)", 1)
    return F.regexp_replace(part, f"[{WHITE}]+", "_")


def canonical_contig(name: Column) -> Column:
    """The first token after the bar: lower case, no leading ``_r_``."""
    return F.regexp_extract(F.lower(name), rf"\|[{WHITE}]*(?:_r_[{WHITE}]*)*([^|{WHITE}]+)", 1)


def canonical_name(name: Column) -> Column:
    """The canonical spelling of a record name.

    Null for null, for a text without bar and where the taxon or the contig is empty.
    """
    taxon, contig = canonical_taxon(name), canonical_contig(name)
    full = F.when((taxon != "") & (contig != ""), F.concat_ws("|", taxon, contig))
    return F.when(name.rlike(PLAIN), name).otherwise(full)


def name_of(taxon: Column, contig: Column) -> Column:
    """The canonical name of a record whose taxon and contig lie in two columns; null if either is null."""
    return canonical_name(F.concat(taxon, F.lit("|"), contig))


def taxon_of(name: Column) -> Column:
    """The taxon of a canonical name."""
    return F.split_part(name, F.lit("|"), F.lit(1))


def contig_of(name: Column) -> Column:
    """The contig of a canonical name, with its allele ending."""
    return F.split_part(name, F.lit("|"), F.lit(2))


def allele_of(name: Column) -> Column:
    """0 or 1 for names ending in ``_allele_0`` or ``_allele_1``, else null."""
    return F.when(name.rlike(r"_allele_[01]\z"), F.right(name, F.lit(1)).cast("int"))


def without_allele(name: Column) -> Column:
    """The name without its allele ending."""
    return F.regexp_replace(name, r"_allele_[01]\z", "")


def short_label(name: Column) -> Column:
    """Report spelling: ``allele`` becomes ``a`` and the prefix ``contig_`` goes."""
    return F.replace(F.replace(name, F.lit("allele"), F.lit("a")), F.lit("contig_"), F.lit(""))


def first_token(text: Column) -> Column:
    """Everything before the first white space of a header line."""
    return F.regexp_extract(text, rf"^[{WHITE}]*([^{WHITE}]*)", 1)
