"""Gene names of T-cell-receptor rearrangements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TRBV families of one gene, which some exports write with "-1".
SINGLETON_FAMILIES = ["TRBV1", "TRBV2", "TRBV9", "TRBV13", "TRBV14", "TRBV15", "TRBV16", "TRBV17", "TRBV18", "TRBV19", "TRBV26", "TRBV27", "TRBV28", "TRBV30"]
# V genes that the primers cannot tell apart, alleles without annotation, genes without reference data.
INDISTINGUISHABLE = {"TRBV12-4": "TRBV12-3", "TRBV6-3": "TRBV6-2"}
ALLELE_FIXES = {"TRBV6-2*02": "TRBV6-2*01"}
DROPPED_GENES = ["TRBV25/OR9-2*01"]


# Expressions name their argument once: composed chains would grow with every further mention.


def adaptive_to_airr(g: Column) -> Column:
    """TCRBV07-02 -> TRBV7-2; of an ambiguous a/b the first; an orphon's /OR9-2 stays."""
    first = F.regexp_replace(F.trim(g), r"^(?!(?i:.*/OR\d))([^/]*)/.*$", "$1")
    return F.regexp_replace(F.regexp_replace(first, r"(?i)^TCRB([VDJ])", "TRB$1"), r"([^0-9])0+([0-9])", "$1$2")


def strip_allele(g: Column) -> Column:
    return F.substring_index(g, "*", 1)


def collapse_singleton(g: Column) -> Column:
    """TRBV13-1 -> TRBV13 for families of one gene."""
    return F.regexp_replace(g, f"^({'|'.join(SINGLETON_FAMILIES)})-1$", "$1")


def canonical_gene(g: Column) -> Column:
    return collapse_singleton(strip_allele(g))


def harmonize_orphon(g: Column) -> Column:
    return F.regexp_replace(g, r"(?i)-or9[_-]2$", "/OR9-2")


def collapse_indistinguishable(g: Column) -> Column:
    for old, new in INDISTINGUISHABLE.items():
        g = F.regexp_replace(g, f"^{old}$", new)
    return g


def v_gene(g: Column) -> Column:
    """The whole chain for a V call; the order matters."""
    return collapse_singleton(collapse_indistinguishable(strip_allele(adaptive_to_airr(harmonize_orphon(g)))))


def j_gene(g: Column) -> Column:
    return strip_allele(adaptive_to_airr(g))


def first_allele(g: Column, canonical: bool = False) -> Column:
    """First of a comma list, with *01 where no allele is named; empty is null."""
    one = F.trim(F.split_part(g, F.lit(","), F.lit(1)))
    one = canonical_gene(one) if canonical else one
    return F.when(one != "", F.when(one.contains("*"), one).otherwise(F.concat(one, F.lit("*01"))))


def is_gene_level_v(g: Column) -> Column:
    return F.coalesce(g.contains("-") | g.isin(SINGLETON_FAMILIES), F.lit(False))


def is_gene_level_j(g: Column) -> Column:
    return F.coalesce(g.contains("-"), F.lit(False))


def is_unresolved(g: Column) -> Column:
    return F.coalesce(F.lower(F.trim(g)) == "unresolved", F.lit(False))


def rename_indistinguishable(g: Column) -> Column:
    """Any allele of an indistinguishable gene -> the kept gene's *01; then exact allele fixes."""
    for old, new in INDISTINGUISHABLE.items():
        g = F.regexp_replace(g, rf"^{old}\*.*$", new + "*01")
    return g


def fix_alleles(g: Column) -> Column:
    for old, new in ALLELE_FIXES.items():
        g = F.regexp_replace(g, "^" + old.replace("*", r"\*") + "$", new)
    return g


def resolved_allele(resolved: Column, allele: Column) -> tuple[Column, Column]:
    """(two-digit allele, whether it was imputed): from the resolved name's suffix, else its own column, else 01."""
    suffix = F.nullif(F.regexp_extract(resolved, r"\*(\d+)$", 1), F.lit(""))
    own = F.nullif(F.regexp_extract(allele, r"^(\d+)$", 1), F.lit(""))
    found = F.coalesce(suffix, own)
    return F.lpad(F.coalesce(found, F.lit("01")), 2, "0"), found.isNull()


def sample_key(path: Column) -> tuple[Column, Column]:
    """(participant, specimen) of a file name: what stands before and after the last underscore."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.tsv(\.gz|\.bz2)?$", "")
    return F.regexp_extract(stem, r"^(.*)_[^_]*$", 1), F.regexp_extract(stem, r"([^_]*)$", 1)


def padded_participant(p: Column, digits: int = 3) -> Column:
    """Study-9 -> Study-009."""
    head, tail = F.regexp_extract(p, r"^(.*-)(\d+)$", 1), F.regexp_extract(p, r"^(.*-)(\d+)$", 2)
    return F.when(tail != "", F.concat(head, F.lpad(tail, digits, "0"))).otherwise(p)
