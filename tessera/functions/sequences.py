"""Amino-acid and nucleotide sequences as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
STANDARD = f"^[{RESIDUES}]+$"

# Atchley factors of the residues.
ATCHLEY = {
    "A": [-0.591, -1.302, -0.733, 1.570, -0.146],
    "C": [-1.343, 0.465, -0.862, -1.020, -0.255],
    "D": [1.050, 0.302, -3.656, -0.259, -3.242],
    "E": [1.357, -1.453, 1.477, 0.113, -0.837],
    "F": [-1.006, -0.590, 1.891, -0.397, 0.412],
    "G": [-0.384, 1.652, 1.330, 1.045, 2.064],
    "H": [0.336, -0.417, -1.673, -1.474, -0.078],
    "I": [-1.239, -0.547, 2.131, 0.393, 0.816],
    "K": [1.831, -0.561, 0.533, -0.277, 1.648],
    "L": [-1.019, -0.987, -1.505, 1.266, -0.912],
    "M": [-0.663, -1.524, 2.219, -1.005, 1.212],
    "N": [0.945, 0.828, 1.299, -0.169, 0.933],
    "P": [0.189, 2.081, -1.628, 0.421, -1.392],
    "Q": [0.931, -0.179, -3.005, -0.503, -1.853],
    "R": [1.538, -0.055, 1.502, 0.440, 2.897],
    "S": [-0.228, 1.399, -4.760, 0.670, -0.033],
    "T": [-0.032, 0.326, 2.213, 0.908, 1.313],
    "V": [-1.337, -0.279, -0.544, 1.242, -1.262],
    "W": [-0.595, 0.009, 0.672, -2.128, -0.184],
    "Y": [0.260, 0.830, 3.097, -0.838, 1.512],
}
# BLOSUM62, lower triangle.
_BLOSUM62 = """
A 4
R -1 5
N -2 0 6
D -2 -2 1 6
C 0 -3 -3 -3 9
Q -1 1 0 0 -3 5
E -1 0 0 2 -4 2 5
G 0 -2 0 -1 -3 -2 -2 6
H -2 0 1 -1 -3 0 0 -2 8
I -1 -3 -3 -3 -1 -3 -3 -4 -3 4
L -1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
K -1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
M -1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
F -2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
S 1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
T 0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
V 0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
_ROWS = [line.split() for line in _BLOSUM62.split("\n") if line]
#: 'AB' -> score, both ways round.
BLOSUM62 = {k: float(v) for i, row in enumerate(_ROWS) for j, v in enumerate(row[1:]) for k in (row[0] + _ROWS[j][0], _ROWS[j][0] + row[0])}


def isometric_codes(scores: dict[str, float] = BLOSUM62, cap: float = 4.0, size: int = 16) -> dict[str, list[float]]:
    """A vector of ``size`` numbers for each residue, squared distances as close to ``cap`` minus the capped score as such
    vectors allow: the leading eigenvectors of the centred score matrix, to six places, each axis's largest entry positive."""
    names = sorted({k[0] for k in scores})
    apart = np.array([[cap - min(scores[a + b], cap) for b in names] for a in names])
    centre = np.eye(len(names)) - 1 / len(names)
    values, axes = np.linalg.eigh(-centre @ apart @ centre / 2)
    axes = axes[:, ::-1][:, :size] * np.sqrt(np.maximum(values[::-1][:size], 0))
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    return {a: [round(float(x), 6) for x in row] for a, row in zip(names, axes, strict=True)}


#: Standard genetic code, by rule: codons in TCAG order.
CODONS = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True))


def _map(pairs: dict, value=F.lit) -> Column:
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), value(v))))


def letters(s: Column) -> Column:
    """The characters of a string as an array."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def clean_aa(c: Column) -> Column:
    """Without spaces, upper case; '' and 'NAN' become null."""
    c = F.upper(F.translate(c, " ", ""))
    return F.when((c != "") & (c != "NAN"), c)


def trim_cdr3(s: Column) -> Column:
    """Without the first and last residue, if longer than two."""
    return F.when(F.length(s) > 2, s.substr(F.lit(2), F.length(s) - 2)).otherwise(s)


def trim_ground_truth(s: Column) -> Column:
    """Without a leading C and a trailing F."""
    return F.regexp_replace(F.regexp_replace(s, "^C", ""), "F$", "")


def is_standard(s: Column) -> Column:
    return F.coalesce(s.rlike(STANDARD), F.lit(False))


def translate_nt(s: Column) -> Column:
    """Codon by codon; an unknown or cut codon is X."""
    code = _map(CODONS)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s), F.lit(3))).otherwise(F.array().cast("array<int>"))
    out = F.array_join(F.transform(starts, lambda i: F.coalesce(F.try_element_at(code, s.substr(i, F.lit(3))), F.lit("X"))), "")
    return F.when(s.isNotNull(), out)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def windows(s: Column, k: int) -> Column:
    """All substrings of length k."""
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: s.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def gapped_kmers(s: Column, k: int = 4) -> Column:
    """All k-mers, each with its k variants of one '_' in place of a residue."""
    blank = [lambda w, j=j: F.concat(w.substr(F.lit(1), F.lit(j)), F.lit("_"), w.substr(F.lit(j + 2), F.lit(k - j - 1))) for j in range(k)]
    return F.flatten(F.transform(windows(s, k), lambda w: F.array(w, *(b(w) for b in blank))))


def atchley(fourmer: Column) -> Column:
    """20 numbers; null where a residue is unknown."""
    table = _map(ATCHLEY, lambda v: F.array(*map(F.lit, v)))
    rows = F.transform(letters(fourmer), lambda c: F.try_element_at(table, c))
    return F.when(~F.exists(rows, lambda r: r.isNull()), F.flatten(rows))


def core(s: Column, head: int = 3, tail: int = 3) -> Column:
    """Without ``head`` and ``tail`` residues; '' if nothing is left."""
    n = F.length(s) - head - tail
    return F.when(n > 0, s.substr(F.lit(head + 1), n)).otherwise(F.lit(""))


def phase_code(s: Column, codes: dict[str, list[float]], phases: int = 6) -> Column:
    """Isometric code: residue vectors summed by their distance from the end modulo ``phases``; phases x size numbers.

    Distances between codes equal those of the rotated-block form, as block order does not matter to L2.
    """
    size = len(next(iter(codes.values())))
    table = _map(codes, lambda v: F.array(*map(F.lit, map(float, v))))
    zero = F.array_repeat(F.lit(0.0), size)
    placed = F.transform(letters(s), lambda c, i: F.struct(F.try_element_at(table, c).alias("v"), ((F.length(s) - i) % phases).alias("p")))

    def block(p: int) -> Column:
        return F.aggregate(F.filter(placed, lambda x: (x["p"] == p) & x["v"].isNotNull()), zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b))

    return F.concat(*(block(p) for p in range(phases)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def pair_scores(a: Column, b: Column, scores: dict[str, float], cap: float = 4.0, gap: float = -6.0) -> Column:
    """Sum of capped residue-pair scores of two equally long strings; ``scores``: 'AB' -> score, '-' or unknown is a gap."""
    table = _map({k: float(min(v, cap)) for k, v in scores.items()})
    each = F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce(F.try_element_at(table, F.concat(x, y)), F.try_element_at(table, F.concat(y, x)), F.lit(float(gap))))
    return F.when(F.length(a) == F.length(b), F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x))


def one_gap_score(a: Column, b: Column, scores: dict[str, float], cap: float = 4.0, gap: float = -6.0) -> Column:
    """Per-residue score with the best place of one gap when lengths differ by one; -1 when they differ by more."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    places = F.sequence(F.lit(0), F.length(short))
    best = F.array_max(F.transform(places, lambda i: pair_scores(F.concat(short.substr(F.lit(1), i), F.lit("-"), short.substr(i + 1, F.length(short) - i)), long, scores, cap, gap)))
    even = pair_scores(a, b, scores, cap, gap)
    return F.when(F.length(a) == F.length(b), even / F.length(a)).when(F.length(long) - F.length(short) == 1, best / F.length(long)).otherwise(F.lit(-1.0))


def integer_code(s: Column, size: int) -> Column:
    """Residues numbered from 1 (unknown 0), cut or padded with 0 to ``size``."""
    table = _map({c: i for i, c in enumerate(RESIDUES, 1)})
    own = F.transform(letters(F.coalesce(s, F.lit(""))), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))
    return F.slice(F.concat(own, F.array_repeat(F.lit(0), size)), 1, size)


def count_scaling(c: Column, mode: str = "log") -> Column:
    return F.ln(F.greatest(c, F.lit(1))) if mode == "log" else F.greatest(c, F.lit(0))


def substitutions(s: Column) -> Column:
    """All single-residue variants as structs (pos from 0, ref, alt, variant), the residue itself included."""
    one = lambda i, a: F.struct((i - 1).alias("pos"), s.substr(i, F.lit(1)).alias("ref"), a.alias("alt"), F.concat(s.substr(F.lit(1), i - 1), a, s.substr(i + 1, F.length(s))).alias("variant"))
    every = F.array(*map(F.lit, RESIDUES))
    return F.when(F.length(s) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.transform(every, lambda a: one(i, a)))))


def standardized_code(s: Column, properties: dict[str, list[float]], size: int) -> Column:
    """Per position the residue's properties standardized over residues, and a gap flag; padded with gaps to ``size``."""
    width = len(next(iter(properties.values())))
    means = [sum(v[j] for v in properties.values()) / len(properties) for j in range(width)]
    stds = [(sum((v[j] - means[j]) ** 2 for v in properties.values()) / len(properties)) ** 0.5 or 1.0 for j in range(width)]
    table = {c: [*((v[j] - means[j]) / stds[j] for j in range(width)), 0.0] for c, v in properties.items()}
    gap = F.array(*map(F.lit, [*([0.0] * width), 1.0]))
    known = _map(table, lambda v: F.array(*map(F.lit, v)))
    own = F.transform(letters(F.rpad(s, size, "-")), lambda c: F.coalesce(F.try_element_at(known, c), gap))
    return F.flatten(own)


def md5_order(seed, *keys: Column) -> Column:
    """A random order that any SQL engine can reproduce."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(k.cast("string") for k in keys)))
