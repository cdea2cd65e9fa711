"""Scalar functions of the ingest recipes, as columns. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies whose ids are no diseases of the graph.
IGNORED_VOCABULARIES = ("MEDGEN", "SNOMED", "BFO", "ICD", "NCI")
#: Substrings of an id and the prefix it gets, in the order of the rules. A bare DO is no rule, as it would take MONDO for DOID.
DISEASE_RULES = (("OMIM", "OMIM"), ("ORPH|ORDO", "ORPHA"), ("MONDO", "MONDO"), ("DOID", "DOID"), ("HP", "HP"), ("EFO", "EFO"), ("UMLS|CUI", "UMLS"), ("MESH|MSH", "MESH"))
#: Forms of ids without a prefix, and the prefix they get, in the order of the rules.
NAKED_RULES = (("^C.{7}$", "UMLS"), ("^[A-Z][0-9]+$", "MESH"), ("^[0-9]+$", "MEDDRA"))
#: Evidence codes from the weakest to the strongest.
EVIDENCE_RANK = {"IEA": 1, "TAS": 2, "PCS": 3}
#: Association kinds and their tiers, in the order of the rules; others are tier 5.
TIERS = (
    ("Disease-causing germline mutation(s) in", 1),
    ("Disease-causing somatic mutation(s) in", 1),
    ("Modifying germline mutation in", 2),
    ("Major susceptibility factor in", 2),
    ("Role in the phenotype of", 3),
    ("Part of a fusion gene in", 3),
    ("Candidate gene tested in", 4),
)


def _code(c: Column) -> Column:
    """The last part after ':', then after '_', up to a space."""
    return F.split_part(F.split_part(F.split_part(c, F.lit(":"), F.lit(-1)), F.lit("_"), F.lit(-1)), F.lit(" "), F.lit(1))


def disease_id(c: Column) -> Column:
    """PREFIX:code of a disease id in any vocabulary's spelling.

    Null for ids of one character or none, for ignored vocabularies and for
    what no rule knows. Ids without a prefix are told by their form.
    """
    s = F.trim(c)
    up = F.upper(s)
    nothing = F.lit(None).cast("string")
    out = F.when(F.length(s) <= 1, nothing).when(up.rlike("|".join(IGNORED_VOCABULARIES)), nothing)
    for marks, prefix in (*DISEASE_RULES, *NAKED_RULES):
        out = out.when(up.rlike(marks), F.concat(F.lit(prefix + ":"), _code(s)))
    return out


def curie(c: Column) -> Column:
    """The first underscore as a colon; Orphanet_ as ORPHA:."""
    return F.when(c.startswith("Orphanet_"), F.concat(F.lit("ORPHA:"), F.substring(c, 10, 1000))).otherwise(F.regexp_replace(c, "^([^_]*)_", "$1:"))


def last_token(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -1)


def symbol_of(c: Column) -> Column:
    """SYMBOL of ``SYMBOL (ENTREZ)``."""
    return F.split_part(c, F.lit(" "), F.lit(1))


def list_items(c: Column, separator: str = "|") -> Column:
    """The trimmed, non-empty items of a delimited list; an empty array for null."""
    return F.coalesce(F.filter(F.transform(F.split(c, rf"\Q{separator}\E"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def list_length(c: Column, separator: str = "|") -> Column:
    return F.size(list_items(c, separator))


def action_pieces(c: Column) -> Column:
    """Structs (degree, kind) of ``degree^kind|degree^kind``; pieces without '^' are left out."""
    pieces = F.filter(list_items(c), lambda x: x.contains("^"))
    return F.transform(pieces, lambda x: F.struct(F.split_part(x, F.lit("^"), F.lit(1)).alias("degree"), F.split_part(x, F.lit("^"), F.lit(2)).alias("kind")))


def evidence_rank(c: Column) -> Column:
    """The rank of an evidence code, 0 for others and null."""
    m = F.create_map(*[F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.lit(0))


def tier(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for mark, t in TIERS:
        out = out.when(c.contains(mark), F.lit(t))
    return out.otherwise(F.lit(5))


def bucket(c: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value, the last bin closed on the right; null outside and for null."""
    out = F.when(c.isNull() | (c < edges[0]) | (c > edges[-1]), F.lit(None).cast("int"))
    for i, top in enumerate(edges[1:-1]):
        out = out.when(c < top, F.lit(i))
    return out.otherwise(F.lit(len(edges) - 2))


def clamped(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def grouped_number(c: Column) -> Column:
    """With thousands separators; '~' for null."""
    return F.coalesce(F.format_number(c, 0), F.lit("~"))


def number_or_null(c: Column) -> Column:
    """A finite double, or null for what is none."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def category_order(c: Column, order: list[str]) -> Column:
    """The place of a category in a stated order, from 1; others, and null, come behind all."""
    place = F.array_position(F.array(*map(F.lit, order)), c)
    return F.coalesce(F.when(place > 0, place), F.lit(len(order) + 1)).cast("int")


def pair_key(a: Column, b: Column, n: Column | int) -> Column:
    """One integer for a pair of numbers under n; n squared must be a long."""
    return a.cast("bigint") * n + b.cast("bigint")


def pair_of(key: Column, n: Column | int) -> tuple[Column, Column]:
    """The two numbers of ``pair_key``."""
    return ((key - F.pmod(key, F.lit(n) if isinstance(n, int) else n)) / n).cast("bigint"), F.pmod(key, F.lit(n) if isinstance(n, int) else n)
