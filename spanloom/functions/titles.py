"""Roles and named tokens of protein titles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role and token patterns in their order of precedence (case ignored).
ROLES = (
    ("rdrp", r"\b(?:rdrp|rna[- ]dependent rna polymerase|rna[- ]directed rna polymerase)\b"),
    ("nucleoprotein", r"\b(?:nucleoprotein|nucleocapsid(?: protein)?)\b"),
    ("glycoprotein", r"\b(?:glycoprotein|envelope glycoprotein|envelope protein)\b"),
    ("capsid", r"\b(?:capsid protein|capsid|coat protein)\b"),
    ("matrix", r"\bmatrix protein\b"),
    ("helicase", r"\bhelicase\b"),
    ("protease", r"\bprotease\b"),
)
FALLBACK_ROLES = (
    ("nonstructural", r"\bnon[- ]?structural protein\b"),
    ("polyprotein", r"\bpolyprotein\b"),
)
TOKEN_VP = r"\bVP[\s_-]*(\d+[A-Z]?)\b"
TOKEN_NS = r"\bNS([SM]|\d+)\b"
TOKEN_G = r"\bG([NC])\b"
TOKEN_SEGMENT = r"\b(?:([LMS])[- ]?(?:protein|segment)|segment[- ]?([LMS]))\b"
MISSING_LABELS = ("", "NA", "N/A", "NONE", "NULL", "UNKNOWN")

#: Case and word classes follow Unicode, not only ASCII.
_FLAGS = "(?iU)"


#: All space separators (Unicode category Zs).
_SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def trimmed(c: Column) -> Column:
    """Without spaces of any script at the ends."""
    return F.trim(c, F.lit(_SPACES))


def is_missing_label(c: Column) -> Column:
    return F.upper(trimmed(c)).isin(*MISSING_LABELS)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") == "")


def _hits(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(role, first matched text) of the rules that match."""
    each = [F.when(c.rlike(_FLAGS + p), F.struct(F.lit(role).alias("role"), F.lower(F.regexp_extract(c, _FLAGS + p, 0)).alias("keyword"))) for role, p in rules]
    return F.array_compact(F.array(*each))


def matched(c: Column) -> Column:
    """All functional roles that match; only if none does, the first fallback."""
    main = _hits(c, ROLES)
    return F.when(F.size(main) > 0, main).otherwise(F.slice(_hits(c, FALLBACK_ROLES), 1, 1))


def roles(c: Column) -> Column:
    return F.when(_blank(c), F.array().cast("array<string>")).otherwise(F.transform(matched(c), lambda m: m["role"]))


def keywords(c: Column) -> Column:
    return F.when(_blank(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(matched(c), lambda m: m["keyword"])))


def role(c: Column) -> Column:
    """The first role, ``unknown`` if a title has none, null without a title."""
    return F.when(~_blank(c), F.coalesce(F.try_element_at(roles(c), F.lit(1)), F.lit("unknown")))


def role_is_ambiguous(c: Column) -> Column:
    return F.size(roles(c)) > 1


def tokens(c: Column) -> Column:
    """VP, NS, G and segment tokens, in this order, each once."""
    every = lambda p, k=1: F.regexp_extract_all(c, F.lit(_FLAGS + p), F.lit(k))
    vp = F.transform(every(TOKEN_VP), lambda x: F.concat(F.lit("VP"), F.upper(x)))
    ns = F.transform(every(TOKEN_NS), lambda x: F.concat(F.lit("NS"), F.lower(x)))
    g = F.transform(every(TOKEN_G), lambda x: F.concat(F.lit("G"), F.lower(x)))
    segment = F.zip_with(every(TOKEN_SEGMENT, 1), every(TOKEN_SEGMENT, 2), lambda x, y: F.upper(F.concat(x, y)))
    return F.when(_blank(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(vp, ns, g, segment)))


def joined_tokens(c: Column) -> Column:
    return F.when(F.size(tokens(c)) > 0, F.array_join(tokens(c), "|"))


def title_labels(c: Column) -> dict[str, Column]:
    """All label columns of a title."""
    return {"viral_protein_role": role(c), "viral_protein_matched_roles": roles(c), "viral_protein_matched_keywords": keywords(c), "viral_protein_named_tokens": tokens(c), "viral_protein_role_ambiguous": role_is_ambiguous(c)}
