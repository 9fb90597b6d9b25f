"""Which extracted entities may become identities and how near their names are, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that name a participant, types that only describe one, identifiers that settle it, most words of a name, marks of quoted speech.
IDENTITY_TYPES = ("person", "device", "application", "service")
FACET_TYPES = ("environment", "version", "patch", "vendor")
SETTLING_IDENTIFIERS = ("email", "fqdn", "hostname", "serial_number", "ip_address")
MOST_NAME_WORDS = 4
QUOTES = "[\"'`‘’“”]"
#: A letter, a capital, and what stands inside identifiers but not inside words.
LETTER, CAPITAL, INSIDE = r"\p{L}", r"\p{Lu}", r"[._/\\@]|[\p{L}\p{N}_]-[\p{L}\p{N}_]"

#: Kinds of entity that are told apart by wording only, what a match must reach, how many candidates, the similarity (parts of) above which a name is near, the least characters and most words that are looked up.
CONFUSABLE_TYPES = ("application", "service")
LINK_THRESHOLDS = {"person": 0.95}
LINK_THRESHOLD = 0.9
MOST_CANDIDATES = 5
NEAR_PARTS, NEAR_OF = 3, 10
LEAST_WORD, MOST_WORDS = 3, 3


def normalised(name: Column) -> Column:
    """Lower case, single blanks, none at the ends; null stays null."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\s\p{Z}]+", " ")))


def entity_type(name: Column) -> Column:
    kind = F.lower(F.trim(name))
    return F.when(F.coalesce(kind, F.lit("")) == "", "unknown").otherwise(kind)


def compatible_kind(kind: Column) -> Column:
    """What entities of a type may be matched within: the type, or the group of confusable ones."""
    return F.when(kind.isin(*CONFUSABLE_TYPES), "/".join(CONFUSABLE_TYPES)).otherwise(kind)


def link_threshold(kind: Column) -> Column:
    out = F.lit(LINK_THRESHOLD)
    for name, least in LINK_THRESHOLDS.items():
        out = F.when(kind == name, least).otherwise(out)
    return out


def trigrams(name: Column) -> Column:
    """Distinct trigrams of the lower-cased words of letters and digits, each word with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def inner_trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(3))))


def longest_words(name: Column) -> Column:
    """The three longest distinct words of at least three characters, equal lengths in order of text; ``%`` and ``_`` part words, ``.,-`` at their ends don't count."""
    words = F.transform(F.split(F.translate(name, "%_", "  "), r"[\s\p{Z}]+"), lambda w: F.regexp_replace(w, r"^[.,-]+|[.,-]+$", ""))
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST_WORD)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, MOST_WORDS), lambda x: x["w"])


def name_shaped(name: Column) -> Column:
    """At least two characters, at most four words, no quotes, and a word with a letter and either a capital or a mark of identifiers; null isn't."""
    text = F.trim(F.regexp_replace(name, r"[\s\p{Z}]+", " "))
    words = F.split(text, " ")
    own = F.exists(words, lambda w: w.rlike(LETTER) & (w.rlike(CAPITAL) | w.rlike(INSIDE)))
    return F.coalesce((F.length(text) >= 2) & ~text.rlike(QUOTES) & (F.size(words) <= MOST_NAME_WORDS) & own, F.lit(False))


def rejection_reason(entity_type: Column, name: Column, identifiers: Column) -> Column:
    """``facet_type``, ``unsupported_type``, ``not_a_name``, or null where an identity may be made.

    ``identifiers`` has the kinds of the entity's strong identifiers; one that
    names a single machine, mailbox or asset settles it, whatever the type and
    name.  An unknown type is unsupported.
    """
    settled = F.coalesce(F.exists(identifiers, lambda k: F.coalesce(k.isin(*SETTLING_IDENTIFIERS), F.lit(False))), F.lit(False))
    return F.when(settled, None).when(entity_type.isin(*FACET_TYPES), "facet_type").when(~F.coalesce(entity_type.isin(*IDENTITY_TYPES), F.lit(False)), "unsupported_type").when(~name_shaped(name), "not_a_name")
