"""Rules for cases and where knowledge applies, as column expressions over maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.messages import let

#: Identifier shapes, and words of that shape that identify nothing.
IDENTIFIER = r"\b(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[A-Za-z]*\d[A-Za-z0-9._-]*|[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)+|[A-Z]{3,12})\b"
IDENTIFIER_STOPWORDS = ("AND", "THE", "NOT", "FOR", "ALL", "ARE", "WAS", "CAN", "HAS", "BUT", "YOU", "OUR", "WHY", "NOW", "GET", "DID", "FYI", "EOD", "ASAP")
MOST_IDENTIFIERS, MOST_TERMS, LAST_WORDS = 8, 24, 16
TERM = r"[A-Za-z0-9][A-Za-z0-9._-]{1,}"

#: Fixed values: (source, object) to the field of its state, and what (source, value) says.
STATE_FIELDS = {("zoho_desk", "tickets"): "status", ("servicenow", "incident"): "state", ("servicenow", "problem"): "state", ("servicenow", "sc_req_item"): "state", ("servicenow", "sc_task"): "state"}
RESOLVED = {"zoho_desk": ("closed", "resolved", "resolved by agent", "resolved by plugin team"), "servicenow": ("6", "7", "resolved", "closed")}
CANCELLED = {"zoho_desk": ("cancelled", "canceled"), "servicenow": ("8", "canceled", "cancelled")}
RESOLVED_STARTS = {"zoho_desk": ("resolved by", "resolved -")}

#: Names of environments and their tier.
ENVIRONMENTS = {
    "prod": "production", "production": "production", "prd": "production", "live": "production", "p": "production",
    "stage": "staging", "staging": "staging", "stg": "staging", "preprod": "staging", "pre prod": "staging", "pre production": "staging", "pre prd": "staging",
    "qa": "qa", "uat": "qa", "test": "qa", "tst": "qa", "sit": "qa", "dev": "development", "development": "development", "sandbox": "development",
}

#: Weights of matched traits, and the floors of the levels.
TRAIT_WEIGHTS = {"error_signature": 0.25, "failure_mode": 0.25, "component": 0.20, "driver_version": 0.15, "software_version": 0.15, "os_version": 0.10, "os_build": 0.10, "model": 0.10, "recent_change": 0.10}
OTHER_TRAIT, SAME_CLASS, RELATED_CLASS, OUTSIDE_CLASS = 0.05, 0.10, 0.05, 0.05
LEVEL_FLOORS = {"exact_ci": 0.95, "same_model_and_configuration": 0.90}
CONFIGURATION, COMPONENT = ("os_version", "os_build", "bios_package"), ("component", "wifi_adapter", "failing_component", "driver_version", "software_version", "policy_version")

#: The same matches: no run is given back that is followed by a character it can't hold.
_POSSESSIVE = IDENTIFIER.replace("[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]++@").replace(r"[A-Za-z]*\d", r"[A-Za-z]*+\d").replace("|[A-Za-z0-9]+(?:", "|[A-Za-z0-9]++(?:")


def identifiers(text: Column) -> Column:
    """The first eight identifier-shaped tokens in the order of the text, each once whatever its case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_POSSESSIVE), 0), lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", ""))
    good = F.filter(found, lambda t: (F.length(t) >= 3) & ~F.upper(t).isin(*IDENTIFIER_STOPWORDS) & t.rlike("[A-Za-z]"))
    none = F.array().cast("array<string>")

    def add(kept: Column, t: Column) -> Column:
        fresh = (F.size(kept["low"]) < MOST_IDENTIFIERS) & ~F.array_contains(kept["low"], F.lower(t))
        return F.when(fresh, F.struct(F.concat(kept["low"], F.array(F.lower(t))).alias("low"), F.concat(kept["own"], F.array(t)).alias("own"))).otherwise(kept)

    # One pass: in a lambda that names the list again, the whole text would be searched for each of its tokens.
    return F.aggregate(good, F.struct(none.alias("low"), none.alias("own")), add, lambda kept: kept["own"])


def lexical_terms(symptom: Column, entities: Column) -> Column:
    """Identifiers, entities, the last words of the symptom, then all other tokens in order; 24 at most."""
    blob = F.concat_ws(" ", symptom, F.array_join(entities, " "))
    words = F.regexp_extract_all(symptom, F.lit("[A-Za-z]{4,}"), 0)
    last = F.slice(words, F.greatest(F.size(words) - LAST_WORDS + 1, F.lit(1)), LAST_WORDS)
    terms = F.concat(identifiers(blob), F.transform(entities, lambda e: F.trim(e)), last, F.regexp_extract_all(blob, F.lit(TERM), 0))
    return F.slice(F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: t != "")), 1, MOST_TERMS)


def case_state(source: Column, kind: Column, fields: Column) -> Column:
    """resolved, cancelled or null: what the source's own field says; ``fields`` is a map."""
    source, kind = F.lower(F.trim(source)), F.lower(F.trim(kind))
    field = F.lit(None).cast("string")
    for (s, k), name in STATE_FIELDS.items():
        field = F.when((source == s) & (kind == k), F.lit(name)).otherwise(field)
    value = F.lower(F.trim(F.when(field.isNotNull(), F.try_element_at(fields, field))))
    out = F.lit(None).cast("string")
    for s, starts in RESOLVED_STARTS.items():
        for x in starts:
            out = F.when((source == s) & value.startswith(x), "resolved").otherwise(out)
    for label, table in (("cancelled", CANCELLED), ("resolved", RESOLVED)):
        for s, values in table.items():
            out = F.when((source == s) & value.isin(*values), label).otherwise(out)
    return F.when(value != "", out)


def environment_tier(label: Column) -> Column:
    """The tier a label names: a negation names none, instance numbers don't count, the longest name in it wins."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", " "))
    bare = F.trim(F.regexp_replace(key, r"\b([a-z]+)\d+\b", "$1"))
    out = F.lit(None).cast("string")
    for name in sorted(ENVIRONMENTS, key=len):  # the longest last, so it goes first
        out = F.when(F.concat(F.lit(" "), bare, F.lit(" ")).contains(f" {name} "), ENVIRONMENTS[name]).otherwise(out)
    return F.when((key != "") & ~key.rlike(r"\bnon\s?(?:prod|production|prd|live)\b"), out)


def values_match(expected: Column, actual: Column) -> Column:
    """Equal, or one holds the other."""
    e = F.lower(F.trim(expected))
    return (e != "") & ((e == actual) | actual.contains(e) | e.contains(actual))


def trigger_verdict(requires: Column, loose: Column, excludes: Column, env: Column, haystack: Column, expired: Column, conflicts: Column) -> Column:
    """struct<level, matched, missing, evaluated, drop, reason> of a playbook's conditions for a case.

    ``requires`` and ``excludes`` are maps of an axis to a value, ``loose`` is
    an array of factors, ``env`` the case's axes, lower-case.  An axis the
    case doesn't state is missing; one it states otherwise contradicts.
    """
    at = lambda m, k: F.nullif(F.try_element_at(m, F.lower(F.trim(k))), F.lit(""))
    hit = F.exists(F.map_entries(excludes), lambda e: F.coalesce(values_match(e["value"], at(env, e["key"])), F.lit(False)))
    keyed = F.transform(F.map_entries(requires), lambda e: let(at(env, e["key"]), lambda a: F.when(a.isNull(), "missing").when(values_match(e["value"], a), "matched").otherwise("other")))
    tokens = lambda f: F.filter(F.regexp_extract_all(f, F.lit(TERM), 0), lambda t: F.length(t) >= 4)
    judged = F.transform(F.filter(loose, lambda f: F.size(tokens(f)) > 0), lambda f: F.when(F.exists(tokens(f), lambda t: F.lower(haystack).contains(F.lower(t))), "matched").otherwise("missing"))

    def decide(states: Column) -> Column:
        count = lambda s: F.size(F.filter(states, lambda x: x == s))
        why = F.when(expired, "expired").when(hit, "environment_excluded").when(F.array_contains(states, "other"), "environment_mismatch")
        return let(F.struct(count("matched").alias("matched"), count("missing").alias("missing"), F.size(states).alias("evaluated"), why.alias("reason")), rank)

    def rank(n: Column) -> Column:
        matched, missing, evaluated, reason = n["matched"], n["missing"], n["evaluated"], n["reason"]
        level = F.when(reason.isNotNull(), "contradicted").when(evaluated == 0, "unvalidated").when((missing == 0) & (evaluated >= 2), F.when(conflicts, "strong").otherwise("exact")).when(missing == 0, "strong")
        level = level.when((matched / evaluated >= 0.7) & (matched >= 2), "strong").when(matched > 0, "partial").otherwise("unvalidated")
        return F.struct(level.alias("level"), matched.alias("matched"), missing.alias("missing"), evaluated.alias("evaluated"), reason.isNotNull().alias("drop"), reason.alias("reason"))

    return let(F.concat(keyed, judged), decide)


def fix_verdict(required: Column, excluded: Column, traits: Column, exact: Column, rule_class: Column, target_class: Column, chain: Column) -> Column:
    """struct<level, score, rejected> of a fix rule for a target; ``chain`` is the target's class and those above it."""
    norm = lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))
    same = lambda e: F.coalesce(norm(e["value"]) == norm(F.try_element_at(traits, e["key"])), F.lit(False))
    rejected = F.when(F.exists(F.map_entries(excluded), same), "excluded_trait").when(~F.forall(F.map_entries(required), same), "required_trait_not_validated")
    keys = F.map_keys(required)
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    same_class, related = F.coalesce(rule_class == target_class, F.lit(False)), F.coalesce(F.array_contains(chain, rule_class), F.lit(False))
    level = F.when(exact, "exact_ci").when(has(("model",)) & has(CONFIGURATION), "same_model_and_configuration").when(has(COMPONENT) & (same_class | related | rule_class.isNull()), "same_component_or_version")
    level = level.when(has(COMPONENT), "cross_class_capability").when(same_class, "same_ci_class").when(related, "related_ci_class").otherwise("semantic_only")
    weights = F.create_map(*[F.lit(x) for pair in TRAIT_WEIGHTS.items() for x in pair])
    score = F.aggregate(keys, F.lit(0.0), lambda n, k: n + F.coalesce(F.try_element_at(weights, k), F.lit(OTHER_TRAIT))) + F.when(same_class, SAME_CLASS).when(related, RELATED_CLASS).otherwise(0.0) - F.when(level == "cross_class_capability", OUTSIDE_CLASS).otherwise(0.0)
    floor = F.when(level == "exact_ci", LEVEL_FLOORS["exact_ci"]).when(level == "same_model_and_configuration", LEVEL_FLOORS["same_model_and_configuration"]).otherwise(0.0)
    return F.struct(level.alias("level"), F.round(F.least(F.greatest(score, floor, F.lit(0.0)), F.lit(1.0)), 2).alias("score"), rejected.alias("rejected"))

