"""Text rules as column expressions: redaction, error lines, tokens, similarity, outcome and noise."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of secrets and personal data in the order they are replaced; Java regular expressions.
REDACTION_RULES = (
    ("API_TOKEN", r"\b(gh[pousr]_[A-Za-z0-9]{16,255}|xox[baprs]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9_\-]{16,}|glpat-[A-Za-z0-9_\-]{16,}|AIza[A-Za-z0-9_\-]{20,}|ya29\.[A-Za-z0-9_\-]{20,})\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b"),
    ("BEARER_TOKEN", r"(?i)\b(?:bearer|authorization:\s*bearer)\s+[A-Za-z0-9._\-+/=]{12,}"),
    ("SECRET_ASSIGNMENT", r"""(?i)\b(password|passwd|pwd|secret|api[_\-]?key|access[_\-]?token|auth[_\-]?token|client[_\-]?secret|private[_\-]?key)\s*[:=]\s*["']?([^\s"'&;,)]{4,})["']?"""),
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("PHONE", r"(?<!\w)(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\w)"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ \-]?){13,19}\b"),
    ("AWS_ACCESS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("AWS_SECRET_KEY", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"),
    ("PRIVATE_KEY", r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)

#: What varies between two occurrences of one error, in the order it is replaced.
ERROR_NORMALIZERS = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<id>"),
    (r"\b0x[0-9a-fA-F]{4,16}\b", "<hex>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,6})?\b", "<time>"),
    (r"\b(?:UTC|GMT|IST|EST|EDT|PST|PDT|CET|CEST)(?:[+-]\d{1,2}(?::\d{2})?)?\b", "<tz>"),
    (r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+", "<path>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<host>"),
    (r"\[REDACTED:[A-Z_]+\]", "<redacted>"),
    (r"""'[^']{1,120}'|"[^"]{1,120}\"""", "<str>"),
    (r"\b\d{3,}\b", "<n>"),
)
#: Words without meaning for an error's identity.
ERROR_STOPWORDS = ("the", "a", "an", "at", "in", "on", "of", "for", "to", "from", "with", "and", "or", "is", "was", "were", "has", "have", "had", "this", "that", "it", "its", "while", "when", "after", "before", "during")

#: Phrases of outcome notes in the order they are tried.
OUTCOME_RULES = (
    ("failure", r"\bunresolved\b"),
    ("failure", r"\bnot\s+resolved\b"),
    ("failure", r"\bun-?fixed\b"),
    ("failure", r"\bstill\s+(failing|broken|occurring|happening)\b"),
    ("failure", r"\b(did\s*not|didn'?t|does\s*not|doesn'?t)\s+(work|help|resolve)"),
    ("failure", r"\bno\s+resolution\b"),
    ("failure", r"\bfailed\b"),
    ("failure", r"\bescalat(ed|ion)\b"),
    ("failure", r"\b(under|ongoing|pending|further)\s+(\w+\s+)?investigation\b"),
    ("failure", r"\binvestigation\s+(ongoing|continues|requested|pending)\b"),
    ("failure", r"\bstill\s+(open|pending)\b"),
    ("failure", r"\bre-?opened\b"),
    ("unknown", r"\b(lack|absence)\s+of\s+(client|customer|user)\s+response\b"),
    ("unknown", r"\bno\s+(client|customer|user)\s+response\b"),
    ("unknown", r"\b(withdrawn|cancelled|canceled|duplicate)\b"),
    ("unknown", r"\bclosed\s+(without|due\s+to)\b"),
    ("unknown", r"\bno\s+(action|further\s+action)\s+(required|taken)\b"),
    ("unknown", r"\binformation\s+(provided|shared)\b"),
    ("partial", r"\bwork[\s-]?around\b"),
    ("partial", r"\btemporar(y|ily)\b"),
    ("partial", r"\bmitigat(ed|ion)\b"),
    ("partial", r"\bpartial(ly)?\b"),
    ("partial", r"\binterim\s+(fix|solution)\b"),
    ("success", r"\bresolved\b"),
    ("success", r"\bfixed\b"),
    ("success", r"\b(renewed|renewal\s+(\w+\s+)?(approved|completed))\b"),
    ("success", r"\b(enabled|unlocked|restored|reinstated|activated|reactivated)\b"),
    ("success", r"\bsuccessfully\b"),
    ("success", r"\b(completed|succeeded)\b"),
    ("success", r"\b(granted|provisioned|installed|configured|reconfigured)\b"),
    ("success", r"\b(reinstalled|upgraded|patched|replaced|migrated)\b"),
    ("success", r"\b(driver|link|licen[sc]e|plugin|access|credentials?)\b[^.]*\b(provided|shared|assigned|delivered|issued)\b"),
    ("success", r"\bissue\s+(is\s+)?(gone|cleared)\b"),
    ("success", r"\bworking\s+(now|as\s+expected)\b"),
    ("success", r"\bsolution\s+provided\b"),
    ("unknown", r"\b(ticket\s+)?closed\b"),
)
#: The rules that follow each other with one outcome, as one expression: a match of any is a match of the first.
OUTCOME_GROUPS = tuple((label, "|".join(rule for _, rule in rules)) for label, rules in groupby(OUTCOME_RULES, key=lambda r: r[0]))

#: Phrases of delivery failures; two make one.
BOUNCE_PHRASES = (
    r"could\s?n[o']t deliver the message",
    r"(was not|could not be|couldn.t be) delivered",
    r"delivery (has failed|to these recipients)",
    r"\bundeliverable\b",
    r"delivery status notification",
    r"non-?delivery report",
    r"recipient address rejected|user unknown|unknown to address",
    r"rejected (the|your) email|access denied policy|mail server .* rejected",
    r"\bhow to fix it\b",
    r"automatic reply|out of (the )?office",
)

#: Cues that turn a clause into its opposite, and what ends the first clause.
NEGATION_CUES = ("do not", "don't", "does not", "doesn't", "never", "must not", "mustn't", "should not", "shouldn't", "cannot", "can't", "avoid", "refrain from", "is not permitted", "are not permitted", "not allowed", "not supported", "not recommended", "we do not suggest", "do not suggest")
CLAUSE_BREAKS = ("but", "however", "although", "whereas", "otherwise", "unless")

#: Fixed value: shorter lines tell no error.
LEAST_ERROR_LINE = 12
EXCEPTION = r"\b([A-Z][A-Za-z0-9]{2,60}(?:Exception|Error|Fault))\b"
VENDOR_CODE = r"\b(ORA-\d{3,6}|SQLSTATE\s*\[?\w{5}\]?|0x[0-9A-Fa-f]{4,16}|errno\s*[=:]?\s*\d{1,5})\b"
HTTP_5XX = r"(?i)\b(?:HTTP|status(?:\s+code)?)[\s:]*([5]\d\d)\b"
LOG_LEVEL = r"(?:^|[\s\[])(?:ERROR|FATAL|SEVERE)(?:[\]\s:]|$)"


def ascii_classes(rule: str) -> str:
    """A rule whose word bounds and blanks are those of ASCII, as in the SQL engine; Java's ``\\b`` takes accented letters for word characters and its ``\\s`` has the vertical tab."""
    return rule.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))").replace(r"\s", r"[\t\n\f\r ]")


#: What a text holds if a rule applies to it: one of these, in lower case where the rule takes either; a rule that isn't here is tried on every text.
_HELD = {
    "API_TOKEN": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "glpat-", "AIza", "ya29."),
    "JWT": ("eyJ",),
    "BEARER_TOKEN": ("bearer",),
    "SECRET_ASSIGNMENT": ("passw", "pwd", "secret", "key", "token"),
    "EMAIL": ("@",),
    "AWS_ACCESS_KEY": ("AKIA", "ASIA"),
    "PRIVATE_KEY": ("-----BEGIN ",),
}
_DIGITS = ("PHONE", "SSN", "CREDIT_CARD")
#: The same matches as the rule: a run of name characters is tried once, from its start or from where the last match ends.
_FASTER = {"EMAIL": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"}


def redaction_step(text: Column, kind: str, rule: str) -> tuple[Column, Column]:
    """What one rule leaves of a text, and how often it applies; texts that it can't apply to pass untouched."""
    rule = _FASTER.get(kind, rule)
    left, count = F.regexp_replace(text, F.lit(rule), F.lit(f"[REDACTED:{kind}]")), F.regexp_count(text, F.lit(rule))
    if kind in _DIGITS:
        may = text.rlike("[0-9]")
    elif kind in _HELD:
        looked = F.lower(text) if "(?i)" in rule else text
        may = reduce(lambda x, y: x | y, (looked.contains(w) for w in _HELD[kind]))
    else:
        return left, count
    return F.when(may, left).otherwise(text), F.when(may, count).when(text.isNotNull(), 0)


def redact(text: Column) -> Column:
    """Every rule in turn, so a later one sees what earlier ones left."""
    return reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[1]), F.lit(f"[REDACTED:{rule[0]}]")), REDACTION_RULES, text)


def redaction_counts(text: Column) -> Column:
    """A map of kind to replacements, in the same order of rules; kinds that did not occur are left out."""
    pairs, t = [], text
    for kind, rule in REDACTION_RULES:
        pairs.append(F.struct(F.lit(kind).alias("key"), F.regexp_count(t, F.lit(rule)).alias("value")))
        t = F.regexp_replace(t, F.lit(rule), F.lit(f"[REDACTED:{kind}]"))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"] > 0))


def redacted(rows: DataFrame, text: str, counts: str, rules: tuple = REDACTION_RULES) -> DataFrame:
    """``rows`` with column ``text`` after all rules and ``counts``, an array of the replacements of each; one step a rule, so each text is computed once."""
    others = [c for c in rows.columns if c not in (text, counts)]
    out = rows.select(*others, text, F.array().cast("array<int>").alias(counts))
    for kind, rule in rules:
        left, count = redaction_step(F.col(text), kind, rule)
        out = out.select(*others, left.alias(text), F.concat(counts, F.array(count.cast("int"))).alias(counts))
    return out


def trimmed(text: Column) -> Column:
    """Without the blanks of any script at both ends, as the SQL engine trims."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def normalize_error_line(line: Column) -> Column:
    squeezed = trimmed(F.regexp_replace(line, ascii_classes(r"\s+"), " "))
    return F.left(trimmed(reduce(lambda t, rule: F.regexp_replace(t, ascii_classes(rule[0]), rule[1]), ERROR_NORMALIZERS, squeezed)), F.lit(500))


def error_type(line: Column) -> Column:
    """The kind of an error-shaped line: exception, vendor code, server error, log level; else null."""
    exception, http = F.regexp_extract(line, EXCEPTION, 1), F.regexp_extract(line, HTTP_5XX, 1)
    vendor = F.upper(F.regexp_extract(line, VENDOR_CODE, 1))
    code = F.when(vendor.startswith("ORA-"), F.replace(vendor, F.lit("-"), F.lit("_"))).when(vendor.startswith("SQLSTATE"), "SQLSTATE").when(vendor.startswith("0X"), "HEX_CODE").otherwise(F.concat(F.lit("ERRNO_"), F.regexp_extract(vendor, r"\d+", 0)))
    return F.when(exception != "", exception).when(vendor != "", code).when(http != "", F.concat(F.lit("HTTP_"), http)).when(line.rlike(LOG_LEVEL), "LOG_ERROR")


def signature_key(kind: Column, normalized: Column) -> Column:
    """Error type and up to six telling words, upper-case with underscores, at most 120 characters."""
    low = F.lower(kind)
    words = F.filter(F.regexp_extract_all(F.lower(normalized), F.lit(r"[a-z0-9<>._]+"), 0), lambda t: ~t.isin(*ERROR_STOPWORDS) & ~t.startswith("<") & (F.length(t) > 1) & ~t.rlike(r"^\d+$") & (t != low) & ~t.endswith(F.concat(F.lit("."), low)))
    key = F.array_join(F.concat(F.array(F.upper(kind)), F.transform(F.slice(words, 1, 6), F.upper)), "_")
    return F.trim(F.left(F.regexp_replace(key, "[^A-Z0-9_]", "_"), F.lit(120)), F.lit("_"))


def tokens(text: Column, pattern: str = r"[a-z0-9]+", least: int = 1) -> Column:
    """Distinct lower-case tokens in the order of their first occurrence."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)), lambda t: F.length(t) >= least)


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def count_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """How many tokens are one of ``terms``."""
    return F.regexp_count(F.lower(text), F.lit(r"(?<![a-z0-9])(?:" + "|".join(terms) + r")(?![a-z0-9])"))


def query_terms(text: Column, most: int = 24) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9._-]{1,}"), 0)), 1, most)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def sorted_pairs(a: Column) -> Column:
    """Neighbours among the sorted distinct tokens."""
    s = F.array_sort(F.array_distinct(a))
    return F.when(F.size(s) > 1, F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each word with two blanks before and one after it."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def negated(text: Column) -> Column:
    """Whether the first clause says the opposite."""
    head = F.split(F.lower(text), r"\b(?:" + "|".join(CLAUSE_BREAKS) + r")\b")[0]
    return head.rlike(r"\b(?:" + "|".join(NEGATION_CUES) + r")\b")


def outcome(text: Column) -> Column:
    """success, partial, failure or unknown: the first rule that matches."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    out = F.lit("unknown")
    for label, rule in reversed(OUTCOME_GROUPS):
        out = F.when(t.rlike(rule), label).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def outcome_recognised(text: Column) -> Column:
    """Whether any rule is met."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.coalesce(reduce(lambda a, rule: a | t.rlike(rule[1]), OUTCOME_GROUPS, F.lit(False)), F.lit(False))


def delivery_failure(text: Column) -> Column:
    return reduce(lambda n, p: n + text.rlike("(?i)" + p).cast("int"), BOUNCE_PHRASES, F.lit(0)) >= 2


def content_fingerprint(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


_VERSION = r"^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(\*|\.\*|\.[xX])?$"


def version_compatible(article: Column, target: Column) -> Column:
    """Whether an article's version may serve a target's; null when either can't be read."""
    part = lambda v, k: F.regexp_extract(F.trim(v), _VERSION, k)
    known = (part(article, 1) != "") & (part(target, 1) != "")
    wild = lambda v: (part(v, 4) != "") | (part(v, 2) == "")
    number = lambda v: F.struct(*(F.coalesce(F.nullif(part(v, k), F.lit("")).cast("int"), F.lit(0)) for k in (1, 2, 3)))
    same = part(article, 1).try_cast("int") == part(target, 1).try_cast("int")
    return F.when(~F.coalesce(known, F.lit(False)), None).when(~same, False).when(wild(article) | wild(target), True).otherwise(number(article) <= number(target))


#: Named and numbered entities; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&bull;", "\u2022"),
    ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&euro;", "\u20ac"), ("&auml;", "\u00e4"), ("&ouml;", "\u00f6"), ("&uuml;", "\u00fc"), ("&Auml;", "\u00c4"), ("&Ouml;", "\u00d6"), ("&Uuml;", "\u00dc"), ("&szlig;", "\u00df"), ("&eacute;", "\u00e9"), ("&egrave;", "\u00e8"), ("&agrave;", "\u00e0"), ("&ccedil;", "\u00e7"), ("&ntilde;", "\u00f1"), ("&#38;", "&"), ("&amp;", "&"),
)


def strip_html(html: Column) -> Column:
    """Visible text: no comments, scripts or styles, tags as blanks, the common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
