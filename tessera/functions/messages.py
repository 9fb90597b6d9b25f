"""Rules for single messages as column expressions: quoted history, signatures, disclaimers, technical content, ticket numbers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where quoted history starts in a message, and what a quoted line looks like.
QUOTE_BOUNDARIES = (
    r"^-{2,}\s*Original Message\s*-{2,}\s*$",
    r"^\s*_{10,}\s*$",
    r"^\s*-*\s*on\b[^\n]{5,160}?\bwrote\b\s*[-:]*\s*$",
    r"(?-i:^\s*From:\s*\S[^\n]*\n\s*(?:Sent|To|Date|Subject):)",
    r"(?-i:^\s*Sent from my \w+)",
)
QUOTED_LINE = r"^\s*>"
#: Legal text at the end, sign-offs on a line of their own, contact data, links.
DISCLAIMER = (
    r"^[^\n]{0,120}?("
    r"this (e-?mail|message|communication|transmission)\b[^\n]{0,120}?(confidential|privileged|intended (solely|only|for))"
    r"|if you (are not the|have received this)[^\n]{0,80}(intended|in error)"
    r"|any (unauthorised|unauthorized) (use|review|disclosure|copying)"
    r"|the (contents|content) of this (e-?mail|message)[^\n]{0,60}confidential"
    r"|disclaimer\s*:"
    r")"
)
SIGN_OFF = r"(?i)^\s*(thanks?\s*(and|&|,)?\s*regards?|best regards?|kind regards?|warm regards?|regards?|sincerely|cheers|thanks?|thank you|br)[\s,!.]*$"
CONTACT = r"(?im)(^\s*(mobile|mob|cell|phone|tel|direct|desk|ext|email|e-?mail|web)\b[:.\s|]|https?://|www\.|@[\w.-]+\.\w{2,}|\+\d[\d\s()-]{7,})"
LINK = r"(?i)(https?://|www\.)"
SIGNATURE_CHARS, SIGNATURE_LINE, SIGNATURE_LINES = 600, 60, 4
LINK_BLOCK_CHARS, LINK_BLOCK_LINE, LINK_BLOCK_URLS = 800, 60, 2
#: Senders that are mail systems.
AUTOMATED_SENDERS = ("microsoft outlook", "mail delivery subsystem", "mailer-daemon", "mailer daemon", "postmaster", "internet mail delivery", "system administrator")
#: Shorter lines repeat in a thread without being quotes.
LEAST_REPEATED_LINE = 40

#: Signs of technical content.
TECHNICAL = (
    r"(?i)\b0x[0-9a-f]{4,}\b",
    r"\b[A-Z]{2,}-\d{3,}\b",
    r"(?i)\b(?:error|status|exit)\s*(?:code)?\s*[:=#]?\s*\d{3,}\b",
    r"[A-Za-z]:\\[^\s]+|/(?:etc|var|opt|usr|home)/[^\s]+",
    r"(?i)\b[\w.-]+\.(?:log|conf|xml|json|jar|dll|exe|sh|bat|properties|yml|yaml)\b",
    r"\bv?\d+\.\d+(?:\.\d+)+\b",
    r"\bhttps?://\S+",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b[\w.-]+@[\w.-]+\.\w{2,}\b",
    r"(?i)\b[a-z0-9-]+\.(?:com|net|org|io|local|corp)\b",
    r"\b[a-z]+(?:[A-Z][a-z]+){2,}\b",
    r"\b[A-Z][A-Z0-9]{2,}_[A-Z0-9_]{2,}\b",
    r"\b\w+\.\w+\.\w+\b",
    r"(?i)\b(?:Exception|Traceback|at\s+\w+\.\w+\(|caused by)\b",
    r"(?i)\b(?:select|insert|update|delete)\s+[^\n]*\b(?:from|into|set|where)\b",
    r"(?i)\b(?:systemctl|service|net\s+stop|net\s+start|kill\s+-9|chmod|chown)\b",
)
#: Mark-up that looks technical and is not; what starts a signature, and a support desk's footer line.
MARKUP = (
    r"zsu\[@user:\d+\]zsu",
    r"\[cid:[^\]]+\]",
    r"\[image:[^\]]*\]",
)
SIGNATURE_START = r"(?im)^\s*(?:regards|best regards|kind regards|warm regards|thanks (?:&|and) regards|atenciosamente|saludos|cordialement|mit freundlichen|follow us\s*:|disclaimer\s*:|this (?:e-?mail|message) (?:and any attachments )?is confidential)\b[\s\S]*"
FOOTER_LINE = r"(?im)^\s*[^\n]{0,60}\|\s*(?:rpa|it|service|technical)\s+support\b[^\n]*$"
LEAST_DIAGNOSTIC = 150

#: Ticket numbers, what quotes all that follows, and how sure a mention is.
TICKET = r"\b(?:(?:INC|PRB|CHG|RITM|REQ|TASK|CS)\d{6,9}|[A-Z][A-Z0-9]{1,9}-\d{1,10})\b"
QUOTE_BLOCK = r"(?im)(?:-{10} forwarded message -{10}|-----original message-----|_{32}|^[ \t]*from: [^\n]+\n(?:[^\n]*\n){0,2}[ \t]*(?:sent|date): )[\s\S]*"
SUBJECT_CONFIDENCE, BODY_CONFIDENCE, QUOTED_CONFIDENCE, DIGEST_CONFIDENCE = 0.98, 0.90, 0.55, 0.5
DIGEST_FROM, QUOTED_WEIGHT = 3, 0.5

#: How sure other places of a number are, what is inherited or corrected, from where a label is trusted, phrases that take a message out of a case.
CARD_CONFIDENCE, BOT_CONFIDENCE, TRANSCRIPT_CONFIDENCE, NUMERIC_CONFIDENCE = 0.95, 0.7, 0.7, 0.8
INHERITED_CONFIDENCE, BOT_INHERITED_CONFIDENCE, CORRECTED_CONFIDENCE, NEGATIVE_CONFIDENCE = 0.85, 0.6, 0.8, 0.7
TRUSTED_LABEL = 0.6
DISSOCIATION = ("different issue", "different problem", "unrelated", "not related", "not this ticket", "separate problem", "separate issue", "wrong incident", "wrong ticket")
#: Bare numbers that may be tickets, digits as they are spoken, and from how many on single characters are a number spelt out.
NUMERIC = (
    r"#(\d{2,10})\b",
    r"(?i)\b(?:ticket|case|incident|request|sr)\b[\s:.#]*(?:no\.?|number|num\.?)?[\s:.#]*(\d{2,10})\b",
)
SPOKEN = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0"}
LEAST_SPELT = 5

#: What a thread says to nobody's use, where a message starts, and what tells that a line has substance.
BOILERPLATE_LINE = r"(?i)^(?:(?:hi|hello|dear|greetings)\b|good\s+(?:morning|afternoon|evening)|thanks?\b|thank\s+you|warm\s+regards|kind\s+regards|best\s+regards|regards\b|cheers\b|sincerely\b|from:|sent:|to:|cc:|subject:|date:|>|-{3,}|_{3,}|={3,}|\*{3,}|disclaimer\b|confidential(?:ity)?\b|this\s+e?-?mail)"
MESSAGE_START = r"(?i)^(?:from:|on\s[^\n]+wrote:|-{3,}\s*(?:original|forwarded)\s+message)"
TECH_WORD = (
    r"(?i)\b(?:error|errors|fail(?:ed|ure|s|ing)?|exception|timeout|timed\s+out|crash(?:ed|es)?|refused|denied|unable|cannot|exhausted|missing|config(?:uration)?|install(?:ed|ation)?|upgrade[ds]?|update[ds]?|patch(?:ed)?|version|log[s]?|server|service|agent"
    r"|plugin|driver[s]?|workflow|job[s]?|restart(?:ed)?|reboot(?:ed)?|resolv(?:e|ed|ing)|fix(?:ed|es)?|disk|memory|cpu|port|certificate|license|queue|database|connection)\b"
)
CODE_TOKEN = r"(?:[\w-]+\.[\w.-]+\w|\w+_\w+|\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b|\b0x[0-9a-fA-F]+\b|\b\d+\.\d+(?:\.\d+)?\b|[\\/][\w\\/.-]{4,})"
SCORE_NOISE, EMAIL_LIKE = r"\[REDACTED:[A-Z_]+\]|<[^>\n]{0,120}>", r"\[REDACTED:EMAIL\]|@[\w.-]+\.\w{2,}"
HEAD_SHARE, LEAST_TAKEN = 0.25, 40

CUT = "(?im)(?:" + "|".join(QUOTE_BOUNDARIES) + r")[\s\S]*"
LEGAL = r"(?im)" + DISCLAIMER + r"[\s\S]*"
ANY_MARKUP = "(?i)" + "|".join(MARKUP)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def fresh_text(body: Column) -> Column:
    """Up to the earliest boundary, without quoted lines; null gives an empty text."""
    head = F.regexp_replace(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), CUT, "")
    return strip(F.array_join(F.filter(lines_of(head), lambda x: ~x.rlike(QUOTED_LINE)), "\n"))


def _tail(lines: Column, last: Column) -> Column:
    return F.slice(lines, last + 1, F.size(lines))


def _is_signature(tail: Column, filled: Column, text: Column) -> Column:
    """Whether lines from a sign-off on are a signature and no prose; ``filled`` are those with content, ``text`` all of them."""
    long = F.size(F.filter(filled, lambda x: F.length(x) > SIGNATURE_LINE))
    short = (long == 0) & (F.size(filled) <= SIGNATURE_LINES)
    return (F.size(filled) > 0) & (F.length(text) <= SIGNATURE_CHARS) & (long <= 1) & (text.rlike(CONTACT) | short)


def without_sign_off(body: Column) -> Column:
    """Without the last sign-off and what follows, if that is a signature."""

    def cut(lines: Column, last: Column) -> Column:
        judged = let(_tail(lines, last), lambda tail: let(F.struct(F.filter(F.transform(tail, lambda x: strip(x)), lambda x: x != "").alias("filled"), F.array_join(tail, "\n").alias("text")), lambda t: _is_signature(tail, t["filled"], t["text"])))
        return F.when(last.isNotNull() & judged, rstrip(F.array_join(F.slice(lines, 1, F.coalesce(last, F.lit(0))), "\n"))).otherwise(F.array_join(lines, "\n"))

    return let(lines_of(body), lambda lines: let(F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(SIGN_OFF), i))), lambda last: cut(lines, last)))


def without_link_menu(body: Column) -> Column:
    """Without trailing lines that are blank, short or links, if they hold two links or more."""
    stays = lambda x: let(strip(x), lambda y: (y != "") & ~y.rlike(LINK) & (F.length(y) > LINK_BLOCK_LINE))

    def cut(lines: Column, keep: Column) -> Column:
        menu = let(F.array_join(_tail(lines, keep), "\n"), lambda block: (F.length(block) <= LINK_BLOCK_CHARS) & (F.regexp_count(block, F.lit(LINK)) >= LINK_BLOCK_URLS))
        return F.when(menu, rstrip(F.array_join(F.slice(lines, 1, keep), "\n"))).otherwise(F.array_join(lines, "\n"))

    return let(lines_of(body), lambda lines: let(F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(stays(x), i + 1))), F.lit(0)), lambda keep: cut(lines, keep)))


def without_boilerplate(body: Column) -> Column:
    """Disclaimer, signature and link menu cut from the end; a text that has any content keeps some."""
    legal = lambda b: F.when(b.rlike(LEGAL), rstrip(F.regexp_replace(b, LEGAL, ""))).otherwise(b)
    return let(body, lambda b: let(strip(without_link_menu(without_sign_off(legal(b)))), lambda out: F.when(out == "", strip(b)).otherwise(out)))


def automated(sender: Column) -> Column:
    return F.coalesce(reduce(lambda a, s: a | F.lower(sender).contains(s), AUTOMATED_SENDERS, F.lit(False)), F.lit(False))


def technical(text: Column) -> Column:
    cleaned = F.regexp_replace(text, ANY_MARKUP, " ")
    return reduce(lambda a, p: a | cleaned.rlike(p), TECHNICAL, F.lit(False))


def content_length(text: Column) -> Column:
    """Length without mark-up, signature and desk footer."""
    return F.length(strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ANY_MARKUP, " "), SIGNATURE_START, ""), FOOTER_LINE, " ")))


def ticket_mentions(body: Column) -> Column:
    """array<struct<token, quoted>>: each number once; what stands in fresh and in quoted text is fresh."""
    head = F.regexp_replace(body, QUOTE_BLOCK, "")
    fresh = F.array_distinct(F.regexp_extract_all(F.array_join(F.filter(lines_of(head), lambda x: ~x.rlike(QUOTED_LINE)), "\n"), F.lit(TICKET), 0))
    every = F.array_distinct(F.regexp_extract_all(body, F.lit(TICKET), 0))
    return F.transform(every, lambda t: F.struct(t.alias("token"), (~F.array_contains(fresh, t)).alias("quoted")))


_ONE = rf"\b(?:[A-Za-z]|\d|{'|'.join(SPOKEN)})\b"
_SPELT = re.compile(rf"{_ONE}(?:[\s.-]+{_ONE}){{{LEAST_SPELT - 1},}}", re.IGNORECASE)


def joined(spelt: str) -> str:
    return "".join(SPOKEN.get(c.lower(), c.upper()) for c in re.split(r"[\s.-]+", spelt))


def unspelt(text: Column) -> Column:
    """Compatibility characters folded (NFKC), five or more single characters or spoken digits in a row as one word; null stays null."""

    @F.arrow_udf("string")
    def folded(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in rows:
            yield pa.array([None if x is None else _SPELT.sub(lambda m: joined(m.group()), unicodedata.normalize("NFKC", x)) for x in col.to_pylist()], pa.string())

    return folded(text)


def places(title: Column, body: Column, cards: Column) -> Column:
    """array<struct<rank, location, token>> of every ticket number of a message; a number may stand in several."""
    at = lambda rank, name, tokens: F.transform(tokens, lambda t: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("location"), t.alias("token")))
    every = lambda text, rule, group: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), group)
    found = ticket_mentions(F.coalesce(body, F.lit("")))
    of = lambda quoted: F.transform(F.filter(found, lambda m: m["quoted"] == quoted), lambda m: m["token"])
    both = F.concat_ws("\n", title, body)
    in_cards = F.flatten(F.transform(F.coalesce(cards, F.array().cast("array<string>")), lambda c: every(c, TICKET, 0)))
    numeric = F.concat(*(every(both, rule, 1) for rule in NUMERIC))
    return F.array_distinct(F.concat(at(0, "bot_card", in_cards), at(1, "subject", every(title, TICKET, 0)), at(2, "body", of(False)), at(3, "quoted_body", of(True)), at(4, "transcript_normalized", every(unspelt(body), TICKET, 0)), at(5, "numeric_candidate", numeric)))


def dissociates(label: Column, sure: Column, title: Column, body: Column) -> Column:
    """The label says so, or none is trusted and a phrase does."""
    text = F.lower(F.concat_ws("\n", body, title))
    phrase = reduce(lambda a, p: a | text.contains(p), DISSOCIATION, F.lit(False))
    untrusted = label.isNull() | (label == "unclassified") | (F.coalesce(sure, F.lit(0.0)) < TRUSTED_LABEL)
    return F.coalesce(label == "dissociation", F.lit(False)) | (untrusted & phrase)


def corrects(label: Column, sure: Column) -> Column:
    return F.coalesce((label == "correction") & (sure >= TRUSTED_LABEL), F.lit(False))
