"""Text functions over opening requests: normalising, masking, predicates, categories, terms.

Patterns carry (?iU), so that words, spaces, digits and case are Unicode's, as in the system whose results these match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns, word lists and lengths must be as they are for the same results.
SCHEDULED = r"\b(?:cron|scheduled|scheduler|automation|pre-run)\b"
COMMUNICATION = r"\b(?:send|post|reply|respond|message|email|slack|msteams|teams|notify|dm)\b"
CODING = r"\b(?:code|script|python|javascript|typescript|repository|repo|git|test|debug|deploy|api|function|database|sql)\b"
ARTIFACT = r"\b(?:document|spreadsheet|workbook|presentation|slides?|pdf|file|report|image|audio|video|transcrib|dashboard)\b"
RESEARCH = r"\b(?:find|search|research|investigate|look up|verify|compare|analyse|analyze|summarize|review|audit|check)\b"
CORRECTION = r"(?:\b(?:this|that|it) (?:is|was|'s) (?:wrong|incorrect|confusing|not what)\b|\byou (?:missed|forgot|misunderstood|didn't|did not)\b|\bplease (?:redo|fix|correct|revise|try again)\b|\bnot what (?:i|we) (?:asked|wanted|meant)\b)"
MULTISTEP = r"\b(?:first|second|then|after that|before you|step \d+|finally|once .* then)\b"
EXTERNAL_ACTION = r"\b(?:send|post|reply|email|notify|upload|submit|publish|deploy|update|edit|create|write|delete|remove|react)\b"
HIGH_RISK = r"\b(?:delete|remove permanently|production|deploy|payment|invoice|financial|legal|contract|tax|irs|credential|password|secret|medical|privacy)\b"
TOOL_CATEGORIES = {
    "communication": r"slack|msteams|teams|email|gmail|outlook|message|dm",
    "file": r"file_|upload|download|document|spreadsheet|pdf",
    "code": r"bash|shell|apply_patch|git|github|code|deploy",
    "research": r"search|browser|web|history|lookup|fetch|query",
    "media": r"image|audio|video|speech|transcri|render",
    "write": r"send|edit|write|delete|upload|submit|create|deploy|react|update|patch",
}
SIDE_EFFECT_TOOL = r"(?:^|_)(?:send|edit|write|delete|upload|submit|create|deploy|react|update|patch)(?:_|$)|send_message|submit_draft|file_edit|file_write|apply_patch"
POSITIVE = r"\b(?:done|completed?|finished|sent|posted|delivered|uploaded|updated|created|resolved|successful(?:ly)?|up[ -]to[ -]date)\b"
NEGATIVE = r"\b(?:unable to|could not|couldn't|cannot|can't|failed to|not completed|blocked by|still blocked|unresolved|gave up)\b"
NOOP_SUCCESS = r"\b(?:nothing queued|queue (?:was|is) empty|no action needed|no new (?:items|messages|replies|emails|leads)|0 (?:new|pending)|nothing to do|no writes|already up[ -]to[ -]date)\b"
STOP_WORDS = "the and for with from this that not you your our are was were have has had into then than can will would should could but all any its it's system entity number date url path pii id".split()
CATEGORIES = ["scheduled", "coding", "artifact", "research", "communication", "general"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: The masks in their order: pattern, flags, what stands for a match.
MASKS = [
    (r"<delivery_note>.*?</delivery_note>", "is", " "),
    (r"\[base64 image redacted\]", "i", " image "),
    (r"`[^`]*`", "", " path "),
    (r"https?://\S+|<mailto:[^>]+>|\b[\w.+-]+@[\w.-]+\b", "i", " url "),
    (r"\bPII_[A-Z0-9_]+\b", "i", " entity "),
    (r"<[A-Z][A-Z0-9_]*(?:_[A-Z0-9_]+)*>", "", " entity "),
    (r"\b(?:[A-Z][A-Z0-9]{7,}|[a-f0-9]{12,})\b", "i", " id "),
    (r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b", "", " date "),
    (r"\b\d+(?:\.\d+)*\b", "", " number "),
    (r"\s*-?\s*cron path\s*:.*?(?:</system>|$)", "is", " "),
    (r"</?[a-z_][^>]*>", "i", " "),
    (CONTROL, "", " "),
]
#: What a text must hold for a mask to match at all; cheap to look for.
NEEDED = dict(zip([m[0] for m in MASKS], ["<", r"\[", "`", "@|://|<", "_", "<", None, r"(?U)\d", r"(?U)\d", ":", "<", None], strict=True))
ROUTING_CHARS, PREVIEW_CHARS, OPENING_CHARS = 6000, 500, 2000

#: The masks as the SQL over the tables has them, with what a text must hold for each: RE2's spaces, digits and case, no mask for PII_.
#: Flags are ASCII's; RE2 folds U+017F and the Kelvin sign into s and k besides.
_WORD, _S, _LETTER = r"\w\p{L}\p{M}\p{N}", "[s\u017f]", "A-Z\u017f\u212a"
TABLE_IMAGE = rf"(?i)\[ba{_S}e64 image redacted\]"
TABLE_URL = rf"http{_S}?://[^\t\n\f\r ]+|<mailto:[^>]+>"
#: The SQL takes a character along on each side of a number, so one that follows another at once waits for the second run; (?!\G) is that.
TABLE_NUMBER = (rf"(?=[0-9])(?:^|(?!\G)(?<![{_WORD}]))[0-9]+(?:\.[0-9]+)*(\z|[^{_WORD}])", " number $1", None)
TABLE_MASKS = [
    (r"(?is)<delivery_note>.*?</delivery_note>", " ", "<"),
    (TABLE_IMAGE, " image ", r"\["),
    (r"`[^`]*`", " path ", "`"),
    (rf"(?i){TABLE_URL}|(?<![{_WORD}])[{_WORD}][{_WORD}.+-]*+@[{_WORD}.-]*[{_WORD}]", " url ", "@"),
    (rf"(?i){TABLE_URL}", " url ", "://|<"),
    (r"<[A-Z][A-Z0-9_]*(?:_[A-Z0-9_]+)*>", " entity ", "<"),
    (rf"(?i)(?<![{_WORD}])(?:[{_LETTER}][{_LETTER}0-9]{{7,}}|[a-f0-9]{{12,}})(?![{_WORD}])", " id ", None),
    (rf"(?<![{_WORD}])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[T ][0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?(?![{_WORD}])", " date ", "-"),
    TABLE_NUMBER,
    TABLE_NUMBER,
    (rf"(?is)[\t\n\f\r ]*-?[\t\n\f\r ]*cron path[\t\n\f\r ]*:.*?(?:</{_S}y{_S}tem>|\z)", " ", ":"),
    (rf"(?i)</?[{_LETTER}_][^>]*>", " ", "<"),
]


def has(text: Column, pattern: str) -> Column:
    """Whether pattern occurs in text; false for null."""
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def routing_text(text: Column) -> Column:
    """User text with the image marker and control characters as spaces, white space collapsed; its last 6000 characters."""
    t = F.regexp_replace(text, r"(?iU)\[base64 image redacted\]", " ")
    return F.right(_squeeze(F.regexp_replace(t, CONTROL, " ")), F.lit(ROUTING_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mask(pattern: str, flags: str, instead: str) -> Callable[[Column], Column]:
    """The mask, applied only to texts with a character that every match has."""
    needs = NEEDED.get(pattern)

    def masked(t: Column) -> Column:
        done = F.regexp_replace(t, f"(?U{flags})" + pattern, instead)
        return done if needs is None else F.when(t.rlike(needs), done).otherwise(t)

    return masked


def sanitise(text: Column) -> Column:
    """Text without identifiers, dates, numbers, paths and delivery notes, in lower case."""
    for pattern, flags, instead in MASKS:
        text = let(text, _mask(pattern, flags, instead))
    return F.lower(_squeeze(text))


def _table_squeeze(text: Column) -> Column:
    """Control characters and RE2's white space as single spaces, without Unicode's spaces at the ends."""
    t = F.trim(F.regexp_replace(text, r" ?[\x00-\x1f\x7f][\x00-\x20\x7f]*| {2,}[\x00-\x20\x7f]*", " "))
    ends = lambda c: F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(r"\p{Zs}")
    return let(t, lambda c: F.when(ends(c), F.regexp_replace(c, r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")).otherwise(c))


def table_routing_text(text: Column) -> Column:
    """routing_text as the SQL over the tables has it."""
    return F.right(_table_squeeze(F.regexp_replace(text, TABLE_IMAGE, " ")), F.lit(ROUTING_CHARS))


def table_sanitise(text: Column) -> Column:
    """sanitise as the SQL over the tables has it: of 1 3.14 it makes three numbers, where sanitise makes two."""

    def masked(pattern: str, instead: str, needs: str | None) -> Callable[[Column], Column]:
        done = lambda t: F.regexp_replace(t, pattern, instead)
        return done if needs is None else lambda t: F.when(t.rlike(needs), done(t)).otherwise(t)

    for mask in TABLE_MASKS:
        text = let(text, masked(*mask))
    # in lower case by single letters, wherever they stand
    return F.lower(F.replace(F.replace(_table_squeeze(text), F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def model_text(sanitised: Column) -> Column:
    """The text of the text model: masked a second time, as the reference results are."""
    return sanitise(sanitised)


def template_key(text: Column) -> Column:
    return F.right(text, F.lit(PREVIEW_CHARS))


def task_flags(text: Column) -> dict[str, Column]:
    """The predicates over a routing text."""
    patterns = {"scheduled": SCHEDULED, "communication": COMMUNICATION, "coding": CODING, "artifact": ARTIFACT, "research": RESEARCH, "correction": CORRECTION, "multistep": MULTISTEP, "external": EXTERNAL_ACTION, "high_risk": HIGH_RISK}
    return {k: has(text, p) for k, p in patterns.items()}


def risk_level(f: dict[str, Column]) -> Column:
    return F.when(f["high_risk"], 3).when(f["external"], 2).when(f["coding"] | f["artifact"], 1).otherwise(0)


def primary_category(f: dict[str, Column]) -> Column:
    out = F.lit("general")
    for name in reversed(CATEGORIES[:-1]):
        out = F.when(f[name], name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)(?:^|\s)(?:\d+[.)]|[-*])\s+"))


def question_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))


def terms(text: Column) -> Column:
    """Words of three letters or more that are no stop words, and pairs of neighbours among them."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[a-z][a-z']{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))

    def with_pairs(w: Column) -> Column:
        n = F.size(w) - 1
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit("__"), b))
        return F.when(n > 0, F.concat(w, pairs)).otherwise(w)

    return let(found, with_pairs)


def tool_counts(names: Column) -> dict[str, Column]:
    """How many of the tool names fall in each category; one may count in several."""

    def count(pattern: str) -> Column:
        return F.size(F.filter(names, lambda n: n.rlike("(?iU)" + pattern)))

    return {k: count(p) for k, p in TOOL_CATEGORIES.items()}
