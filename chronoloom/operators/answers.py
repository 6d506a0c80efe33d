"""Free answers read into columns: an option's letter, a number, or one of some labels.

Null and blank texts give null; of several candidates the first in the order of the tries counts; nothing is guessed
where no try fits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_EDGES = r"(?U)^\s+|\s+$"
# Words that an option's letter may follow, labels before a result, and the shape of a number.
_NAMED = r"\b(?:answer|option|letter|choose|select|selected)\b(?:\s+(?:is|was))?\s*[:=\-]?\s*([A-Z])\b"
_LABEL = r"(?i)^\s*(?:answer|result|value)\s*[:=]?\s*"
_TOKEN = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?(?:[eE][-+]?\d+)?(?:\s*%)?"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def lines(text: Column) -> Column:
    """The lines of a text that aren't blank, without space at their ends."""
    return F.filter(F.transform(F.split(text, _BREAK), stripped), lambda x: x != "")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def letter_reply(text: Column) -> Column:
    """``struct<letter, justification>`` of a reply: a letter that begins its first line, one that a word like "answer" names in the
    first 80 characters, or one that is alone on the last line; the justification is what follows (of the last try all of it).

    A pronoun or an article at the front is such a letter, too: "I choose E" reads as I, "A bad day" as A.
    """
    whole = stripped(text)
    own = F.split(whole, _BREAK)
    first, last = stripped(own[0]), F.try_element_at(lines(whole), F.lit(-1))
    head = F.substr(text, F.lit(1), F.lit(80))
    begun = _group(F.concat(first, F.lit(" ")), r"(?i)^\s*([A-Z])[.):\s]")
    named = _group(head, f"(?i){_NAMED}")
    alone = _group(last, r"(?Ui)^[^\w]*([A-Z])[^\w]*$")
    upto = F.length(F.regexp_extract(head, f"(?is)^.*?{_NAMED}", 0))
    rest = stripped(F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), " "))
    told = lambda letter, why: F.struct(F.upper(letter).alias("letter"), why.alias("justification"))
    return (
        F.when(F.coalesce(whole, F.lit("")) == "", F.lit(None)).when(begun.isNotNull(), told(begun, rest))
        .when(named.isNotNull(), told(named, stripped(F.substr(text, upto + 1)))).when(alone.isNotNull(), told(alone, whole)).otherwise(told(F.lit(None).cast("string"), whole))
    )


def answer_letter(text: Column) -> Column:
    return letter_reply(text)["letter"]


def _first_number(text: Column) -> Column:
    bare = F.regexp_replace(F.ltrim(F.regexp_replace(text, _LABEL, "")), r"^\s*=?\s*", "")
    bare = F.regexp_replace(F.replace(bare, F.lit("−"), F.lit("-")), r"(?i)\bminus\s+(?=\d|\.)", "-")
    bare = F.regexp_replace(bare, r"([+-])\s+(?=\d|\.)", "$1")
    tokens = F.filter(F.regexp_extract_all(bare, F.lit(f"({_TOKEN})"), 1), lambda t: t.rlike(r"\d") & ~t.rlike(r"^[-+]?[eE]"))
    token = F.try_element_at(tokens, F.lit(1))
    value = F.regexp_replace(token, r"[,%\s]", "").cast("double")
    return F.when(token.endswith("%"), value / 100).otherwise(value)


def answer_number(text: Column) -> Column:
    """The first number of the first line that isn't blank, else of the whole text: labels before it, thousands' commas, a minus in any
    writing, exponents; a percent sign right after it divides it by 100."""
    return F.coalesce(_first_number(F.try_element_at(lines(text), F.lit(1))), _first_number(text))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(text)), r"(?U)\s+", " ")


def answer_label(text: Column, allowed: Column | None = None) -> Column:
    """The label that a reply names: the first line as it is or, of ``allowed``, one equal to the first line, to any line, inside of the
    first line or around it, or anywhere inside of the text; in the last two tries longer labels go first."""
    own = lines(text)
    first = F.try_element_at(own, F.lit(1))
    clean = stripped(F.regexp_replace(first, _LABEL, ""))
    if allowed is None:
        return F.coalesce(F.nullif(clean, F.lit("")), first)
    head, body, each = _plain(clean), _plain(text), F.transform(own, _plain)
    known = F.filter(allowed, lambda a: F.coalesce(stripped(a), F.lit("")) != "")
    ranked = F.transform(F.array_sort(F.transform(known, lambda a, i: F.struct((-F.length(_plain(a))).alias("size"), i.alias("at"), a.alias("label")))), lambda s: s["label"])
    pick = lambda labels, test: F.try_element_at(F.filter(labels, test), F.lit(1))
    found = F.coalesce(
        pick(known, lambda a: _plain(a) == head), pick(known, lambda a: F.array_contains(each, _plain(a))),
        pick(ranked, lambda a: F.contains(head, _plain(a)) | ((head != "") & F.contains(_plain(a), head))), pick(ranked, lambda a: F.contains(body, _plain(a))),
    )
    return F.when(first.isNotNull(), found)
