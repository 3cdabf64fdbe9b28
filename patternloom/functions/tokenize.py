"""Tokenizers as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: characters at which the markup tokenizer splits; of these, the ones that become tokens
SPLIT = r"""\x00-\x20;"&/:!#?$%()@^*+\-,=><\[\]{}|`~_"""
PUNCTUATION = r""";"&/:!#?$%()@+\-,`"""
MAX_BYTES = 100


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-cased runs between white space; a null text has no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"\s+"), lambda t: t != "")


def strip_markup(text: Column | str) -> Column:
    """Text without comments, processing instructions, script and style bodies, and tags; entities leave their ``&``."""
    out = _col(text)
    for pattern, to in ((r"(?s)<!--.*?(?:-->|$)", " "), (r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)", " "), (r"(?s)<[?!].*?>", " "), (r"(?s)<[/a-zA-Z][^>]*>", " "), (r"&[a-z0-9#]*;", "& ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def tag_tokens(text: Column | str) -> Column:
    """Tokens of marked-up text: lower-case, apostrophes deleted, acronyms joined, chosen punctuation kept.

    A run with a period takes the period path: outer periods are stripped (one
    ``.`` token for each stripped end where no inner one is left), an acronym
    with a period at every second place is joined, other runs split at periods
    into parts of two characters or more; the punctuation right after such a
    run isn't a token.  Tokens of 100 bytes or more are dropped.
    """
    run, mark = f"[^{SPLIT}]", f"[{PUNCTUATION}]"
    dotted = rf"[^{SPLIT}.]*\.{run}*{mark}?"
    found = F.regexp_extract_all(strip_markup(F.coalesce(_col(text), F.lit(""))), F.lit(f"({dotted}|{run}+|{mark})"), F.lit(1))
    tokens = F.flatten(F.transform(found, _fixed))
    return F.filter(tokens, lambda t: (t != "") & (F.octet_length(t) < MAX_BYTES))


def _fixed(raw: Column) -> Column:
    word = F.lower(F.regexp_replace(raw, "'", ""))
    body = F.regexp_replace(word, rf"[{PUNCTUATION}]$", "")
    core = F.regexp_replace(body, r"^\.+|\.+$", "")
    ends = F.filter(F.array(F.when(body.startswith("."), F.lit(".")), core, F.when(body.endswith(".") & (core != ""), F.lit("."))), lambda t: t.isNotNull())
    parts = F.filter(F.split(core, r"\."), lambda p: F.length(p) > 1)
    dotted = F.when(~core.contains("."), ends).when(core.rlike(r"^(?:[^.]\.)+[^.]$"), F.array(F.regexp_replace(core, r"\.", ""))).otherwise(parts)
    return F.when(raw.contains("."), dotted).otherwise(F.array(word))


def sentences(text: Column | str) -> Column:
    """Line feeds become spaces; a sentence ends after ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\n", " "), r"(?<=[.!?])\s+"), lambda s: s != "")


def ngrams(tokens: Column | str, most: int, least: int = 1) -> Column:
    """All n-grams of ``least`` to ``most`` tokens, joined by spaces."""
    t = _col(tokens)
    return F.concat(*[_ngrams_of(t, n) for n in range(least, most + 1)])


def _ngrams_of(t: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(t) - (n - 1))
    return F.when(F.size(t) >= n, F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed values: the Treebank tokenization rules, applied in order
PTB_RULES = (
    (r"\s+", " "),
    (r'^"', "`` "),
    (r"([ (\[{<])\"", "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([,;:@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r"$", " "),
    (r"\"", " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"'([sSmMdD]) ", " '$1 "),
    (r"('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", " $1 "),
)


def ptb_tokens(text) -> Column:
    """Treebank tokens of a sentence: punctuation, quotes and contractions apart."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for pattern, to in PTB_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.filter(F.split(out, " +"), lambda x: x != "")


TOKENIZERS = {"whitespace": whitespace_tokens, "tag": tag_tokens, "treebank": ptb_tokens}
