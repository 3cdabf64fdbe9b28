"""Personal data by weak supervision (operator 1, native).

Patterns propose candidates: strict ones (the base kinds) and loose ones
(written-out e-mail addresses, national telephone numbers, IPv6, 13-digit
cards).  Four labelers vote on each candidate (+1, -1, or 0 to abstain): the
regular expressions' own checks, gazetteers (top-level domains, card issuer
and telephone prefixes), the words around it, and its form.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability per kind; its posteriors train a logistic span
classifier on votes and features.  Candidates that it accepts are added to
the base spans, which always stay; an added span never overlaps a base one.

Everything over documents is DataFrame functions.  Positions come from the
gaps between matches: ``split`` gives the text between matches, and a window
per document sums lengths, so a text with very many matches stays linear.
The driver sees only counts of vote patterns (at most a few hundred rows).
Patterns use possessive loops and start at run borders, which keeps them
linear in very long words without changing what they match.

A null text is empty and has no span.  Rows that repeat a doc_id are told
apart by a row number held in the shared folder.  Spans that start together are
in the order of kinds.  An empty table gives an empty result.  Only doc_id and
text are read, so further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import spill

KINDS = ("email", "ip", "card", "phone")
AROUND = 24  # code points of context on either side


@dataclass(frozen=True)
class Pattern:
    kind: int  # index in KINDS
    base: bool
    regex: str
    needs: str  # a cheap condition that any text with a match fulfils


_DIGIT = "text rlike '[0-9]'"
PATTERNS = (
    Pattern(0, True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    Pattern(1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"contains(text, '.') and {_DIGIT}"),
    Pattern(2, True, r"[0-9](?:[\x20-]?[0-9])++", _DIGIT),
    Pattern(3, True, r"\+[0-9][\x20().0-9-]+[0-9]", f"contains(text, '+') and {_DIGIT}"),
    Pattern(0, False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?[Aa][Tt]\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?[Dd][Oo][Tt]\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}", "contains(lower(text), 'dot')"),
    Pattern(1, False, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", f"contains(text, ':') and {_DIGIT}"),
    Pattern(2, False, r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{3}(?![\x20-]?[0-9])", _DIGIT),
    Pattern(3, False, r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", _DIGIT),
)

#: fixed values: gazetteers
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at", "nl", "be", "pt", "br", "mx", "ca", "au", "jp", "in")
CARD_PREFIX = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|35|6011|64[4-9]|65|62)"
PHONE_PREFIX = r"^(?:1[2-9]|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|80|85|88|96|97|99)"
WORDS = {
    0: r"(?i)mail|contact|write|reach|correo|courriel|schreib|kontakt",
    1: r"(?i)\bip\b|address|host|server|network|adresse|direcci",
    2: r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    3: r"(?i)tel|phone|call|fax|mobil|cell|sms|dial|ring|anruf|appel|llam",
}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, found): one row per document; found has a struct for each gap and match of each pattern."""
    kind = "array<struct<p:int,i:int,gap:int,m:string,left:string,right:string>>"
    none = F.array().cast(kind)
    found = F.concat(*[F.coalesce(F.when(F.expr(p.needs), _gaps(k, p.regex).cast(kind)), none) for k, p in enumerate(PATTERNS)])
    return docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "rid", found.alias("found"))


def _gaps(k: int, regex: str) -> Column:
    """For each match, and for the end: number, length and borders of the gap before it, and the match."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(0)), F.split("text", regex, -1))

    def one(z, i):
        m, gap = z["0"], z["1"]
        return F.struct(F.lit(k).alias("p"), i.alias("i"), F.length(gap).alias("gap"), m.alias("m"), F.right(gap, F.lit(AROUND)).alias("left"), F.left(gap, F.lit(AROUND)).alias("right"))

    return F.filter(F.transform(both, one), lambda c: (c["i"] > 0) | c["m"].isNotNull())


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn() -> Column:
    """Of the column ``digits``."""
    return F.expr(
        """aggregate(sequence(1, length(digits)), 0, (a, i) -> a + cast(
            case when i % 2 = 1 then int(substr(digits, -i, 1))
                 when int(substr(digits, -i, 1)) > 4 then 2 * int(substr(digits, -i, 1)) - 9
                 else 2 * int(substr(digits, -i, 1)) end as int)) % 10 = 0"""
    )


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def spans(table: DataFrame) -> DataFrame:
    """(rid, kind, base, start, end, m, votes v1..v4, features) of every candidate that passes its pattern's own checks."""
    rows = table.where(F.size("found") > 0).select("rid", F.explode("found").alias("c")).select("rid", "c.*")
    along = Window.partitionBy("rid", "p").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.coalesce(F.lead("right").over(along), F.lit(""))).where(F.col("m").isNotNull())
    of = lambda what: F.expr("case p " + " ".join(f"when {k} then {what(p)}" for k, p in enumerate(PATTERNS)) + " end")
    rows = rows.withColumns({"kind": of(lambda p: p.kind), "base": of(lambda p: str(p.base).lower()), "digits": _digits(F.col("m"))})
    rows = rows.withColumn("start", F.col("end") - F.length("m")).withColumn("n", F.length("digits"))
    fits = (
        F.when(~F.col("base") & (F.col("kind") != 2), True)
        .when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("m").rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
        .when(F.col("kind") == 2, F.col("n").between(13, 19) & (F.col("base") == (F.col("n") > 13)) & _luhn())
        .otherwise(F.col("n").between(10, 15))
    )
    rows = rows.where(F.coalesce(fits, F.lit(False)))
    # an added span gives way to base spans that it overlaps
    by_start = Window.partitionBy("rid").orderBy("start", "end")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_e": base_end, "_s": base_start}).where(F.col("base") | ((F.coalesce("_e", F.lit(-1)) <= F.col("start")) & (F.coalesce("_s", F.col("end")) >= F.col("end"))))
    return rows.select("rid", "kind", "base", "start", "end", *_votes())


def _votes() -> list[Column]:
    k, m, around = F.col("kind"), F.col("m"), F.concat_ws(" ", "left", "after")
    yes = lambda c: F.when(c, 1).otherwise(-1)
    tld = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    gazetteer = (
        F.when(k == 0, yes(tld.isin(*DOMAINS)))
        .when(k == 1, F.when(m.contains(":"), 0).otherwise(yes(~m.rlike(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."))))
        .when(k == 2, yes(F.col("digits").rlike(CARD_PREFIX)))
        .otherwise(yes(F.when(m.startswith("+"), F.col("digits").rlike(PHONE_PREFIX)).otherwise(F.col("digits").rlike(r"^(?:00[1-9]|[2-9][0-9]{2}[2-9])"))))
    )
    named = _named(around)
    glued = F.right("left", F.lit(1)).rlike("[A-Za-z0-9]") | F.left("after", F.lit(1)).rlike("[A-Za-z0-9]")
    form = (
        F.when(k == 0, yes(m.rlike(r"^[A-Za-z0-9]") & ~m.contains("..")))
        .when(k == 1, yes(~m.rlike(r"(?:^|[.:])0[0-9]")))
        .when(k == 2, yes(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{3,6}(?:\1[0-9]{3,6})+)$")))
        .otherwise(yes(m.rlike(r"[ ().-]") & ~m.rlike(r"[ .-]{2,}")))
    )
    # the regular expressions' own check: a base match has passed it, an added one must have a regular shape
    strict = (
        F.when(k == 0, m.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*\x20?(?:[\[({]\x20?at\x20?[\])}]|at)\x20?[a-z0-9-]+(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|dot)\x20?[a-z0-9-]+)*\x20?(?:[\[({]\x20?dot\x20?[\])}]|dot)\x20?[a-z]{2,}$"))
        .when(k == 1, m.rlike(r"^[23][0-9A-Fa-f]{3}:|^[Ff][CcDdEe]"))
        .when(k == 2, m.rlike(r"^[0-9]{13}$|^[0-9]{4}([ -])[0-9]{3}\1[0-9]{3}\1[0-9]{3}$"))
        .otherwise(m.rlike(r"^(?:00[1-9][0-9]{0,2}[ .-])?(?:\([2-9][0-9]{2}\)[ .-]|[2-9][0-9]{2}([ .-]))[2-9][0-9]{2}[ .-][0-9]{4}$"))
    )
    return [
        F.when(F.col("base"), 1).otherwise(yes(strict)).alias("v1"),
        gazetteer.alias("v2"),
        F.when(glued, -1).when(named, 1).otherwise(0).alias("v3"),
        form.alias("v4"),
        F.least(F.lit(3), F.floor(F.length(m) / 8)).cast("int").alias("size"),
    ]


def _named(around: Column) -> Column:
    out = F.lit(False)
    for i, r in WORDS.items():
        out = F.when(F.col("kind") == i, around.rlike(r)).otherwise(out)
    return out


# ---------------------------------------------------------------- model (on counts of vote patterns)


@dataclass
class Model:
    weights: dict[int, list[float]]  # of each kind: bias, then one weight for each feature

    def column(self) -> Column:
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            z = F.lit(w[0])
            for x, c in zip(_expand_columns(), w[1:], strict=True):
                z += x * c
            out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out


def _expand(v: tuple[int, ...], size: int) -> list[float]:
    return [float(x == s) for x in v for s in (1, -1)] + [float(size == s) for s in range(4)]


def _expand_columns() -> list[Column]:
    return [(F.col(f"v{j}") == s).cast("double") for j in range(1, 5) for s in (1, -1)] + [(F.col("size") == s).cast("double") for s in range(4)]


def em(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior that a candidate is personal data, for each vote pattern (+1, -1, 0 abstains).

    Each labeler has its own accuracy for true and for false candidates, with
    a Beta prior that it is mostly right; abstentions say nothing.
    """
    n = len(next(iter(counts), ()))
    right, wrong, share = [0.8] * n, [0.2] * n, 0.7  # chance of +1 for true, for false candidates
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in counts:
            a, b = math.log(share), math.log(1 - share)
            for j, x in enumerate(v):
                if x:
                    a += math.log(right[j] if x > 0 else 1 - right[j])
                    b += math.log(wrong[j] if x > 0 else 1 - wrong[j])
            post[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
        total = sum(counts.values())
        share = min(0.99, max(0.01, (sum(c * post[v] for v, c in counts.items()) + 7) / (total + 10)))
        for j in range(n):
            up_t = sum(c * post[v] for v, c in counts.items() if v[j] > 0)
            up_f = sum(c * (1 - post[v]) for v, c in counts.items() if v[j] > 0)
            all_t = sum(c * post[v] for v, c in counts.items() if v[j])
            all_f = sum(c * (1 - post[v]) for v, c in counts.items() if v[j])
            right[j], wrong[j] = (up_t + 8) / (all_t + 10), (up_f + 2) / (all_f + 10)
    return post


def train(found: DataFrame, rounds: int = 300, ridge: float = 1.0) -> Model:
    """EM per kind, then a logistic classifier on the posteriors; both on counted patterns."""
    rows = found.groupBy("kind", "v1", "v2", "v3", "v4", "size").count().collect()
    weights = {}
    for kind in range(len(KINDS)):
        mine = [((r.v1, r.v2, r.v3, r.v4), r["size"], r["count"]) for r in rows if r.kind == kind]
        counts: dict[tuple[int, ...], int] = {}
        for v, _, c in mine:
            counts[v] = counts.get(v, 0) + c
        post = em(counts)
        width = 1 + 12
        w, total = [0.0] * width, sum(c for *_, c in mine) or 1
        for _ in range(rounds):
            grad = [ridge * x / total for x in w]
            for v, size, c in mine:
                x = [1.0, *_expand(v, size)]
                p = 1 / (1 + math.exp(max(-30.0, min(30.0, -sum(a * b for a, b in zip(w, x, strict=True))))))
                for j, a in enumerate(x):
                    grad[j] += c * (p - post[v]) * a / total
            w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
        weights[kind] = w
    return Model(weights)


def find(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id and ``spans``, an array of (start, kind number, end, base) in order."""
    table = spill(candidates(docs), "candidates")
    found = spill(spans(table), "spans")
    model = train(found)
    kept = found.where(F.col("base") | (model.column() >= accept))
    per = kept.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "base"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return table.select("doc_id", "rid").join(per, "rid", "left").select("doc_id", F.coalesce(F.col("spans").cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"), none).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of base spans, all spans."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"

    def written(a: str) -> Column:
        return F.expr(f"array_join(transform({a}, s -> concat_ws(':', get({names}, s.kind), s.start, s.end)), ',')")

    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))
