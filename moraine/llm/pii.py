"""Personal data by patterns, check sums and context (operator 7), in DataFrame functions only.

Patterns propose spans; check sums (Luhn for cards, mod 97 for IBANs), ranges and mixed characters confirm
them; context words within ``NEAR`` characters before a span raise its score.  A span's
place comes from two readings of the same leftmost matches: what matches, and what lies
between matches.  Patterns start only where a run of their characters starts or where the
last match ended, and take runs whole, so that long runs cost no more than their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import ids_and_text

NEAR = 40
#: Score of a span that is confirmed, and what a context word adds.
THRESHOLD = 0.5
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind -> (pattern, what a text must hold for the pattern to be tried, context words, score of a match, added by context).
KINDS: dict[str, tuple[str, str, str, float, float]] = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@", r"mail|contact|write", 0.9, 0.1),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|host|server|address", 0.7, 0.3),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", r"card|visa|credit|pay", 0.8, 0.2),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|tel|call|mobile", 0.7, 0.3),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", r"iban|account|bank|konto", 0.8, 0.2),
    "ssn": (r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "-", r"ssn|social|security", 0.3, 0.4),
    "secret": (r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/.-])", "", r"token|secret|key|passw|pwd|bearer|auth|credential", 0.3, 0.4),
}
#: Beginnings of keys that tell a secret without context.
ISSUED = "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|xox[abprs]-|AIza|eyJ)"
BASE = ("email", "ip", "card", "phone")
_SPAN = "array<struct<begin:int,end:int,found:string,near:string>>"
#: Matches that are placed one after another before their places are put together.
_BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right counts twice, less 9 if over 9."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    one = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(twice(F.try_to_number(c, F.lit("9")).cast("int"))))
    return F.coalesce(F.aggregate(one, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))), F.lit(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, leaves 1."""
    bare = F.regexp_replace(iban, "\x20", "")
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (a * 100 + letter) % 97).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise(a)

    return F.aggregate(turned, F.lit(0), step) == 1


def _confirmed(kind: str, x: Column) -> Column:
    found = x["found"]
    if kind == "ip":  # parts at most 255, leading zeros apart
        return found.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "secret":  # letters and digits in many different characters, no name in words
        return (F.length(F.regexp_replace(found, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(found, "[^A-Za-z]", "")) >= 3) & (F.size(F.array_distinct(F.split(found, ""))) >= 10)
    return F.lit(True)


def _bound(value: Column, then) -> Column:
    """then(value) with the value worked out once, also where lambdas use it again and again."""
    return F.get(F.transform(F.array(value), then), 0)


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap, found, after) of the leftmost matches of a kind that do not overlap: the text since the match before, the match, and the text up to the next."""
    pattern = KINDS[kind][0]
    between = lambda gaps: F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("after")
    )
    return _bound(F.split(text, pattern, -1), between)


def _placed(matches: Column) -> Column:
    """Array of (begin, end, found, near) for the matches, ends exclusive, in code points.

    An array grows by copying, so blocks of matches are placed first and then put together.
    """

    def add(acc: Column, x: Column) -> Column:
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(NEAR))  # what stands before, other matches included
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        near = F.concat(before, F.lit("\n"), F.left(x["after"], F.lit(NEAR)))
        one = F.struct(begin.alias("begin"), end.alias("end"), x["found"].alias("found"), near.alias("near"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["found"]), F.lit(NEAR)).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), F.array().cast(_SPAN).alias("out"))
        done = lambda end: F.struct(end["at"].alias("at"), end["tail"].alias("tail"), F.concat(acc["out"], F.array(end["out"])).alias("out"))
        return F.aggregate(xs, start, add, done)

    blocks = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int")), lambda k: F.slice(m, k * _BLOCK + 1, F.lit(_BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return _bound(matches, lambda m: F.when(F.size(m) > 0, F.flatten(F.aggregate(blocks(m), start, block, lambda acc: acc["out"]))).otherwise(F.array().cast(_SPAN)))


def _likely(text: Column, kind: str) -> Column:
    pattern, must, _, _, _ = KINDS[kind]
    return text.rlike(pattern) if not must else text.contains(must) & text.rlike(pattern)


def spans(text: Column, kind: str) -> Column:
    """Array of (begin, end, found, near): leftmost matches of a kind that do not overlap, ends exclusive, in code points."""
    return F.when(_likely(text, kind), _placed(_matches(text, kind))).otherwise(F.array().cast(_SPAN))


def _score(kind: str, x: Column) -> Column:
    _, _, words, base, more = KINDS[kind]
    own = F.when(x["found"].rlike(ISSUED), F.lit(0.8)).otherwise(F.lit(base)) if kind == "secret" else F.lit(base)
    return F.least(F.lit(1.0), own + F.when(F.lower(x["near"]).rlike(words), F.lit(more)).otherwise(F.lit(0.0)))


def find(docs: DataFrame, threshold: float = THRESHOLD, kinds: tuple[str, ...] = tuple(KINDS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, an array of (begin, end, found, near, score) of confirmed spans.

    Spans of the kinds in BASE stay whatever their score; of the others those at or over the
    threshold.  A null text is empty and has none.  Every row gives a row.
    """
    source = ids_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    out = source.select("doc_id", *(spans(F.col("text"), k).alias(k) for k in kinds))

    def kept(k: str) -> Column:
        scored = F.transform(F.filter(k, lambda x: _confirmed(k, x)), lambda x: x.withField("score", _score(k, x)))
        return scored if k in BASE else F.filter(scored, lambda x: x["score"] >= threshold)

    return out.select("doc_id", *(kept(k).alias(k) for k in kinds))


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["begin"].cast("string"), x["end"].cast("string")))


def report(docs: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """A row for every row of ``docs``, repeated ones included.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:begin:end,
    comma-joined), and scores, those of the spans in the same order.  A null or empty text has
    no spans, and a text of any length is read whole.
    """
    found = find(docs, threshold, **columns)
    base = F.concat_ws(",", F.flatten(F.array(*(_listed(k) for k in BASE))))
    every = F.concat_ws(",", F.flatten(F.array(*(_listed(k) for k in KINDS))))
    scores = F.concat_ws(",", F.flatten(F.array(*(F.transform(k, lambda x: F.round(x["score"], 2).cast("string")) for k in KINDS))))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), scores.alias("scores"))


def _replaced(kind: str, threshold: float):
    """What turns matches of a kind into a text with the spans that stay replaced, without what follows the last."""
    keeps = lambda x: _confirmed(kind, x) & (F.lit(kind in BASE) | (_score(kind, x) >= threshold))
    piece = lambda x: F.concat(x["gap"], F.when(keeps(x["span"]), F.lit(f"[{kind}]")).otherwise(x["span"]["found"]))
    return lambda m: F.array_join(F.transform(F.arrays_zip(m["gap"].alias("gap"), _placed(m).alias("span")), piece), "")


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, all rows and columns kept.

    Kinds are replaced in turn, so of spans that overlap the first kind counts.  A null text
    stays null.
    """
    out = docs
    for k in KINDS:
        text = F.coalesce(F.col(text_col), F.lit(""))
        rest = F.element_at(F.split(text, KINDS[k][0], -1), -1)
        changed = F.when(_likely(text, k), F.concat(_bound(_matches(text, k), _replaced(k, threshold)), rest)).otherwise(text)
        out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), changed))
    return out
