"""Personal data spans, in DataFrame functions only.

Regular expressions propose spans; validators (part ranges, digit counts, Luhn, mod 97) confirm them; words in the 40
characters before or after a span adjust its score. Four base kinds (email, ip, card, phone) are kept on validation alone. Two
more kinds are proposed: iban (mod 97) and ssn, which has no checksum and so needs a context word to reach the threshold.

Members of a list share their context, however long the list: what stood before the last member holds for the next one, unless
more than 40 characters or a new clause with words of its own ('ssn 1...; id 2...') come between. Words after a span, or after
the list it stands in (as far as 60 characters on), count within its clause, unless a number follows, whose label they are.

An iban is proposed by its first four characters only, so that what follows it can not be taken into it: its end is the one at
its country's length if mod 97 holds there, else the last end of a token where it holds.

Positions come without any row-at-a-time code: split() and regexp_extract_all() walk the same leftmost non-overlapping
matches, so the lengths of the pieces between matches and of the matches themselves add up to code-point offsets.

Edge cases: null and empty texts have no spans; texts are searched whole; rows are independent, so repeated rows repeat their
result and an empty table gives an empty one; only the id and text columns are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import text_or_empty

# Possessive forms and anchors at run starts keep each search linear in the text; they match the same spans as the plain
# forms, because a match can only begin where a run of its first class begins or where the previous match has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A text without this cannot hold a span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.25, 0.5
#: Characters after a match that can matter: the rest of an iban with a space before each character, a list, the context after it.
AHEAD_CHARS = 60 + 60 + CONTEXT_CHARS
AHEAD_MATCHES = AHEAD_CHARS // 3 + 2
#: What may stand between two members of a list, and between a span and words after it; {0} are the words.
LIST_GAP = r"^(?:\P{L}{0,40}|[^.;:!?\n]{0,40})$"
WORDS_AFTER = r"^(?:[^\p{{L}}.;:!?\n]|\b(?:and|or)\b){{0,60}}+[^.;:!?\n0-9]{{0,40}}?(?:{0})(?!\w*\W{{0,5}}[0-9])"
#: Lengths of ISO 13616, by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO",
        16: "BE",
        18: "DK FI FK FO GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        32: "LC",
        33: "RU",
    }.items()
    for c in countries.split()
}


@dataclass(frozen=True)
class Weight:
    """score of a validated span, and the words that raise it when they stand near it"""

    score: float
    words: str


WEIGHTS = {
    "email": Weight(0.7, r"mail|contact|write|reach"),
    "ip": Weight(0.6, r"\bip\b|address|host|server"),
    "card": Weight(0.75, r"card|visa|credit|pay"),
    "phone": Weight(0.6, r"phone|tel|call|mobile|fax"),
    "iban": Weight(0.75, r"iban|bank|account|konto|compte|cuenta"),
    "ssn": Weight(0.4, r"ssn|social|security"),
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """The Luhn sum of the digits in m is a multiple of ten: every second digit from the right counts double, less nine if over nine."""
    digits = F.split(F.reverse(_digits(m)), "")
    value = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(m: Column) -> Column:
    """The account number m, its first four characters moved to the end and letters read as 10..35, leaves 1 modulo 97."""
    flat = F.regexp_replace(m, r"\x20", "")
    moved = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    values = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _iban_rest(head: Column, ahead: Column) -> Column:
    """How many of the characters ahead belong to the account number that begins with head; null if there is none."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def ends(run: Column) -> Column:
        at_end = lambda n: (F.substr(run, n, F.lit(1)) != " ") & ~F.substr(ahead, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        flat = lambda n: F.length(F.regexp_replace(F.left(run, n), r"\x20", "")) + 4
        holds = F.filter(F.sequence(F.lit(11), F.length(run)), lambda n: at_end(n) & (flat(n) >= 15) & mod97(F.concat(head, F.left(run, n))))
        at_length = lambda ok: F.array_max(F.filter(ok, lambda n: flat(n) == F.try_element_at(lengths, F.left(head, F.lit(2)))))
        return _let(holds, lambda ok: F.coalesce(at_length(ok), F.array_max(ok)))

    return _let(F.regexp_extract(ahead, r"^(?:\x20?[A-Z0-9]){11,30}", 0), lambda run: F.when(run != "", ends(run)))


SPAN = "array<struct<kind:string,s:int,e:int,score:double>>"
#: Items that are cut out of a text's matches, and whose results are gathered, together: slices and concatenations copy whole
#: arrays, so one for each match would cost the square of their number.
BLOCK = 256


def _blocks(items: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int"))


def _block(items: Column, k: Column, more: int = 0) -> Column:
    return F.slice(items, k * BLOCK + 1, F.lit(BLOCK + more))


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: kind, start, end (code points, end exclusive), score."""
    pattern, weight = PATTERNS[kind], WEIGHTS[kind]
    walked = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def ahead(walk: Column, at: Column) -> Column:
        """The text after match number `at` of a block; a match and the gap before it have three characters at least, or the gap is the first."""
        parts = F.transform(F.slice(walk, at + 1, F.lit(AHEAD_MATCHES)), lambda x: F.concat(F.left(x["gap"], F.lit(AHEAD_CHARS)), F.coalesce(F.left(x["m"], F.lit(AHEAD_CHARS)), F.lit(""))))
        return F.left(F.array_join(parts, ""), F.lit(AHEAD_CHARS))

    def step(walk: Column, acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        before = F.lower(F.right(x["gap"], F.lit(CONTEXT_CHARS))).rlike(weight.words) | (acc["near"] & x["gap"].rlike(LIST_GAP))

        def judged(after: Column) -> Column:
            rest = _iban_rest(x["m"], after) if kind == "iban" else F.lit(0)
            near = lambda n: before | F.lower(F.substr(after, n + 1)).rlike(WORDS_AFTER.format(weight.words))
            return _let(rest, lambda n: F.when(n.isNotNull(), F.struct((stop + n).alias("e"), near(n).alias("near"))))

        valid = (start >= acc["e"]) & _valid(kind, x["m"])

        def moved(v: Column) -> Column:
            score = F.round(F.lit(weight.score) + F.when(v["near"], CONTEXT_BONUS).otherwise(0.0), 2)
            keep = v.isNotNull() & (F.lit(True) if kind in BASE else score >= THRESHOLD)
            found = F.struct(F.lit(kind).alias("kind"), start.alias("s"), v["e"].alias("e"), score.alias("score"))
            return F.struct(
                (acc["n"] + 1).alias("n"),
                stop.alias("at"),
                F.greatest(acc["e"], v["e"]).alias("e"),
                F.coalesce(v["near"], before).alias("near"),
                F.when(keep, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).cast(SPAN).alias("found"),
            )

        return F.when(x["m"].isNull(), acc).otherwise(_let(F.when(valid, _let(ahead(walk, acc["n"] + 1), judged)), moved))

    none = F.array().cast(SPAN)
    def block(walk: Column, acc: Column, k: Column) -> Column:
        kept = ("at", "e", "near")
        start = F.struct(F.lit(0).alias("n"), *[acc[c].alias(c) for c in kept], none.alias("found"))
        done = _let(_block(walk, k, AHEAD_MATCHES), lambda wide: F.aggregate(F.slice(wide, F.lit(1), F.lit(BLOCK)), start, lambda a, x: step(wide, a, x)))
        return _let(done, lambda d: F.struct(*[d[c].alias(c) for c in kept], F.concat(acc["found"], F.array(d["found"])).alias("found")))

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("e"), F.lit(False).alias("near"), F.array().cast(f"array<{SPAN}>").alias("found"))
    all_spans = _let(walked, lambda walk: F.aggregate(_blocks(walk), first, lambda acc, k: block(walk, acc, k), lambda acc: F.flatten(acc["found"])))
    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(may, all_spans).otherwise(none)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, per kind, its array of spans."""
    return docs.select(F.col(id_col), *[spans_of(k, text_or_empty(text_col)).alias(k) for k in KINDS])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by <KIND>; of overlapping spans the first decides the name and all are covered.

    A null text stays null. All columns keep their names and order.
    """
    text = text_or_empty(text_col)
    order = lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["e"] > b["e"], -1).when(a["e"] < b["e"], 1).otherwise(0)
    found = F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS]), order)

    none = F.array().cast("array<string>")

    def block(acc: Column, some: Column) -> Column:
        """The text from the last span's end to the end of this block's spans is cut once, and spans are replaced in that."""
        stop = F.greatest(acc["at"], F.array_max(F.transform(some, lambda x: x["e"])))

        def replaced(part: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                before = F.substr(part, a["at"] - acc["at"] + 1, x["s"] - a["at"])
                fresh = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(before, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).alias("out"))
                return F.when(x["s"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

            return F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)

        done = _let(F.substr(text, acc["at"] + 1, stop - acc["at"]), replaced)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    clean = _let(found, lambda spans: F.aggregate(_blocks(spans), start, lambda acc, k: _let(_block(spans, k), lambda some: block(acc, some)), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))))
    return docs.select(*[F.when(F.col(c).isNotNull(), clean).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans as text."""
    told = lambda kinds: F.array_join(F.transform(F.concat(*map(F.col, kinds)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return find_spans(docs, id_col, text_col).select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(BASE), 256).alias("base_sha256"),
        told(KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.concat(*map(F.col, KINDS)), lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )
