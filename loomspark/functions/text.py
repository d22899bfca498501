"""Scalar text functions as Column expressions; all run inside the JVM unless the name says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of unified CJK ideographs, and of kana.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF66}-\x{FF9F}"
#: What a JavaScript-style trim removes.
JS_SPACE = r"[\x09-\x0D\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Fixed value: what counts as an identifier with several parts.
IDENTIFIER = r"[A-Za-z0-9]+(?:[._\-][A-Za-z0-9]+)+"
#: Words before a number that name a place in a text, not a model.
PROSE_LABELS = ("book", "chapter", "example", "figure", "item", "level", "page", "part", "phase", "point", "rule", "section", "step", "table", "version", "volume")
#: A version or a size in a name; a model's name and number written together, and apart.
VERSION_OR_SIZE = r"(?i)\b(v?\d+(?:\.\d+)*|\d+\.?\d*\s*[bm])\b"
MODEL_TOGETHER = r"(?i)(?<![a-z0-9])([a-z]{2,})([0-9][a-z]*)(?![a-z0-9])"
MODEL_APART = r"(?i)(?<![a-z0-9])([a-z]{2,})[\s._-]+([0-9][a-z]*)(?![a-z0-9])"


@F.pandas_udf(T.StringType())
def nfkc(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which the JVM functions lack."""
    for part in s:
        yield part.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unmarked(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks."""
    for part in s:
        yield part.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def folded(c: Column) -> Column:
    """NFKC only where there is anything to fold: ASCII texts stay in the JVM's columns as they are."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c)


def collapse(c: Column, to: str = " ") -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", to))


def concept_norm(c: Column, fold: bool = True) -> Column:
    """Name identity: folded, lower case, letters, digits and single spaces only."""
    c = folded(c) if fold else c
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w ]|_", ""))


def is_initialism(short: Column, full: Column) -> Column:
    """short is made of the first characters of full's words."""
    words = F.filter(F.split(full, r"[\s\-_]+"), lambda w: w != "")
    first = F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return (first != "") & (first == F.regexp_replace(F.lower(short), "[^a-z0-9]+", ""))


def without_initialism(c: Column) -> Column:
    """'Full Name (FN)' becomes 'Full Name'; other brackets stay."""
    pattern = r"^(.+?)\s*\(([A-Za-z0-9]+)\)\s*$"
    head, short = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when((short != "") & is_initialism(short, head), head).otherwise(c)


def seed_v1(c: Column, fold: bool = True) -> Column:
    """Concept seed: punctuation and separators become spaces."""
    c = F.lower(F.trim(without_initialism(folded(c) if fold else c)))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w+/ ]+", " "), r"[\s\-_]+", " "))


def seed_v2(c: Column, fold: bool = True) -> Column:
    """Concept seed: separators that the name has go first, then punctuation becomes spaces."""
    c = F.lower(F.trim(without_initialism(folded(c) if fold else c)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\s\-_]+", ""), r"(?U)[^\w+/ ]+", " "), r"\s+", " "))


def squash_key(c: Column, fold: bool = True) -> Column:
    return F.replace(seed_v2(c, fold), F.lit(" "), F.lit(""))


def statement_seed(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]+", ""))


def formula_seed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def steps_seed(names: Column) -> Column:
    """Order-free identity of a list of step names."""
    return F.array_join(F.array_sort(F.filter(F.transform(names, statement_seed), lambda x: x != "")), "|")


# Reasons a concept name is noise, in order, and the words that begin a reference to a place in a text.
NOISE_REASONS = ("too_short", "pure_number", "reference", "section_heading", "symbol", "instance_label")
REFERENCE_WORDS = ("fig", "figure", "table", "eq", "equation", "sec", "section")


def noise_reason(name: Column, listed: Column) -> Column:
    """Why a concept name is noise, or an empty text; listed names never are.

    A symbol is one word with a caret, or with an underscore beside a part of one character or none.
    """
    name = F.trim(F.coalesce(name, F.lit("")))
    number = F.split(F.regexp_extract(name, r"^(\S+)\s+[A-Z]", 1), r"\.")
    one_word = ~F.contains(name, F.lit(" "))
    short_part = F.contains(name, F.lit("_")) & F.exists(F.split(name, "_"), lambda part: F.length(part) <= 1)
    tests = (
        F.length(name) <= 2,
        ~name.rlike("[^0-9]"),
        F.lower(F.regexp_extract(name, r"^\w+", 0)).isin(*REFERENCE_WORDS) | name.rlike(r"^§\w"),
        (F.size(number) > 1) & F.forall(number, lambda part: part.rlike("^[0-9]+$")),
        one_word & (F.contains(name, F.lit("^")) | short_part),
        F.left(name, F.lit(1)).rlike("[A-Za-z]") & ~F.substr(name, F.lit(2)).rlike("[^0-9]"),
    )
    reason = F.coalesce(*[F.when(test, F.lit(told)) for test, told in zip(tests, NOISE_REASONS, strict=True)], F.lit(""))
    return F.when(listed, F.lit("")).otherwise(reason)


def variant_base(c: Column) -> Column:
    """The name's words without versions and sizes; null where it has none or under three characters are left."""
    words = lambda text: F.filter(F.split(F.lower(text), r"[\s\-_]+"), lambda w: w != "")
    left = words(F.regexp_replace(c, VERSION_OR_SIZE, " "))
    base = F.array_join(left, " ")
    return F.when((left != words(c)) & (F.length(base) >= 3), base)


def content_key(text: Column, ident: Column, fold: bool = True) -> Column:
    """Identity of a text within its source; an empty text is only itself."""
    key = collapse(F.lower(folded(text) if fold else text))
    return F.coalesce(F.nullif(key, F.lit("")), ident.cast("string"))


def spaced_terms(c: Column) -> Column:
    """A space between letters and digits that touch."""
    return F.regexp_replace(c, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")


def identifiers(c: Column, most: int = 16) -> Column:
    """Distinct joined identifiers of four characters or more with a letter, in order."""
    found = F.filter(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)), lambda x: F.length(x).between(4, 256) & x.rlike("[A-Za-z]"))
    return F.slice(F.array_distinct(found), 1, most)


def exact_probes(c: Column) -> Column:
    """Identifiers specific enough for a search of their own."""
    return F.filter(identifiers(c), lambda x: x.rlike("[_.0-9]"))


def model_aliases(c: Column) -> Column:
    """'gpt4' for 'gpt 4' and the other way round, but not for 'chapter 4'."""

    def respelled(pattern: str, between: str) -> Column:
        stems, numbers = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2))
        kept = F.arrays_zip(stems.alias("stem"), numbers.alias("number"))
        if not between:
            kept = F.filter(kept, lambda x: ~F.lower(x["stem"]).isin(*PROSE_LABELS))
        return F.transform(kept, lambda x: F.concat_ws(between, x["stem"], x["number"]))

    return F.concat(respelled(MODEL_TOGETHER, " "), respelled(MODEL_APART, ""))


def cjk_grams(c: Column, n: int = 3) -> Column:
    """Runs of ideographs of n characters or more, and their n-grams."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.length(r) >= n)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda k: F.substr(r, k, F.lit(n)))))
    return F.array_distinct(F.concat(runs, grams))


def word_terms(c: Column) -> Column:
    """Distinct runs of letters and digits, three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(rf"(?U)[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0)), lambda w: F.length(w) >= 3))


def recall_terms(c: Column, most: int = 64, reserve: int = 8) -> Column:
    """Terms of a query: the sentence, identifiers, model names, words, ideograph runs and grams; ideographs keep `reserve` places."""
    sentence = F.when(F.length(F.trim(c)).between(3, 256), F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.filter(F.concat(sentence, identifiers(c), model_aliases(c), word_terms(c), cjk_grams(c)), lambda t: F.length(t) >= 3))
    ideographs = F.filter(every, lambda t: t.rlike(f"[{CJK}]"))
    others = F.filter(every, lambda t: ~t.rlike(f"[{CJK}]"))
    kept = F.least(F.size(ideographs), F.greatest(F.lit(reserve), F.lit(most) - F.size(others)))
    return F.when(F.length(F.trim(c)) < 3, F.array().cast("array<string>")).otherwise(F.concat(F.slice(others, F.lit(1), F.lit(most) - kept), F.slice(ideographs, F.lit(1), kept)))


def gated_terms(terms: Column, languages: Column, head: Column) -> Column:
    """Terms without those a corpus of known languages cannot hold; the first `head` stay whatever they are."""
    drop = (F.size(languages) > 0) & ~F.array_contains(languages, "zh")
    return F.when(drop, F.filter(terms, lambda t, i: (i < head) | ~t.rlike(f"^[{CJK}]+$"))).otherwise(terms)


def quoted_phrases(c: Column, least: int = 3, longest: int = 256, most: int = 4) -> Column:
    """Distinct quoted spans that are neither too short nor too long."""
    found = F.filter(F.regexp_extract_all(c, F.lit(r'"([^"]+)"|\x{201C}([^\x{201D}]+)\x{201D}'), F.lit(0)), lambda x: (F.length(x) - 2).between(least, longest))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(2), F.length(x) - 2))), 1, most)


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def language(c: Column) -> Column:
    """zh from 30 % ideographs without kana, en from half ASCII letters, else other; white space does not count."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "")
    count = lambda what: F.length(bare) - F.length(F.regexp_replace(bare, f"[{what}]", ""))
    total = F.length(bare)
    return F.when(total == 0, "other").when((count(KANA) == 0) & (count(CJK) >= 0.3 * total), "zh").when(count("A-Za-z") >= 0.5 * total, "en").otherwise("other")


def head_of(c: Column, *marks: str) -> Column:
    """What stands before the first of the service marks."""
    for m in marks:
        c = F.substring_index(c, m, 1)
    return F.trim(c)


def without_images(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""))


def node_name(c: Column, longest: int = 40) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substr(c, F.lit(1), F.lit(longest - 1)), F.lit("…"))).otherwise(c)


def value_key(c: Column, longest: int = 80) -> Column:
    """Case, white space and punctuation do not tell values apart; long ones are hashed."""
    key = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", "")
    return F.when(F.length(key) > longest, F.sha2(key, 256)).otherwise(key)


def row_title(cells: Column, first: int = 3, longest: int = 16) -> Column:
    some = F.slice(F.filter(F.transform(cells, lambda x: F.trim(x)), lambda x: x != ""), 1, first)
    return F.array_join(F.transform(some, lambda x: F.substr(x, F.lit(1), F.lit(longest))), " / ")


def column_kind(name: Column) -> Column:
    """The kind a column's heading suggests."""
    n = F.lower(name)
    return (
        F.when(n.rlike(r"(^|_)(id|key|code|no)$|key$"), "anchor")
        .when(n.rlike("date|time|^ts$"), "date")
        .when(n.rlike("price|qty|quantity|amount|bal|size|value|tax|discount|chars|number"), "number")
        .when(n.rlike("url|link|html"), "link")
        .otherwise("text")
    )


def grounding_norm(c: Column) -> Column:
    """Letters and digits only, marks stripped, lower case."""
    plain = F.when(c.rlike(r"[^\x00-\x7F]"), unmarked(c)).otherwise(c)
    return F.regexp_replace(F.lower(plain), r"(?U)[^\p{L}\p{N}]+", "")


def probe_tags(c: Column) -> Column:
    """Shapes that suspicious names have."""
    tag = lambda cond, name: F.when(cond, F.lit(name))
    return F.filter(
        F.array(
            tag(c.rlike(r"[\^_{}\\=<>]"), "symbol"),
            tag(c.rlike(r"(?i)^(fig|figure|table|eq|equation|sec|section)\b"), "reference"),
            tag(c.rlike(r"(?i)^\d+(\.\d+)?\s*(%|mm|cm|kg|ms|hz|v|a|w)?$"), "quantity"),
            tag(c.rlike(r"^[A-Za-z]+\d+$|^[a-z]+_[a-z_0-9]+$"), "code"),
            tag(F.length(c) <= 2, "short"),
        ),
        lambda x: x.isNotNull(),
    )


def digit_mask(c: Column) -> Column:
    """Numbers, Arabic or Roman, become one sign, so that enumerated names meet."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), r"\b[ivx]+\b", "#")


def loose(c: Column) -> Column:
    """Trimmed, unquoted, single-spaced, lower case."""
    return collapse(F.lower(F.regexp_replace(F.trim(c), r"^[\"'\x{201C}\x{201D}]+|[\"'\x{201C}\x{201D}]+$", "")))


def equivalent(a: Column, b: Column, least: int = 4) -> Column:
    """Equal loosely, or one holds the other and that one is long enough."""
    x, y = loose(a), loose(b)
    return (x == y) | ((F.least(F.length(x), F.length(y)) >= least) & (F.contains(x, y) | F.contains(y, x)))


def jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def leakage(question: Column, source: Column) -> Column:
    """Share of the question's tokens that the source holds."""
    q = F.array_distinct(question)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, source)) / F.size(q))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))


def iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    both = overlap(a1, a2, b1, b2)
    whole = (a2 - a1) + (b2 - b1) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def parsed_time(c: Column) -> Column:
    """UTC time of a text; text without a zone is UTC, what cannot be read is null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def tolerant_array(c: Column, element: str = "string") -> Column:
    """A JSON array, or an empty one for anything else."""
    return F.coalesce(F.when(c.rlike(r"^\s*\["), F.from_json(c, f"array<{element}>")), F.array().cast(f"array<{element}>"))


def hashed_id(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in cols]), 256), 1, 16))


def index_digits(c: Column) -> Column:
    """How many digits the index at an id's end has."""
    return F.length(F.regexp_extract(c, r"-(\d+)[^-]*$", 1))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}|{JS_SPACE}$", "")


def group_path(crumb: Column, term: Column) -> Column:
    """The shortest prefix of a breadcrumb that holds the term, else the whole."""
    parts = F.split(crumb, " > ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " > "))
    return F.coalesce(F.try_element_at(F.filter(prefixes, lambda p: F.contains(F.lower(p), F.lower(term))), F.lit(1)), crumb)


def citation_keys(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[([A-Z]\d+)\]"), F.lit(1))


def defused_citations(c: Column) -> Column:
    """Look-alikes of citation marks in quoted text, made harmless."""
    return F.regexp_replace(c, r"\[([A-Z]\d+)\]", "($1)")


def like_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def word_match(text: Column, term: Column) -> Column:
    """Short ASCII terms need free edges (a plural s is allowed); longer ones are searched as they are."""
    short = term.rlike(r"^[A-Za-z0-9]{1,4}$")
    escaped = F.regexp_replace(F.lower(term), r"([^A-Za-z0-9])", r"\\$1")
    edged = F.regexp(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), escaped, F.lit("s?(?![a-z0-9])")))
    return F.when(text.isNull() | term.isNull(), F.lit(None).cast("boolean")).when(short, edged).otherwise(F.contains(F.lower(text), F.lower(term)))


def boundary_hit(alias: Column, text: Column) -> Column:
    """The alias occurs with no ASCII letter or digit on either side."""
    escaped = F.regexp_replace(alias, r"([^A-Za-z0-9\s])", r"\\$1")
    return F.regexp(text, F.concat(F.lit("(?<![a-zA-Z0-9])"), escaped, F.lit("(?![a-zA-Z0-9])")))


def preview(c: Column, longest: int = 200) -> Column:
    """Markdown as plain text, cut at the last sentence end that fits."""
    plain = c
    for pattern, to in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"[*_`>]+", ""), (r"\s+", " ")):
        plain = F.regexp_replace(plain, pattern, to)
    plain = F.trim(plain)
    cut = F.substr(plain, F.lit(1), F.lit(longest))
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(plain) <= longest, plain).when(sentence != "", sentence).otherwise(cut)
