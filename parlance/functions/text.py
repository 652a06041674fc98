"""Column functions on text. All are native expressions; null text gives null."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L

#: White space as a regular-expression class that Java and RE2 read alike.
W = r"[\t-\r\x1c-\x20\x85\xa0\p{Z}]"
#: A character inside a word.
C = r"[\p{L}\p{N}_]"
_PRINTED = string.ascii_letters + string.digits + string.punctuation
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


#: Marks and what the synthesizer reads for them, in this order.
PLAIN_MARKS = (
    ("...", ", "), ("…", ", "), (":", ","), (" - ", ", "), (";", ", "), ("—", "-"), ("–", "-"), (" ,", ","), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"),
)
#: What is tidied after the sound-word rules, in this order.
TIDY = (
    ("([a-z])([A-Z])", "$1 $2"), (f"(?:(?:,|{W})+,)+", ","), (f",{W}*,+", ","), (f"{W}{{2,}}", " "), (f"{W}+,|,{W}+", ", "), (rf"(^|[.!?]{W}*),+", "$1"), (rf",+{W}*([.!?])", "$1"),
)


def let(value: Column, body) -> Column:
    """body(value), value evaluated once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{W}+|{W}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    # a blank that stands alone is no match (most do), and Java tests listed characters faster than classes
    return F.trim(F.regexp_replace(c, f"(?=[^{re.escape(_PRINTED)}])(?:[{W[1:-1]}&&[^ ]]{W}*| {W}+)", " "))


def to_lower(c: Column) -> Column:
    return F.lower(c)


def normalize_ws(c: Column) -> Column:
    """Strips, and makes runs of two or more white-space characters one blank."""
    return F.regexp_replace(strip(c), f"{W}{{2,}}", " ")


def dot_letters(c: Column) -> Column:
    """`J.R.R.` to `J R R`."""
    marked = F.regexp_replace(c, rf"(?:\G(?!^)|(?<!{C})(?=(?:[A-Za-z]\.){{2}}))([A-Za-z])\.", "$1\x01")
    return F.regexp_replace(F.regexp_replace(marked, "\x01(?=[A-Za-z]\x01)", " "), "\x01", "")


def strip_ref_numbers(c: Column) -> Column:
    """Drops digits that stand after sentence punctuation and before white space or the end."""
    return F.regexp_replace(c, rf"([.!?,\"'”’)\]])\d+(?={W}|$)", "$1")


def punc_norm(c: Column) -> Column:
    """The synthesizer's punctuation form: capital first, plain quotes and dashes, an end mark."""
    head = F.substring(c, 1, 1)
    c1 = F.when(head != F.upper(head), F.concat(F.upper(head), F.substring(c, 2, 2**31 - 1))).otherwise(c)
    out = squeeze(c1)
    for old, new in PLAIN_MARKS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.rtrim(out)
    ended = F.when(out.rlike("[.!?,-]$"), out).otherwise(F.concat(out, F.lit(".")))
    return F.when(c == "", F.lit("You need to add some text for me to talk.")).otherwise(ended)


def speakable(c: Column) -> Column:
    """A reply without hidden thoughts, emphasis marks, bracketed asides and laughs."""
    c = F.regexp_replace(c, "(?s)<think>.*?</think>", "")
    return squeeze(F.regexp_replace(c, r"[*_#`]|\[[^\n]*?\]|\(laughs?\)", " "))


def _tree(words: Sequence[str]) -> str:
    """A pattern of these words that share their beginnings."""
    first = sorted({w[0] for w in words if w})
    ways = [c + _tree([w[1:] for w in words if w.startswith(c)]) for c in first]
    return "" if not ways else f"(?:{'|'.join(ways)}){'?' if '' in words else ''}"


def _canon_pattern() -> str:
    """Every known respelling as a whole word; its first letter is looked for before all else."""
    first = "".join(sorted({w[0] for w in L.RESPELLINGS}))
    return f"(?=[{first}{first.upper()}])(?<!{C})(?i){_tree(list(L.RESPELLINGS))}(?!{C})"


def canonicalize(c: Column) -> Column:
    """Known respellings back to ordinary words, whole words, any case."""
    parts = F.regexp_extract_all(c, F.lit(f"({C}+|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in L.RESPELLINGS.items() for x in kv])
    word = lambda w: F.when(F.lower(w).isin(*L.RESPELLINGS), F.element_at(table, F.lower(w))).otherwise(w)
    changed = F.array_join(F.transform(parts, word), "")
    return F.when(c.rlike(_canon_pattern()), changed).otherwise(c)


def compare_form(c: Column) -> Column:
    """Lower-case words without punctuation, for comparing target and transcript."""
    c = canonicalize(c)
    for dash in "–—-":
        c = F.replace(c, F.lit(dash), F.lit(" "))
    return F.lower(squeeze(F.regexp_replace(c, PUNCTUATION, "")))


def num_words(n: Column) -> Column:
    """English words of an integer up to 999,999; larger ones digit by digit."""
    ones, tens = F.array(*[F.lit(x) for x in L.ONES]), F.array(*[F.lit(x) for x in L.TENS])
    n = n.cast("long")
    part = lambda q: F.floor(q).cast("int")

    def to_99(v):
        rest = v % 10
        return F.when(v < 20, F.get(ones, v.cast("int"))).otherwise(F.concat(F.get(tens, part(v / 10) - 2), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), F.get(ones, rest.cast("int"))))))

    def to_999(v):
        rest = v % 100
        return F.when(v < 100, to_99(v)).otherwise(F.concat(F.get(ones, part(v / 100)), F.lit(" hundred"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), to_99(rest)))))

    rest = n % 1000
    thousands = F.concat(to_999(F.floor(n / 1000)), F.lit(" thousand"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), to_999(rest))))
    digits = F.array_join(F.transform(F.filter(F.split(n.cast("string"), ""), lambda d: d != ""), lambda d: F.get(ones, d.try_cast("int"))), " ")
    return F.when(n < 1000, to_999(n)).when(n < 1000000, thousands).otherwise(digits)


def norm_words(c: Column) -> Column:
    """Lower-case ASCII words with numbers spelt out."""
    # Java tests listed letters by one look-up, ranges one by one
    kept = lambda t: F.regexp_replace(t, f"[^{string.ascii_lowercase}{string.digits}' ]+", " ")

    def spelt(t):
        t = F.regexp_replace(kept(F.regexp_replace(t, r"(\d),(\d)", "$1$2")), r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")
        parts = F.regexp_extract_all(t, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
        return F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[0-9]+$"), F.coalesce(num_words(w.try_cast("long")), w)).otherwise(w)), "")

    return let(F.lower(c), lambda t: squeeze(F.when(t.rlike("[0-9]"), spelt(t)).otherwise(kept(t))))


def selection_form(c: Column) -> Column:
    """Text without quote marks and backslashes, for finding a selection."""
    return F.lower(squeeze(F.regexp_replace(c, "[\"'“”‘’«»\\\\]", "")))


def split_sentences(c: Column) -> Column:
    """Sentences: after . ! ? and white space. Never empty: blank text gives its stripped form."""
    parts = F.filter(F.split(strip(c), f"(?<=[.!?]){W}+"), lambda s: s.rlike(f"[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\p{{Z}}]"))
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(c))))


def split_sentences_abbr(c: Column) -> Column:
    """Sentences whose end may carry quotes or brackets, not broken after known abbreviations."""
    kept = F.regexp_replace(c, rf"(?i)(?<!{C})({L.ABBREVIATIONS})\.([\"'”’»)]*)({W}+)", "$1\x02$2$3")
    marked = F.regexp_replace(kept, rf"([.!?][\"'”’»)]*){W}+", "$1\x03")
    return F.filter(F.transform(F.split(marked, "\x03"), lambda s: strip(F.replace(s, F.lit("\x02"), F.lit(".")))), lambda s: s != "")


def has_word(c: Column) -> Column:
    return c.rlike(C)


def parse_rules(c: Column) -> Column:
    """Lines `a=>b` or `a` to an array of (pattern, replacement)."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def rule(x):
        has = F.locate("=>", x)
        return F.struct(
            F.when(has > 0, strip(F.substring(x, F.lit(1), has - 1))).otherwise(x).alias("pattern"),
            F.when(has > 0, strip(F.substring(x, has + 2, F.length(x)))).otherwise("").alias("replacement"),
        )

    return F.transform(lines, rule)


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Sound-word rules in order, then the clean-up of commas and blanks."""
    for pattern, new in rules:
        p, r = re.escape(pattern), new.replace("\\", "\\\\").replace("$", "\\$")
        if not new:
            c = F.regexp_replace(c, f"(?i){p}", "")
            continue
        c = F.regexp_replace(c, f"(?i){p}[’']s?", r + "'s")
        c = F.regexp_replace(c, f"(?i)([\"']){p}([\"'])", f"$1{r}$2")
        if all(x in "-–—" for x in pattern.strip()):
            c = F.regexp_replace(c, p, r)
        else:
            c = F.regexp_replace(c, f"(?i)(?<!{C}){p}(?!{C})", r)
    for pattern, new in TIDY:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def name_shaped(c: Column) -> Column:
    """Up to three capitalised tokens that can be a person's name."""
    tokens = F.filter(F.split(c, f"{W}+"), lambda t: t != "")
    low = F.lower(c)

    def good(t):
        core = F.regexp_replace(F.regexp_replace(t, r"\.+$", ""), "s+$", "")
        return t.rlike(r"^[A-Z][A-Za-z'’-]*\.?$") & ~((F.length(core) >= 2) & (core == F.upper(core)) & core.rlike("[A-Z]"))

    return F.coalesce(
        let(tokens, lambda t: F.size(t).between(1, 3) & F.forall(t, good) & ~((F.size(t) == 1) & F.regexp_replace(F.lower(F.get(t, 0)), r"\.+$", "").isin(L.HONORIFICS)))
        & ~low.isin(L.NUMBER_WORDS + L.INTERJECTIONS),
        F.lit(False),
    )


def is_name(c: Column) -> Column:
    return F.coalesce(~F.regexp_replace(F.lower(strip(c)), r"^\.+|\.+$", "").isin(L.NOT_NAMES), F.lit(False))


def name_key(c: Column, ascii_only: bool = False) -> Column:
    """Lower-case identity key; ascii_only drops accented letters too."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]" if ascii_only else r"[^\p{L}\p{N} ]", ""))


def name_parts(c: Column) -> Column:
    """(bare, single, last, titled) of a name; null if nothing or more than three words are left."""
    key = name_key(c, ascii_only=True)
    tokens = F.filter(F.split(key, " +"), lambda t: t != "")

    def of(t):
        lead = F.aggregate(t, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x.isin(L.TITLES), 1).otherwise(0)).alias("n"), (a["on"] & x.isin(L.TITLES)).alias("on")))["n"]
        bare = F.slice(t, lead + 1, F.greatest(F.size(t) - lead, F.lit(0)))
        titled = lead > 0
        return let(
            bare,
            lambda b: F.when(
                F.size(b).between(1, 3),
                F.struct(
                    F.array_join(b, " ").alias("bare"), F.when((F.size(b) == 1) & ~titled, F.get(b, 0)).alias("single"),
                    F.when((F.size(b) > 1) | titled, F.element_at(b, -1)).alias("last"), titled.alias("titled"),
                ),
            ),
        )

    return let(tokens, of)


def is_nick(short: Column, long: Column) -> Column:
    """Whether the first name is a short form of the second."""
    hit = F.lit(False)
    for end in L.NICK_ENDINGS:
        base = F.substring(short, F.lit(1), F.length(short) - len(end))
        hit = hit | ((F.endswith(short, F.lit(end)) if end else F.lit(True)) & (F.length(base) >= 3) & F.startswith(long, base))
    return F.coalesce((short != "") & (F.length(short) < F.length(long)) & hit, F.lit(False))


def mention_token(c: Column) -> Column:
    """The word by which a text mentions a name: its last one of three letters or more that is no title; null if there is none."""
    words = F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z'’-]+)"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~name_key(w, True).isin(L.TITLES))
    return F.try_element_at(words, F.lit(-1))


def mentions(text: Column, token: Column) -> Column:
    """Whether a text holds a token as a whole word (null token: false)."""
    whole = F.concat(F.lit(f"(?<!{C})\\Q"), token, F.lit(f"\\E(?!{C})"))
    return F.coalesce(F.contains(text, token) & F.regexp_like(text, whole), F.lit(False))


def keep_case(original: Column, new: Column) -> Column:
    """`new` in the case of the word that it replaces: Title or UPPER."""
    title = F.substring(original, 1, 1).rlike("^\\p{Lu}")
    upper = (F.length(original) > 1) & (original == F.upper(original)) & (original != F.lower(original))
    return F.when(upper, F.upper(new)).when(title, F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def safe_name(c: Column, squeeze_marks: bool = False) -> Column:
    """A file name: other characters become _; squeezed names are trimmed and never empty."""
    if not squeeze_marks:
        return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("TV_Voice"))


def derive_seed(base: Column, chunk: Column, cand: Column, attempt: Column) -> Column:
    """A 32-bit seed for each chunk, candidate and attempt; never 0."""
    mix = (base.cast("long") % 4294967296) * 1000003 + chunk * 10007 + cand * 10009 + attempt * 101
    return let(mix.bitwiseAND(F.lit(4294967295)), lambda s: F.when(s == 0, F.lit(1).cast("long")).otherwise(s))


def parse_reply(c: Column) -> Column:
    """The first JSON object of a model's reply as (speakers, new_characters); null if there is none."""
    plain = F.regexp_replace(c, "```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")), "speakers map<string,string>, new_characters array<string>")


def merge_rects(rects: Column, tolerance: float = 2.0) -> Column:
    """Word boxes to one box for each text line: a word joins the first line whose first word has its top and bottom within the tolerance.

    A line keeps the top and bottom of its first word and grows to the sides. Only words
    that begin a line are gathered while words are followed in turn, so nothing that grows
    with the words is copied; which line a word is in is then a look-up.
    """
    edges = "array<struct<y0:double,y1:double>>"
    fits = lambda m, r: F.coalesce((F.abs(m["y0"] - r["y0"]) <= tolerance) & (F.abs(m["y1"] - r["y1"]) <= tolerance), F.lit(False))
    begin = lambda firsts, r: F.when(F.exists(firsts, lambda m: fits(m, r)), firsts).otherwise(F.concat(firsts, F.array(F.struct(r["y0"].cast("double").alias("y0"), r["y1"].cast("double").alias("y1")))))

    def lines(firsts):
        placed = F.transform(rects, lambda r: F.struct(F.array_position(F.transform(firsts, lambda m: fits(m, r)), F.lit(True)).alias("at"), r["x0"].alias("x0"), r["x1"].alias("x1")))

        def box(of):
            def one(m, k):
                own = lambda c: F.transform(F.filter(of, lambda w: w["at"] == k + 1), lambda w: w[c])
                return F.struct(F.array_min(own("x0")).alias("x0"), m["y0"].alias("y0"), F.array_max(own("x1")).alias("x1"), m["y1"].alias("y1"))

            return F.transform(firsts, one)

        return let(placed, box)

    return let(F.aggregate(rects, F.array().cast(edges), begin), lines)
