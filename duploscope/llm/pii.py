"""Personal data in texts, in DataFrame functions only.

Method: regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for bank account
numbers), and words near a span, on either side or beside the list it stands in, raise its score. The kinds of BASE are reported by their
rules alone, with their scores; those of ADDED only from MIN_SCORE up, so that a number that merely looks right needs a word that says what
it is: always for social security numbers, and for bank accounts unless country, length and checksum agree.

Positions come from splitting the text at the matches: what lies between and the matches' lengths, summed up.
Patterns are the plain ones in a form that takes linear time in Java and no stack for each repetition:
repetitions that never have to give back are possessive, and a match begins where a run of its characters begins.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.llm.columns import text_or_empty

CONTEXT = 40  # code points on either side of a span, spans of its kind left out, in which words count
_LISTED = 8  # gaps between spans that are put together for that; a list without letters and digits between its spans is one, at any length
MIN_SCORE = 0.7
_BLOCK = 64  # spans whose positions are summed together


class Kind(NamedTuple):
    name: str
    pattern: str
    needed: str  # a text without it has no match
    confirmed: Callable[[Column], Column]
    score: Callable[[Column], Column]
    words: str  # which raise the score by 0.2


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _byte_parts(match: Column) -> Column:
    significant = F.transform(F.split(match, "\\."), lambda part: F.regexp_replace(part, "^0+", ""))
    return F.forall(
        significant,
        lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")),
    )


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _mod_97(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise(
            F.pmod(
                acc * F.when(c.between("0", "9"), 10).otherwise(100)
                + F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1,
                F.lit(97),
            )
        ),
    )
    return (F.length(plain).between(15, 34)) & (rest == 1)


# How long the account numbers of a country are.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK|FK|FI|FO|GL|NL|SD",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|MZ|PT|ST",
    26: "DZ|IR|IS|TR",
    27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE",
    31: "MT|SC",
    32: "LC",
    33: "RU",
}
_any_iban = "|".join(IBAN_LENGTHS.values())
_known_iban = "|".join(rf"(?:{names})[A-Z0-9]{{{length - 2}}}" for length, names in IBAN_LENGTHS.items())
_ibans = "|".join(rf"(?:{names})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, names in IBAN_LENGTHS.items())



def _always(score: float) -> Callable[[Column], Column]:
    return lambda match: F.lit(score)


def _account_score(match: Column) -> Column:
    return F.when(F.replace(match, F.lit(" "), F.lit("")).rlike(f"^(?:{_known_iban})$"), 0.8).otherwise(0.5)


BASE = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
        lambda match: F.lit(True), _always(0.9), "mail|contact|write",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", _byte_parts, _always(0.6), "ip|address|server|host"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", _luhn, _always(0.8), "card|visa|credit|payment"),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]",
        lambda match: F.length(_digits(match)).between(9, 15), _always(0.6), "phone|tel|call|mobile|fax",
    ),
)
ADDED = (
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?:{_ibans}|(?!{_any_iban})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        _mod_97, _account_score, "iban|account|bank|konto|cuenta|compte",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
        lambda match: ~match.rlike("^(000|666|9)|-00-|-0000$"), _always(0.5), "ssn|social security",
    ),
)
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _with_words_around(docs: DataFrame, body: Column, kind: Kind) -> DataFrame:
    """Adds `near` to the steps: whether a word of the kind is near a span on either side.

    Each gap between spans has a letter: A for one without letters and digits, T, H or B for one with a word near its tail, its head or
    both, N for others. Through gaps A a word counts for the whole list.
    """
    gap_ends = lambda gap: F.struct(
        F.lower(F.left(gap, F.lit(CONTEXT))).alias("head"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("tail"),
        ((F.length(gap) <= CONTEXT) & ~gap.rlike(r"[\p{L}\p{N}]")).alias("plain"),
    )
    docs = docs.withColumn("__pii_gaps", F.when(F.size("__pii_steps") > 0, F.transform(F.split(body, kind.pattern, -1), gap_ends)))
    word = rf"\b({kind.words})"

    def letter(gap: Column, i: Column) -> Column:
        first = F.greatest(i - (_LISTED - 2), F.lit(1))
        before = F.array_join(F.transform(F.slice("__pii_gaps", first, i + 2 - first), lambda g: g["tail"]), " ")
        after = F.array_join(F.transform(F.slice("__pii_gaps", i + 1, F.lit(_LISTED)), lambda g: g["head"]), " ")
        tail, head = F.right(before, F.lit(CONTEXT)).rlike(word), F.left(after, F.lit(CONTEXT)).rlike(word)
        return (
            F.when(tail & head, "B").when(tail, "T").when(head, "H").when(gap["plain"], "A").otherwise("N")
        )

    docs = docs.withColumn("__pii_letters", F.array_join(F.transform("__pii_gaps", letter), ""))
    spread = lambda letters, ends: F.regexp_replace(letters, rf"(?:(?<=[{ends}B])|(?!^)\G)A", ends)
    near = F.zip_with(
        F.split(spread(F.col("__pii_letters"), "T"), ""),
        F.slice(F.split(F.reverse(spread(F.reverse("__pii_letters"), "H")), ""), F.lit(2), F.greatest(F.size("__pii_steps"), F.lit(0))),
        lambda before, after: before.isin("T", "B") | after.isin("H", "B"),
    )
    said = F.when(F.size("__pii_steps") > 0, near)
    docs = docs.withColumn("__pii_near", said)
    named = F.zip_with(
        "__pii_steps", "__pii_near",
        lambda s, near: F.when(s.isNotNull(), F.struct(
            s["gap"].alias("gap"), s["size"].alias("size"), s["match"].alias("match"),
            near.alias("near"),
        )),
    )
    named = F.filter(named, lambda s: s.isNotNull())
    return docs.withColumn("__pii_steps", named).drop("__pii_gaps", "__pii_letters", "__pii_near")


def _with_spans(docs: DataFrame, text: str, kind: Kind, name: str) -> DataFrame:
    """Adds the confirmed spans of one kind.

    Every step is a column of its own that several expressions use, so that it is computed once for a row; functions over
    arrays use no column but through their arguments, as they would compute it again for each element. Positions are sums
    inside blocks of matches on top of sums of whole blocks.
    """
    body = text_or_empty(text)
    wanted = body.contains(kind.needed) if kind.needed == "@" else body.rlike(kind.needed)
    found = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
    zero = F.lit(0).cast("long")

    def step(gap: Column, match: Column) -> Column:  # what lies before a match, and the match; after the last, a gap alone
        return F.struct(
            F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), match.alias("match"),
        )

    steps = F.filter(F.zip_with(F.split(body, kind.pattern, -1), found, step), lambda s: s["match"].isNotNull())
    docs = docs.withColumn("__pii_steps", F.when(wanted, steps))
    has = F.size("__pii_steps") > 0
    docs = _with_words_around(docs, body, kind)
    last = F.ceil(F.size("__pii_steps") / _BLOCK).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("__pii_steps", b * _BLOCK + 1, F.lit(_BLOCK)))
    docs = docs.withColumn("__pii_blocks", F.when(has, blocks))

    def advanced(total: Column, s: Column) -> Column:
        return total + s["gap"] + s["size"]

    bases = F.aggregate(
        "__pii_blocks",
        F.struct(zero.alias("total"), F.array().cast("array<long>").alias("before")),
        lambda acc, block: F.struct(
            F.aggregate(block, acc["total"], advanced).alias("total"),
            F.concat(acc["before"], F.array(acc["total"])).alias("before"),
        ),
        lambda acc: acc["before"],
    )

    def located(block: Column, base: Column) -> Column:
        return F.transform(
            block,
            lambda s, i: F.struct(
                (F.aggregate(F.slice(block, F.lit(1), i), base, advanced) + s["gap"]).alias("start"),
                s["match"].alias("match"), s["near"].alias("near"),
            ),
        )

    def span(s: Column) -> Column:
        start, match = s["start"], s["match"]
        raised = F.when(s["near"], 0.2).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
            F.least(kind.score(match) + raised, F.lit(1.0)).alias("score"),
        )

    least = 0.0 if kind in BASE else MIN_SCORE
    places = F.flatten(F.zip_with("__pii_blocks", bases, located))
    confirmed = F.transform(F.filter(places, lambda s: kind.confirmed(s["match"])), span)
    kept = F.filter(confirmed, lambda s: s["score"] >= least)
    return docs.withColumn(name, F.when(has, kept).otherwise(F.array().cast(SPAN))).drop("__pii_steps", "__pii_blocks")


def _running(docs: DataFrame, spans: str, name: str, start: int, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds an array of what `merge` makes of all spans before each one, by sums inside blocks on top of sums of whole blocks."""
    last = F.ceil(F.size(spans) / _BLOCK).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)))
    docs = docs.withColumn("__pii_blocks", F.when(F.size(spans) > 0, blocks))
    tops = F.aggregate(
        "__pii_blocks",
        F.struct(F.lit(start).cast("long").alias("top"), F.array().cast("array<long>").alias("before")),
        lambda acc, block: F.struct(
            F.aggregate(block, acc["top"], merge).alias("top"), F.concat(acc["before"], F.array(acc["top"])).alias("before")
        ),
        lambda acc: acc["before"],
    )
    inside = lambda block, top: F.transform(block, lambda s, i: F.aggregate(F.slice(block, F.lit(1), i), top, merge))
    return docs.withColumn(name, F.flatten(F.zip_with("__pii_blocks", tops, inside))).drop("__pii_blocks")


def _without_overlaps(docs: DataFrame) -> DataFrame:
    """Drops the spans of added kinds that overlap a base span, along the order of all spans: one overlaps if a base span that
    begins before it ends after its start, or one that begins after it begins before its end."""
    base = [kind.name for kind in BASE]
    ordered = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].isin(base).alias("base"), s["kind"].alias("kind"), s["score"].alias("score")
    )
    added = F.flatten(F.array(*[F.col(f"_{kind.name}") for kind in ADDED]))
    every = F.concat(F.flatten(F.array(*[F.col(f"_{name}") for name in base])), added)
    docs = docs.withColumn("__pii_all", F.when(F.size(added) > 0, F.array_sort(F.transform(every, ordered))))
    ends = lambda top, s: F.when(s["base"], F.greatest(top, s["end"])).otherwise(top)
    docs = _running(docs, "__pii_all", "__pii_reach", -1, ends)
    docs = docs.withColumn("__pii_back", F.reverse("__pii_all"))
    starts = lambda top, s: F.when(s["base"], F.least(top, s["start"])).otherwise(top)
    docs = _running(docs, "__pii_back", "__pii_next", (1 << 62), starts)
    names = ("kind", "start", "end", "score")
    clear = F.zip_with(
        "__pii_all", "__pii_reach",
        lambda s, reach: F.struct(*[s[name].alias(name) for name in names], (~s["base"] & (reach <= s["start"])).alias("clear")),
    )
    marked = F.zip_with(
        clear, F.reverse("__pii_next"),
        lambda s, following: F.struct(*[s[name].alias(name) for name in names], (s["clear"] & (following >= s["end"])).alias("apart")),
    )
    docs = docs.withColumn("__pii_all", marked)
    plain = lambda s: F.struct(*[s[name].alias(name) for name in names])
    for name in (kind.name for kind in ADDED):
        own = F.filter("__pii_all", lambda s: s["apart"] & (s["kind"] == name))  # noqa: B023
        docs = docs.withColumn(f"_{name}", F.coalesce(F.transform(own, plain), F.array().cast(SPAN)))
    return docs.drop("__pii_all", "__pii_reach", "__pii_back", "__pii_next")


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one column of spans per kind, `_email`, `_ip`, `_card`, `_phone`, `_iban`, `_ssn`: (kind, start, end, score).

    Positions count code points from 0, the end excluded. Within a kind spans are the leftmost ones that do not overlap;
    one that its checksum refuses is dropped and its place not searched again. Added kinds that overlap a base span are
    dropped. A null or empty text has no spans; rows and other columns stay as they are. Columns that have one of the six names
    are replaced, and names that begin with `__pii_` are taken.
    """
    for kind in (*BASE, *ADDED):
        docs = _with_spans(docs, text, kind, f"_{kind.name}")
    return _without_overlaps(docs)


def _digest(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every row of (doc_id, text); `spans` is
    kind:start:end of all spans by kind, then start, `scores` their scores in percent, joined likewise, and base_sha256 the digest of
    `spans` without added kinds."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.flatten(F.array(*[F.col(f"_{kind.name}") for kind in BASE]))
    every = F.flatten(F.array(*[F.col(f"_{kind.name}") for kind in (*BASE, *ADDED)]))
    return found.select(
        "doc_id",
        *[F.size(f"_{kind.name}").cast("long").alias(f"n_{kind.name}") for kind in BASE],
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each confirmed span of the text replaced by its kind in brackets, as `[EMAIL]`.

    All kinds are sought in the text as given and kept by the rules of `find_spans`, scores and words included. Spans that
    overlap are replaced as one, by the kind of the one that starts first (of these, the longest); so an added kind that
    `find_spans` drops for a base span inside it is replaced whole. Null and empty texts, and all other columns, stay as
    they are; names that begin with `__pii_` are taken.
    """
    kinds = (*BASE, *ADDED)
    for kind in kinds:
        docs = _with_spans(docs, text, kind, f"__pii_{kind.name}")
    ordered = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))
    every = F.flatten(F.array(*[F.col(f"__pii_{kind.name}") for kind in kinds]))
    docs = docs.withColumn("__pii_spans", F.array_sort(F.transform(every, ordered)))
    has = F.size("__pii_spans") > 0
    last = F.ceil(F.size("__pii_spans") / _BLOCK).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("__pii_spans", b * _BLOCK + 1, F.lit(_BLOCK)))
    docs = docs.withColumn("__pii_blocks", F.when(has, blocks))

    def cut(rest: Column, begin: Column, size: Column | None = None) -> Column:
        return F.substr(rest, (begin + 1).cast("int"), None if size is None else size.cast("int"))

    def replaced(acc: Column, block: Column) -> Column:  # `rest` is the text from `at`, so that no cut begins far from a block
        def one(inner: Column, s: Column) -> Column:
            end = -s["minus"]
            piece = F.concat(cut(acc["rest"], inner["at"] - acc["at"], s["start"] - inner["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(
                s["start"] >= inner["at"], F.struct(end.alias("at"), F.concat(inner["out"], F.array(piece)).alias("out"))
            ).otherwise(F.struct(F.greatest(inner["at"], end).alias("at"), inner["out"].alias("out")))

        return F.aggregate(
            block,
            F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")),
            one,
            lambda inner: F.struct(
                inner["at"].alias("at"), cut(acc["rest"], inner["at"] - acc["at"]).alias("rest"),
                F.concat(acc["done"], F.array(F.array_join(inner["out"], ""))).alias("done"),
            ),
        )

    hidden = F.aggregate(
        "__pii_blocks",
        F.struct(
            F.lit(0).cast("long").alias("at"), text_or_empty(text).alias("rest"), F.array().cast("array<string>").alias("done")
        ),
        replaced,
        lambda acc: F.concat(F.array_join(acc["done"], ""), acc["rest"]),
    )
    docs = docs.withColumn(text, F.when(has, hidden).otherwise(F.col(text)))
    return docs.drop("__pii_spans", "__pii_blocks", *[f"__pii_{kind.name}" for kind in kinds])
