"""Find personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.arrays import let

# The base patterns of the contract, written without backtracking into groups
# (nothing that follows a group could match what it gives back), so that long digit or label runs
# need no stack. A run is tried once: from its start, or from the end of a match inside it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The added kind: an international bank account number, compact or in groups of four.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: Kinds in result order with their pattern, a cheap test that a text can have a match, and their context words.
KINDS: tuple[tuple[str, str, str, str], ...] = (
    ("email", EMAIL, "@", "mail|contact|write|reply|address|courriel|correo"),
    ("ip", IP, r"[0-9]\.[0-9]", "ip|host|server|address|login|ping|serveur|servidor"),
    ("card", CARD, r"[0-9][\x20-]?[0-9]", "card|visa|master|credit|pay|carte|karte|tarjeta"),
    ("phone", PHONE, r"\+[0-9]", "phone|call|tel|mobile|fax|ruf|appel|llam"),
    ("iban", IBAN, r"[A-Z]{2}[0-9]{2}", "iban|bank|account|konto|compte|cuenta|transfer"),
)
#: Letters and digits of the shortest account number.
IBAN_LENGTH = 15
BASE_KINDS = ("email", "ip", "card", "phone")
#: Code points on each side of a span that count as its context, up to the next span of its kind.
CONTEXT = 40
#: Matches whose places are added up together; the sums of these blocks are added up in turn.
BLOCK = 256
#: Score of a span by its pattern alone, gain of a passed checksum, gain of a context word.
PATTERN_SCORE, CHECKSUM_GAIN, CONTEXT_GAIN = 0.5, 0.3, 0.2

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,checked:boolean,score:double>>"


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int") * (F.pmod(i, 2) + 1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add), F.lit(10)) == 0


def mod97_ok(iban: Column) -> Column:
    """The check of an account number without blanks: moved and spelled in digits it leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, F.pmod(acc * 10 + code - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + code - 55, F.lit(97)))

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = F.regexp_replace
        return F.forall(
            F.split(match, r"\."),
            lambda p: (F.length(part(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(part(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97_ok(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _running(values: Column) -> Column:
    """Sums of all earlier values, and at the end of all."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("got"))
    done = F.aggregate(
        values, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got"))
    )
    return let(done, lambda d: F.concat(d["got"], F.array(d["at"])))


def _starts(lengths: Column) -> Column:
    """The running sums of an array, in two levels, so that work grows little faster than its length."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    )

    return let(blocks, lambda parts: let(_running(F.transform(parts, lambda p: F.element_at(p, -1))), lambda firsts: F.flatten(
        F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(firsts, i)))
    )))


def _confirmed(kind: str, match: Column) -> Column:
    """The match if its check passes; of an account number also the match without its last group or two, which may
    be other words."""
    if kind != "iban":
        return F.when(_valid(kind, match), match)
    shorter = F.regexp_replace(match, r"\x20[A-Z0-9]+$", "")
    least = F.regexp_replace(shorter, r"\x20[A-Z0-9]+$", "")
    tries = [F.when(_valid(kind, m) & (F.length(F.regexp_replace(m, " ", "")) >= IBAN_LENGTH), m) for m in (match, shorter, least)]
    return F.coalesce(*tries)


def _matches(text: Column, kind: str, pattern: str, words: str) -> Column:
    """All confirmed spans of one kind.

    The matches and the pieces between them come from the same leftmost scan, so the start of a match is
    the length of all pieces up to it plus that of all matches before it.
    """

    def spans(pieces: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p).cast("bigint") + F.length(m))
        return let(F.when(F.size(found) > 0, _starts(steps)), lambda starts: F.filter(F.transform(found, lambda m, i: span(pieces, starts, m, i)), lambda s: s["text"].isNotNull()))

    def span(pieces: Column, starts: Column, match: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        start = F.get(starts, i) + F.length(before)
        near = F.concat(F.right(before, F.lit(CONTEXT)), match, F.left(after, F.lit(CONTEXT)))
        score = (
            F.lit(PATTERN_SCORE + (CHECKSUM_GAIN if kind in ("card", "iban") else 0.0))
            + F.when(F.lower(near).rlike(rf"\b(?:{words})"), CONTEXT_GAIN).otherwise(0.0)
        )
        return let(_confirmed(kind, match), lambda good: F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(good)).alias("end"), good.alias("text"),
            F.lit(kind in ("card", "iban")).alias("checked"), score.alias("score"),
        ))

    return let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: spans(p, m)))


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``pii``, the spans of every kind with text, checksum flag and score.

    Spans are leftmost and non-overlapping within their kind, ordered by kind as in ``KINDS``, then by
    start; positions are code points, ends exclusive. A match that fails its check (address parts above
    255, card length or Luhn, phone length, account number modulo 97) is dropped without a retry. The
    score starts at the pattern's, gains by a passed checksum and by a context word nearby; it never
    removes a span. Documents without a sign of a kind skip its patterns.

    Null and empty texts have no spans. Rows are independent: repeats, null ids and extra columns pass
    through, an older ``pii`` column is replaced. No shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)
    per_kind = [
        F.when(F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint), _matches(text, kind, pattern, words).cast(_SPAN)).otherwise(none)
        for kind, pattern, hint, words in KINDS
    ]
    return docs.withColumn("pii", F.concat(*per_kind))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
