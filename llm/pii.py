"""Personal data: an Aho-Corasick automaton finds anchors, local parsers grow and validate spans.

One pass of the automaton over a text reports at-signs, dots and separators before digits, plus
signs, URL schemes and identifier cues. From each anchor a small deterministic parser grows a span
to both sides and validates it, so the cost follows the anchors and not the text times the kinds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import joined, table

#: Kinds of the contract first, in its order; then what cues and schemes add.
KINDS = ["email", "ip", "card", "phone", "url", "account", "address"]
BASE = KINDS[:4]

#: A word that announces an account or identity number; case variants are derived.
CUES = ["account", "acct", "a/c", "iban", "routing number", "sort code", "passport", "ssn", "social security",
        "member id", "customer id", "tax id"]
SCHEMES = ["http://", "https://", "ftp://", "mailto:"]
#: Street words that close an address which began with a house number.
STREETS = ["street", "avenue", "road", "boulevard", "lane", "drive"]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"[ ().0-9-]*")
_URL = re.compile(r"[A-Za-z0-9._~:/?#@!$&'()*+,;=%\[\]-]+")
_CUED = re.compile(r"(?i:[ ]?(?:number|no\.?|nr\.?|#))?[ ]?[:=#]?[ ]?([A-Za-z]{0,4}[0-9](?:[ -]?[A-Za-z0-9]){4,33})(?![A-Za-z0-9])")
_STREET = re.compile(r"([0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]{1,19}){1,3} )$")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, words in (("url", SCHEMES), ("account", CUES), ("address", STREETS)):
        for w in words:
            for x in {w, w.upper(), w.capitalize(), w.title()}:
                found.add_word(x, (kind, len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part may not begin before ``free``."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if start < at and domain else None


def _digits(text: str, at: int, spans: list, numbered: int, carded: int) -> tuple[int, int]:
    """Dotted numbers and card numbers around a digit; returns where the next search may begin."""
    if at >= numbered:
        chain = _NUMBERS.match(text, at)
        parts, start = chain.group().split("."), at
        for i in range(0, len(parts) - 3, 4):
            quad = ".".join(parts[i : i + 4])
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                spans.append((start, start + len(quad), "ip"))
            start += len(quad) + 1
        numbered = chain.end()
    if at >= carded:
        chain = _CARD.match(text, at)
        carded = at + 1
        if chain:
            carded, number = chain.end(), chain.group().replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                spans.append((at, carded, "card"))
    return numbered, carded


def _phones(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _PHONE.match(text, at + 2).end()
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end > at + 3 else None


def iban(value: str) -> bool:
    if not re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find_spans(text: str | None, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data of a text, by start, then kind as listed in KINDS.

    Base kinds are the leftmost matches that do not overlap within their kind; matches that fail
    their check are dropped and the search goes on behind them.
    """
    spans: list[tuple[int, int, str]] = []
    mailed = numbered = carded = phoned = linked = held = 0
    if not text:
        return spans
    for last, (kind, size) in found.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= numbered or at >= carded:
                numbered, carded = _digits(text, at, spans, numbered, carded)
        elif kind == "email":
            if (span := _emails(text, at, mailed)) is not None:
                spans.append((*span, kind))
                mailed = span[1]
        elif kind == "phone":
            if at >= phoned and (span := _phones(text, at)) is not None:
                phoned = span[1]
                if 10 <= sum(c in _DIGITS for c in text[span[0] : span[1]]) <= 15:
                    spans.append((*span, kind))
        elif kind == "url":
            # Schemes inside a URL are not matched to its end again.
            if at >= linked and (body := _URL.match(text, last + 1)):
                end = last + 1 + len(body.group().rstrip(".,;:!?)'"))
                if end > last + 1:
                    spans.append((at, end, kind))
                    linked = end
        elif kind == "account":
            value = _CUED.match(text, last + 1)
            if value and value.start(1) >= held and not (at and text[at - 1].isalnum()):
                plain = re.sub("[ -]", "", value.group(1))
                if iban(plain) or 6 <= sum(c in _DIGITS for c in plain) and "iban" not in text[at : last + 1].lower():
                    spans.append((*value.span(1), kind))
                    held = value.end(1)
        elif not text[last + 1 : last + 2].isalnum():
            house = _STREET.search(text, max(0, at - 90), at)
            if house and not (house.start() and text[house.start() - 1] in _DIGITS | {"."}):
                spans.append((house.start(), last + 1, kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def pii_spans(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``pii``, an array of (kind, start, end) over code points.

    Map-only. Text null or empty gives an empty array; rows repeat as they come; a column already
    named ``pii`` is replaced.
    """
    kept = docs.drop("pii")
    schema = kept.withColumn("pii", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t, found)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "pii"])

    return kept.mapInArrow(find, schema)


def redact(docs: DataFrame) -> DataFrame:
    """Replace every span by its kind in brackets; of overlapping spans the first start wins.

    Rows and columns stay; ``n_chars``, where there is one, is counted anew for changed texts.
    """
    kept = docs.schema
    names = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                parts, done = [], 0
                for start, end, kind in find_spans(text, found):
                    if start >= done:
                        parts += [text[done:start], f"[{kind.upper()}]"]
                    elif end > done:
                        pass  # its head is masked already; the rest goes with it
                    done = max(done, end)
                out.append(text if text is None or not parts else "".join(parts) + text[done:])
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if "n_chars" in names:
                i = batch.schema.get_field_index("n_chars")
                counts = [n if o == t else len(o) for n, o, t in zip(columns[i].to_pylist(), out, batch.column(at).to_pylist())]
                columns[i] = pa.array(counts, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, kept)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op1_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("pii", _of(k))).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
