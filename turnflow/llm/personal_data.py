"""Personal data in texts: patterns on the text itself, and on what it says under look-alike letters, spelled digits and at/dot disguises.

A transducer reads a text and writes another one, and keeps for each character written the source characters it stands for
(`Tape`). The first undoes look-alikes and invisible characters. On what it wrote, one undoes disguised addresses and another spelled and
split numbers. The patterns then run on their output, and what they find is mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm.common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:[ .-][0-9]++)*+")
PHONE_REST = re.compile(r"[ ().0-9-]++")

# Letters of other alphabets that look like ASCII ones, in pairs of look-alike and letter.
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝАВСЕНІЈКМОРЅТХУЗ", "aceopxyijshdqwABCEHIJKMOPSTXY3", strict=True))
GREEK = dict(zip("αεικνορτυχγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxywABEZHIKMNOPTYX", strict=True))
OTHER = dict(zip("ɑɡɩıʟօսհցոԍ∙•·‧․。｡", "agiiLouhgnG.......", strict=True))
# The digits' names in the languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "una": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
AT_WORDS, DOT_WORDS, DASH_WORDS, PLUS_WORDS, TIMES = "at|arroba|arobase", "dot|punto|point|punkt|period", "dash|hyphen|tiret|guion|strich|minus", "plus|más", {"double": 2, "triple": 3}
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "&#43;": "+"}
#: A disguised local part is looked for in so many characters before its at.
REACH = 200


@lru_cache(65536)
def plain(c: str) -> str:
    """What a look-alike stands for; '' for an invisible character, the character itself for all others."""
    seen = CYRILLIC.get(c) or GREEK.get(c) or OTHER.get(c)
    if seen:
        return seen
    if c in "\xad͏᠎" or unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if unicodedata.category(c) == "Pd" or c == "−":
        return "-"
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    compatible = unicodedata.normalize("NFKC", c)
    return compatible if compatible.isascii() else c


class Tape:
    """A written text, and of each of its characters the first source character it stands for and the end of the last."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.start is None else (int(self.start[start]), int(self.end[end - 1]))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Without the characters of each (start, end, text), ascending and apart, and with the text in their place."""
        if not edits:
            return self
        start = np.arange(len(self.text)) if self.start is None else self.start
        end = np.arange(1, len(self.text) + 1) if self.end is None else self.end
        texts, starts, ends, at = [], [], [], 0
        for x, y, new in edits:
            texts += [self.text[at:x], new]
            starts += [start[at:x], np.full(len(new), start[x])]
            ends += [end[at:x], np.full(len(new), end[y - 1])]
            at = y
        return Tape("".join([*texts, self.text[at:]]), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))


def emails(s: str) -> Iterator[tuple[int, int]]:
    done, at = 0, s.find("@")
    while at >= 0:
        start = at
        while start > done and s[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(s, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = s.find("@", at + 1)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def runs(s: str, marks: str) -> Iterator[tuple[int, str]]:
    """Parts of a text between the marks, with their places."""
    at = 0
    for part in re.split(f"[{marks}]", s):
        yield at, part
        at += len(part) + 1


def ips_and_cards(s: str, numbers: list[tuple[int, int]]) -> Iterator[Span]:
    for base, end in numbers:
        whole = s[base:end]
        if len(whole) < 7:
            continue
        if "." in whole:
            for at, part in runs(whole, " -"):
                start, rest = base + at, part.split(".")
                for k in range(0, len(rest) - 3, 4):
                    four = rest[k : k + 4]
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                        yield start, 1, start + sum(map(len, four)) + 3
                    start += sum(map(len, four)) + 4
        for at, part in runs(whole, "."):
            if len(part) >= 14:
                digits = part.replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield base + at, 2, base + at + len(part)


def phones(s: str) -> Iterator[tuple[int, int]]:
    at = s.find("+")
    while at >= 0:
        m = PHONE_REST.match(s, at + 2) if s[at + 1 : at + 2] in DECIMAL else None
        if m:
            end = at + 2 + len(m.group().rstrip(" ().-"))
            if end >= at + 4 and 10 <= sum(c in DECIMAL for c in s[at:end]) <= 15:
                yield at, end
        at = s.find("+", at + 1)


DECIMAL = frozenset("0123456789")


def digit_runs(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in NUMBERS.finditer(s)]


def number_spans(s: str, numbers: list[tuple[int, int]]) -> Iterator[Span]:
    yield from ips_and_cards(s, numbers)
    yield from ((x, 3, y) for x, y in phones(s))


def base_spans(s: str, numbers: list[tuple[int, int]]) -> list[Span]:
    """What the plain patterns find, leftmost and apart for each kind."""
    return sorted([*((x, 0, y) for x, y in emails(s)), *number_spans(s, numbers)])


def alternatives(words: list[str]) -> str:
    """One of the words, as a pattern; longer ones first, by first letter."""
    first: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(map(re.escape, rest))})" for c, rest in sorted(first.items()))


DIGIT = alternatives([*DIGITS, *TIMES])
NAMED = frozenset([*DIGITS, *TIMES])
GAP = r"[\s,.()-]{1,4}"
PLUS = re.compile(rf"(?:{PLUS_WORDS})\s{{1,3}}(?:[0-9]|{DIGIT})")
BRACKET_DOT = rf"\s?[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]\s?"
JOINT = rf"{BRACKET_DOT}|\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}|\s{{1,2}}(?:{DASH_WORDS})\s{{1,2}}|{GAP}"
ONE = rf"(?:{'|'.join(TIMES)})\s(?:{alternatives([*DIGITS])})|{alternatives([*DIGITS])}|[0-9]+"
NUMBER = re.compile(rf"(?<![^\W_])(?:(?:{PLUS_WORDS})\s{{1,3}}(?=[0-9]|(?:{DIGIT})(?![^\W_])))?(?:{ONE})(?![^\W_])(?:(?:{JOINT})(?:{ONE})(?![^\W_]))+")
STEP = re.compile(rf"(?P<plus>{PLUS_WORDS})\s+|(?P<one>{ONE})(?![^\W_])|(?P<dot>{BRACKET_DOT}|\s+(?:{DOT_WORDS})\s+)|(?P<dash>\s+(?:{DASH_WORDS})\s+)|(?P<gap>{GAP})")
#: A letter for a digit, in a number with real digits beside it.
LETTERS = re.compile(r"(?<![^\W_])(?=[OoIl|]*[0-9])[0-9OoIl|]++(?![^\W_@])")
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}

#: Where AT can match, as a cheap search.
AT_CORE = re.compile(rf"[\s\[({{<_*~|/-]\s?(?:{AT_WORDS}|@)(?=[\s\])}}>_*~|/-])|@")
AT = re.compile(
    rf"(?P<bracket>\s*[\[({{<]\s?(?:{AT_WORDS}|@)\s?[\])}}>]\s*)|(?P<bare>\s+(?:{AT_WORDS})\s+)|(?P<mark>(?<=[a-z0-9])[_*~|/-]{{1,2}}at[_*~|/-]{{1,2}}(?=[a-z0-9]))|(?P<spaced>\s+@\s*|@\s+)|(?P<plain>@)"
)
DOT = rf"\s?[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]\s?|\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}|(?<=[a-z0-9])[_*~|/-]{{1,2}}dot[_*~|/-]{{1,2}}(?=[a-z0-9])| \. |\."
LABEL, ATOM = r"[a-z0-9]+(?:-+(?!dot-)[a-z0-9]+)*", r"[a-z0-9%+]+(?:[_-]+(?!dot[_-])[a-z0-9%+]+)*"
HOST = re.compile(rf"{LABEL}(?:(?:{DOT}){LABEL})+")
BEFORE = re.compile(rf"(?<![a-z0-9._%+-]){ATOM}(?:(?:{DOT}){ATOM})*\Z")
DOTS = re.compile(DOT)
LAST_LABEL = re.compile(r"[a-z]{2}[a-z0-9-]*\Z")
HINTS = ("dot", "punto", "punkt", "point", "period", "[.]", "(.)", "{.}", "at]", "at)", "at}", "at>", "at ]", "at )", "[@", "(@", "{@", "<@", "arroba", "arobase", "_at_", "-at-", "*at*", "~at~", "|at|", "/at/", " @", "@ ", " at ")


def address_edits(low: str) -> list[tuple[int, int, str]]:
    """What turns disguised addresses of a lower-case text into plain ones.

    A bare 'at' counts with a disguised dot after it, or, as prose has it too, if what stands before has a digit or mark of an address.
    """
    out: list[tuple[int, int, str]] = []
    done = 0
    for core in AT_CORE.finditer(low):
        start = core.start()
        while start > done and low[start - 1].isspace():
            start -= 1
        m = AT.match(low, start)
        host = HOST.match(low, m.end()) if m else None
        if not host or m.start() < done or not LAST_LABEL.search(host.group()):
            continue
        left = max(done, m.start() - REACH)
        local = BEFORE.search(low[left : m.start()])
        if not local:
            continue
        first = left + local.start()
        dots = [(left + d.start(), left + d.end()) for d in DOTS.finditer(low[left : m.start()], local.start())] + [(d.start(), d.end()) for d in DOTS.finditer(low, m.end(), host.end())]
        hidden = [d for d in dots if low[d[0] : d[1]] != "."]
        kind = m.lastgroup
        if kind == "plain" and not hidden:
            continue
        if kind == "bare" and not any(d[0] >= m.end() for d in hidden) and not re.search(r"[0-9._%+-]", low[first : m.start()]):
            continue
        at = [] if kind == "plain" else [(m.start(), m.end(), "@")]
        out += sorted([*((x, y, ".") for x, y in hidden), *at])
        done = host.end()
    return out


def number_edits(low: str) -> list[tuple[int, int, str]]:
    """What turns spelled and split numbers of a lower-case text into digits, in numbers long enough for an identifier."""
    out = []
    for m in NUMBER.finditer(low):
        steps = [(s.lastgroup, s.start(), s.end(), s.group()) for s in STEP.finditer(low, m.start(), m.end())]
        if all(kind in ("one", "gap") and (kind == "gap" or text[0] in DECIMAL) for kind, _, _, text in steps):
            continue
        edits, digits, dots = [], 0, 0
        for k, (kind, x, y, text) in enumerate(steps):
            spelled = [steps[i][0] == "one" and steps[i][3][0] not in DECIMAL for i in (k - 1, min(k + 1, len(steps) - 1))]
            if kind == "plus":
                edits.append((x, y, "+"))
            elif kind == "dot":
                edits.append((x, y, "."))
                dots += 1
            elif kind == "dash":
                edits.append((x, y, "-"))
            elif kind == "gap":
                dots += text == "."
                if any(spelled) and text != ".":
                    edits.append((x, y, ""))
            elif text[0] in DECIMAL:
                digits += len(text)
            else:
                times, _, word = text.rpartition(" ")
                new = DIGITS[word] * TIMES.get(times, 1)
                edits.append((x, y, new))
                digits += len(new)
        if digits >= 10 or (digits >= 4 and dots >= 3):
            out += edits
    return out


def beside(low: str) -> bool:
    """Whether a spelled digit has a digit, spelled or not, beside it: only such texts are read for spelled numbers."""
    for mark in ",.()-":
        low = low.replace(mark, " ")
    names = low.split()
    if NAMED.isdisjoint(names):
        return False
    digit = [w in NAMED or w[0] in DECIMAL for w in names]
    return any(x and y and (v in NAMED or w in NAMED) for x, y, v, w in zip(digit, digit[1:], names, names[1:], strict=False))


def letter_edits(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Letters for digits in numbers, but not where another edit is."""
    out = []
    for m in LETTERS.finditer(text):
        out += [(m.start() + k, m.start() + k + 1, LETTER_DIGITS[c]) for k, c in enumerate(m.group()) if c in LETTER_DIGITS]
    starts = [x for x, _, _ in taken]
    return [e for e in out for k in [bisect_right(starts, e[0]) - 1] if k < 0 or taken[k][1] <= e[0]]


def lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def look_alikes(text: str) -> Tape:
    """The text without look-alikes, invisible characters and character references of marks."""
    try:
        text.encode("latin-1")
        odd = any(c in text for c in "\xa0\xad¹²³·")
    except UnicodeEncodeError:
        odd = True
    tape = Tape(text)
    if odd:
        tape = tape.rewritten([(m.start(), m.end(), new) for m in re.finditer(r"[^\x00-\x7f]", text) for new in [plain(m.group())] if new != m.group()])
    if "&" in text or "%40" in text:
        tape = tape.rewritten([(m.start(), m.end(), ENTITIES[m.group().lower()]) for m in ENTITY.finditer(tape.text)])
    return tape


ENTITY = re.compile("|".join(map(re.escape, ENTITIES)), re.IGNORECASE)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """What the patterns find in a text, and what they find in addition once the disguises are undone, as places of the source."""
    runs = digit_runs(text)
    base = base_spans(text, runs)
    tape = look_alikes(text)
    runs = runs if tape.start is None else digit_runs(tape.text)
    low = lower(tape.text)
    found = []
    addresses = tape.rewritten(address_edits(low)) if any(h in low for h in HINTS) else tape
    if addresses.start is not None:
        found += [(*addresses.source(x, y), 0) for x, y in emails(addresses.text)]
    digits = number_edits(low) if beside(low) or PLUS.search(low) or any(h in low for h in HINTS[:8]) else []
    if any(tape.text[x - 1 : x] in LETTER_DIGITS or tape.text[y : y + 1] in LETTER_DIGITS or tape.text[y + 1 : y + 2] in LETTER_DIGITS for x, y in runs):
        digits = sorted([*digits, *letter_edits(tape.text, digits)])
    numbers = tape.rewritten(digits)
    if numbers.start is not None:
        found += [(*numbers.source(x, y), k) for x, k, y in number_spans(numbers.text, digit_runs(numbers.text))]
    of_kind = [[b for b in base if b[1] == k] for k in range(len(KINDS))] if found else []
    last = lambda x, k: of_kind[k][bisect_right(of_kind[k], x, key=lambda b: b[0]) - 1 :][:1] if of_kind[k] and of_kind[k][0][0] <= x else []
    return base, sorted((x, k, y) for x, y, k in set(found) if not any(y <= b[2] for b in last(x, k)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in spans)


def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to what is found."""
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base, more = spans_of(text)
            counts = [0, 0, 0, 0]
            for _, k, _ in base:
                counts[k] += 1
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted([*base, *more])), len(more)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([batch.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["doc_id", *NAMES])


NAMES = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans, n_added (spans beside the base ones).

    Spans are kind:start:end in code points of the source, by start, kind and end. An added span is never equal to a base span of its kind or inside
    one, but may hold one, where a disguise has cut an identifier short. Null and empty texts have no spans. Texts are read whole, in time that grows with
    their length. Each row is judged alone, so repeated rows get equal results. Other columns of docs aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in NAMES)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(found_rows, schema)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
