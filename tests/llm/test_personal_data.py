"""Personal data: base spans beside plain regular expressions, and disguises made from known identifiers."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from turnflow.llm import personal_data
from turnflow.llm.personal_data import KINDS, base_spans, digit_runs, spans_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text: str) -> list[tuple[int, int, int]]:
    return sorted((m.start(), KINDS.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group()))


def test_base_equals_regular_expressions():
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for letters in ("a1.@-", "12.3 ", "0123456789 -", "+1() .-9", "a.@+1 -٣é") for _ in range(3000)]
    texts += [f"{a}{r.choice([' ', '.', '-', ''])}{b}" for a in ("4111 1111 1111 1111", "10.0.0.255", "+1 (988) 555-2485", "a@b.c") for b in ("4111-1111-1111-1111", "10.0.0.256", "+49 1", "a@b.c", "0001.2.3.4", "9" * 30)]
    found = 0
    for t in texts:
        want = brute(t)
        assert base_spans(t, digit_runs(t)) == want, t
        found += len(want)
    assert found > 1000


#: Text before, an identifier in disguise, its kind, text after.
DISGUISED = [
    ("write to ", "bosbt.42 at mail8.example.com", "email", " please"),
    ("write to ", "bosbt dot 42 at mail8 dot example dot com", "email", ", please"),
    ("an ", "bosbt.42 [at] mail8 [dot] example [dot] com", "email", " or"),
    ("an ", "bosbt.42(at)mail8(dot)example(dot)com", "email", "."),
    ("", "bosbt.42_at_mail8_dot_example_dot_com", "email", ""),
    ("an ", "bosbt-42 AT mail8 DOT Example DOT com", "email", " x"),
    ("mit ", "ana.maria arroba correo punto es", "email", "."),
    ("de ", "jean arobase exemple point fr", "email", "\n"),
    ("x ", "bosbt @ mail8 . example . com", "email", " y"),
    ("x ", "bosbt&#64;mail8&#46;example&#46;com", "email", " y"),
    ("é ñ ", "bоsbt.42@mаil8.example.com", "email", " ü"),
    ("日本 ", "ｂosbt＠example．com", "email", " 日"),
    ("x ", "bos​bt@exam­ple.com", "email", " y"),
    ("call ", "plus one nine eight eight five five five two four eight five", "phone", " now"),
    ("call ", "+one (nine eight eight) five five five - two four eight five", "phone", ". Now"),
    ("call ", "+1 (988) five five five-2485", "phone", " now"),
    ("call ", "plus 1 988 555 2485", "phone", " now"),
    ("ruf ", "+vier neun, acht acht acht, fünf fünf fünf, zwei vier", "phone", " an"),
    ("call ", "+1 (988) 555‑2485", "phone", " now"),
    ("call ", "+١ (٩٨٨) ٥٥٥-٢٤٨٥", "phone", " now"),
    ("call ", "+1 (9O8) 555-l485", "phone", " now"),
    ("call ", "+1 nine double eight triple five 2485", "phone", " now"),
    ("at ", "192 dot 168 dot 1 dot 1", "ip", " it"),
    ("at ", "192[.]168[.]1[.]1", "ip", " it"),
    ("at ", "one nine two dot one six eight dot zero dot one", "ip", " it"),
    ("pay ", "four one one one one one one one one one one one one one one one", "card", " now"),
    ("pay ", "4111 1111 one one one one 1111", "card", " now"),
    ("paga ", "cuatro uno uno uno 1111 1111 1111", "card", " ya"),
    ("pay ", "4111 1111 1111 1111", "card", " now"),
]


@pytest.mark.parametrize("before, hidden, kind, after", DISGUISED)
def test_disguises(before, hidden, kind, after):
    text = before + hidden + after
    base, more = spans_of(text)
    assert (len(before), KINDS.index(kind), len(before) + len(hidden)) in more
    assert base == brute(text) and not set(base) & set(more)
    assert len([s for s in more if s[1] == KINDS.index(kind)]) == 1


def test_clean_texts():
    for text in (
        "visit us at example.com today", "we met at noon. Then he left", "plus une ou deux fois", "un, un deux", "one two three four", "the point at hand. The dot is small",
        "list (a) first (b) second", "see a.b and c.d at the end of it", "5 of 10 at 20.5 or 30.25", "stay-at-home people", "nine of ten, two at a time. Six dot com years", "version 1.2.3", "follow @name on it",
    ):
        assert spans_of(text) == ([], []), text


def test_documents(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = personal_data.op13_personal_data(spark, sf_dir).collect()
    assert len(out) == len(rows)
    name = lambda spans: ",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in spans)
    for r in out:
        want = brute(rows[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(name(want).encode()).hexdigest()
        assert set(name([s]) for s in want) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email for r in out) > 0 and sum(r.n_added for r in out) == 0  # nobody hides anything in these


def test_odd_rows(spark):
    text = "so " * 5 + "bosbt.42 [at] example [dot] com"
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, text, "x"), (2, text, "x"), (3, text + " a@b.c " + text, None)], "doc_id long, text string, spans string")
    out = sorted((r.doc_id or 0, r.spans, r.n_added, r.n_email) for r in personal_data.personal_data(docs).collect())
    hidden = f"email:15:{len(text)}"
    again = len(text) + 7
    assert out == [(0, "", 0, 0), (1, "", 0, 0), (2, hidden, 1, 0), (2, hidden, 1, 0), (3, f"{hidden},email:{len(text) + 1}:{len(text) + 6},email:{again + 15}:{again + len(text)}", 2, 1)]
    assert personal_data.personal_data(docs.limit(0)).collect() == []


def test_long_texts():
    """Megabytes of what might be the start of something take seconds."""
    began = time.time()
    for part in ("1", "1 ", "1.", "a", "a.", "@", "a@", "+1 ", "+", " at ", "one ", "one dot ", "a at b dot ", "[at] ", "-", " ", "a@b.", "о", "l1", "4111 1111 1111 1111 "):
        spans_of(part * (400_000 // len(part)))
    assert time.time() - began < 60
