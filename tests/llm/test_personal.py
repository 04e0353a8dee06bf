from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from termwarden.llm import pii
from tests.llm.conftest import AWKWARD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (place % 2 + 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_base(text):
    """The base spans, pattern by pattern."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def found_of(docs):
    return {r.doc_id: r for r in pii.span_digests(docs).collect()}


def check(docs_of, texts):
    found = found_of(docs_of(list(enumerate(texts))))
    for i, text in enumerate(texts):
        base = plain_base(text)
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert found[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), text
        counts = [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        assert [found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone] == counts
        added = [s for s in found[i].spans.split(",") if s and s.split(":")[0] not in PATTERNS]
        assert set(f"{k}:{s}:{e}" for k, s, e in base) | set(added) == set(filter(None, found[i].spans.split(",")))


def test_base_spans_against_plain_patterns(docs_of):
    random.seed(1)
    parts = ["a@b.c", "x.y_z@d-e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "010.0.0.255", "4111 1111 1111 1111"]
    parts += ["4111-1111-1111-1112", "+1 (269) 555-3296", "+4", "1", "12", " ", "-", "é", "🙂", "_", "+", "9" * 25, "(", "0"]
    texts = ["".join(random.choices(parts, k=random.randrange(1, 14))) for _ in range(600)]
    check(docs_of, [*texts, None, "", "a@b.c.@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@@b.c", "+1+1 234 567 890"])


def test_awkward_rows(awkward, docs_of):
    found = pii.span_digests(awkward.withColumns({n: F.lit(1) for n in ("found", "spans", "_doc")})).collect()
    assert sorted(r.doc_id or -1 for r in found) == sorted(i or -1 for i, _ in AWKWARD)
    assert {r.spans for r in found} == {""}
    assert pii.span_digests(awkward.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 it is", ["iban:5:32"]),
        ("GB82WEST12345698765432", ["iban:0:22"]),
        ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("my SSN: 123-45-6789.", ["ssn:8:19"]),
        ("part 123-45-6789.", []),
        ("SSN 000-45-6789 and 900-45-6789", []),
        ("personnummer 811218-9876", ["personal:13:24"]),
        ("personnummer 811218-9875", []),
        ("811218-9876", []),
        ("call 212-555-1234 now", ["local_phone:5:17"]),
        ("call order 212-555-1234 now", []),
        ("call 112-555-1234", []),
        ("phone +1 212-555-1234", ["phone:6:21"]),
        ("tel 212-555-12345", []),
    ],
)
def test_confirmation_and_context(docs_of, text, spans):
    assert [s for s in found_of(docs_of([(1, text)]))[1].spans.split(",") if s] == spans


def test_masked_texts(docs_of):
    docs = docs_of([(1, "to a@b.c, 1.2.3.4!"), (2, None), (3, "none")])
    masked = {r.doc_id: r.text for r in pii.masked(docs.withColumn("found", F.lit(0))).collect()}
    assert masked == {1: "to [email], [ip]!", 2: None, 3: "none"}


def test_long_runs_take_time_in_proportion(docs_of):
    texts = ["9" * 300_000, "a" * 300_000, "a." * 100_000 + "@", "a@b" + ".c" * 100_000, "+1" * 100_000]
    texts.append(" ".join(f"4111 1111 1111 1111 x{i}" for i in range(10_000)))
    docs = docs_of(list(enumerate(texts)))
    start = time.perf_counter()
    found = found_of(docs)
    assert time.perf_counter() - start < 60
    assert found[3].n_email == 1 and found[5].n_card == len(plain_base(texts[5]))


def test_no_python_and_no_shuffle(docs_of):
    plan = pii.span_digests(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
