import random
import re

import pytest

from flowlens.llm import pii

from .conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


@pytest.mark.parametrize("letters", ["0123456789.+-@ ()aZ%_ï", "0123. -@+a", "@a.@-", "12.", "49 -"])
def test_base_spans_equal_the_plain_patterns(letters):
    rnd = random.Random(letters)
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == list(brute(text)), text


def test_added_kinds_and_context():
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("code 123-45-6789") == []
    assert kinds("my social security number 123-45-6789") == ["ssn"]
    assert kinds("order ssn 123-45-6789 version") == []
    plain, near = (pii.spans(t)[0][3] for t in ("zz 10.0.0.1", "host 10.0.0.1"))
    assert near > plain


def test_linear_on_long_runs():
    for text in ("1" * 300_000, "1." * 200_000, "@" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "+" * 200_000):
        pii.spans(text)


def test_find_and_redact(odd, docs, spark):
    assert pii.find(odd).count() == len(ODD)
    assert pii.find(docs([])).count() == 0
    rows = docs([(1, "mail é a.b@c.de, call +1 (555) 123-4567"), (2, None), (3, "clean")])
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip, got[1].n_card) == (1, 1, 0, 0)
    assert got[1].spans == "email:7:15,phone:22:39"
    assert got[2].spans == ""
    out = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert out[1].text == "mail é <email>, call <phone>" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean" and out[3].n_chars == 5
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)
    clash = docs([(1, "a@b.cc")]).selectExpr("*", "1 AS c0", "2 AS spans", "3 AS id")
    assert pii.redact(clash).first().asDict()["text"] == "<email>" and pii.redact(clash).columns == clash.columns
