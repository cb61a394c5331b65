"""Personal data against plain regular expressions over whole texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.llm.common import table
from chainloom.llm.personal import KINDS, find_spans, scan_personal
from chainloom.llm.queries import op12_personal_data

#: The base as the contract states it.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(CARD, text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


ODD = [
    "a@b@c.d a@b.c@d.e x@y.z.", "@a.b", "a.b+c%d@e-f.g..h", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0255.1.1.001 1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111 11111111  1",
    "+49 (30) 1234567", "+1 555", "++1 234-567-890.", "+1 2345678901234567", "é 4111111111111111 漢 +49 30 1234567 ü a@b.de", "0 0 0 0 0 0 0 0 0 0 0 0", "0-0-0-0-0-0-0-0-0-0-0-0 1", "1-2 3-4 5-6 7-8 9-0 1-2",
    "http://1.2.3.4/a@b.c 4111111111111111@x.y", "a" * 5000 + "@" + "b" * 5000, "1" * 5000, "1." * 3000, "+1" * 3000, "@" * 3000, "a@b" * 2000 + ".c", "+1 " + "(" * 5000, "9" * 12 + "." + "9" * 12, "", "1 2", "00000000000000000000",
]


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    assert find_spans(text)[0] == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01945@.-+ ()aé:/", max_size=60) | st.lists(st.sampled_from(["4111 1111 1111 1111", "0", "00", "1.2.3.4", "a@b.c", "+49 30 123456", " ", "-", ".", "@", "+", "é", "acct 123456", "http://a.b/"]), max_size=12).map("".join))
def test_any_text(text):
    base, every = find_spans(text)
    assert base == brute(text)
    assert [x for x in every if x[1] < 4] == base
    added = [x for x in every if x[1] >= 4]
    assert all(e <= s2 or e2 <= s for s, _, e in added for s2, _, e2 in base)


def shown(text):
    return [(KINDS[k], text[s:e]) for s, k, e in find_spans(text)[1]]


def test_added_kinds():
    assert shown("see https://user:pw@example.org:8080/a?b=c#d.") == [("email", "pw@example.org")]
    assert shown("see (https://example.org/a?b=c).") == [("url", "https://example.org/a?b=c")]
    assert shown("foo://example.org http://nohost http://") == []
    assert shown("IBAN: DE89 3704 0044 0532 0130 00 and so on") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert shown("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert shown("SSN 123-45-6789, ssn 000-45-6789, ssn: 123-45-67890") == [("ssn", "123-45-6789")]
    assert shown("Account no. 12 34 56 78, Kontonummer: 7654321; on account of 20 men; accounts 1234567") == [("account", "12 34 56 78"), ("account", "7654321")]
    assert shown("account 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]


def test_whole_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    rows = op12_personal_data(spark, folder).collect()
    assert len(rows) == len(docs)
    found = 0
    for r in rows:
        want = brute(docs[r.doc_id])
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
        found += len(want)
    assert found > 20


def test_rows(spark):
    rows = [(1, "a@b.de 1.2.3.4", 5), (1, "a@b.de 1.2.3.4", 5), (None, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_email int")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans, r.masked) for r in scan_personal(df, mask=True).collect())
    assert got == [(0, 0, 0, "", ""), (1, 1, 1, "email:0:6,ip:7:14", "<EMAIL> <IP>"), (1, 1, 1, "email:0:6,ip:7:14", "<EMAIL> <IP>"), (2, 0, 0, "", "")]
    assert scan_personal(df.limit(0)).collect() == []
