import random
import re

import pytest
from veilframe.functions import registry
from veilframe.operators import scan as S

POSITIVE = {
    "aadhaar": "id 2345 6789 0123.", "pan": "PAN abcde1234f x", "passport": "Passport No: A1234567", "voter_id": "EPIC no LDN2989101 and abc1234567", "driving_license": "MH01 2017 1234567",
    "ssn": "SSN: 123-45-6789", "abha_number": "ABHA no: 12-3456-7890-1234", "credit_card": "card 4111 1111 1111 1111", "bank_account": "account no: 123456789012", "upi": "pay me.you@okaxis now",
    "ifsc": "ifsc HDFC0001234", "iban": "GB82 WEST 1234 5698 7654 32", "nhs_number": "NHS no 943 476 5919", "expiry": "exp 09/27", "cvv": "CVV: 123", "annual_income": "annual income: $12,000 per annum",
    "credit_score": "CIBIL score: 750", "user_id": "username: jo_doe", "password": "password: hunter22", "father_name": "S/O Ram Kumar\n", "dob": "DOB: 01/02/1990", "gender": "Gender: Female",
    "address": "address: 12 Main Street, Town\n\n\n", "allergies": "allergies: pollen, dust\n", "age": "Age: 42 years", "marital_status": "marital status: single", "prescription": "prescribed 5 mg/day",
    "immunization": "booster dose", "blood_group": "type O+ve AB-x", "mrn": "MRN: AB1234", "insurance_policy": "policy no: XY-12345", "employee_id": "emp id: E1234", "corporate_email": "a@corp.com",
    "educational_qualification": "holds a PhD and B.Tech", "email": "jo . doe@mail\n.example . com", "phone": "+91 98765 43210 or 9876543210", "pincode": "pin code: 400001", "weight": "weight: 70 kg",
    "height": "height 180 cm", "lab_test_results": "lab report", "insurance_account_number": "insurance member no: M-12345", "contact": "contact: reception desk", "ip_address": "10.0.0.1 and 999.1.1.1",
}


def spec(text, use_nlp=False):
    """Whole-match spans by Python's re, which is the dialect that the registry is written in."""
    out = []
    for t in registry.PATTERN_TYPES:
        if use_nlp and t.id in registry.MODEL_PREFERRED:
            continue
        for m in re.finditer(t.pattern, text):
            raw, number = m.group().strip(), re.sub(r"\D", "", m.group())
            if t.id == "credit_card" and not luhn(number):
                continue
            if t.id == "phone" and not number.startswith("91") and len(number) < 10:
                continue
            if t.id == "upi" and re.match(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", raw):
                continue
            if t.id == "father_name":
                value = next((g for g in reversed(m.groups()) if g), raw).strip().rstrip(".")
                if len(value.split()) == 1 and len(value) <= 2:
                    continue
            out.append((t.id, m.start(), m.end()))
    return sorted(out)


def luhn(d):
    total = sum(x - 9 * (x > 9) for k, c in enumerate(reversed(d)) for x in [int(c) * (1 + k % 2)])
    return len(d) >= 13 and total % 10 == 0


def scanned(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in S.scan(df, use_nlp=False, names=False, **how).collect():
        out[r.doc_id].append(r)
    return out


def test_one_positive_of_each_type(spark):
    assert set(POSITIVE) == {t.id for t in registry.PATTERN_TYPES}
    texts = list(POSITIVE.values())
    got = scanned(spark, texts)
    for i, (kind, text) in enumerate(POSITIVE.items()):
        assert sorted((r.pii_type, r.start, r.end) for r in got[i]) == spec(text), text
        assert kind in {r.pii_type for r in got[i]}, kind
    values = {(r.pii_type, r.value) for rs in got.values() for r in rs}
    assert {("aadhaar", "234567890123"), ("pan", "abcde1234f"), ("passport", "PassportNo:A1234567"), ("voter_id", "LDN2989101"), ("credit_card", "4111111111111111"),
            ("bank_account", "123456789012"), ("user_id", "jo_doe"), ("password", "hunter22"), ("father_name", "Ram Kumar"), ("dob", "01/02/1990"), ("gender", "Female"), ("age", "42"),
            ("mrn", "AB1234"), ("email", "jo.doe@mail.example.com"), ("phone", "919876543210"), ("pincode", "400001"), ("ip_address", "10.0.0.1"), ("ssn", "SSN:123-45-6789")} <= values


def test_random_texts_against_the_patterns(spark):
    rng = random.Random(5)
    pieces = [*POSITIVE.values(), " ", "\n", "1", "12", "@", ".", ":", "-", "a", "AB", "é", "𝄞", "name: ", "\r\n", "  ", "4111-1111-1111-1111", "dob"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(400)]
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        assert sorted((r.pii_type, r.start, r.end) for r in got[i]) == spec(text), text


def test_names_by_their_labels(spark):
    texts = ["Full Name: John Smith\n1", "PATEL NARESH\nDOB: 1/1/1990", "16/11/1974\nMOHAN PATEL\nINDIA", "Elector's Name: Asha Rao\n", "Father's Name:\nRAM KUMAR\n", "name: INDIA\n", "name: Jo\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.value, r.start, r.end, r.confidence) for r in S.scan(df, types=["name"], use_nlp=False).collect())
    want = [(0, "John Smith"), (1, "PATEL NARESH"), (2, "MOHAN PATEL"), (3, "Asha Rao"), (4, "RAM KUMAR")]
    assert sorted({(i, v) for i, v, *_ in got}) == want
    assert all(texts[i][s:e].strip() == v and c == 0.92 for i, v, s, e, c in got)


@pytest.mark.parametrize("text", ["a" * 50_000 + "@", "a@" + "b." * 3000 + "c", "1 " * 20_000, "a ." * 5000 + "@", "+" * 20_000])
def test_long_texts_end(spark, text):
    scanned(spark, [text], types=["email", "corporate_email", "phone", "credit_card", "upi"])


def test_field_scan(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x", None), (2, "none", "10.0.0.1", 5)], "id long, mail string, host string, n int")
    got = sorted((r.id, r.field, r.pii_type, r.value) for r in S.field_scan(df, "id", types=["email", "ip_address"]).collect())
    assert got == [(1, "mail", "email", "a@b.com"), (2, "host", "ip_address", "10.0.0.1")]


def test_addresses_after_sentences(spark):
    """A word, a full stop and a blank belong to the address that follows, as the registry's pattern has it."""
    rng = random.Random(11)
    texts = ["für. Enach. un.77@mail.example x", "der. he.60@mail.example", "a . . b@c.de", "a. . .b@c.de", "a@b.co. 1@c.de", "x .. y@c.de"]
    texts += ["".join(rng.choices("a. ", k=rng.randint(1, 12))) + "@b.co" + "".join(rng.choices(["", " ", ".", "1", ". 1", "a. . b"], k=2)) + "".join(rng.choices("a. ", k=rng.randint(0, 6))) + rng.choice(["@c.de", ""]) for _ in range(2000)]
    got = scanned(spark, texts, types=["email"])
    pattern = registry.BY_ID["email"].pattern
    for i, text in enumerate(texts):
        assert [(r.start, r.end) for r in got[i]] == [m.span() for m in re.finditer(pattern, text)], text


@pytest.mark.parametrize("text", ["a. " * 100_000 + "@", ". " * 100_000 + "@", "a. . . . " * 30_000 + "@", "a .. .. " * 30_000 + "@"])
def test_long_chains_of_full_stops_end(spark, text):
    scanned(spark, [text], types=["email"])
