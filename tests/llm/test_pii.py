import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import pii, registry

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's own patterns, match by match."""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"\D", "", m.group())
            ok = True
            if kind == "ip":
                ok = all(int(x[-400:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))
            if kind == "card":
                total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
                ok = 13 <= len(digits) <= 19 and total % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base(text):
    return [x for x in pii.joined(pii.find(text), pii.BASE).split(",") if x]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aé@.+- ()0123459_%:/", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


def test_known_cases():
    assert base("a@b.c_d@e.f x@y@z.com a@b") == ["email:0:5", "email:5:11", "email:14:21"]
    assert base("1.2.3.4.5.6.7.8 256.1.1.1 1.2.3") == ["ip:0:7", "ip:8:15"]
    assert base("4111 1111-1111 1111") == ["card:0:19"]
    assert base("9" * 5000) == plain("9" * 5000)
    found = pii.find("IBAN: GB82 WEST 1234 5698 7654 32, ftp://me:secret@host.example, jo (at) mail (dot) org, SSN 123-45-6789")
    assert len(found["account"]) == 2 and len(found["login"]) == 1 and len(found["masked"]) == 1
    assert pii.redact("to bob@example.org now") == "to [email] now" and pii.redact(None) is None


def secrets(text):
    return [text[a:b] for a, b in pii.find(text)["secret"]]


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'token = "{key}" then', f"API_KEY={key}", f"x-api-key: {key}", f"client_secret := '{key}'", f'"access_token": "{key}"', f"Authorization: Bearer {key}", f"bearer {key}."):
        assert secrets(text) == [key], text
    assert secrets("password: hunter22, next") == ["hunter22"] and secrets("AKIA" + "Q7" * 8 + " x") == ["AKIA" + "Q7" * 8]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIE+/=\n-----END RSA PRIVATE KEY-----"
    assert secrets(f"a {pem} b {pem} c") == [pem, pem] and secrets("-----BEGIN PRIVATE KEY-----" * 20_000) == []
    for text in ("the token = something_of_the_kind", "tokens are counted: 12345678901234567890", "secret: aaaaaaaaaaaaaaaaaaaaaaa1a1", "password: as you like", "a key is a key", "token", "token = ", "MAKIA" + "Q7" * 8, "keyed tokenizer_version_2024: abcdefghijklmnopqrst"):
        assert not secrets(text), text
    assert pii.redact(f'token = "{key}"') == 'token = "[secret]"'


def test_planted_secrets_of_the_tables(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in registry.op1_pii(spark, sf).collect()}
    for i, t in rows.items():
        assert out[i]["n_secret"] == len(re.findall(r"token = \"[0-9a-f]{40}\"", t))
        assert out[i]["n_spans"] == len([x for x in out[i]["spans"].split(",") if x])


def test_query_covers_every_document(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op1_pii(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_odd_rows(odd_docs, no_docs):
    rows = pii.detect(odd_docs).collect()
    assert len(rows) == odd_docs.count() and pii.detect(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["spans"] == "" and (by[10]["n_email"], by[10]["n_ip"], by[10]["n_card"], by[10]["n_phone"]) == (1, 1, 1, 1)
