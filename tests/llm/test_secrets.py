import hashlib
import random
import re
import string

import pytest
from conftest_llm import edge_texts, random_texts

from seriesweave.llm import secrets

PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def brute(text):
    """Pattern spans in code points, straight from the contract."""
    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if LEAST[k](m)]
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found))


def planted(seed, n):
    """Texts with pieces of all sorts in them."""
    rng = random.Random(seed)
    pieces = ["password", "PassWord = ", "passwd:", "secret", "Token=", "token : ", "api_key", "APIKEY=", "'", '"', " ", "=", ":", "AKIA", "AKIA" + "Z9" * 8, "AKIAAKIA", "ü", "ſecret=abcdefgh", "deadbeef", "0" * 23, "f" * 24, "0123abcd" * 4, "abc", "abcdef", "x1/_.-=", "TokenK"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_pattern_spans_equal_brute_force(spark, edge_docs, no_docs):
    texts = [(i, t) for i, t in enumerate(planted(1, 1500))] + [(5000, "secret: token : abcdefgh"), (5001, None), (None, "x\ntoken='abcdefg'"), (5000, "again token=1234567")]
    got = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    expected = sorted(((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == expected
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(brute(t).split(",") if brute(t) else [])
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("novel")]
        assert base in by[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
    assert len(secrets.scan(edge_docs).collect()) == len(edge_texts())
    assert secrets.scan(no_docs).collect() == []


def secret_of(rng, kind):
    alphabet = {"base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789abcdef", "upper": string.ascii_uppercase + string.digits}[kind]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 40)))


PLACES = ["Authorization: Bearer {}", 'client_secret_value -> "{}"', "postgres://admin:{}@db.internal/main", "private_key is {} and stays so", "aws_access_key_id\t{}", "the signature was {}"]

HARMLESS = ["your_api_key_goes_here_{}", "see docs/authentication/Part{}/README.md", "com.example.service.ClientFactory{}", "REPLACE_WITH_YOUR_KEY_{}", "the words that follow"]


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(7)
    clean = [t.replace("\n", " ") for t in random_texts(300, seed=3, words=80)]
    rows, secret = [], {}
    for i, text in enumerate(clean):
        place = PLACES[i % len(PLACES)]
        if i % 3 == 0:
            value = secret_of(rng, ("base64", "hex", "upper")[i // 3 % 3])
            secret[i] = (text + "\n" + place.format(value), value)
            rows.append((i, secret[i][0]))
        elif i % 3 == 1:  # sensitive words with nothing secret behind them
            rows.append((i, text + "\n" + place.format(rng.choice(HARMLESS).format(i)) + " " + text))
        else:  # random strings without a sensitive word
            rows.append((i, text + "\nchecksum of build " + secret_of(rng, "base64") + " " + text))
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    return secret, {r.doc_id: r for r in got.collect()}


def test_novel_strings_are_found_in_sensitive_context(scanned):
    secret, got = scanned
    hit = 0
    for i, (text, value) in secret.items():
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        at = text.rindex(value)
        hit += any(int(a) <= at and at + len(value) <= int(b) for _, a, b in spans)
    assert hit >= 0.95 * len(secret)
    assert {r.spans for i, r in got.items() if i >= 1000} == {got[0].spans} and got[0].n_novel == 1


def test_clean_texts_are_left_alone(scanned):
    secret, got = scanned
    wrong = [i for i, r in got.items() if i < 1000 and i not in secret and r.n_novel]
    assert len(wrong) <= 0.05 * 200, [got[i].spans for i in wrong]


def test_marginal_bytes():
    novelty = secrets.Novelty(b"client factory service example password token")
    rng = random.Random(1)
    around = (b"the token of the service is ", b" and the example goes on")
    random_value = secret_of(rng, "base64").encode()
    assert novelty(around[0], random_value, around[1]) >= secrets.NOVEL
    assert novelty(around[0], b"client_factory_service_example", around[1]) < novelty(around[0], random_value, around[1])
    # What the surroundings say already costs next to nothing.
    assert novelty(around[0] + random_value + b" ", random_value, around[1]) < 0.3
