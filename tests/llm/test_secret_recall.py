"""The randomness battery against brute force, its recall by encoding and length, and its cost on texts full of matches."""

import math
import random
import re
import time
from collections import Counter

import pytest
from kohesion.llm import secrets

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE32, BASE36, HEX, BASE64 = UPPER + "234567", LOWER + DIGITS, DIGITS + "ABCDEF", UPPER + LOWER + DIGITS + "+/"
CASES = [
    (BASE32, 32, 0.9), (BASE32, 24, 0.8), (BASE32, 20, 0.65), (BASE36, 20, 0.75), (BASE36, 32, 0.95), (HEX, 20, 0.85),
    (BASE64, 20, 0.9), (BASE64, 24, 0.95), (BASE64, 40, 0.99), (LOWER, 48, 0.8),
]
PLAIN = [
    "abcdefghijklmnopqrstuvwxyz0123456789", "internationalization2024", "HTTPSERVERCONNECTIONERROR404", "00000000000000000000000000000001", "202601012026010220260103",
    "getElementByIdentifierOrName", "chapter_12_of_the_long_story", "some/path/to/a/file/in/2024/here", "donaudampfschifffahrtsgesellschaft", "state-of-the-art-technology",
]


@pytest.mark.parametrize(("alphabet", "size", "least"), CASES)
def test_recall_by_encoding_and_length(docs, alphabet, size, least):
    rnd = random.Random(size)
    rows = [(i, "the key " + "".join(rnd.choice(alphabet) for _ in range(size)) + " leaked") for i in range(200)]
    found = sum(bool(r["found"]) for r in secrets.find_secrets(docs(rows)).collect())
    print("recall", len(alphabet), size, found)
    assert found >= least * 200


def test_text_is_not_reported_among_random_tokens(docs):
    rnd = random.Random(3)
    rows = [(i, f"here is {t} in a text") for i, t in enumerate(PLAIN)]
    rows += [(100 + i, "the key " + "".join(rnd.choice(BASE32) for _ in range(32)) + " leaked") for i in range(20)]
    got = {r["id"]: r["found"] for r in secrets.find_secrets(docs(rows)).collect()}
    assert [PLAIN[i] for i in range(len(PLAIN)) if any(s["kind"] == secrets.METHOD_KIND for s in got[i])] == []


def brute_scores(token):
    body = token.rstrip("=")
    n = len(body)
    name = next(k for k, v in secrets.ENCODINGS.items() if re.search(v[0], body))
    _, alphabet, rate, change = secrets.ENCODINGS[name]
    chi2 = sum((c - n / alphabet) ** 2 / (n / alphabet) for c in (Counter(body).get(x, 0) for x in set(body)))
    chi2 += (alphabet - len(set(body))) * n / alphabet
    repeat = ((chi2 + n) * n / alphabet - n) / (n * (n - 1))
    kind = ["a" if c in LOWER else "A" if c in UPPER else "0" if c in DIGITS else "-" for c in body]
    changes = sum(a != b for a, b in zip(kind[:-1], kind[1:], strict=True))
    vowel = [float(c in "aeiouAEIOU") for c in body]
    mean = sum(vowel) / n
    power = sum((x - mean) ** 2 for x in vowel)
    z1 = (rate - repeat) / math.sqrt(2 * rate * (1 - rate) / (n * (n - 1)))
    z2 = None if change is None else (changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    z3 = (sum((a - mean) * (b - mean) for a, b in zip(vowel[:-1], vowel[1:], strict=True)) / power - secrets.SERIAL) * math.sqrt(n) if power else 0.0
    if 2 * sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(body[:-1], body[1:], strict=True)) > n - 1:
        z3 = -math.sqrt(n)
    used = [z for z in (z1, z2, z3) if z is not None]
    return z1, z2, z3, 0.5 * math.erfc(sum(used) / math.sqrt(len(used)) / math.sqrt(2))


def test_scores_match_brute_force(spark):
    rnd = random.Random(5)
    tokens = PLAIN + ["".join(rnd.choice(a) for _ in range(rnd.randrange(20, 120))) + "=" * rnd.randrange(3) for a in (BASE32, BASE36, HEX, BASE64, LOWER, UPPER, "xyz_-", "aeiou1") for _ in range(12)]
    got = secrets.randomness(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    for r in got:
        z1, z2, z3, p = brute_scores(r["token"])
        assert (r["z_uniform"], r["z_serial"]) == pytest.approx((z1, z3), abs=1e-9), r["token"]
        assert (r["z_runs"] is None) if z2 is None else r["z_runs"] == pytest.approx(z2, abs=1e-9)
        assert r["p"] == pytest.approx(max(p, 1e-300), rel=0.2, abs=3e-7)


def test_step_up_matches_brute_force(spark):
    rnd = random.Random(6)
    rows = [(c, rnd.choice([rnd.randrange(40), rnd.randrange(40, 900)])) for c in (0, 1, 3) for _ in range(200)] + [(2, 5)] * 7
    spans = [(i, [(0, 3, 1, c, b), (5, 0, 9, None, None)]) for i, (c, b) in enumerate(rows)]
    table = spark.createDataFrame(spans, "id long, spans array<struct<start:int,rank:int,end:int,class:int,bin:int>>")
    got = {r["class"]: r["least"] for r in secrets.step_up(table, 0.01).collect()}
    want = {}
    for c in range(4):
        p = sorted(10 ** (-b / secrets.BINS_PER_DECADE) for k, b in rows if k == c)
        passed = [x for i, x in enumerate(p, 1) if x <= 0.01 * i / len(p)]
        if passed:
            want[c] = round(-math.log10(max(passed)) * secrets.BINS_PER_DECADE)
    assert got == want and 2 not in want


def brute_candidates(text, base):
    return [m.span() for m in re.finditer(secrets.TOKEN, text) if not any(a < m.end() and m.start() < z for a, _, z, *_ in base)]


def test_candidates_are_tokens_clear_of_base_spans(docs):
    rnd = random.Random(8)
    parts = ["token=", "A1b2C3d4E5f6G7h8I9j0", "deadbeef" * 4, "AKIA" + "B1" * 8, " ", "\n", ".", "=", "x" * 19, "password: ", "/", "é"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in range(300)]
    for r in secrets.scan(docs(rows)).collect():
        base = [s for s in r["spans"] if s["bin"] is None]
        got = [(s["start"], s["end"]) for s in r["spans"] if s["bin"] is not None]
        assert got == brute_candidates(rows[r["id"]][1], [(s["start"], s["rank"], s["end"]) for s in base])


def test_a_text_full_of_matches_takes_seconds(docs):
    rnd = random.Random(9)
    tokens = ["".join(rnd.choice(BASE64[:62]) for _ in range(24)) for _ in range(10_000)]
    text = " ".join(f"token=abcdefgh{i % 10} {t}" for i, t in enumerate(tokens))
    start = time.monotonic()
    (row,) = secrets.find_secrets(docs([(1, text)])).collect()
    assert time.monotonic() - start < 40
    assert row["n_assign"] == 10_000 and len(row["base"]) == 10_000
    assert len(row["found"]) > 19_000
    # Places far into the text are right.
    assert all(text[s["start"] : s["end"]] in (f"token=abcdefgh{i}" for i in range(10)) for s in row["base"][-50:])
