"""Random tokens after a name and "=", behind a path, and of mixed alphabets."""

import random
import string

import pytest

from plenum.llm import secrets

ALNUM = string.ascii_letters + string.digits
#: What stands before the secret, its alphabet and length, and what comes after it.
CASES = {
    "env": ("STRIPE_KEY=", ALNUM, 40, ""),
    "export": ("export FOO=", ALNUM + "+/", 42, "=="),
    "parameter": ("see https://example.com/get?id=7&sig=", ALNUM + "-_", 48, "&more=no"),
    "mixed": ("x ", ALNUM + "+/-_", 64, " y"),
    "path": ("in /some/where/of-the/other-kinds/and-more-of-them/under-that/", ALNUM, 40, " there"),
}


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for name, (before, alphabet, n, after) in CASES.items():
        for i in range(40):
            secret = "".join(rng.choice(alphabet) for _ in range(n))
            if name == "mixed":
                secret = secret[:20] + "+" + secret[21:40] + "_" + secret[41:]
            want[f"{name}{i}"] = (len(before), len(before) + n)
            rows.append((f"{name}{i}", before + secret + after))
    plain = ["NAME_OF_IT=" + "internationalizationsofthings" * 2, "/some-long/path_of/ordinary-words/in_the/middle-of-the/text_and/more-of-it", "a=b=c==" * 9, "=" * 60, "-_/+" * 20, "internationalizationsofthings-and/otherinternationalizations_of-things"]
    rows += [(f"plain{i}", t) for i, t in enumerate(plain)]
    return want, {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_secrets_behind_something(found, name):
    want, spans = found
    hits = 0
    for i in range(40):
        start, end = want[f"{name}{i}"]
        at = [tuple(map(int, s.split(":")[1:])) for s in spans[f"{name}{i}"].split(",") if s.startswith("random")]
        assert all(b[0] >= a[1] for a, b in zip(at, at[1:], strict=False)), "random spans overlap"
        hits += any(a <= start and end <= b for a, b in at)
        assert name == "path" or all(a >= start for a, _ in at)
    assert hits >= 36, hits


def test_words_are_no_secrets(found):
    assert {k: v for k, v in found[1].items() if k.startswith("plain") and v} == {}
