"""Base kinds against Python's re, the battery's statistics against numpy, and very long tokens."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import secrets

ALNUM = string.ascii_uppercase + string.ascii_lowercase + string.digits
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
    }


def texts() -> list[str]:
    rng = random.Random(3)
    pieces = ["token=", "API_KEY : '", "apikey=", "Secret\": \"", "passwd =", "PassWord='", "AKIA", "é ü 😀 ", " ", "\n", "=", "-", "token = secret = ", "0" * 15, "deadbeef" * 2, "AKIAABCDEFGHIJ01234"]
    out = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            parts.append(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choices(rng.choice((ALNUM, "0123456789abcdef", "ABCDEFGHIJ0123", "ab./=+_-")), k=rng.randrange(1, 30))))
        out.append("".join(parts))
    return [*out, "", "no secret", "token=" + "x" * 11, "token=" + "x" * 12]


def test_base_kinds(spark):
    want = texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(want)] + [(-1, None)], "doc_id long, text string")
    n = 0
    for r in secrets.digest(docs).collect():
        kinds = base(want[r.doc_id] if r.doc_id >= 0 else "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, kinds.values()))
        order = sorted((s, i, e) for i, at in enumerate(kinds.values()) for s, e in at)
        spelled = ",".join(f"{secrets.KINDS[i]}:{s}:{e}" for s, i, e in order)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in spelled.split(",") if x]
        n += len(order)
    assert n > 200


def test_running_sums(spark, monkeypatch):
    for block in (1, 3, 512):
        monkeypatch.setattr(secrets, "BLOCK", block)
        rows = [([],), ([5],), (list(range(10)),), ([1, 0, 0, 7, 2, 2, 9],)]
        found = spark.createDataFrame(rows, "v array<int>").select("v", secrets.running(F.col("v")).alias("s")).collect()
        assert all(r.s == np.cumsum(r.v).astype(int).tolist() for r in found)


def test_statistics_are_numpys(spark):
    rng, rows = random.Random(11), []
    for pattern, alphabet in secrets.ENCODINGS:
        for n in (20, 37, 64, 200):
            rows.append(("".join(rng.choices(alphabet, k=n)), alphabet))
            rows.append(("".join(rng.choices(alphabet[:3] + alphabet[-2:], k=n)), alphabet))
        rows += [(alphabet * 3, alphabet), (alphabet[0] * 25, alphabet), (alphabet[-1] * 25, alphabet)]
    x = F.struct(F.col("body").alias("body"), F.col("alphabet").alias("alphabet"))
    found = spark.createDataFrame(rows, "body string, alphabet string").select("body", "alphabet", secrets.statistics(secrets.counted(x)).alias("s")).collect()
    for r in found:
        code, n, k = np.array([r.alphabet.index(c) for c in r.body]), len(r.body), len(r.alphabet)
        counts = np.bincount(code, minlength=k)
        assert np.isclose(r.s.chi2, ((counts - n / k) ** 2 / (n / k)).sum(), atol=1e-6)
        high = code * 2 >= k
        changes, up = int((high[1:] != high[:-1]).sum()), int(high.sum())
        expected = 2 * up * (n - up) / n
        assert np.isclose(r.s.rate, (changes - expected) / (n - 1))
        var = expected * (expected - 1) / (n - 1)
        assert (r.s.z_runs is None) == (var <= 0) and (var <= 0 or np.isclose(r.s.z_runs, (changes - expected) / np.sqrt(var)))
        d = code - code.mean()
        if len(set(r.body)) > 1:
            assert np.isclose(r.s.serial, (d[1:] * d[:-1]).sum() / (d * d).sum())
        else:
            assert r.s.serial is None


def test_one_pass_over_very_long_tokens(spark):
    rng = random.Random(2)

    def took(text: str) -> tuple[float, str]:
        began = time.perf_counter()
        (row,) = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        return time.perf_counter() - began, row.spans

    took("warm up " + "".join(rng.choices(ALNUM, k=50)))
    trivial, _ = took("a b")
    long, spans = took("x " + "".join(rng.choices(ALNUM, k=1_000_000)))
    assert spans == "random:2:1000002"
    assert long < trivial + 10
    many, spans = took(" ".join("%016x" % rng.getrandbits(64) for _ in range(30_000)))
    assert spans.count("hex") == 30_000 and many < trivial + 15


@pytest.mark.parametrize("body", ["zy" * 200, "abcdefghijklmnopqrstuvwxyz" * 10, "zz" * 150, "internationalization" * 12])
def test_structure_is_no_secret(spark, body):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(ALNUM, k=300))) for i in range(1, 30)] + [(0, body)]
    found = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == "" and sum(found[i] == "random:0:300" for i in range(1, 30)) >= 27
