"""The pipeline as a whole against a plain version of its stages."""

import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plenum.llm import bpe, common, langid
from tests.llm.test_langid import naive
from tests.llm.test_operators import fill, split

WORDS = {"en": "the and that not is one to have will with good for word time house".split(), "de": "der die und das nicht ist ein zu haben werden mit schön für wort zeit".split()}


def documents() -> list[tuple]:
    rng, rows = random.Random(6), []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "", "x", "ing", "en")) for _ in range(rng.randrange(1, 120)))
        rows.append((i, text, lang if i % 5 else None, f"src{i % 6 if i % 2 else 0}"))
    for i in range(160, 200):  # exact and near copies
        d, text, lang, source = rows[rng.randrange(160)]
        rows.append((i, text if i % 2 else text + " more", lang, source))
    return [*rows, (300, None, "en", "src1"), (301, "12 34", "en", None), (302, "αβγ δεζ " * 30, None, "src2"), (303, "the one", "en", None), (303, "the one", "en", None), (None, "the house and the time", None, "src3")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stages(docs: list[tuple], samples: dict[str, bytes]) -> list[tuple]:
    """What is left after the first three stages."""
    symbols, left = len(set(b"".join(samples.values()))), []
    for r in docs:
        t = langid.normal(r[1])
        bits = {lang: math.log2(len(s) + 1) for lang, s in samples.items()}
        if t and min((naive(s, t) * bits[x] / len(t), (naive(s, t) - 1) * bits[x]) for x, s in samples.items())[1] <= langid.UNEXPLAINED * len(t) * math.log2(symbols + 1):
            left.append(r)
    key = lambda r: (r[0] is not None, r[0] or 0)
    left = list({r[1]: r for r in sorted(left, key=key)}.values())
    sets, up = [], list(range(len(left)))
    for r in left:
        w = r[1].lower().split() if r[1].isascii() else "".join(c.lower() if c.isascii() else c for c in r[1]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i, r in enumerate(left):
        groups.setdefault(root(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(*r, len(r[1] or "")) for r in documents()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_all_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    samples = langid.learn(docs)
    assert set(samples) == {"en", "de"}
    left = stages(documents(), samples)
    assert len(left) < 170 and not {300, 301, 302} & {r[0] for r in left}
    found = corpus_pipeline.run(spark, folder).collect()
    codec = bpe.Codec(*bpe.vocabulary())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    text, source = {r[0]: r[1] for r in left}, {r[0]: r[3] for r in left}
    copies, mixed = Counter(r.doc_id for r in found), Counter()
    for r in found:
        ids = own.encode_ordinary(text[r.doc_id])  # no other documents are left
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
        mixed[source[r.doc_id]] += len(split(text[r.doc_id]))
    sizes = Counter()
    for d, t in text.items():
        sizes[source[d]] += len(split(t))
    want = fill(sizes)
    assert all(abs(mixed[s] - want[s]) <= 121 for s in sizes) and max(copies.values()) <= 2


def test_stages_keep_columns_and_take_any_table(spark, folder):
    docs = common.table(spark, folder, "documents").selectExpr("*", "1 AS size", "'x' AS key", "0 AS b", "'y' AS p", "2 AS n")
    for part in (docs, docs.limit(0), docs.withColumn("text", docs.text.substr(1, 0)), docs.selectExpr(*(f"CAST(NULL AS {t}) AS {c}" for c, t in docs.dtypes))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, part, folder)
            assert out.columns == docs.columns, name
            out.count()
    assert {r.lang for r in corpus_pipeline.language_id(spark, docs, folder).collect()} == {"en", "de"}
