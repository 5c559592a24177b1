"""Near copies whose doc_id is null."""

from plenum.llm import minhash

TEXT = " ".join(f"word{i}" for i in range(90))
OTHER = " ".join(f"other{i}" for i in range(90))


def test_null_ids(spark):
    rows = [(None, TEXT), (None, TEXT + " more"), (None, OTHER), (7, OTHER + " more"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.n_shingles, r.component_id or 0, r.kept) for r in minhash.digest(docs).collect())
    assert [x for x in found if not x[0]] == [(0, 0, True)] * 2
    assert [x for x in found if x[1] == 7] == [(86, 7, False), (87, 7, True)]
    rest = [x for x in found if x[0] and not x[1]]
    assert [x[0] for x in rest] == [86, 87] and sum(x[2] for x in rest) == 1
    kept = [r.text for r in minhash.keep_one(docs).collect()]
    assert len(kept) == 4 and OTHER + " more" in kept and OTHER not in kept and (TEXT in kept) != (TEXT + " more" in kept)
