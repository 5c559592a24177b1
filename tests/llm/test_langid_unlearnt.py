"""The language stage without a labelled row."""

from plenum.llm import langid


def test_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (2, "123 !", None), (3, None, None), (4, "", None), (None, "schön", None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["schön", "some words here"]
