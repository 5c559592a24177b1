"""The registered queries of the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, html, langid, licenses, merkle, minhash, mixing, periodic, quality, secrets, substrings
from .common import bounded, table


def op1_secrets(spark, sf_dir):
    return secrets.digest(table(bounded(spark), sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.digest(table(bounded(spark), sf_dir, "documents"))


def op3_langid(spark, sf_dir):
    return langid.identify(table(bounded(spark), sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    return licenses.digest(table(bounded(spark), sf_dir, "documents"))


def op5_substrings(spark, sf_dir):
    return substrings.remove(table(bounded(spark), sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(bounded(spark), sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.digest(table(bounded(spark), sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(bounded(spark), sf_dir, "documents"))


def op9_html(spark, sf_dir):
    return html.extract(table(bounded(spark), sf_dir, "pages"))


def op10_minhash(spark, sf_dir):
    return minhash.digest(table(bounded(spark), sf_dir, "documents"))


def op11_ann(spark, sf_dir):
    return ann.digest(table(bounded(spark), sf_dir, "embeddings"))


def op12_periodic(spark, sf_dir):
    return periodic.digest(table(bounded(spark), sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_secrets, op2_quality, op3_langid, op4_licenses, op5_substrings, op6_mixing, op7_bpe, op8_exact_dedup, op9_html, op10_minhash, op11_ann, op12_periodic, op13_merkle)}


def oracle_sql():
    return {"op8_exact_dedup": exact_dedup.SQL, "op11_ann": ann.SQL, "op13_merkle": merkle.SQL}
