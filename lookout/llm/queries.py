"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lookout.llm import (audit, bpe, decontaminate, licenses, linededup, mixing, neardup, periodic, pii, quality,
                         sharding, substrings, toxicity)
from lookout.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@register
def op1_license_scan(spark, sf_dir):
    """Operator 1 over all documents."""
    return licenses.scan_licenses(documents(spark, sf_dir))


@register
def op2_line_chunks(spark, sf_dir):
    """Operator 2 over all documents."""
    return linededup.digest(documents(spark, sf_dir))


@register
def op3_order_minhash(spark, sf_dir):
    """Operator 3 over all documents."""
    return neardup.classes(documents(spark, sf_dir))


@register
def op4_repeated_substrings(spark, sf_dir):
    """Operator 4 over all documents."""
    return substrings.digest(documents(spark, sf_dir))


@register
def op5_repetition_rules(spark, sf_dir):
    """Operator 5 over all documents: the contract's columns, then the shares."""
    return quality.measured(documents(spark, sf_dir))


@register
def op6_toxicity(spark, sf_dir):
    """Operator 6: trained on ``labels``, over all documents."""
    return toxicity.toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@register
def op7_mix_sources(spark, sf_dir):
    """Operator 7 over all documents."""
    return mixing.mixed(documents(spark, sf_dir))


@register
def op8_personal_data(spark, sf_dir):
    """Operator 8 over all documents."""
    return pii.personal_data(documents(spark, sf_dir))


@register
def op9_byte_shards(spark, sf_dir):
    """Operator 9 over all documents."""
    return sharding.sharded(documents(spark, sf_dir))


@register
def op10_benchmark_leaks(spark, sf_dir):
    """Operator 10 over all documents and all test items."""
    return decontaminate.contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register
def op11_periodic_runs(spark, sf_dir):
    """Operator 11 over all documents, with the contract's runs planted."""
    return periodic.digest(documents(spark, sf_dir))


@register
def op12_filter_audit(spark, sf_dir):
    """Operator 12 over all documents and labels."""
    return audit.audited(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@register
def op13_byte_bpe(spark, sf_dir):
    """Operator 13 over all documents, with the public 50k byte-level vocabulary."""
    import public_tokenizers  # only this query needs its files

    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN)


ORACLES["op7_mix_sources"] = mixing.ORACLE
ORACLES["op9_byte_shards"] = sharding.ORACLE
ORACLES["op12_filter_audit"] = audit.ORACLE
