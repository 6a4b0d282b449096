"""The registered query of each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from trackspark.registry import Registry

from . import common, decontamination, dialogue, html, language, lm, media, mixing, ngramjoin, sharding, spelling, suffix, toxicity, warc

REGISTRY = Registry()


@REGISTRY.add("op1_suffix_dedup")
def op1(spark, sf_dir):
    return suffix.report(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@REGISTRY.add("op3_language")
def op3(spark, sf_dir):
    return language.report(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op4_decontaminate", decontamination.sql())
def op4(spark, sf_dir):
    return decontamination.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@REGISTRY.add("op5_mix_sources", mixing.sql())
def op5(spark, sf_dir):
    return mixing.mix(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op6_language_model")
def op6(spark, sf_dir):
    return lm.report(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op7_shard", sharding.sql())
def op7(spark, sf_dir):
    return sharding.shard(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op8_html")
def op8(spark, sf_dir):
    return html.report(common.table(spark, sf_dir, "pages"))


@REGISTRY.add("op9_media")
def op9(spark, sf_dir):
    return media.report(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op10_ngram_jaccard_join", ngramjoin.SQL)
def op10(spark, sf_dir):
    return ngramjoin.join(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op11_spelling", spelling.SQL)
def op11(spark, sf_dir):
    return spelling.report(common.table(spark, sf_dir, "documents"))


@REGISTRY.add("op12_warc", warc.SQL)
def op12(spark, sf_dir):
    return warc.report(common.table(spark, sf_dir, "pages"))


@REGISTRY.add("op13_dialogue")
def op13(spark, sf_dir):
    return dialogue.report(common.table(spark, sf_dir, "conversations"))
