"""Registered queries of this subpackage: ``opN_<name>`` over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, exact_dedup, line_dedup, mixing, ngram_join, quality, repair, spelling, suffix_dedup, syncmers, toxicity
from .frames import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), bpe.Tokenizer.from_file(tokenizer_path()))


@query("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_groups(documents(spark, sf_dir))


@query("op2_syncmers")
def op2_syncmers(spark, sf_dir):
    """Each text against its own edit: its last third is replaced by the beginning of the next document (descending ids)."""
    return syncmers.edited_likeness(documents(spark, sf_dir))


@query("op3_suffixes")
def op3_suffixes(spark, sf_dir):
    return suffix_dedup.digest(documents(spark, sf_dir))


@query("op4_mixing", mixing.ORACLE)
def op4_mixing(spark, sf_dir):
    return mixing.poisson_mix(documents(spark, sf_dir))


@query("op5_lines")
def op5_lines(spark, sf_dir):
    return line_dedup.digest(documents(spark, sf_dir))


@query("op6_chat", chat.ORACLE)
def op6_chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.prefix_target_examples(c.unionByName(chat.control_conversation(spark))))


EXACT_SQL = r"""
with a as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*)::bigint as group_size from a group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from a join g using (t)
"""


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op9_exact", EXACT_SQL)
def op9_exact(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query("op12_decontaminate", decontaminate.ORACLE)
def op12_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


@query("op11_spelling")
def op11_spelling(spark, sf_dir):
    """Words of at least five letters that occur three times or more, after the contract's damage."""
    return spelling.spelling_groups(spelling.word_counts(documents(spark, sf_dir), shortest=5, damage=97).where("n >= 3"))


@query("op13_repair", repair.ORACLE)
def op13_repair(spark, sf_dir):
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))
