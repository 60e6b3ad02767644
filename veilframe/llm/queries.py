"""The corpus operators' queries and their SQL, keyed as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .chat_format import OP6_SQL, op6_chat_format
from .decontaminate import OP5_SQL, op5_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op2_html_text
from .mixing import OP11_SQL, op11_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op10_quality
from .sharding import op7_sharding
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .topk import OP3_SQL, op3_topk
from .warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_html_text": op2_html_text,
        "op3_topk": op3_topk,
        "op4_warc": op4_warc,
        "op5_decontaminate": op5_decontaminate,
        "op6_chat_format": op6_chat_format,
        "op7_sharding": op7_sharding,
        "op8_bpe": op8_bpe,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality": op10_quality,
        "op11_mixing": op11_mixing,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL,
        "op3_topk": OP3_SQL,
        "op4_warc": OP4_SQL,
        "op5_decontaminate": OP5_SQL,
        "op6_chat_format": OP6_SQL,
        "op9_suffix_dedup": OP9_SQL,
        "op11_mixing": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
