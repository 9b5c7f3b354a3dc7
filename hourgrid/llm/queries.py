"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourgrid.llm.chat import OP4_SQL, op4_chat_format
from hourgrid.llm.decontaminate import OP2_SQL, op2_decontaminate
from hourgrid.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from hourgrid.llm.licenses import op7_license_scan
from hourgrid.llm.packing import op9_packing
from hourgrid.llm.passage_dedup import op5_passage_dedup
from hourgrid.llm.quality_classifier import op1_quality_classifier
from hourgrid.llm.quality_rules import op6_quality_rules
from hourgrid.llm.repair import op12_conversation_repair
from hourgrid.llm.simhash import op3_simhash
from hourgrid.llm.suffix_dedup import op8_suffix_dedup
from hourgrid.llm.topk import OP13_SQL, op13_exact_top_k
from hourgrid.llm.warc import OP10_SQL, op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_classifier": op1_quality_classifier, "op2_decontaminate": op2_decontaminate, "op3_simhash": op3_simhash, "op4_chat_format": op4_chat_format, "op5_passage_dedup": op5_passage_dedup, "op6_quality_rules": op6_quality_rules, "op7_license_scan": op7_license_scan, "op8_suffix_dedup": op8_suffix_dedup, "op9_packing": op9_packing, "op10_warc": op10_warc, "op11_fill_in_middle": op11_fill_in_middle, "op12_conversation_repair": op12_conversation_repair, "op13_exact_top_k": op13_exact_top_k}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_chat_format": OP4_SQL, "op10_warc": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_exact_top_k": OP13_SQL}
