"""The corpus queries: one for each operator, and the pipeline where its module is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from restora.llm.ann import op5_ann
from restora.llm.bpe import op8_bpe
from restora.llm.decontaminate import op2_decontaminate
from restora.llm.langid import op9_langid
from restora.llm.lm import op7_lm
from restora.llm.minhash import op6_minhash
from restora.llm.oracles import ORACLES as ORACLES
from restora.llm.negatives import op13_hard_negatives
from restora.llm.quality import op4_quality
from restora.llm.repeats import op1_repeats
from restora.llm.secrets import op3_secrets
from restora.llm.token_files import op10_token_files
from restora.llm.topk import op12_topk
from restora.llm.variants import op11_spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op6_minhash": op6_minhash,
    "op7_lm": op7_lm,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_topk": op12_topk,
    "op13_hard_negatives": op13_hard_negatives,
}
