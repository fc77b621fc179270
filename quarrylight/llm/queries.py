"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.alignment import op13_alignment
from quarrylight.llm.ann import op8_ann
from quarrylight.llm.fingerprint import op12_fingerprint
from quarrylight.llm.html_extract import op4_html
from quarrylight.llm.jaccard import OP5_SQL, op5_ngram_jaccard
from quarrylight.llm.langid import op9_langid
from quarrylight.llm.line_dedup import OP1_SQL, op1_line_dedup
from quarrylight.llm.mixing import op3_mixing
from quarrylight.llm.pii import op10_pii
from quarrylight.llm.quality import op7_quality
from quarrylight.llm.runs import op11_runs
from quarrylight.llm.sp_codec import op2_sentencepiece
from quarrylight.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_ann": op8_ann,
    "op9_langid": op9_langid,
    "op10_pii": op10_pii,
    "op11_runs": op11_runs,
    "op12_fingerprint": op12_fingerprint,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op6_warc": OP6_SQL,
}
