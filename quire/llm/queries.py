"""Registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from quire.llm.chat import OP7_SQL, op7_chat
from quire.llm.cotrain import op3_cotrain
from quire.llm.decontaminate import OP5_SQL, op5_decontaminate
from quire.llm.html_extract import op4_html_extract
from quire.llm.line_dedup import OP10_SQL, op10_line_dedup
from quire.llm.ngram_join import op2_ngram_join
from quire.llm.pieces import op8_pieces
from quire.llm.quality_rules import op6_quality_rules
from quire.llm.spelling import OP12_SQL, op12_spelling
from quire.llm.suffix_dedup import op1_suffix_dedup
from quire.llm.token_files import op11_token_files
from quire.llm.warc import OP9_SQL, op9_warc
from quire.llm.whitening import op13_whitening


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_cotrain": op3_cotrain,
        "op4_html_extract": op4_html_extract,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality_rules": op6_quality_rules,
        "op7_chat": op7_chat,
        "op8_pieces": op8_pieces,
        "op9_warc": op9_warc,
        "op10_line_dedup": op10_line_dedup,
        "op11_token_files": op11_token_files,
        "op12_spelling": op12_spelling,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op7_chat": OP7_SQL, "op9_warc": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_spelling": OP12_SQL}
