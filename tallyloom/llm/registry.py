"""Queries of this package and their DuckDB SQL where SQL can express them."""

from tallyloom.llm.decontaminate import OP8_SQL, op8_decontamination
from tallyloom.llm.exactdedup import OP9_SQL, op9_exact_dedup
from tallyloom.llm.filteraudit import OP12_SQL, op12_filter_audit
from tallyloom.llm.htmltext import op13_html_text
from tallyloom.llm.jaccard import OP6_SQL, op6_ngram_jaccard
from tallyloom.llm.linededup import OP5_SQL, op5_line_dedup
from tallyloom.llm.piececode import op1_sentencepiece
from tallyloom.llm.quality import op4_quality
from tallyloom.llm.secrets import op2_secret_scan
from tallyloom.llm.suffixdedup import op10_suffix_dedup
from tallyloom.llm.toxicity import op7_toxicity
from tallyloom.llm.warc import OP3_SQL, op3_warc_revisits
from tallyloom.llm.whitening import op11_whitening

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_html_text": op13_html_text,
}

ORACLE_SQL = {
    "op3_warc_revisits": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
}
