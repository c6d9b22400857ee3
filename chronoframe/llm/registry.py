"""Name → query and name → DuckDB SQL of this subpackage."""

from chronoframe.llm.align import op11_token_alignment
from chronoframe.llm.chat_format import OP9_SQL, op9_chat_formatting
from chronoframe.llm.decontaminate import op1_decontamination
from chronoframe.llm.html_extract import op10_html_extraction
from chronoframe.llm.language_id import op2_language_id
from chronoframe.llm.license_scan import op5_license_scan
from chronoframe.llm.media_avi import op3_media_avi
from chronoframe.llm.mixing import OP4_SQL, op4_mixing_sources
from chronoframe.llm.negatives import OP12_SQL, op12_hard_negatives
from chronoframe.llm.ngram_join import op8_ngram_join
from chronoframe.llm.quality import op13_quality_rules
from chronoframe.llm.toxicity import op6_toxicity
from chronoframe.llm.warc_revisit import OP7_SQL, op7_warc_revisit

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_language_id,
        op3_media_avi,
        op4_mixing_sources,
        op5_license_scan,
        op6_toxicity,
        op7_warc_revisit,
        op8_ngram_join,
        op9_chat_formatting,
        op10_html_extraction,
        op11_token_alignment,
        op12_hard_negatives,
        op13_quality_rules,
    )
}
ORACLES = {"op4_mixing_sources": OP4_SQL, "op7_warc_revisit": OP7_SQL, "op9_chat_formatting": OP9_SQL, "op12_hard_negatives": OP12_SQL}
