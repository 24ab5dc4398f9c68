"""The registered queries of this subpackage."""

from __future__ import annotations

from .bpe import op9
from .common import table
from .decontam import OP1_SQL, op1
from .hardneg import OP11_SQL, op11
from .jaccard import op8
from .langid import op6
from .lm import op4
from .merkle import op13
from .quality import OP3_SQL, op3
from .secrets import op7
from .simhash import op12
from .substring import op5
from .urlfilter import OP2_SQL, op2
from .warc import OP10_SQL, op10


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_decontamination": lambda spark, sf: op1(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op2_url_filter": lambda spark, sf: op2(table(spark, sf, "pages")),
    "op3_quality_rules": lambda spark, sf: op3(table(spark, sf, "documents")),
    "op4_lm_score": lambda spark, sf: op4(table(spark, sf, "documents")),
    "op5_suffix_dedup": lambda spark, sf: op5(table(spark, sf, "documents")),
    "op6_language_id": lambda spark, sf: op6(table(spark, sf, "documents")),
    "op7_secret_scan": lambda spark, sf: op7(table(spark, sf, "documents")),
    "op8_jaccard_join": lambda spark, sf: op8(table(spark, sf, "documents")),
    "op9_bpe_codec": lambda spark, sf: op9(table(spark, sf, "documents"), vocabulary()),
    "op10_warc": lambda spark, sf: op10(table(spark, sf, "pages")),
    "op11_hard_negatives": lambda spark, sf: op11(table(spark, sf, "embeddings")),
    "op12_simhash": lambda spark, sf: op12(table(spark, sf, "documents")),
    "op13_merkle_manifest": lambda spark, sf: op13(table(spark, sf, "documents")),
}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_quality_rules": OP3_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL}
