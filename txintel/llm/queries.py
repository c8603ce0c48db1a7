"""Registry of this subpackage's queries; their SQL where DuckDB can express them."""

from __future__ import annotations

from txintel.llm.ann import op8_ann
from txintel.llm.bpe import op4_bpe
from txintel.llm.langid import op6_langid
from txintel.llm.licenses import op9_licenses
from txintel.llm.lm import op3_lm
from txintel.llm.minhash import OP11_SQL, op11_minhash
from txintel.llm.mixing import OP5_SQL, op5_mixing
from txintel.llm.quality import op10_quality
from txintel.llm.resampling import OP13_SQL, op13_resampling
from txintel.llm.sharding import op2_sharding
from txintel.llm.simhash import op7_simhash
from txintel.llm.topk import OP1_SQL, op1_topk
from txintel.llm.whitening import op12_whitening

QUERIES = {
    "op1_topk": op1_topk,
    "op2_sharding": op2_sharding,
    "op3_lm": op3_lm,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_ann": op8_ann,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op11_minhash": OP11_SQL,
    "op13_resampling": OP13_SQL,
}
