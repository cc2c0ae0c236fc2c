"""The registered corpus queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from tessitura.llm.bagminhash import op9_bagminhash
from tessitura.llm.chains import op7_toxicity
from tessitura.llm.matroska import op6_matroska
from tessitura.llm.mih import op10_mih
from tessitura.llm.mixing import OP2_SQL, op2_mixing
from tessitura.llm.pii import op1_pii
from tessitura.llm.secrets import op5_secrets
from tessitura.llm.segment import op8_segment
from tessitura.llm.token_files import op3_token_files
from tessitura.llm.warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_token_files, op4_warc, op5_secrets, op6_matroska, op7_toxicity, op8_segment, op9_bagminhash, op10_mih)}
ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_warc": OP4_SQL}
