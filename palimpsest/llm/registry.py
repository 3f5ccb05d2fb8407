"""Queries of the training-data operators and their SQL, as ``__spark_entry__`` registers them."""

from .chat import op6_chat
from .decontam import OP1_SQL, op1_decontaminate, op1_proximity
from .langid import op8_langid
from .licenses import op4_licenses
from .linededup import op7_linededup
from .minhash import OP5_SQL, op5_minhash
from .packing import op3_packing
from .pii import op9_pii
from .quality import op10_quality
from .simhash import op2_simhash

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op1_proximity": op1_proximity,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_minhash": op5_minhash,
    "op6_chat": op6_chat,
    "op7_linededup": op7_linededup,
    "op8_langid": op8_langid,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op5_minhash": OP5_SQL,
}
