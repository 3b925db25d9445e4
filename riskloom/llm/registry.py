"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import langid, licenses, media, minhash, mixing, packing, spelling, suffix_dedup, tokenfiles, topk, urlfilter, warc, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_warc": warc.op2_warc,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_minhash": minhash.op5_minhash,
    "op6_topk": topk.op6_topk,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_media": media.op8_media,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_token_files": tokenfiles.op13_token_files,
}
ORACLE_SQL = {
    "op5_minhash": minhash.OP5_SQL,
    "op6_topk": topk.OP6_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
}
