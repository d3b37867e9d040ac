"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import fingerprint, language, mixing, pieces, quality, rules, simhash, substrings, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        pieces.op1_max_plus_pieces,
        mixing.op2_curriculum,
        language.op3_cross_parsing,
        simhash.op4_simhash,
        quality.op5_attention_quality,
        fingerprint.op6_bottom_k,
        warc.op7_warc_revisits,
        urls.op8_url_vocabulary,
        substrings.op9_difference_cover,
        rules.op10_suffix_repetition,
    )
}
SQL = {"op7_warc_revisits": warc.SQL, "op8_url_vocabulary": urls.SQL}
