"""Queries of this subpackage and their SQL."""

from . import bagminhash, chat, gru, imatch, language, latent, licenses, pieces, secrets, suffix

QUERIES = {f.__name__: f for f in (suffix.op1_suffix_dedup, secrets.op2_secret_scan, imatch.op3_imatch, chat.op4_chat_format, language.op5_language_id, bagminhash.op6_bagminhash, latent.op7_latent_decontamination, gru.op8_gru_score, pieces.op9_sentencepiece, licenses.op10_license_scan)}
SQL = {"op2_secret_scan": secrets.ORACLE_SQL, "op4_chat_format": chat.ORACLE_SQL, "op10_license_scan": licenses.ORACLE_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
