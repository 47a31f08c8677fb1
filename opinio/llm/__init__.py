"""Operators of a training-data pipeline (language ID, near-dedup, top-k search,
URL filters, token counts, byte-level BPE, WARC, decontamination, PII, quality,
periodic runs, whitening, SentencePiece).

One module per operator; ``queries.py`` registers them as ``opN_<name>``.
Nothing else in the library imports this subpackage."""
