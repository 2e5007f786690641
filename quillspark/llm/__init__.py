"""Operations of a training-data pipeline: packing, mixing, chat formatting, near and exact
deduplication, language, quality, licence, URL and media operators.

Nothing outside this package imports it.
"""
