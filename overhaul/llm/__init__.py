"""Operators of a training-data pipeline: dedup, tokens, extraction, search,
quality, chat, URL and license filters, packing.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` registers one query per operator.
"""
