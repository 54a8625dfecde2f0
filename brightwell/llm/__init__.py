"""Operators of a training-data pipeline: output formats, filters, deduplication, decontamination and encoding.

Every operator takes DataFrames and returns DataFrames. Input frames may hold further columns; only the named ones are
read. Nulls in text columns count as empty text unless the operator says otherwise.
"""
