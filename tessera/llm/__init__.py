"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator reads whole
tables, keeps what it gathers either distributed or of a fixed size, and
cuts lineage only through Parquet tables in the shared checkpoint folder.
"""
