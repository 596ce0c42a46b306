"""Lead-data engine on PySpark: page corpora and multi-source company files in,
clean, deduplicated, quality-scored company tables out.

Every public function maps columns to columns or DataFrames to DataFrames.
"""
