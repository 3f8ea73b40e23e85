"""Operators for large-scale training-data pipelines (self-contained subpackage).

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.
"""
