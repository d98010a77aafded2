"""Training-data operators: thirteen numbered operators, each in a module of its own.

Nothing outside this subpackage (but corpus_pipeline.py, which counts as part
of it) imports it.
"""
