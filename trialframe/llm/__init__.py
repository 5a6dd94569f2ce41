"""Operators for preparing training text at scale.

Nothing outside this folder (but for ``corpus_pipeline.py``) imports it.  Every
operator takes the columns it needs by name, ignores all others, and treats a
null text as an empty one unless its docstring says otherwise.
"""
