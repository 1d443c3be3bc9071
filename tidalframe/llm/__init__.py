"""Operators for large training-corpus pipelines.

Nothing outside this folder imports it; its queries and oracle SQL are in
``tidalframe.llm.queries``.
"""
