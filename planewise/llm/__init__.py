"""Text, vector and web-page operators for building training corpora on Spark.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` live in ``planewise.llm.registry``.
"""
