"""Training-data operators: thirteen corpus-scale steps, each one a module of its own.

Nothing outside this subpackage imports it.  Registered queries are in
``accordant.llm.registry``.
"""
