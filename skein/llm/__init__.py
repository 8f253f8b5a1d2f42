"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; ``skein.llm.queries``
holds the registered queries and their SQL.
"""
