"""Operators for large-scale training-data pipelines: thirteen of them, one module each, and their registered queries.

Nothing outside this package imports it.  All operators share these rules:

* a row is known by ``row_key``: 128 bits over its doc_id and whole text, so null and repeated ids need no special case;
* a null text counts as empty; needed columns are ``doc_id`` and ``text`` (and ``source`` or ``lang`` where named);
* extra columns are ignored, and where rows pass through, an extra column with the name of a result column is replaced.
"""
