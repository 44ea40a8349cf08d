"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries.py`` registers the fixed queries on top.

Conventions shared by all operators
-----------------------------------
* An operator selects the columns it needs first, so extra columns of any name
  (clashing ones included) never reach it; results carry the documented columns.
* A null text counts as the empty text.  A null identifier is carried through
  and sorts after every other identifier.
* Rows that repeat an identifier are separate rows and yield one result each.
* An empty table yields an empty result with the same schema.
"""
