"""Training-data operators at corpus scale.

Each module holds one operator with a general interface; :mod:`.queries` holds
the thin registered queries and their SQL.  Nothing outside this package
imports it.
"""
