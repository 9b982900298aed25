"""Training-data operators over text tables: filters, deduplication, scans, packing.

Nothing outside this folder imports it. ``queries.py`` lists the registered queries and their
SQL; each operator has a module of its own with a general interface.
"""
