"""Operators for preparing training data: classify, mix, join, sketch, scan, pack, store, dedup.

Nothing outside this subpackage imports it. Operators take and return DataFrames; ``queries``
holds the registered queries and ``oracle`` their SQL.
"""
