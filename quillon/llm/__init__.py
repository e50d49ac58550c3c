"""Training-data operators: text scoring, deduplication, filtering, mixing and output.

Nothing outside this folder imports it.  Each operator lives in a module of its own and takes and
returns DataFrames; ``queries`` registers one query per operator and ``oracle`` holds their SQL.
"""
