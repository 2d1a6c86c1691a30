"""Training-data operators: ten document operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
