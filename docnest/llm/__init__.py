"""Operators for preparing text for language-model training.

Each module holds one operator with its general interface; ``queries`` applies them to the sample tables.
Operators read only the columns they name, so further columns of any name are ignored unless said otherwise.
"""
