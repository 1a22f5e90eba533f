"""Training-data operators for document, page, label and conversation tables.

Every operator takes DataFrames with any columns (name the id and text
columns by argument) and returns a DataFrame; ``queries.py`` holds the thin
``opN_<name>`` queries over the driver's tables. Nothing outside this
subpackage imports it.
"""
